"""Column and file names of the input data model.

Fixed values: these names must equal the ones in the published data files
and in the reference's outputs, so they are stated here as text.
"""

# Pair table (one row per predicted pair / run).
NAME = "name"
ID1 = "af3_id1"
ID2 = "af3_id2"
BEST = "chain_pair_iptm_best"
MEAN = "chain_pair_iptm_mean"
BEST_CORRECTED = "chain_pair_iptm_best_corrected"
MEAN_CORRECTED = "chain_pair_iptm_mean_corrected"
SOURCE_GENE = "michaelis2023:Source Gene names (SGD/UniProt-primary or ordered locus)"
TARGET_GENE = "michaelis2023:Target Gene names  (SGD/UniProt-primary or ordered locus)"

# Confidence table (one row per run).
PTM = "ptm"
IPTM = "iptm"

# Evidence tables (links, aliases, info).
PROTEIN1 = "protein1"
PROTEIN2 = "protein2"
COMBINED_SCORE = "combined_score"
STRING_ID = "string_id"
STRING_ID_HEADERS = ("string_protein_id", "#string_protein_id")
ALIAS = "alias"
SOURCE = "source"
PREFERRED_NAME = "preferred_name"
ANNOTATION = "annotation"

# Derived columns.
PROTEIN_ID = "protein_id"
UNIPROT_ID = "uniprot_id"
GENE_NAME = "gene_name"
STRING_ID1 = "string_id1"
STRING_ID2 = "string_id2"
PAIR_KEY1 = "pair_key1"
PAIR_KEY2 = "pair_key2"
INTERACTION_COUNT = "confident_interaction_count"
PROTEIN_AVG = "protein_avg_iptm"
DIFF_FROM_AVG = "iptm_diff_from_avg"
STD_UNITS = "standard_deviation"
WEIGHT = "weight"
DIRECTION = "direction"

# Evidence file naming and separators.
DEFAULT_ORGANISM = 4932
DEFAULT_VERSION = "v12.0"
LINKS_DATA_ID = "protein.physical.links.detailed"
ALIASES_DATA_ID = "protein.aliases"
INFO_DATA_ID = "protein.info"
TAB_SEPARATED = ("protein.aliases", "protein.info")

# Thresholds used by the analyses.
CONFIDENT_IPTM = 0.6
SIGNIFICANT_LINK_SCORE = 400
EDGE_CUTOFF = 0.061
CASCADE_QUANTILE = 0.75
CASCADE_ROUNDS = 3
ALIAS_SOURCE_PATTERN = "UniProt"
UNDIRECTED = "U"
