"""Scale run at the reference's published volume (7.6 M pairs).

The sf0.1 adapter tables are replicated K times by Spark (``explode(sequence)``
with every id and run name shifted by the copy number, so copies never
collide), written once in the source layout (pair/confidence Parquet,
evidence text) under a scratch folder, and the end-to-end jobs are timed on
it. Counts must come out exactly K times the sf0.1 counts.

usage: python tools/scale_run.py [copies] [scratch_dir]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from pairnet.functions import names as N  # noqa: E402
from pairnet.plans import jobs as J  # noqa: E402
from pairnet.plans.inputs import ORGANISM, Inputs  # noqa: E402
from pairnet.session import local_session  # noqa: E402
from pairnet.sources.readers import evidence_file_name  # noqa: E402
from pairnet.sources.sinks import write_delimited, write_parquet  # noqa: E402


def shifted(df, cols, copies, files=32):
    """Every row once per copy; text ids of copy k > 0 get the prefix ``k<k>_``
    (a common prefix keeps the order of ids within a copy). Spread over
    ``files`` output files, as source data would be."""
    out = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    for c in cols:
        pre = F.concat(F.lit("k"), F.col("_copy").cast("string"), F.lit("_"))
        if c == N.ALIAS:  # keep the padding; only the stripped text matters
            val = F.concat(F.lit(" "), pre, F.trim(F.col(c)), F.lit(" "))
        else:
            val = F.concat(pre, F.col(c))
        out = out.withColumn(c, F.when(F.col("_copy") == 0, F.col(c)).otherwise(val))
    return out.drop("_copy").repartition(files)


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 13
    scratch = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="pairnet-scale-", dir="/tmp")
    spark = local_session(cores=os.environ.get("BENCH_CPUS", "8"), shuffle_partitions=16)
    i = Inputs(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))
    data, ev = f"{scratch}/data", f"{scratch}/evidence"
    t = time.perf_counter()
    write_parquet(shifted(i.pairs_raw(), [N.NAME, N.ID1, N.ID2], copies), f"{data}/summary_pairs.parquet")
    write_parquet(shifted(i.conf(), [N.NAME], copies), f"{data}/summary_confidences.parquet")
    write_delimited(shifted(i.links(), [N.PROTEIN1, N.PROTEIN2], copies),
                    f"{ev}/{evidence_file_name(N.LINKS_DATA_ID, ORGANISM)}", sep=" ")
    al = shifted(i.aliases(), [N.STRING_ID, N.ALIAS], copies)
    write_delimited(al.withColumnRenamed(N.STRING_ID, "#string_protein_id"),
                    f"{ev}/{evidence_file_name(N.ALIASES_DATA_ID, ORGANISM)}", sep="\t", quote="")
    write_delimited(shifted(i.info(), [N.STRING_ID], copies).withColumnRenamed(N.STRING_ID, "string_protein_id"),
                    f"{ev}/{evidence_file_name(N.INFO_DATA_ID, ORGANISM)}", sep="\t", quote="")
    staged = time.perf_counter() - t

    times, counts = {}, {}

    def timed(name, fn):
        t0 = time.perf_counter()
        counts[name] = fn()
        times[name] = round(time.perf_counter() - t0, 2)

    timed("pairs", lambda: spark.read.parquet(f"{data}/summary_pairs.parquet").count())
    timed("run_pipeline", lambda: J.run_pipeline(spark, data).bias.count())
    timed("load_and_map_data", lambda: J.load_and_map_data(spark, data, ev, organism=ORGANISM).count())
    timed("size_corrected_edges", lambda: J.size_corrected_edges(spark, data).count())
    timed("edges_cascade", lambda: J.size_corrected_edges(spark, data, cutoff=None).count())
    print(json.dumps({"copies": copies, "staging_sec": round(staged, 2), "sec": times, "rows": counts,
                      "spark": spark.version, "scratch": scratch}))


if __name__ == "__main__":
    main()
