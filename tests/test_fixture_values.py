"""Expected values of FIXTURES.md section C (sf0.001), computed through the
library operators."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pairnet.functions import names as N
from pairnet.operators import curves as C
from pairnet.operators import export as E
from pairnet.operators import ids as I
from pairnet.operators import pairs as P
from pairnet.operators import profile as PR
from pairnet.operators import stats as S
from pairnet.plans.inputs import Inputs


@pytest.fixture(scope="module")
def inp(spark):
    return Inputs(spark, SF_SMALL)


@pytest.fixture(scope="module")
def cmp(inp):
    prot = P.distinct_proteins(inp.pairs())
    return S.checkpoint(P.compare_scores(inp.pairs(), inp.links(), I.id_map(prot, inp.aliases(), inp.info())))


def test_adapter_row_counts(inp):
    assert inp.pairs_raw().count() == 6000
    assert inp.conf().count() == 1500
    assert inp.links().count() == 6000
    assert inp.aliases().count() == 218
    assert inp.info().count() == 200
    assert inp.pairs().count() == 5681


def test_id_mapping_counts(inp):
    prot = P.distinct_proteins(inp.pairs())
    genes = I.gene_name_map(inp.pairs())
    assert prot.count() == 200
    assert genes.count() == 152
    assert I.ids_needing_lookup(prot, genes).count() == 48
    assert I.id_map(prot, inp.aliases(), inp.info()).count() == 162
    assert I.annotated_ids(prot, inp.aliases(), inp.info(), normalize=False).count() == 93
    assert I.matched_missing(prot, genes, inp.aliases(), inp.info()).count() == 45
    assert I.matched_missing(prot, genes, inp.aliases(), inp.info(), normalize=False).count() == 27
    dup = I.duplicate_ids(I.id_alias_join(prot, inp.aliases()).distinct())
    assert dup.agg(F.sum("surplus")).first()[0] == 16


def test_confident_network(inp):
    j = P.filter_confident(P.join_confidences(inp.pairs(), inp.conf()))
    assert j.count() == 1614
    cp = P.confident_pairs(inp.pairs(), inp.conf())
    assert cp.count() == 1121
    assert P.network_protein_count(cp).first()[0] == 200
    ms = S.protein_mean_std(S.protein_stats(cp)).first()
    assert ms[0] == pytest.approx(0.822317, abs=1e-6)
    assert ms[1] == pytest.approx(0.050071, abs=1e-6)
    z = S.bias_table(S.protein_stats(cp)).agg(F.max(N.STD_UNITS)).first()[0]
    assert z == pytest.approx(3.016064, abs=1e-6)


def test_comparison(inp, cmp):
    assert P.comparison_pairs(inp.pairs()).count() == 5392
    assert P.link_scores(inp.links()).count() == 2990
    assert cmp.count() == 3530
    assert cmp.where(F.col(N.COMBINED_SCORE).isNotNull()).count() == 2344
    assert P.network_table(cmp, N.BEST).count() == 710
    assert P.network_table(cmp, N.MEAN).count() == 649
    assert P.network_table(cmp, N.BEST, min_link_score=None).count() == 1507
    assert P.network_table(cmp, N.MEAN, min_link_score=None).count() == 1374


def test_score_shaping(inp):
    pairs = inp.pairs()
    assert S.filter_cutoff(pairs, N.MEAN_CORRECTED, 0.0).count() == 3334
    z = S.zscore(pairs, N.MEAN_CORRECTED).agg(F.max("z_score")).first()[0]
    assert z == pytest.approx(1.871998, abs=1e-6)
    _, summary = S.quartile_cascade(pairs)
    rows = [(r["round"], r["cutoff"], r["kept"]) for r in summary.orderBy("round").collect()]
    assert [r[2] for r in rows] == [1421, 364, 97]
    assert [round(r[1], 4) for r in rows] == [0.32, 0.5016, 0.5506]
    we = E.weighted_edges(pairs).agg(F.count("*"), F.sum(N.WEIGHT), F.min(N.WEIGHT), F.max(N.WEIGHT)).first()
    assert we[0] == 2962
    assert we[1] == pytest.approx(1541.4987, abs=1e-3)
    assert we[2] == pytest.approx(0.108333, abs=1e-6)
    assert we[3] == 1.0


def test_profiles(inp, cmp):
    pairs = inp.pairs()
    ic = P.interaction_counts(pairs).agg(F.count("*"), F.max("interaction_count"),
                                         F.min("interaction_count")).first()
    assert tuple(ic) == (200, 634, 14)
    h = PR.histogram(pairs.select(N.ID1, N.ID2, N.MEAN_CORRECTED).distinct(), N.MEAN_CORRECTED, 30)
    agg = h.agg(F.count("*"), F.sum("count"), F.max("count")).first()
    assert tuple(agg) == (30, 5664, 257)
    h2 = PR.histogram(P.dedupe_runs(pairs), N.BEST, 30).agg(F.count("*"), F.sum("count"), F.max("count")).first()
    assert tuple(h2) == (30, 1893, 228)
    bias = S.bias_table(S.protein_stats(P.confident_pairs(pairs, inp.conf())))
    box = PR.box_stats(bias, N.INTERACTION_COUNT, N.PROTEIN_AVG).agg(F.count("*"), F.sum("median")).first()
    assert box[0] == 19
    assert box[1] == pytest.approx(15.5964, abs=1e-4)
    reg = PR.regression(P.network_table(cmp, N.BEST), N.COMBINED_SCORE, N.BEST).first()
    assert reg["n"] == 710
    assert reg["slope"] * 1e6 == pytest.approx(10.4911, abs=1e-4)
    assert reg["intercept"] == pytest.approx(0.789019, abs=1e-6)
    assert reg["r2"] == pytest.approx(0.00023061, rel=1e-4)


def test_curves(cmp):
    roc = C.roc_curve(cmp, N.BEST)
    assert roc.count() == 50
    last = roc.orderBy("threshold").first()
    assert (last["tp"], last["fp"]) == (1644, 700)
    assert C.roc_auc(cmp, N.BEST).first()[0] == pytest.approx(0.484833, abs=1e-6)
    assert C.average_precision(cmp, N.BEST).first()[0] == pytest.approx(0.69073, abs=1e-5)
