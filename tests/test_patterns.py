"""Mining scans over patterns of conditions instead of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.operators import mining as M


@pytest.fixture(scope="module")
def table(spark):
    """2,000 rows, 27 combinations of conditions, every seventh target missing."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({v: rng.integers(0, 3, 2000) for v in "abc"})
    pdf["y"] = np.where(np.arange(2000) % 7 == 0, np.nan, np.round(rng.normal(0, 1, 2000) + (pdf.a == 1) * (pdf.b == 2) * (pdf.c == 0) * 2.0, 1))
    pdf["symbol"], pdf["regime"], pdf["split"] = pdf.index % 5, pdf.index % 2, "discovery"
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    return pdf, df.withColumn("conditions", F.array(*[F.concat(F.lit(v), v) for v in "abc"])).drop(*"abc").repartition(5)


def _rows(pdf, rule):
    return pdf[np.logical_and.reduce([pdf[c[0]] == int(c[1]) for c in rule])]


def test_rows_of_equal_conditions_are_one_pattern(table):
    p = M.patterns(table[1], "y")
    assert p.count() == 27 and p.agg(F.sum("_n"), F.sum("_k")).first()[:] == (2000, 1714)


def test_third_conditions_equal_brute_force(table):
    pdf, df = table
    pairs = M.level2_scan(df, "y", 0.0)
    want = {}
    for p in pairs.collect():
        for third in {f"{v}{i}" for v in "abc" for i in range(3)} - {p.a, p.b}:
            x = _rows(pdf, [p.a, p.b, third])
            if len(x) >= 20 and x.y.mean() > p.mean_r + 1e-10:
                want[p.a, p.b, third] = (len(x), x.y.mean() - p.mean_r)
    got = {(r.a, r.b, r.third): (r.support, r.improvement) for r in M.level3_scan(df, pairs, "y", 0.01).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_scores_of_rules_come_from_counts(table, spark):
    pdf, df = table
    rules = spark.createDataFrame([("ab", ["a1", "b2"]), ("abc", ["a1", "b2", "c0"]), ("c", ["c0"])], "rule_id string, rule array<string>")
    got = {r.rule_id: r for r in M.score_rules(df, rules, "y").collect()}
    oos = {r.rule_id: r for r in M.validate_rules_oos(df, rules, "y").collect()}
    for r in rules.collect():
        x = _rows(pdf, r.rule)
        m = x.groupby("symbol").y.mean()
        for have, want in ((got[r.rule_id].n, len(x)), (got[r.rule_id].mean_r, x.y.mean()), (got[r.rule_id].median_r, x.y.median()), (got[r.rule_id].std_r, x.y.std(ddof=0)),
                           (got[r.rule_id].symbol_cv, m.std(ddof=0) / abs(m.mean())), (oos[r.rule_id].n_discovery, len(x)), (oos[r.rule_id].mean_discovery, x.y.mean())):
            assert abs(have - want) < 1e-9
        assert oos[r.rule_id].n_holdout == 0 and oos[r.rule_id].mean_holdout is None


def test_similarity_counts_pairs_of_patterns(table, spark):
    pdf, df = table
    rules = spark.createDataFrame([("ab", ["a1", "b2"]), ("c", ["c0"])], "rule_id string, rule array<string>")
    s = M.rule_similarity(df, rules, "y").first()
    a, c, both = (len(_rows(pdf, r)) for r in (["a1", "b2"], ["c0"], ["a1", "b2", "c0"]))
    assert (s.a, s.b) == ("ab", "c") and abs(s.jaccard - both / (a + c - both)) < 1e-12


def test_family_means_that_differ_by_noise_go_by_name(spark):
    rules = spark.createDataFrame([("b", 0.1 + 0.2), ("a", 0.3)], "rule_id string, mean_r double")
    sim = spark.createDataFrame([("a", "b", 0.9)], "a string, b string, similarity double")
    assert [r.rule_id for r in M.dedupe_rules(rules, sim, 0.5).filter("is_representative").collect()] == ["a"]
