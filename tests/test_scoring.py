import json
import time

import pytest
from pyspark.sql import functions as F

from skarn.operators import resample, scoring
from tests.test_text import CYBER, FX, PARAPHRASE

RISKS = "array<struct<title:string,category:string,summary:string>>"


def risk(spark, gold, pred):
    df = spark.createDataFrame([(gold, pred)], f"g {RISKS}, p {RISKS}")
    return df.select(scoring.risk_score(F.col("g"), F.col("p")).alias("r")).first().r


def test_one_to_one(spark):
    r = risk(spark, [CYBER], [PARAPHRASE, CYBER])
    assert (r.n_gold, r.n_pred, r.category_tp, r.matched, r.matched_same_category) == (1, 2, 1, 1, 1)


def test_greedy_takes_the_best_first(spark):
    df = spark.createDataFrame([([PARAPHRASE, CYBER], [CYBER, FX])], f"g {RISKS}, p {RISKS}")
    m = df.select(scoring.greedy_matches(F.col("g"), F.col("p")).alias("m")).first().m
    assert [(x.g, x.p) for x in m] == [(1, 0)] and m[0].score == pytest.approx(1.0)


def test_empty_lists(spark):
    r = risk(spark, [CYBER], [])
    assert (r.category_tp, r.matched) == (0, 0)
    assert risk(spark, [], []).n_gold == 0


def test_macro_and_micro(spark):
    rows = spark.createDataFrame([(46, 46, 46, 46, 46), (1, 1, 0, 0, 0)], "n_gold int, n_pred int, category_tp int, matched int, matched_same_category int")
    r = scoring.risk_report(rows).first()
    assert r.macro_category_f1 == 0.5 and r.micro_category_f1 > 0.9 and r.macro_category_accuracy == 1.0
    none = scoring.risk_report(rows.limit(0)).first()
    assert (none.n, none.macro_category_f1, none.macro_category_accuracy) == (0, 0.0, None)


def target(**f):
    return json.dumps({"company": "C", "ticker": "T", "fiscal_year": 2025, "form_type": "10-K", "financials": {"revenue": 1e9, "net_income": 5e7, "total_assets": 2e9, "eps_diluted": 2.5} | f, "risk_factors": [dict(zip(("title", "category", "summary"), r)) for r in (CYBER, FX)]})


def scored(spark):
    gold = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": target()}]
    ex = [(a, a, a == "c", [(m["role"], m["content"]) for m in gold]) for a in "abcd"]
    pr = [("m", "a", "x", target(), None, 1, 1), ("m", "b", "x", "```json\n" + target(revenue=1e6) + "```", None, 1, 1), ("m", "c", "x", target(eps_diluted=None), None, 1, 1)]
    from skarn.schemas import EXAMPLE_DDL, PREDICTION_DDL

    return scoring.score_examples(spark.createDataFrame(ex, EXAMPLE_DDL), spark.createDataFrame(pr, PREDICTION_DDL))


def test_examples(spark):
    got = {r["accession_no"]: r for r in scored(spark).collect()}
    assert got["a"].strict and got["a"].revenue == "exact" and got["a"].risk.matched == 2
    assert not got["b"].strict and got["b"].lenient and got["b"].revenue == "scale_error"
    assert got["c"].risk is None and got["c"].eps_diluted == "missing"
    assert got["d"].error == "empty" and got["d"].net_income == "missing" and got["d"].risk.n_pred == 0
    v = scoring.validity_rates(scored(spark)).first()
    assert (v.n, v.strict_rate, v.lenient_rate) == (4, 0.5, 0.75)


def test_intervals_bracket_the_estimate(spark):
    out = {r["metric"]: r for r in resample.bootstrap(scoring.filing_stats(scored(spark)), "accession_no", list(scoring.METRICS), 300).collect()}
    assert set(out) == set(scoring.METRICS) and out["strict_valid_rate"].low <= 0.5 <= out["strict_valid_rate"].high


def stats(spark, hits):
    return spark.createDataFrame([(i, float(h), 1.0) for i, h in enumerate(hits)], "k int, m_num double, m_den double")


def test_more_clusters_narrow_the_interval(spark):
    few, many = (resample.bootstrap(stats(spark, [1, 0] * n), "k", ["m"], 400).first() for n in (6, 60))
    assert few.high - few.low > 0.4 and (many.high - many.low) * 2 < few.high - few.low


def test_no_interval_without_enough_clusters(spark):
    assert resample.bootstrap(stats(spark, [1, 0]), "k", ["m"], 100, least=3).count() == 0
    assert resample.bootstrap(stats(spark, []), "k", ["m"], 100).count() == 0
    zero = spark.createDataFrame([(1, 0.0, 0.0)], "k int, m_num double, m_den double")
    assert resample.bootstrap(zero, "k", ["m"], 100).count() == 0


def test_report_of_long_lists_of_copies(spark):
    kinds = [CYBER, FX, PARAPHRASE, ("Weather", "other", "Storms may close stores")]
    df = spark.range(3).select(*[F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i, s=step: F.element_at(F.from_json(F.lit(json.dumps([dict(zip(("title", "category", "summary"), k)) for k in kinds])), RISKS), (i * s % 4 + 1).cast("int"))).alias(c) for c, n, step in (("g", 4000, 1), ("p", 4400, 3))])
    at = time.monotonic()
    r = scoring.risk_report(df.select(scoring.risk_score(F.col("g"), F.col("p")).alias("r")).select("r.*")).first()
    assert time.monotonic() - at < 40
    assert (r.n, r.n_gold, r.n_pred, r.category_tp, r.matched, r.matched_same_category) == (3, 12000, 13200, 12000, 12000, 12000)


def test_report_of_long_lists_of_many_titles(spark):
    words = "red blue hot cold old new large small".split()
    entry = lambda i: F.struct(F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, words)), ((i * a + i.cast("int") / b).cast("int") % 8 + 1).cast("int")) for a, b in ((1, 8), (3, 5))]).alias("title"), F.lit("c").alias("category"), F.lit("Storms").alias("summary"))
    df = spark.range(2).select(*[F.transform(F.sequence(F.lit(0), F.lit(n - 1)), entry).alias(c) for c, n in (("g", 1000), ("p", 900))])
    at = time.monotonic()
    r = scoring.risk_report(df.select(scoring.risk_score(F.col("g"), F.col("p")).alias("r")).select("r.*")).first()
    assert time.monotonic() - at < 40
    assert (r.n, r.n_gold, r.n_pred, r.category_tp, r.matched, r.matched_same_category) == (2, 2000, 1800, 1800, 1800, 1800)


def test_report_of_a_long_list_of_titles_that_all_differ(spark):
    entry = lambda i: F.struct(F.concat_ws(" ", F.concat(F.lit("hot"), i % 8), F.concat(F.lit("bolt"), i % 7), F.concat(F.lit("w"), i)).alias("title"), F.lit("c").alias("category"), F.lit("Storms").alias("summary"))
    df = spark.range(1).select(*[F.transform(F.sequence(F.lit(a), F.lit(2 * n), F.lit(2)), entry).alias(c) for c, a, n in (("g", 0, 3999), ("p", 1, 3700))])
    at = time.monotonic()
    r = scoring.risk_report(df.select(scoring.risk_score(F.col("g"), F.col("p")).alias("r")).select("r.*")).first()
    assert time.monotonic() - at < 45
    assert (r.n, r.n_gold, r.n_pred, r.category_tp, r.matched, r.matched_same_category) == (1, 4000, 3700, 3700, 3700, 3700)
