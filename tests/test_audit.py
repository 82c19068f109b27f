import pytest
from pyspark.sql import functions as F

from skarn.operators import audit, sampling
from skarn.schemas import AUDIT_FILING_DDL, AUDIT_RISK_DDL


def row(i, acc="a", teacher="legal", human="legal", grounded=None, ok=None, note="", digest="d", stratum="random"):
    return (f"{acc}#{i}", "T", acc, "train", stratum, i, digest, "t", teacher, "s", human, grounded, ok, note)


def sheet(spark, *rows):
    return spark.createDataFrame(list(rows), AUDIT_RISK_DDL)


def rates(spark, *rows):
    return audit.agreement(audit.reviewed(sheet(spark, *rows)), ["stratum"]).first()


def test_unreviewed_rows_do_not_count(spark):
    r = rates(spark, row(0), row(1, human=None))
    assert (r.n_reviewed, r.category_agreement) == (1, 1.0)


def test_three_of_four(spark):
    rows = [row(0), row(1), row(2), row(3, human="regulatory")]
    assert rates(spark, *rows).category_agreement == 0.75
    assert [tuple(r) for r in audit.confusions(audit.reviewed(sheet(spark, *rows))).collect()] == [("legal", "regulatory", 1)]


def test_revised_rows(spark):
    r = rates(spark, row(0), row(1, note="revised; blind verdict was 'cyber'"))
    assert (r.category_agreement, r.category_agreement_recorded, r.n_revised) == (0.5, 1.0, 1)


def test_uninformative_rows_leave_only_the_category_rate(spark):
    r = rates(spark, row(0, grounded=True), row(1, human="cyber", grounded=False, note="UNINFORMATIVE: x"))
    assert (r.category_agreement, r.grounded_rate, r.n_uninformative, r.summary_ok_rate) == (1.0, 0.5, 1, None)


def test_stale_rows(spark):
    live = spark.createDataFrame([("a", "new"), ("b", "d"), ("d", None)], "accession_no string, risk_digest string")
    s = sheet(spark, row(0), row(0, acc="b"), row(0, acc="c"), row(0, acc="d"))
    assert [r["id"] for r in audit.stale_rows(s, live).collect()] == ["a#0"]
    assert audit.reviewed(s, live).count() == 3


def test_recall(spark):
    filings = [("a", "T", "train", "random", "d", 10, 4, 1, ""), ("b", "T", "train", "random", "d", 8, 4, 1, ""), ("c", "T", "train", "random", "d", 99, 4, None, "")]
    r = audit.implied_recall(spark.createDataFrame(filings, AUDIT_FILING_DDL), ["stratum"]).first()
    assert r.recall == pytest.approx(18 / 20) and r.filings_read == 2


def test_notes(spark):
    rows = [row(0, note="revised"), row(1, note="blind verdict was 'weather'"), row(2, note="UNINFORMATIVE x"), row(3, note="UNINFORMATIVE : x"), row(4, note=None)]
    got = sorted((r["id"], r["problem"]) for r in audit.check_notes(sheet(spark, *rows)).collect())
    assert got == [("a#0", "revised_without_blind_verdict"), ("a#1", "unknown_blind_category"), ("a#2", "uninformative_without_colon")]


def test_samples(spark):
    clusters = spark.range(40).select(F.concat(F.lit("f"), "id").alias("k"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    drawn = sampling.draw_strata(clusters, "k", 12, 3).collect()
    assert len(drawn) == 15 == len({r["k"] for r in drawn}) and all(r["split"] == "test" for r in drawn if r["stratum"] == "test")
    assert drawn == sampling.draw_strata(clusters.repartition(7), "k", 12, 3).collect()
    other = sampling.draw_clusters(clusters, "k", 12, 1).collect()
    assert {r["k"] for r in other} != {r["k"] for r in drawn if r["stratum"] == "random"}
    rows = spark.range(30).select((F.col("id") % 3).alias("c"), F.col("id").alias("i"))
    assert sampling.draw_within(rows, "c", "i", 4).groupBy("c").count().where("count <> 4").count() == 0
