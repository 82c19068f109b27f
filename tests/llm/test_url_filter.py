import random

from skarn.llm import url_filter as U
from skarn.llm.queries import RULES


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


URLS = [
    None, "", "nothing", "http://", "http://com", "http://com/", "HTTP://A.COM/x", "http://www.Example.com/en/1?q=/es/", "http://example.com/en", "http://example.com/en/", "http://a.www.example.com/en/#t", "x://notexample.com/en/",
    "http://a.net/es/1", "http://net/fr/", "http://a.net?x=/es/", "http://a.net#/fr/", "http://a..net/fr/", "http://.net/fr/", "http://net./fr/", "http://a.net:80/fr/", "a://b://c.com/d", "http://é.com/ü",
]


def judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(df, rules).orderBy("page_id").collect()]


def test_against_direct_reading(spark):
    rng = random.Random(4)
    urls = URLS + ["http://" + ".".join(rng.choice(["www", "example", "com", "net", "a"]) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/", "/en/", "/es/x", "/fr/", "/en"]) for _ in range(200)]
    assert judged(spark, urls, RULES) == [brute(u, RULES) for u in urls]


def test_cascade_is_exact(spark, monkeypatch):
    """With small levels there are false positives at every level, and membership is exact all the same."""
    monkeypatch.setattr(U, "BITS_PER_KEY", 4)
    monkeypatch.setattr(U, "SPARE", 10**9)
    from pyspark.sql import functions as F

    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%7'")
    levels = U.build_cascade(listed, universe)
    assert len(levels) > 2
    wrong = universe.where(U.listed_in(F.col("key"), levels) != F.col("key").like("%7"))
    assert wrong.count() == 0


def test_no_rules_and_no_rows(spark):
    assert judged(spark, ["http://a.com/"], []) == [("a.com", "/", None, "allow")]
    assert judged(spark, ["http://a.com/"], [])[0][3] == "allow"
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def test_long_hosts_and_repeated_rows(spark):
    """A host of 100,000 labels, a path of a million characters, each twice."""
    urls = ["http://" + "a." * 100_000 + "example.com/en/", "http://x.net/es/" + "y" * 1_000_000] * 2
    got = judged(spark, urls, RULES)
    assert [g[2:] for g in got] == [("example.com/en/", "block"), ("net/es/", "block")] * 2 and got[0][0] == "a." * 100_000 + "example.com"


def test_levels_follow_the_list_not_the_universe(spark):
    from pyspark.sql import functions as F

    universe = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key in ('k1', 'k77', 'k4000')")
    levels = U.build_cascade(listed, universe)
    assert sum(bits for bits, *_ in levels) < 100_000
    assert {r["key"] for r in universe.where(U.listed_in(F.col("key"), levels)).collect()} == {"k1", "k77", "k4000"}
