"""URL filters by a cascade of Bloom filters.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus's key universe that level 0
takes wrongly; level 2 the listed keys that level 1 takes, and so on until a level has no such keys.
A key of the universe is listed exactly if the first level that doesn't take it is an odd one. The
universe is complete (every key that any url of the corpus can ask for), so membership is exact and
no join is needed. Level 0 is made so large that what it takes wrongly is no more than the listed keys,
however many keys the universe has, so all levels are of the size of the list. All of it is DataFrame
functions; a level is an array of longs in the plan, of at most MAX_BITS bits: that bounds the list (some
eight million keys), not the universe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, select_as

#: Bits for each key of a level, hashes of a key, the largest level, and keys that level 0 may always take wrongly.
BITS_PER_KEY, HASHES, MAX_BITS, SPARE = 8, 4, 1 << 26, 1000


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for urls of host, or a subdomain of it, whose path starts with path."""

    verdict: str
    host: str
    path: str


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """Every (host suffix + path prefix) that a rule with a path of one of these lengths and a host of so many labels could have."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    suffixes = F.filter(F.array(*[F.when(dots + 1 >= k, F.substring_index(host, ".", -k)) for k in labels]), lambda s: s.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= k, path.substr(1, k)) for k in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("key"), F.length(s).alias("host_len")))))
    return F.array_distinct(pairs)


def _places(key: Column, bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _level(keys: DataFrame, n: int, seed: int, others: int) -> tuple[int, int, list[int]]:
    """A level that takes all n keys (a column key of distinct strings), with hashes of its own; others: keys that it should not take."""
    # Of keys that aren't its own, a level takes a share of about (HASHES * n / bits) ** HASHES.
    need = max(BITS_PER_KEY * n, HASHES * n * (others / max(n, SPARE)) ** (1 / HASHES))
    bits = 64
    while bits < min(need, MAX_BITS):
        bits *= 2
    if BITS_PER_KEY * n > MAX_BITS:
        raise ValueError(f"{n} listed keys need more than {MAX_BITS} bits")
    places = keys.select(F.explode(F.array(*_places(F.col("key"), bits, seed))).alias("p"))
    words = places.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    out = [0] * (bits // 64)
    for w, v in words.collect():  # at most MAX_BITS / 64 words, however many keys there are
        out[w] = v
    return bits, seed, out


def takes(key: Column, level: tuple[int, int, list[int]]) -> Column:
    """Whether a level takes key."""
    bits, seed, words = level
    table = F.array(*[F.lit(w).cast("long") for w in words]) if len(words) <= 64 else F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    out = F.lit(True)
    for p in _places(key, bits, seed):
        word = F.element_at(table, (F.floor(p / 64) + 1).cast("int"))
        out = out & (F.call_function("getbit", word, (p % 64).cast("int")) == 1)
    return out


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[tuple[int, int, list[int]]]:
    """Levels for the listed keys over all keys of the universe (columns key; repeats and nulls are ignored).

    Each level has hashes of its own, so what one takes wrongly the next ones rarely do, and the sets
    shrink by a constant factor until one is empty.
    """
    mine = materialize(listed.where("key is not null").select("key").distinct(), "urlin")
    n, others = mine.count(), universe.agg(F.approx_count_distinct("key")).first()[0]
    levels = [_level(mine, n, 0, others)]
    outside = universe.where("key is not null").where(takes(F.col("key"), levels[0])).select("key").distinct()
    other = materialize(outside.join(mine, "key", "left_anti"), "urlout")
    while wrong := other.count():
        levels.append(_level(other, wrong, len(levels), n))
        mine, n, other, spent = other, wrong, materialize(mine.where(takes(F.col("key"), levels[-1])), "urlnext"), mine
        discard(spent)
    discard(mine)
    discard(other)
    return levels


def listed_in(key: Column, levels: list[tuple[int, int, list[int]]]) -> Column:
    """Whether key is listed; exact for keys of the universe of the cascade."""
    out = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        out = F.when(~takes(key, levels[k]), F.lit(k % 2 == 1)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    A null url, or one without ://, has an empty host and path and gets the default verdict, like any
    url that no rule fits; rule is null there. Of several rules that fit, the longest wins, and of
    equally long ones the longer host. Repeated rows are judged one by one; other columns are dropped.
    Without rules, every url gets the default verdict; an empty table gives an empty result. Time is
    linear in a url's length, however many labels its host has.
    """
    rows = select_as(pages, **{id_col: "long", url_col: "string"})
    host, path = host_path(F.col(url_col))
    rows = rows.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    lengths = sorted({len(r.path) for r in rules})
    labels = sorted({r.host.count(".") + 1 for r in rules})
    keys = keys_of(F.col("host"), F.col("path"), lengths, labels)
    verdicts = {r.host + r.path: r.verdict for r in rules}
    listed = rows.sparkSession.createDataFrame([(k,) for k in sorted(verdicts)], "key string")
    # Distinct hosts and path heads first: a host with a third of all rows is one row from here on.
    end = F.substring_index("host", ".", -max(labels) - 1).alias("host")  # with one label more, so that dots tell where a suffix starts
    heads = materialize(rows.select(end, F.expr(f"substring(path, 1, {max(lengths)})").alias("path")).distinct(), "heads")
    universe = heads.select(F.explode(F.transform(keys, lambda k: k["key"])).alias("key"))
    levels = build_cascade(listed, universe)
    discard(heads)
    fits = F.filter(keys, lambda k: listed_in(k["key"], levels))
    best = F.get(F.sort_array(F.transform(fits, lambda k: F.struct(F.length(k["key"]), k["host_len"], k["key"].alias("key"))), asc=False), F.lit(0))
    out = rows.withColumn("rule", best["key"])
    table = F.create_map(*[F.lit(x) for pair in sorted(verdicts.items()) for x in pair])
    return out.withColumn("verdict", F.coalesce(F.element_at(table, F.col("rule")), F.lit(default)))
