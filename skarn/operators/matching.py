"""One-to-one matching of lists of any length: a similarity join for the pairs, then rounds of mutual best pairs.

Entries of a list with the same words form a class, which keeps the places of its entries in order. Pairs
of classes that can be similar enough are found by a prefix-filtered join on rare words. In a round, a
pair of classes that is the best of both, by similarity, then first gold place, then first predicted
one, is final: whatever is left in both can't change it. It is as the sequential greedy choice, which
takes the best pair of all again and again, because the order of pairs is total.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import TITLE_WEIGHT, risk_similarity, tokens
from skarn.session import ship_code
from skarn.tables import discard, materialize

MATCH_THRESHOLD = 0.30
#: Rounds after which what is left goes through the sequential choice, list by list, as a stream of sorted pairs.
ROUNDS = 6
#: Entries of one frequent word that meet in one task at most, on the gold side.
MEETING = 4096


def classes(rows: DataFrame, key: str = "accession_no") -> DataFrame:
    """(list, c, places, t, s) from (key, place, title, summary): entries with the same words of title and summary; c is the first place."""
    words = lambda c: F.array_sort(tokens(F.coalesce(F.col(c), F.lit(""))))
    seen = rows.select(F.col(key).alias("list"), "place", words("title").alias("t"), words("summary").alias("s"))
    return seen.groupBy("list", "t", "s").agg(F.array_sort(F.collect_list("place")).alias("places")).select("list", F.col("places")[0].alias("c"), "places", "t", "s")


def _prefixes(side: DataFrame, counts: DataFrame, words: str, least: float) -> DataFrame:
    """(list, word, c, size, nth, n): words of each class of a side in order of rarity, as far as a partner with Dice's coefficient least must share one."""
    rows = side.select("list", "c", F.size(words).alias("size"), F.explode(words).alias("word")).join(counts, ["list", "word"])
    in_order = F.array_sort(F.collect_list(F.struct("n", "word")))
    rows = rows.groupBy("list", "c", "size").agg(in_order.alias("ws"))
    needed = F.ceil(F.lit(least / (2 - least)) * F.col("size") - 1e-9)
    kept = F.slice("ws", F.lit(1), (F.col("size") - F.greatest(needed, F.lit(1)) + 1).cast("int"))
    return rows.select("list", "c", "size", F.posexplode(kept).alias("nth", "w")).select("list", "c", "size", "nth", "w.word", "w.n")


def candidates(gold: DataFrame, pred: DataFrame, words: str, least: float) -> DataFrame:
    """(list, g, p) of classes whose sets of words may have a Dice's coefficient of least or more; all that have are among them.

    Sets of a and b words need an overlap of least * (a + b) / 2, so two sets in one order share a word
    among the first a - overlap + 1 and b - overlap + 1. The order is by rarity in both lists. A word that
    many classes have is met in several tasks.
    """
    every = gold.select("list", F.explode(words).alias("word")).unionByName(pred.select("list", F.explode(words).alias("word")))
    counts = every.groupBy("list", "word").agg(F.count("*").alias("n"))
    a, b = _prefixes(gold, counts, words, least), _prefixes(pred, counts, words, least)
    parts = F.ceil(F.col("n") / MEETING).cast("int")
    a = a.select("list", "word", F.col("c").alias("g"), F.col("size").alias("a"), F.col("nth").alias("i"), F.pmod(F.xxhash64("c"), parts).cast("int").alias("part"))
    b = b.select("list", "word", F.col("c").alias("p"), F.col("size").alias("b"), F.col("nth").alias("j"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    overlap = F.ceil(F.lit(least / 2) * (F.col("a") + F.col("b")) - 1e-9)
    fits = (F.col("i") <= F.col("a") - overlap) & (F.col("j") <= F.col("b") - overlap)
    return a.join(b, ["list", "word", "part"]).where(fits).select("list", "g", "p").distinct()


def similar_classes(gold: DataFrame, pred: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """(list, g, p, score) of classes of two sides with a similarity of threshold or more.

    The threshold is split in two halves: a pair that reaches neither half's share in its words can't reach
    the whole, so pairs that may reach one of them are all that have to be looked at.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is more than 0, and 1 at most")
    found = None
    for words, weight in (("t", TITLE_WEIGHT), ("s", 1 - TITLE_WEIGHT)):
        least = threshold / 2 / weight * (1 - 1e-9)
        if least <= 1:
            some = candidates(gold, pred, words, least)
            found = some if found is None else found.union(some).distinct()
    sides = [df.select("list", F.col("c").alias(name), F.col("t").alias(f"{name}_t"), F.col("s").alias(f"{name}_s")) for df, name in ((gold, "g"), (pred, "p"))]
    both = found.join(sides[0], ["list", "g"]).join(sides[1], ["list", "p"])
    score = risk_similarity(F.col("g_t"), F.col("g_s"), F.col("p_t"), F.col("p_s"))
    return both.select("list", "g", "p", score.alias("score")).where(F.col("score") >= threshold)


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("g0"), F.asc("p0")]


def _round(pairs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(list, g, p, score, k) of the pairs of classes that are final: the first k places of both, one by one, are matched.

    k stops where another class with the same similarity would have its turn.
    """
    now = pairs.join(gold.select("list", F.col("c").alias("g"), F.col("places").alias("gs"), F.col("places")[0].alias("g0")), ["list", "g"])
    now = now.join(pred.select("list", F.col("c").alias("p"), F.col("places").alias("ps"), F.col("places")[0].alias("p0")), ["list", "p"])
    of_g, of_p = Window.partitionBy("list", "g").orderBy(*_order()), Window.partitionBy("list", "p").orderBy(*_order())
    # The places themselves needn't be sorted along: the final pairs get them afterwards.
    now = now.select("list", "g", "p", "score", "g0", "p0")
    now = now.withColumns({"at_g": F.row_number().over(of_g), "tied_p": F.when(F.lead("score").over(of_g) == F.col("score"), F.lead("p0").over(of_g))})
    now = now.withColumns({"at_p": F.row_number().over(of_p), "tied_g": F.when(F.lead("score").over(of_p) == F.col("score"), F.lead("g0").over(of_p))})
    return now.where("at_g = 1 and at_p = 1").select("list", "g", "p", "score", "tied_g", "tied_p")


def _rest(pairs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(list, g, p, score) of places: the sequential choice over pairs of places in order, of lists that rounds haven't ended."""
    now = pairs.join(gold.select("list", F.col("c").alias("g"), F.col("places").alias("gs")), ["list", "g"]).join(pred.select("list", F.col("c").alias("p"), F.col("places").alias("ps")), ["list", "p"])
    now = now.select("list", "score", "gs", "ps").repartition("list").sortWithinPartitions("list", F.desc("score"), F.col("gs")[0], F.col("ps")[0])

    def run(batches):
        # Pairs of classes of one list and one score come together; their places are merged in order, without making all pairs.
        at, group, used_g, used_p = (None, None), [], set(), set()

        def settle():
            import heapq

            out, heap = [], []
            for gs, ps in group:
                gs, ps = [x for x in gs if x not in used_g], [x for x in ps if x not in used_p]
                if gs and ps:
                    heapq.heappush(heap, (gs[0], ps[0], id(gs), gs, ps, 0, 0))
            while heap:
                g, p, _, gs, ps, i, j = heapq.heappop(heap)
                if g not in used_g and p not in used_p:
                    used_g.add(g)
                    used_p.add(p)
                    out.append((at[0], g, p, at[1]))
                while i < len(gs) and gs[i] in used_g:
                    i += 1
                while j < len(ps) and ps[j] in used_p:
                    j += 1
                if i < len(gs) and j < len(ps):
                    heapq.heappush(heap, (gs[i], ps[j], id(gs), gs, ps, i, j))
            return out

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type, batch.schema.field(2).type.value_type, batch.schema.field(3).type.value_type, pa.float64()]
            found = []
            for key, score, gs, ps in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, score) != at:
                    found += settle()
                    if key != at[0]:
                        used_g, used_p = set(), set()
                    at, group = (key, score), []
                group.append((gs, ps))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 4, kinds)], ["list", "g", "p", "score"])
        if kinds and (found := settle()):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["list", "g", "p", "score"])

    kind = gold.schema["list"].dataType.simpleString(), gold.schema["c"].dataType.simpleString()
    return now.mapInArrow(run, f"list {kind[0]}, g {kind[1]}, p {kind[1]}, score double")


def match_lists(gold: DataFrame, pred: DataFrame, key: str = "accession_no", threshold: float = MATCH_THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """(key, g, p, score): one-to-one matches of the entries of two lists of a key, the most similar pairs first, ties to smaller places.

    gold and pred: key, place, title, summary; a place is a number of an entry, used once in its list. The
    result equals scoring.greedy_matches() on the same lists, and no row holds more than the places of one
    class. Null titles and summaries have no words; entries without any match nothing, and a null key is no list.
    """
    spark = gold.sparkSession
    ship_code(spark)
    sides = [materialize(classes(df.where(F.col(key).isNotNull()), key), "match-classes") for df in (gold, pred)]
    pairs = materialize(similar_classes(*sides, threshold), "match-pairs")
    left = [materialize(df.select("list", "c", "places"), "match-places") for df in sides]
    for df in sides:
        discard(df)
    out = []
    for _ in range(rounds):
        if pairs.isEmpty():
            break
        final = _round(pairs, *left)
        final = final.join(left[0].select("list", F.col("c").alias("g"), F.col("places").alias("gs")), ["list", "g"]).join(left[1].select("list", F.col("c").alias("p"), F.col("places").alias("ps")), ["list", "p"])
        before = lambda xs, end: F.when(F.col(end).isNull(), F.size(xs)).otherwise(F.size(F.filter(xs, lambda x: x < F.col(end))))
        final = materialize(final.withColumn("k", F.least(before("gs", "tied_g"), before("ps", "tied_p"))), "match-final")
        some = F.arrays_zip(F.slice("gs", F.lit(1), F.col("k")).alias("g"), F.slice("ps", F.lit(1), F.col("k")).alias("p"))
        matched = materialize(final.select("list", "score", F.inline(some)).select("list", "g", "p", "score"), "match-out")
        rest = []
        for df, name in zip(left, ("g", "p")):
            done = final.select("list", F.col(name).alias("c"), "k")
            cut = df.join(done, ["list", "c"], "left").withColumn("places", F.expr("if(k is null, places, slice(places, k + 1, greatest(size(places) - k, 0)))"))
            rest.append(materialize(cut.where(F.size("places") > 0).select("list", "c", "places"), "match-places"))
        open_ = pairs.join(rest[0].select("list", F.col("c").alias("g")), ["list", "g"], "left_semi").join(rest[1].select("list", F.col("c").alias("p")), ["list", "p"], "left_semi")
        new = materialize(open_.select("list", "g", "p", "score"), "match-pairs")
        for df in (pairs, final, *left):
            discard(df)
        pairs, left = new, rest
        out.append(matched)
    if not pairs.isEmpty():
        out.append(materialize(_rest(pairs, *left), "match-out"))
    kind = gold.schema[key].dataType.simpleString(), gold.schema["place"].dataType.simpleString()
    found = spark.createDataFrame([], f"list {kind[0]}, g {kind[1]}, p {kind[1]}, score double")
    for df in out:
        found = found.union(df)
    for df in (pairs, *left):
        discard(df)
    return found.withColumnRenamed("list", key)
