"""Scoring predictions: numeric verdicts, category agreement, one-to-one matching, micro and macro."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.numeric import f1, is_hit, is_scorable, ratio, verdict
from skarn.functions.text import TITLE_WEIGHT, tokens
from skarn.functions.validate import validate_target
from skarn.schemas import SCORED_FIELDS, TARGET_DDL, VERDICTS

MATCH_THRESHOLD = 0.30


def verdict_rows(pairs: DataFrame, fields: tuple[str, ...] = SCORED_FIELDS) -> DataFrame:
    """(accession_no, field, verdict) of rows with gold and pred structs; a null pred misses everything."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), verdict(F.col(f"gold.{f}"), F.col(f"pred.{f}")).alias("verdict")) for f in fields])
    return pairs.select("accession_no", F.inline(each))


def verdict_rates(rows: DataFrame) -> DataFrame:
    """(field, n, scorable, hits, accuracy) by field, and over all as field ALL; no scorable row: null."""
    tally = [F.count("*").alias("n"), F.count_if(is_scorable(F.col("verdict"))).alias("scorable"), F.count_if(is_hit(F.col("verdict"))).alias("hits")]
    both = rows.select(F.explode(F.array(F.col("field"), F.lit("ALL"))).alias("field"), "verdict")
    return both.groupBy("field").agg(*tally).withColumn("accuracy", ratio(F.col("hits"), F.col("scorable")))


def verdict_tally(rows: DataFrame) -> DataFrame:
    """A row for each field with a column for each verdict."""
    return rows.groupBy("field").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def alignment_faults(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """(accession_no, fault): examples with no answer (missing), answers of no example (orphan), keys that occur more than once (repeated)."""
    sides = [df.groupBy("accession_no").agg(F.count("*").alias(name)) for df, name in ((examples, "e"), (predictions, "p"))]
    both = sides[0].join(sides[1], "accession_no", "full").fillna(0, ["e", "p"])
    faults = F.array_compact(F.array(F.when(F.col("p") == 0, F.lit("missing")), F.when(F.col("e") == 0, F.lit("orphan")), F.when(F.greatest("e", "p") > 1, F.lit("repeated"))))
    return both.select("accession_no", F.explode(faults).alias("fault"))


def join_predictions(examples: DataFrame, predictions: DataFrame, strict: bool = False) -> DataFrame:
    """examples with their answers by accession_no; an example without one has an empty answer.

    Of several answers to one example the first in order counts, so that examples aren't multiplied. With
    strict, any fault of alignment_faults() ends the job instead.
    """
    if strict and (found := alignment_faults(examples, predictions).orderBy("accession_no").limit(5).collect()):
        raise ValueError("examples and answers don't match: " + ", ".join(f"{r['accession_no']} {r['fault']}" for r in found))
    p = predictions.groupBy("accession_no").agg(F.min(F.coalesce("raw", F.lit(""))).alias("raw"))
    return examples.join(p, "accession_no", "left").withColumn("raw", F.coalesce("raw", F.lit("")))


def score_examples(examples: DataFrame, predictions: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each example: validity, verdicts by field, and risk counts (null by reference)."""
    rows = join_predictions(examples, predictions, strict).withColumn("p", validate_target(F.col("raw")))
    gold = F.from_json(F.element_at("messages", -1)["content"], TARGET_DDL)
    rows = rows.withColumn("gold", gold)
    none = F.array().cast("array<struct<title:string,category:string,summary:string>>")
    risk = risk_score(F.coalesce(F.col("gold.risk_factors"), none), F.coalesce(F.col("p.target.risk_factors"), none))
    rows = rows.withColumn("risk", F.when(~F.coalesce(F.col("risk_factors_by_reference"), F.lit(False)), risk))
    verdicts = [verdict(F.col(f"gold.financials.{f}"), F.col(f"p.target.financials.{f}")).alias(f) for f in SCORED_FIELDS]
    return rows.select("ticker", "accession_no", F.col("p.strict").alias("strict"), F.col("p.lenient").alias("lenient"), F.col("p.error").alias("error"), *verdicts, "risk")


def multiset_overlap(gold: Column, pred: Column) -> Column:
    """Size of the multiset intersection of two arrays of categories."""

    def count(of: Column, c: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == c))

    return F.aggregate(F.array_distinct(gold), F.lit(0), lambda s, c: s + F.least(count(gold, c), count(pred, c)))


def _choose(threshold: float, weight: float):
    """The greedy choice over two lists of token sets (words of title and summary, sorted, as 'a b|c d'); it goes to the workers by value."""

    def choose(gold, pred):
        from collections import defaultdict
        from heapq import heapify, heappop, heappush

        import numpy as np

        if gold is None or pred is None:
            return None
        # Equal texts are scored once: places by text, and texts that share a word.
        sides = []
        for texts in (gold, pred):
            places = defaultdict(list)
            for i, text in enumerate(texts):
                places[text].append(i)
            sides.append([([part.split() for part in text.split("|")], at) for text, at in places.items()])
        sizes, index = [], []
        for k in (0, 1):
            known = defaultdict(list)
            for j, (words, _) in enumerate(sides[1]):
                for w in words[k]:
                    known[w].append(j)
            sizes.append(np.array([len(words[k]) for words, _ in sides[1]], np.int64))
            index.append({w: np.array(js, np.int32) for w, js in known.items()})
        rows, cols, scores = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0)]
        for i, (words, _) in enumerate(sides[0]):
            dice = []
            for k in (0, 1):
                met = [index[k][w] for w in words[k] if w in index[k]]
                n = np.bincount(np.concatenate(met), minlength=len(sides[1])) if met else 0
                dice.append(2.0 * n / np.maximum(len(words[k]) + sizes[k], 1))
            score = weight * dice[0] + (1 - weight) * dice[1]
            cols.append(np.flatnonzero(score >= threshold).astype(np.int32))
            rows.append(np.full(len(cols[-1]), i, np.int32))
            scores.append(score[cols[-1]])
        rows, cols, scores = (np.concatenate(x) for x in (rows, cols, scores))
        order = np.argsort(-scores, kind="stable")
        rows, cols, scores = rows[order], cols[order], scores[order]
        ends = [0, *(np.flatnonzero(np.diff(scores)) + 1).tolist(), len(scores)]
        out, used_g, used_p = [], set(), set()
        left = [[at for _, at in side] for side in sides]
        alive = [np.ones(len(side), bool) for side in sides]
        for a, b in zip(ends, ends[1:]):
            if len(used_g) == len(gold) or len(used_p) == len(pred):
                break
            # Pairs of texts of one score: their places are merged in order, without making all pairs.
            live = np.flatnonzero(alive[0][rows[a:b]] & alive[1][cols[a:b]]) + a
            if not len(live):
                continue
            score, both = float(scores[a]), (rows[live].tolist(), cols[live].tolist())
            heap = [(left[0][x][0], left[1][y][0], n, left[0][x], left[1][y], 0, 0) for n, (x, y) in enumerate(zip(*both))]
            heapify(heap)
            while heap and len(used_g) < len(gold) and len(used_p) < len(pred):
                g, p, n, gs, ps, i, j = heappop(heap)
                if g not in used_g and p not in used_p:
                    used_g.add(g)
                    used_p.add(p)
                    out.append((g, p, score))
                while i < len(gs) and gs[i] in used_g:
                    i += 1
                while j < len(ps) and ps[j] in used_p:
                    j += 1
                if i < len(gs) and j < len(ps):
                    heappush(heap, (gs[i], ps[j], n, gs, ps, i, j))
            for of, ok, used, texts in zip(left, alive, (used_g, used_p), both):
                for x in set(texts):
                    of[x] = [at for at in of[x] if at not in used]
                    ok[x] = bool(of[x])
        return out

    return choose


def greedy_matches(gold: Column, pred: Column, threshold: float = MATCH_THRESHOLD) -> Column:
    """Array of (gold_index, pred_index, score): one-to-one, the most similar pairs first, ties to smaller indices.

    The only order-dependent step. Its work grows with the pairs of different texts of a row and with the
    entries, not with the pairs of entries; a pair of texts is a few numbers in arrays. Words are found in the
    JVM, and few rows at once are in Python.
    """
    words = lambda c: F.coalesce(F.array_join(F.array_sort(tokens(c)), " "), F.lit(""))
    seen = lambda rs: F.transform(rs, lambda r: F.concat(words(r["title"]), F.lit("|"), words(r["summary"])))
    choose = F.udf(_choose(threshold, TITLE_WEIGHT), "array<struct<g:int,p:int,score:double>>", useArrow=False)
    return choose(seen(gold), seen(pred))


def risk_score(gold: Column, pred: Column) -> Column:
    """struct of counts: n_gold, n_pred, category_tp, matched, matched_same_category."""
    matches = greedy_matches(gold, pred)
    same = F.size(F.filter(matches, lambda m: F.get(gold, m["g"])["category"] == F.get(pred, m["p"])["category"]))
    overlap = multiset_overlap(F.transform(gold, lambda r: r["category"]), F.transform(pred, lambda r: r["category"]))
    return F.struct(F.size(gold).alias("n_gold"), F.size(pred).alias("n_pred"), overlap.alias("category_tp"), F.size(matches).alias("matched"), same.alias("matched_same_category"))


def risk_report(rows: DataFrame) -> DataFrame:
    """One row of micro and macro figures over rows (n_gold, n_pred, category_tp, matched, matched_same_category).

    Macro figures are means over filings: one with many risks weighs no more than another. Without
    filings they are 0, but category accuracy, which only filings with a match have, is null.
    """
    per = rows.withColumns({"cf1": f1(F.col("category_tp"), F.col("n_pred"), F.col("n_gold")), "mf1": f1(F.col("matched"), F.col("n_pred"), F.col("n_gold")), "acc": ratio(F.col("matched_same_category"), F.col("matched"))})
    names = ("n_gold", "n_pred", "category_tp", "matched", "matched_same_category")
    out = per.agg(
        F.count("*").alias("n"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names],
        F.coalesce(F.avg("cf1"), F.lit(0.0)).alias("macro_category_f1"),
        F.coalesce(F.avg("mf1"), F.lit(0.0)).alias("macro_match_f1"),
        F.avg("acc").alias("macro_category_accuracy"),
    )
    c = {n: F.col(n) for n in names}
    return out.withColumns({"micro_category_f1": f1(c["category_tp"], c["n_pred"], c["n_gold"]), "micro_match_f1": f1(c["matched"], c["n_pred"], c["n_gold"])})


def validity_rates(rows: DataFrame) -> DataFrame:
    """(n, strict_rate, lenient_rate) over all rows, invalid ones included."""
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("strict").cast("double")).alias("strict_rate"), F.avg(F.col("lenient").cast("double")).alias("lenient_rate"))


def filing_stats(scored: DataFrame) -> DataFrame:
    """Sufficient statistics of each filing, so that a resample is a sum: see resample.bootstrap()."""
    out = {"strict_valid_rate_num": F.col("strict").cast("double"), "strict_valid_rate_den": F.lit(1.0), "lenient_valid_rate_num": F.col("lenient").cast("double"), "lenient_valid_rate_den": F.lit(1.0)}
    total_n, total_d = F.lit(0.0), F.lit(0.0)
    for f in SCORED_FIELDS:
        n, d = is_hit(F.col(f)).cast("double"), is_scorable(F.col(f)).cast("double")
        out |= {f"numeric_{f}_num": n, f"numeric_{f}_den": d}
        total_n, total_d = total_n + n, total_d + d
    out |= {"numeric_accuracy_num": total_n, "numeric_accuracy_den": total_d}
    has = F.col("risk").isNotNull().cast("double")
    for name, tp in (("macro_category_f1", "category_tp"), ("macro_match_f1", "matched")):
        value = F.when(F.col("risk").isNotNull(), f1(F.col(f"risk.{tp}"), F.col("risk.n_pred"), F.col("risk.n_gold"))).otherwise(0.0)
        out |= {f"{name}_num": value, f"{name}_den": has}
    return scored.select("accession_no", *[c.alias(k) for k, c in out.items()])


METRICS = ("strict_valid_rate", "lenient_valid_rate", "numeric_accuracy", *(f"numeric_{f}" for f in SCORED_FIELDS), "macro_category_f1", "macro_match_f1")
