"""Trie of conversation prefixes by prefix-doubling naming.

Turns get dense names (0, 1, ...); a block of 2^j turns is named by the pair of names of its halves, one
join round for each j. The prefix of d turns is the chain of blocks that the binary digits of d spell,
largest first, so it is named by the prefix without its last block and that block, one round for each
further digit. Prefixes of one depth and name are a node. Sums over subtrees double as well: after round
k a node holds its descendants nearer than 2^k, and takes those of its descendants at exactly 2^k.

Texts stay where they are read: exchanges carry digests and names. No step collects a conversation or a
group: turns are numbered by a range sort, and members that end at a node are hashed as a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, select_as, small_batches

#: Every so many-th conversation lends its first turns to those after it; the number lent is a remainder of this.
GROUP, LENT = 5, 9
#: Characters of one piece of a list of ids on its way to the hash.
PIECE = 1 << 16
_PARTITION = 33  # bits of monotonically_increasing_id within a partition


def _dense(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, list[DataFrame]]:
    """rows (a written table) with a column name: the number of its keys among the distinct ones, from 0 without gaps; and a table to discard after use.

    The join is a plain one of two written tables, so Spark splits the partition of a frequent name.
    """
    found = materialize(rows.select(*keys).distinct().withColumn("at", F.monotonically_increasing_id()), f"{name}-names")
    part = F.shiftright("at", _PARTITION)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of a written table.
    starts = found.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbers = found.withColumn("part", part).join(starts, "part").select(*keys, (F.col("start") + F.col("at").bitwiseAND((1 << _PARTITION) - 1)).alias(name))
    return rows.join(numbers, keys), [found]


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, digest, size) of every turn, pos from 0 in order of turn; (conv, n) of every conversation).

    Null turns come first, turns of one number go by digest. Rows without conv_id belong to no conversation.
    """
    rows = select_as(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.select(F.col("conv_id").alias("conv"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = ["conv", F.asc_nulls_first("turn"), "digest"]
    # Partitions of the sort are ranges, so a conversation of any length is spread and its places follow from counts.
    turns = materialize(turns.orderBy(*order).select("conv", "digest", "size", F.monotonically_increasing_id().alias("at")), "turns")
    turns = turns.withColumn("part", F.shiftright("at", _PARTITION))
    parts = turns.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.select("conv", "part", "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift")), "turn-parts")
    numbered = turns.join(parts.drop("n"), ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "digest", "size")
    return numbered, parts.groupBy("conv").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, name, size) and lengths (conv, n) with each conversation's first h turns taken from its group's first.

    h is crc32 of the decimal conv, unsigned, modulo LENT; the group of c starts at c - c % GROUP. A
    conversation's own turns follow from its h-th on. Both inputs are written tables.
    """
    h = F.crc32(F.col("conv").cast("string")) % LENT
    plan = lengths.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    plan = plan.join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = materialize(plan.select("conv", "base", "n", "h", "lent"), "rebuild")
    heads = turns.where(F.col("pos") < LENT - 1).withColumnRenamed("conv", "base")
    lent = heads.join(plan.select("conv", "base", "lent"), "base").where("pos < lent").select("conv", "pos", "name", "size")
    # The hash of conv alone tells which turns stay, and the join then adds what was lent.
    own = turns.where(F.col("pos") >= h).join(plan.select("conv", "h", "lent"), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "name", "size")
    return lent.union(own), plan.select("conv", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def prefix_names(turns: DataFrame, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(conv, d, name) of the prefix of each d turns, from (conv, pos, name): equal prefixes of one d have equal names; and tables to discard."""
    blocks, used = turns.select("conv", F.col("pos").alias("b"), "name"), []
    odd_half = F.col("b") % 2 == 1
    # A block at an even place ends a prefix: that of (b + 1) * 2^j turns, whose rest is the prefix of b * 2^j.
    ends = []
    for j in range(max(longest, 1).bit_length()):
        if j:
            halves = blocks.groupBy("conv", F.shiftright("b", 1).alias("b")).agg(F.max(F.when(~odd_half, F.col("name"))).alias("l"), F.max(F.when(odd_half, F.col("name"))).alias("r"))
            halves = materialize(halves.where("l is not null and r is not null"), "halves")
            named, more = _dense(halves, ["l", "r"], "name")
            blocks = materialize(named.select("conv", "b", "name"), "blocks")
            used += [halves, blocks, *more]
        ends.append(blocks.where(~odd_half).select("conv", "b", F.lit(1 << j).cast("long").alias("size"), "name"))
    last = ends[0]
    for more in ends[1:]:
        last = last.union(more)
    last = last.select("conv", ((F.col("b") + 1) * F.col("size")).alias("d"), (F.col("b") * F.col("size")).alias("rest"), F.bit_count("b").alias("digits"), F.col("name").alias("last"))
    done = materialize(last.where("digits = 0").select("conv", "d", F.col("last").alias("name")), "prefixes")
    out, used = done, [*used, done]
    for digits in range(1, longest.bit_length()):
        rest = done.select("conv", F.col("d").alias("rest"), F.col("name").alias("first"))
        pairs = materialize(last.where(F.col("digits") == digits).join(rest, ["conv", "rest"]).select("conv", "d", "first", "last"), "prefix-pairs")
        named, more = _dense(pairs, ["d", "first", "last"], "name")
        done = materialize(named.select("conv", "d", "name"), "prefixes")
        out, used = out.union(done), [*used, pairs, done, *more]
    return out, used


def _hash_of_ids(ends: DataFrame) -> DataFrame:
    """(d, m, ends_sha256): sha256 of the conv of each (d, m), ascending, in decimal, joined by commas.

    The sort deals a large group to several tasks, which join its ids to pieces; only pieces meet in the one
    task that hashes the group, and pass through it as a stream.
    """

    def pieces(batches):
        key, first, held, size = None, None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])], ["d", "m", "first", "piece"])

        for batch in batches:
            out = []
            for d, m, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (d, m) or size > PIECE:
                    if key:
                        out.append(row())
                    key, first, held, size = (d, m), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if key:
            yield row()

    def hashes(batches):
        key, state = None, None

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in found], pa.int64()), pa.array([x[0][1] for x in found], pa.int64()), pa.array([x[1].hexdigest() for x in found], pa.string())], ["d", "m", "ends_sha256"])

        for batch in batches:
            found = []
            for d, m, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if key == (d, m):
                    state.update(b"," + piece.encode())
                    continue
                if key:
                    found.append((key, state))
                key, state = (d, m), hashlib.sha256(piece.encode())
            if found:
                yield rows(found)
        if key:
            yield rows([(key, state)])

    small_batches(ends.sparkSession)
    cut = ends.select("d", "m", "conv").orderBy("d", "m", "conv").mapInArrow(pieces, "d long, m long, first long, piece string")
    return cut.repartition("d", "m").sortWithinPartitions("d", "m", "first").mapInArrow(hashes, "d long, m long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations.

    Turns go by turn (null first), those of one number by the sha256 of role and text, so repeated rows
    are turns like any other; null role or text is empty. Rows without conv_id are in no conversation.
    Without conversations there is no node, not even the root. Extra columns are not looked at, and a
    long text is hashed where it is read and moved nowhere.
    """
    numbered, lengths = numbered_turns(conversations)
    numbered, lengths = materialize(numbered, "numbered"), materialize(lengths, "lengths")
    named, used = _dense(numbered, ["digest"], "name")
    named = materialize(named.select("conv", "pos", "name", "size"), "named")
    turns, lengths = rebuilt(named, lengths)
    turns, lengths = materialize(turns, "rebuilt"), materialize(lengths, "rebuilt-lengths")
    for done in (numbered, named, *used):
        discard(done)
    whole = lengths.agg(F.count("*").alias("n"), F.min("conv").alias("root"), F.max("n").alias("longest")).first()
    longest, root = whole["longest"] or 0, whole["root"]

    # A node's smallest member names it among those of its depth.
    prefixes, used = prefix_names(turns.select("conv", "pos", "name"), longest)
    grouped = materialize(prefixes.groupBy("d", "name").agg(F.min("conv").alias("m"), F.count("*").alias("n_convs")), "nodes")
    member = materialize(prefixes.join(grouped.select("d", "name", "m"), ["d", "name"]).select("conv", "d", "m"), "members")
    for done in used:
        discard(done)

    def above(rows: DataFrame, step: int) -> DataFrame:
        """rows (d, m, ...) below depth step, with the node step turns above each: (up, up_m)."""
        at = member.select(F.col("conv").alias("m"), F.col("d").alias("up"), F.col("m").alias("up_m"))
        deep = rows.withColumn("up", F.col("d") - step)
        return deep.where("up > 0").join(at, ["m", "up"]).unionByName(deep.where("up = 0").withColumn("up_m", F.lit(root).cast("long")))

    last = turns.select(F.col("conv").alias("m"), (F.col("pos") + 1).alias("d"), "size")
    nodes = above(grouped.drop("name").join(last, ["m", "d"]), 1).select("d", "m", F.col("up_m").alias("parent"), "n_convs", "size")
    top = lengths.where(F.col("conv") == root).limit(1).select(F.lit(0).cast("long").alias("d"), F.col("conv").alias("m"), F.lit(None).cast("long").alias("parent"), F.lit(whole["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("size"))
    nodes = materialize(nodes.union(top), "trie")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("m")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["d", "m"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialize(nodes, "trie")

    sums = nodes.select("d", "m", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    step = 1
    while step <= longest:
        lower = above(sums, step).select(F.col("up").alias("d"), F.col("up_m").alias("m"), "n_leaves", "saved_tokens")
        sums = materialize(sums.union(lower).groupBy("d", "m").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "subtrees")
        step *= 2

    ends = lengths.where("n > 0").select("conv", F.col("n").alias("d")).join(member, ["conv", "d"])
    ends = ends.select("conv", "d", "m").union(lengths.where("n = 0").select("conv", F.lit(0).cast("long"), F.lit(root).cast("long")))
    out = nodes.join(sums, ["d", "m"]).join(_hash_of_ids(ends), ["d", "m"], "left")
    return out.select(
        F.col("m").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
