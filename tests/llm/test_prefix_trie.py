import hashlib
import math
import random
import zlib

import pytest

from skarn.llm import prefix_trie as P
from skarn.llm.queries import OP12_SQL

DDL = "conv_id long, turn long, role string, text string, depth int, d string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t, r or "", x or ""))

    def digest(t):
        return hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()

    own = {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))] for c, ts in turns.items()}
    new = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    members = {}
    for c, ts in new.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    leaves, saved, children = {}, {}, {}
    for path, cs in members.items():
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, cs in members.items():
        value = (len(cs) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
            saved[path[:d]] = saved.get(path[:d], 0) + value
    out = []
    for path, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(new[c]) == len(path))))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations(rng, n, turns=8):
    """n conversations with few kinds of turns, so that prefixes are shared to any depth."""
    rows = []
    for c in range(n):
        size = rng.randrange(1, turns + 1)
        stop = rng.randrange(size + 1)
        rows += [(c * rng.choice((1, 1, 3)) if t == 0 else c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} é" if t < stop else rng.choice(("yes", "no", ""))) for t in range(size)]
    return rows


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DDL).repartition(3)
    out = P.trie(df)
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2])


def test_equals_brute_force(spark):
    rows = conversations(random.Random(1), 120)
    rows += [(None, 0, "user", "lost"), (500, None, None, None), (500, None, "user", None), (500, 0, None, "x"), (501, 0, "user", "a"), (501, 0, "user", "a"), (502, 0, "", "usera"), (503, 0, "u", "sera")]
    rows += [(c, t, "user", "same") for c in (-7, -3, -1, 10**15) for t in range(12)] + [(-(2**63), 0, "user", "far")]
    assert got(spark, rows) == brute(rows)


def test_many_equal_conversations_pass_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 20)
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(3)] + [(c, 0, "user", "other") for c in range(300, 330)]
    assert got(spark, rows) == brute(rows)


def test_long_conversation(spark):
    rng = random.Random(3)
    rows = [(5, t, "user", rng.choice("ab")) for t in range(261)]
    rows += [(10, t, "user", x) for t, (_, _, _, x) in enumerate(rows[:200])] + [(15, t, "user", x) for t, (_, _, _, x) in enumerate(rows[:77])] + [(15, 77, "user", "c")]
    rows += [(5, 261, "user", "x" * 200_000)]
    assert got(spark, rows) == brute(rows)


def test_turnless_conversations_and_empty_table(spark):
    alone = next(c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(alone, 0, "user", "a"), (alone, 1, "user", "b")]
    assert got(spark, rows) == brute(rows) and len(brute(rows)) == 1
    assert got(spark, []) == []


@pytest.mark.parametrize("seed", [4, 5])
def test_sql(spark, tmp_path, seed):
    import duckdb

    rows = conversations(random.Random(seed), 60) + [(500, None, None, None), (501, 0, "user", "a"), (501, 0, "user", "a"), (-3, 0, "user", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{tmp_path}/c/*.parquet'")
    rel = con.sql(OP12_SQL)
    assert sorted((tuple(r[rel.columns.index(c)] for c in COLUMNS) for r in rel.fetchall()), key=lambda r: r[:2]) == brute(rows)
