"""Secret scans by pattern and by sliding-window entropy, with DataFrame functions only.

Pattern spans come from split() and regexp_extract_all() of one pattern: both find the same leftmost
matches, so the running length of the pieces gives each match's place in code points. Entropy spans
come from candidate strings: a window slides over each, and Shannon entropy per character class is
kept by counts to which one character is added and from which one is taken at each step.

Texts may be long and hold many spans, so nothing is worked out again for each of them: what a lambda
needs is bound to a variable first, and running sums go over blocks of about the square root of their
number, as an array that grows by one is copied each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import select_as

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Candidate strings for the entropy method: 24 characters or more of the base64 alphabet.
CANDIDATE_LEAST = 24
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}+"
WINDOW = 24
#: Bits per character that the highest window must reach, by class of characters of the string.
LEAST_BITS = {"hex": 3.0, "alnum": 3.9, "base64": 4.0}
#: Allow-list: candidates that match one of these are no secrets (paths, words in one case, runs of one character).
ALLOW = [r"^[a-z/_-]+$", r"^[A-Z/_-]+$", r"^[A-Z]?[a-z]+$", r"(?i)example|sample|placeholder|changeme|xxxx", r"^[0-9_/-]+$", r"^(.)\1+$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"]
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


_SPANS = "array<struct<start:int,end:int,kind:string,hit:string,inner:string>>"


def _bound(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine) -> Column:
    """For each place of an array of ints >= 0, combine (a sum or a maximum) over all places before it; 0 for the first."""

    def fold(part, item):
        start = F.struct(F.lit(0).alias("all"), F.expr("cast(array() as array<int>)").alias("before"))
        return F.aggregate(part, start, lambda s, x: F.struct(combine(s["all"], item(x)).alias("all"), F.concat(s["before"], F.array(s["all"])).alias("before")))

    def blocks(vs):
        side = F.ceil(F.sqrt(F.size(vs))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(vs), side), lambda i: fold(F.slice(vs, i, side), lambda x: x))

    def joined(parts):
        heads = fold(parts, lambda p: p["all"])["before"]
        return F.flatten(F.zip_with(parts, heads, lambda p, h: F.transform(p["before"], lambda x: combine(h, x))))

    return _bound(values, lambda vs: F.when(F.size(vs) == 0, F.expr("cast(array() as array<int>)")).otherwise(_bound(blocks(vs), joined)))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def spans_of(text: Column, pattern: str, kind: str, keep, wide: int | None = None) -> Column:
    """Array of (start, end, kind, text) of the matches of pattern that keep(match, group) lets pass."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(wide)) if wide else found

    def placed(rows):
        length = lambda r: F.coalesce(F.length(r["hit"]), F.lit(0))  # noqa: E731  the last piece has no match behind it
        before = running(F.transform(rows, lambda r: r["gap"] + length(r)), _plus)
        start = lambda r, at: at + r["gap"]
        return F.zip_with(rows, before, lambda r, at: F.struct(start(r, at).alias("start"), (start(r, at) + length(r)).alias("end"), F.lit(kind).alias("kind"), r["hit"].alias("hit"), r["inner"].alias("inner")))

    spans = _bound(F.arrays_zip(gaps.alias("gap"), found.alias("hit"), inner.alias("inner")), placed)
    return F.filter(spans, lambda s: s["hit"].isNotNull() & keep(s["hit"], s["inner"]))


def _guarded(text: Column, probe: str, spans: Column) -> Column:
    """spans, worked out only for texts in which probe occurs."""
    return F.when(text.rlike(probe), spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans of the three base kinds: assign, access, hex."""
    # A run of 24 or more hex digits is a match of [0-9a-f]+ that passes, and the same holds for access keys.
    assign = _guarded(text, ASSIGN, spans_of(text, ASSIGN, "assign", lambda m, g: F.length(g) >= ASSIGN_LEAST, 2))
    access = _guarded(text, "AKIA[A-Z0-9]{16}", spans_of(text, ACCESS, "access", lambda m, g: F.length(m) >= ACCESS_LEAST))
    hexes = _guarded(text, "[0-9a-f]{24}", spans_of(text, "[0-9a-f]{24,}+", "hex", lambda m, g: F.length(m) >= HEX_LEAST))
    return assign, access, hexes


def highest_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits per character, of the windows of s; of all of s if it is shorter.

    Null if s is null, 0 if it is empty.
    """
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    xlogx = F.array(*[F.lit(0.0)] + [F.lit(float(k)) * F.log2(F.lit(float(k))) for k in range(1, window + 2)])
    size = len(_ALPHABET) + 1
    start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(0.0).alias("best"))

    def place(c):
        return F.instr(F.lit(_ALPHABET), c)  # 0 for any other character

    def change(counts, at, by):
        return F.concat(F.slice(counts, 1, at), F.array(F.element_at(counts, at + 1) + by), F.slice(counts, at + 2, size))

    def step(state, c):
        i, gone = state["i"] + 1, place(c["gone"])
        out = i > window
        n_gone = F.element_at(state["counts"], gone + 1)
        kept = F.struct(
            F.when(out, change(state["counts"], gone, F.lit(-1))).otherwise(state["counts"]).alias("counts"),
            F.when(out, state["sum"] - F.element_at(xlogx, n_gone + 1) + F.element_at(xlogx, F.greatest(n_gone, F.lit(1)))).otherwise(state["sum"]).alias("sum"),
        )
        return _bound(kept, lambda k: add(k, place(c["come"]), i, state["best"]))

    def add(kept, at, i, best):
        n = F.element_at(kept["counts"], at + 1)
        total = kept["sum"] - F.element_at(xlogx, n + 1) + F.element_at(xlogx, n + 2)
        return F.struct(change(kept["counts"], at, F.lit(1)).alias("counts"), total.alias("sum"), i.alias("i"), F.when(i >= window, F.greatest(best, bits(total, F.lit(float(window))))).otherwise(best).alias("best"))

    def bits(total, held):
        return F.log2(held) - total / held

    def steps(chars):
        # Character after character, each with the one that leaves the window as it comes.
        gone = F.concat(F.array_repeat(F.lit(""), window), F.slice(chars, 1, F.greatest(F.size(chars) - window, F.lit(0))))
        return F.zip_with(chars, F.slice(gone, 1, F.greatest(F.size(chars), F.lit(1))), lambda c, g: F.struct(c.alias("come"), F.coalesce(g, F.lit("")).alias("gone")))

    rows = F.when(s == "", F.expr("cast(array() as array<struct<come:string,gone:string>>)")).otherwise(_bound(F.filter(F.split(s, ""), lambda c: c != ""), steps))
    return F.aggregate(rows, start, step, lambda x: F.when((x["i"] >= window) | (x["i"] == 0), x["best"]).otherwise(bits(x["sum"], x["i"].cast("double"))))


def looks_random(hit: Column) -> Column:
    """Whether a candidate's highest window reaches the entropy of its class and no allow-list entry fits."""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | hit.rlike(pattern)
    least = F.when(hit.rlike("^[0-9a-fA-F]+$"), LEAST_BITS["hex"]).when(hit.rlike("^[A-Za-z0-9]+$"), LEAST_BITS["alnum"]).otherwise(LEAST_BITS["base64"])
    mixed = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.when(allowed | ~mixed, F.lit(False)).otherwise(highest_entropy(hit) >= least)


#: Order of kinds that start at one place.
_KINDS = ("assign", "access", "hex", "entropy")


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")


def _sorted(spans: list[Column]) -> Column:
    """Spans (start, k, end, kind) by start, then kind as listed."""
    order = F.create_map(*[F.lit(x) for pair in zip(_KINDS, range(len(_KINDS))) for x in pair])
    return F.array_sort(F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _uncovered(spans: Column) -> Column:
    """Sorted spans without entropy spans that lie within a base span."""

    def free(spans):
        # A base span of the same start comes first, so the farthest end before a span is of those that could hold it.
        ends = running(F.transform(spans, lambda s: F.when(s["kind"] == "entropy", 0).otherwise(s["end"])), F.greatest)
        pairs = F.arrays_zip(spans.alias("s"), ends.alias("far"))
        return F.transform(F.filter(pairs, lambda p: (p["s"]["kind"] != "entropy") | (p["far"] < p["s"]["end"])), lambda p: p["s"])

    return _bound(spans, free)


def scan(documents: DataFrame) -> DataFrame:
    """Adds __skarn_spans, the sorted array of spans (start, k, end, kind), to all columns of documents.

    Null text counts as empty: no spans. Spans of several kinds may overlap; entropy spans that a base
    span covers are left out. Repeated rows are scanned one by one. Time is about linear in a text's
    length, and grows with the power 1.5 of the number of its spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    entropy = _guarded(text, f"[A-Za-z0-9+/_-]{{{CANDIDATE_LEAST}}}", spans_of(text, CANDIDATE, "entropy", lambda m, g: looks_random(m)))
    return documents.withColumn("__skarn_spans", _uncovered(_sorted([*base_spans(text), entropy])))


def scan_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; see scan()."""
    found = scan(select_as(documents, doc_id="long", text="string"))
    count = lambda kind: F.size(F.filter("__skarn_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in _KINDS[:3]],
        F.sha2(_listed(F.filter("__skarn_spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        _listed(F.col("__skarn_spans")).alias("spans"),
    )


#: Code points of a piece that a long text is cut into, so that a part of it is found without walking from its start.
PIECE = 4096


def mask_secrets(documents: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """documents with every span replaced by mask, overlapping spans by one; n_chars follows if there is one.

    Rows without spans are unchanged, null text stays null.
    """
    text, columns = F.col("text"), documents.columns

    def part(pieces, start, end):
        """Code points from start up to end."""
        first = F.floor(start / PIECE).cast("int")
        held = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))

    def masked(row):
        """The text before each span that starts beyond all earlier ones, with the mask behind it, and the rest."""
        far = running(F.transform(row["spans"], lambda s: s["end"]), F.greatest)
        cuts = F.filter(F.arrays_zip(row["spans"].alias("s"), far.alias("far")), lambda p: p["s"]["start"] >= p["far"])
        last = F.array_max(F.transform(row["spans"], lambda s: s["end"]))
        kept = F.transform(cuts, lambda p: F.concat(part(row["pieces"], p["far"], p["s"]["start"]), F.lit(mask)))
        return F.concat(F.array_join(kept, ""), part(row["pieces"], last, F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = _bound(F.struct(pieces.alias("pieces"), F.col("__skarn_spans").alias("spans")), masked)
    hit = F.size("__skarn_spans") > 0
    out = scan(documents).withColumn("text", F.when(hit, clean).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)
