"""Against the tokenizers library, and round trips."""

import random

import numpy as np
import pytest

from skarn.llm import bpe_lexicon as B
from skarn.llm.queries import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    return tokenizers.Tokenizer.from_file(path)


def odd_texts():
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(1, 0x180), 0x1680, 0x2000, 0x2028, 0x3000, 0x200B, 0x660, 0x2160, 0x4E00, 0x1F600, 0x300, 0x17F, 0x212A]]
    out = ["", "<|endoftext|>" * 3, "a" * 3000, "ab" * 2000 + " " * 300 + "x", "  \n\n  'll 's don't"]
    for k in range(400):
        s = "".join(rng.choice(pool) if rng.random() < 0.3 else rng.choice(" \t\n'abcdefst019RE.,<|>") for _ in range(rng.randrange(0, 60)))
        out.append(s + "<|endoftext|>x" if k % 9 == 0 else s)
    return out


def test_ids_are_the_librarys(path, library):
    t = B.Tokenizer(path)
    lexicon = B.Lexicon(B.compile_lexicon({w.encode(): t.merge(w.encode()) for w in [" the", "the", " thing", "thing", "ing", "a", "'s", " über"]}))
    encoder, texts = B.Encoder(t, lexicon), odd_texts()
    ids, edge = encoder.encode(texts)
    for i, s in enumerate(texts):
        want = library.encode(s, add_special_tokens=False).ids
        assert ids[edge[i] : edge[i + 1]].tolist() == want
        assert encoder.decode(np.array(want, np.int64)).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_transducer_is_minimal_and_exact(path):
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))).encode() for _ in range(300)}
    table = {w: [i, i + 1] for i, w in enumerate(sorted(words))}
    data = B.compile_lexicon(table)
    lexicon = B.Lexicon(data)
    asked = sorted(words) + [b"", b"d", b"abcabcabca", b"ac" * 20]
    assert lexicon.find(asked) == [table.get(w) for w in asked]
    # Minimal: no two states accept the same endings.
    n = len(lexicon.final)
    right: dict = {}
    for s in range(n):
        arcs = [(int(k) & 255, int(t)) for k, t in zip(lexicon.keys, lexicon.target) if int(k) >> 8 == s]
        language = frozenset([b""] if lexicon.final[s] else []) | frozenset(bytes([b]) + e for b, t in arcs for e in right[t])
        right[s] = language
    assert len(set(right.values())) == n


def test_lexicon_is_mapped_from_a_file(tmp_path):
    B.compile_lexicon({b"ab": [7]}).tofile(tmp_path / "x.bin")
    assert B.Lexicon(str(tmp_path / "x.bin")).find([b"ab", b"a"]) == [[7], None]
    assert B.Lexicon(B.compile_lexicon({})).find([b"a", b""]) == [None, None]


def test_long_words_merge_alike(path):
    t, rng = B.Tokenizer(path), random.Random(1)
    for _ in range(60):
        w = bytes(rng.choice(b"abthe ing") for _ in range(rng.randrange(1, 150)))
        assert t.merge(w) == t.merge_long(w) == t.merge_many([b"", w, w * 3])[1]


def test_query_rows(documents, path, library):
    import hashlib

    got = sorted((tuple(r) for r in B.round_trip(documents, path, 50).collect()), key=str)
    want = []
    for r in documents.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_and_decode_tables(documents, path):
    name = B.build_lexicon(documents, path, 50)
    encoded = B.encode_documents(documents, path, name)
    back = {r["doc_id"]: r["text"] for r in B.decode_documents(encoded, path).collect()}
    for r in documents.collect():
        assert back[r["doc_id"]] == (r["text"] or "")


def test_empty(empty, path):
    assert B.round_trip(empty, path).collect() == []


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    """Texts cut into pieces have the ids that whole ones have."""
    import tokenizers

    monkeypatch.setattr(B, "PIECE_CHARS", 40)
    path = tokenizer_file("byte_bpe_50k.json")
    rng = random.Random(21)
    bits = ["word", "it's", "x" * 70, "  ", " ", "\n", "123", "é", "ü", "!?", "<|endoftext|>", "a b c", "日本"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(n)) for n in (1, 10, 100, 400)] + ["", None]
    ids, edge = B.Encoder(B.Tokenizer(path), B.Lexicon(B.compile_lexicon({}))).encode(texts)
    library = tokenizers.Tokenizer.from_file(path)
    for t, a, b in zip(texts, edge, edge[1:]):
        assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids
