"""BPE against the tokenizers library, Merkle proofs against a plain Python tree."""

import hashlib
import random
import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from prepline.llm import bpe, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, idx long, hash string, ids string, tree string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_file())


def test_words_equal_the_library(library):
    own, tokens = bpe.load(bpe.default_file()), bpe.load_tokens(bpe.default_file())
    rng = random.Random(3)
    letters = "ab e'stllre  \n\t\r\x00\x1c\x85\xa0　éß中文𝒳١²Ⅳͅ​😀.,!?<|>0123"
    pieces = ["<|endoftext|>", " the", "'ll", "'s", "aaaa", "  ", "\n\n", "hello", "World", " 1234", "ẞ", "ſ"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) if rng.random() < 0.2 else rng.choice(letters) for _ in range(rng.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert list(memoryview(got).cast("I")) == ids, text
        assert bpe.text_of(got, tokens) == library.decode(ids, skip_special_tokens=False)
    for _ in range(1000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]
        assert bpe.text_of(array("I", ids).tobytes(), tokens) == library.decode(ids, skip_special_tokens=False)


def test_long_words_and_full_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PARTS", 3)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 50)
    own = bpe.Bpe(bpe.default_file())
    for text in ["a" * 30_000, "ab" * 5_000 + " " + "=" * 9_000, " " * 7_000 + "x", " ".join(f"word{k} wört{k}." for k in range(300))]:
        assert list(memoryview(own.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark, library):
    texts = [None, "", " ", "plain words\nand more", "<|endoftext|> x", "中文 text", "a" * 3000]
    rows = [(k if k % 3 else None, t, "en", None, 1, 7, "h", "i", "t") for k, t in enumerate(texts + texts)]
    docs = spark.createDataFrame(rows, DOCS)
    enc = bpe.encode(docs)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"])) for r in enc.collect()))
    want = sorted((k is None, k or 0, array("I", library.encode(t or "", add_special_tokens=False).ids).tobytes()) for k, t, *_ in rows)
    assert got == want
    back = bpe.decode(enc.withColumn("text", F.lit("other")))
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for t in texts + texts)
    assert [r["text"] for r in bpe.decode(enc.limit(1).withColumn("ids", F.lit(None).cast("binary"))).collect()] == [""]
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 16 * 16
        out.append((level[lo:i], level[i + 1 : lo + 16]))
        i //= 16
    return out


def brute(rows):
    def leaf(r, text):
        vals = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))

    by = {}
    for r in rows:
        own = leaf(r, r["text"])
        low = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        by.setdefault(r["source"], []).append((r["doc_id"], own, leaf(r, low) if hit else own))
    trees, order = {}, sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree_of([x[1] for x in by[s]])
    top = tree_of([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, (doc, own, claimed) in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, j)
            value = claimed
            for a, b in steps:
                value = sha(*a, value, *b)
            proof = "".join(x for a, b in steps for x in a + b)
            out.append((doc, own, trees[s][-1][0], top[-1][0], sha(proof), value, value == top[-1][0], proof))
    return out


@pytest.mark.parametrize(("n_sources", "block"), [(1, 4096), (3, 7), (40, 50)])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, n_sources, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(n_sources)
    rows = []
    for k in range(700):
        source = None if k % 11 == 0 else "hot" if k % 3 == 0 else f"s{rng.randrange(n_sources)}é"
        text = rng.choice([None, "", "lower", "Upper Text", "ÄÖ Ü"])
        rows.append((rng.choice([None, k, k, k, 5]), text, rng.choice(["en", None]), source, rng.choice([None, k]), 1, "x", "y", "z"))
    rows += [rows[3]] * 40
    docs = spark.createDataFrame(rows, DOCS)
    got = merkle.prove(merkle.manifest(merkle.document_leaves(docs)), "claimed", with_proofs=True).collect()
    want = brute([r.asDict() for r in docs.collect()])
    key = lambda t: (t[0] is not None, t[0] or 0, *t[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert not all(r["verified"] for r in got) and sum(r["verified"] for r in got) > 500


def test_single_leaf_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", None, "s", 1, 1, "h", "i", "t")], DOCS)
    (r,) = merkle.prove(merkle.manifest(merkle.document_leaves(docs))).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == sha()
    assert merkle.prove(merkle.manifest(merkle.document_leaves(docs.limit(0)))).count() == 0


def test_missing_is_minimal():
    assert merkle.missing(range(16, 32), 64) == [(1, 0), (1, 2), (1, 3)]
    assert merkle.missing([0], 1) == []
    assert merkle.missing([3], 5) == [(0, 0), (0, 1), (0, 2), (0, 4)]
