"""Operator 11, BPE encoding and decoding: per-prefix dynamic programming.

A byte-level BPE encoding of a word is found without merging anything. For every prefix of the
word's bytes the last token of the prefix's own encoding is unique, so one pass from left to
right stores it: an automaton over the vocabulary gives all tokens that are a suffix of the
prefix, and the one is kept that is *compatible* with the last token of what lies before it.
Following the stored tokens back from the whole word gives the exact ids.

Two neighbouring tokens are compatible if merging their joined bytes leaves them as they are:
no merge across their border may come before both sides have finished. Only the tokens along
the right edge of the first token's merge tree and the left edge of the second one's ever touch
the border, so the test looks at those few pairs. On equal ranks the merge further left is first.

Texts are cut where the pre-tokenizer always ends a word. Words with characters beyond U+024F
(and odd control characters) are cut by the tokenizer's own pre-tokenizer, so that the Unicode
tables of its version decide. Distinct parts are encoded once per worker, until the cache is full.
There is no shuffle: rows are encoded where they are read.

Defined results: a null or empty text has no ids and decodes to an empty text; rows with a null or
repeated doc_id each stay; null ids decode to an empty text; an empty table gives no rows; other
columns are ignored. A very long word needs one stored token per byte.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CACHE_PARTS = 400_000
CACHE_WORDS = 400_000
CACHE_PAIRS = 1_000_000
#: rows encoded at once
ROWS = 256
_NEVER = 1 << 40
#: what stands before the first token
_START = (-1, 0, {})
_PAIR = re.compile(r"\s\s")
_EDGE = re.compile(r"(?<=\S) (?=\S)")
_LINE = re.compile(r"(?<=\S)(\n)(?=\S)")


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


_TO_BYTE = {ord(c): b for c, b in byte_alphabet().items()}


def token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of every token id of a tokenizer file."""
    own = {i: t.translate(_TO_BYTE).encode("latin-1") for t, i in spec["model"]["vocab"].items()}
    return own | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def text_of(ids: bytes, tokens: dict[int, bytes]) -> str:
    """The text of ids, ill-formed UTF-8 replaced as the tokenizer's own decoder does."""
    return b"".join(map(tokens.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class Bpe:
    """A byte-level BPE vocabulary, for encoding by prefixes."""

    def __init__(self, tokenizer_file: str) -> None:
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model["type"] != "BPE" or spec["normalizer"] or any(pre.get(k, v) != v for k, v in plain.items()) or pre.get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without normalizer and prefix space")
        if model.get("ignore_merges") or model.get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("vocabulary options beyond plain merges")
        self.pre_tokenize = Tokenizer.from_file(tokenizer_file).pre_tokenizer.pre_tokenize_str
        self.to_byte = _TO_BYTE
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        #: characters whose classes every version of the Unicode tables agrees on
        self.plain = regex.compile(r"[\t\n\r -ɏ]*")
        vocab = model["vocab"]
        self.bytes_of = token_bytes(spec)
        self._trees(vocab, model["merges"])
        self.automaton = ahocorasick.Automaton()
        #: (id, length, ids of tokens known to stand before it or not)
        self.tokens = [(i, len(self.bytes_of[i]), {-1: True}) for i in self.right_edge]
        for t in self.tokens:
            self.automaton.add_word(self.bytes_of[t[0]].decode("latin-1"), t)
        self.automaton.make_automaton()
        self.n_pairs = 0
        self.words: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def _trees(self, vocab: dict[str, int], merges: list) -> None:
        """The edges of each token's merge tree: (token, rank of the merge that takes it up) from
        the token itself inwards. A token whose own merges do not lead to it has none and never occurs."""
        self.rank: dict[tuple[int, int], int] = {}
        self.right_edge: dict[int, list[tuple[int, int]]] = {}
        self.left_edge: dict[int, list[tuple[int, int]]] = {}
        for t, i in vocab.items():
            if len(t) == 1:
                self.right_edge[i] = self.left_edge[i] = [(i, _NEVER)]
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), r)
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if t in self.right_edge or x not in self.right_edge or y not in self.right_edge or self._broken(x, y, r):
                continue
            self.right_edge[t] = [(t, _NEVER), (y, r), *self.right_edge[y][1:]]
            self.left_edge[t] = [(t, _NEVER), (x, r), *self.left_edge[x][1:]]

    def _broken(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether a merge of a rank below ``before`` crosses the border between tokens a and b."""
        for x, ends_x in self.right_edge[a]:
            for y, ends_y in self.left_edge[b]:
                r = self.rank.get((x, y))
                if r is not None and r < ends_x and r <= ends_y and r < before:
                    return True
        return False

    def compatible(self, a: int, token: tuple) -> bool:
        """Whether token may follow token id a; remembered with the token."""
        if self.n_pairs >= CACHE_PAIRS:
            self.n_pairs = 0
            for t in self.tokens:
                t[2].clear()
                t[2][-1] = True
        self.n_pairs += 1
        ok = token[2][a] = not self._broken(a, token[0])
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as one character (U+0000 to U+00FF) per byte."""
        n = len(word)
        last: list[tuple | None] = [None] * (n + 1)  # the last token of each prefix
        last[0] = _START
        for end, token in self.automaton.iter(word):
            if last[end + 1] is None:
                before = last[end + 1 - token[1]]
                if before is not None:
                    ok = token[2].get(before[0])
                    if ok is None:
                        ok = self.compatible(before[0], token)
                    if ok:
                        last[end + 1] = token
        out = []
        while n:
            token = last[n]
            if token is None:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(token[0])
            n -= token[1]
        out.reverse()
        return out

    def words_of(self, part: str) -> Iterator[str]:
        """The pre-tokenizer's words of a part without special tokens, one character per byte."""
        if self.plain.fullmatch(part):
            for w in self.word.findall(part):
                yield w if w.isascii() else w.encode().decode("latin-1")
        else:
            for w, _ in self.pre_tokenize(part):
                yield w.translate(self.to_byte)

    def encode_part(self, part: str) -> bytes:
        out = []
        for k, piece in enumerate(self.marks.split(part) if self.marks and self.marks.search(part) else [part]):
            if k % 2:
                out.append(array("I", [self.special[piece]]).tobytes())
            elif piece:
                for w in self.words_of(piece):
                    e = self.words.get(w)
                    if e is None:
                        e = array("I", self.encode_word(w)).tobytes()
                        if len(w) <= 64:
                            self.words[w] = e
                    out.append(e)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers. It is cut at single line breaks
        and in front of single spaces, where the pre-tokenizer always ends a word."""
        out: list[bytes] = []
        for line in _LINE.split(text) if "\n" in text else [text]:
            parts = _EDGE.split(line) if _PAIR.search(line) else line.split(" ")
            first = self.firsts.get(parts[0])
            out.append(self._learn(self.firsts, parts[0], parts[0]) if first is None else first)
            del parts[0]
            known = list(map(self.others.get, parts))
            if None in known:
                known = [self._learn(self.others, p, " " + p) if e is None else e for p, e in zip(parts, known, strict=True)]
            out.extend(known)
        return b"".join(out)

    def _learn(self, known: dict[str, bytes], key: str, part: str) -> bytes:
        e = self.encode_part(part)
        if len(part) <= 64:
            if len(known) > CACHE_PARTS:
                known.clear()
            known[key] = e
        return e


@lru_cache(1)
def load(tokenizer_file: str) -> Bpe:
    """The vocabulary of a file, read once per worker."""
    return Bpe(tokenizer_file)


@lru_cache(1)
def load_tokens(tokenizer_file: str) -> dict[int, bytes]:
    """What decoding needs of a file, read once per worker."""
    with open(tokenizer_file, encoding="utf-8") as f:
        return token_bytes(json.load(f))


def default_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encode(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (binary: little-endian unsigned 32-bit ids)."""
    file = tokenizer_file or default_file()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                some = b.slice(lo, ROWS)
                ids = pa.array([bpe.encode(t) for t in some.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *_fields("ids binary")]))


def _fields(ddl: str) -> list[StructField]:
    return list(StructType.fromDDL(ddl).fields)


def decode(encoded: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Rows with ``ids`` as of :func:`encode` -> the same rows, ``text`` in place of ids."""
    file = tokenizer_file or default_file()
    others = [c for c in encoded.columns if c not in ("ids", "text")]
    rows = encoded.select(*others, F.coalesce("ids", F.lit(b"")).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load_tokens(file)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                some = b.slice(lo, ROWS)
                text = pa.array([text_of(i, tokens) for i in some.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in others), text], names=[*others, "text"])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in others), StructField("text", StringType())]))


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    ids = encode(table(spark, sf_dir, "documents")).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    back = decode(ids.withColumn("ids_sha256", F.sha2("ids", 256)))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
