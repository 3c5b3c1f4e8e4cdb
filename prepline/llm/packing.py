"""Operator 1, best-fit packing: hierarchical residual packing.

Documents become token ids once, in tasks; what is packed afterwards are narrow rows (piece,
length). Each group of items is packed by best fit, longest first. Bins whose free room is
at most ``slack`` are final; the others go on as items of their own into the next round,
where ``fan_in`` groups meet in one, until one group is left or a round joins nothing more.
The number of groups also follows the number of open bins, so no task ever holds more than
about ``GROUP_ROWS`` items, and the root is as bounded as the leaves. Each round is
checkpointed; a lost executor repeats its groups with the same content.

Token ids: a block of texts is cut, in numpy over its bytes, only where the pre-tokenizer always
ends a token, so the parts have the ids they have in the whole text. Arrow finds the distinct
parts and puts their ids back in order. A part is encoded once per worker, until the cache is full;
parts without inner white space are encoded together, as lines of one text.

Defined results: a null or empty text is the end token alone; repeated rows are packed each
on their own, as are rows with a null doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from prepline.llm.common import ceil_div, cut, small_batches

SEQUENCE = 1024
END_ID = 2
GROUP_ROWS = 100_000
CACHE_WORDS = 300_000
CACHE_BYTES = 32 << 20

#: bytes of text encoded at once, unless a single text has more
BLOCK = 4 << 20

_BYTE = np.arange(256)
#: parts of these characters only are cut alike by every version of the Unicode tables
_PLAIN = re.compile(r"[\n -\u024f]*")
#: first bytes of characters beyond ASCII of which none is white space
_FIRST = ((_BYTE >= 0xC3) & (_BYTE < 0xE0)) | (_BYTE >= 0xE4)
#: bytes of white space, control characters and characters beyond U+023F
_OTHER = (_BYTE < 0x21) | (_BYTE == 0x7F) | (_BYTE >= 0xC9)


def bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts (none null), one after the other, and where they begin and end."""
    _, where, data = texts.buffers()
    at = np.frombuffer(where or bytes(8), dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the UTF-8 bytes of texts, which begin and end at ``at``, are cut: at their ends and where
    the pre-tokenizer always ends a token: in front of a space or line break behind a character that is
    not white space, behind a single line break between such, and between a letter and a full stop or comma."""
    seen = data - np.uint8(0x21) < 0x5E
    beyond = np.flatnonzero(data >= 0x80)
    if len(beyond):
        first = data[beyond] >= 0xC0
        seen[beyond] = _FIRST[data[beyond][first]][np.cumsum(first) - 1]
    end = np.zeros(len(data) + 1, dtype=bool)
    line = data == 0x0A
    blank = np.flatnonzero(line | (data == 0x20))
    end[blank[seen[blank - 1]]] = True
    line = np.flatnonzero(line[:-1])
    end[line[seen[line - 1] & seen[line + 1]] + 1] = True
    stop = np.flatnonzero((data == 0x2E) | (data == 0x2C))
    end[stop[(data[stop - 1] | np.uint8(0x20)) - np.uint8(0x61) < 26]] = True
    end[at] = True
    return np.flatnonzero(end)


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    ``ranks_file`` holds the same vocabulary for a faster encoder, which takes the parts of
    plain characters; all other parts go through the tokenizer itself."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.plain = None
        if ranks_file is not None:
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            (self.line_end,) = self.plain("\n")
        self.forget()

    def forget(self) -> None:
        self.parts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def learn(self, parts: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each part."""
        data, at = bytes_of(parts)
        other = _OTHER[data]
        other[at[:-1]] &= data[at[:-1]] != 0x20
        # control characters and the no-break space from U+0080 on; what may begin a special token
        other[1:] |= (data[:-1] == 0xC2) & (data[1:] <= 0xA0) | (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        line = np.full(len(parts), self.plain is not None)
        line[np.searchsorted(at, np.flatnonzero(other), side="right") - 1] = False
        known = self._learn_lines(parts.filter(pa.array(line)))
        if line.all():
            return known
        known = pa.concat_arrays([known, self._learn_rest(parts.filter(pa.array(~line)).to_pylist())])
        return known.take(pa.array(np.argsort(np.argsort(~line, kind="stable"))))

    def _learn_lines(self, lines: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of parts without white space but for one space in front: they become the lines of one
        text, whose line breaks, in front of a space or not, are tokens of their own."""
        if not len(lines):
            return pa.array([], pa.large_binary())
        data, at = bytes_of(lines)
        ids = np.array(array("I", self.plain(np.insert(data, at[1:-1], 0x0A).tobytes().decode())), dtype="<u4")
        ends = np.flatnonzero(ids == self.line_end)
        ids = np.delete(ids, ends)
        where = np.concatenate(([0], ends - np.arange(len(ends)), [len(ids)]))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lines), [None, pa.py_buffer(4 * where), pa.py_buffer(ids)])

    def _learn_rest(self, parts: list[str]) -> pa.LargeBinaryArray:
        known: dict[str, bytes] = {}
        rest = []
        for p in parts:
            if self.plain is not None and "<|" not in p and _PLAIN.fullmatch(p):
                known[p] = array("I", self.plain(p)).tobytes()
            else:
                rest.append(p)
        for i in range(0, len(rest), 1024):
            some = rest[i : i + 1024]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[p] = array("I", e.ids).tobytes()
        return pa.array([known[p] for p in parts], pa.large_binary())

    def encode_block(self, data: np.ndarray, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids of the texts that lie in the UTF-8 bytes ``data`` and begin and end at ``at``, one
        after the other, and where in these bytes of ids each text's begin and end."""
        ends = cuts(data, at)
        parts = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))
        if len(self.parts) > CACHE_WORDS or self.parts.nbytes + self.ids.nbytes > CACHE_BYTES:
            self.forget()
        n = len(self.parts)
        # the known parts come first, so they keep their numbers and new ones follow
        coded = pa.concat_arrays([self.parts, parts]).dictionary_encode()
        self.ids = pa.concat_arrays([self.ids, self.learn(coded.dictionary.slice(n))])
        self.parts = coded.dictionary
        ids = self.ids.take(coded.indices.slice(n))
        _, where, flat = ids.buffers()
        where = np.frombuffer(where, dtype=np.int64, count=len(ids) + 1)
        return memoryview(flat or b""), where[np.searchsorted(ends, at)]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encode_block(*bytes_of(pa.array(texts, pa.large_string())))
        return [bytes(ids[lo:hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(1)
def load(tokenizer_file: str, ranks_file: str | None) -> Encoder:
    """The vocabulary of a file and the parts encoded so far, once per worker."""
    return Encoder(tokenizer_file, ranks_file)


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts (none null) in blocks of about ``BLOCK`` bytes: (number of the first one, the block's UTF-8
    bytes, where in them the texts begin and end)."""
    data, at = bytes_of(texts.cast(pa.large_string()))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, side="right")) - 1)
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole if it fits, else pieces of ``size`` of which
    the first may be shorter."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def tokenize(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text) -> pieces (doc_id as text, piece, start, length, ids_crc32)."""
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(tokenizer_file, ranks_file)
        for b in batches:
            for first, data, at in blocks(b.column("text")):
                ids, where = enc.encode_block(data, at)
                out = []
                for k, (lo, hi) in enumerate(zip(where[:-1].tolist(), where[1:].tolist(), strict=True), first):
                    pieces = cut_pieces((hi - lo) // 4 + 1, size)
                    for p, (s, n) in enumerate(pieces):
                        crc = zlib.crc32(ids[lo + 4 * s : min(lo + 4 * (s + n), hi)])
                        out.append((k, p, s, n, crc if p + 1 < len(pieces) else zlib.crc32(end, crc)))
                k, p, s, n, crc = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(k)), pa.array(p.astype(np.int32)), *map(pa.array, (s, n, crc))], names=names)

    # ids pass through pandas as text later: a column of integers with nulls would turn into floats
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(
        run, "doc_id string, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin, offset) of each item and the fill of each bin. The bins of
    one free room are a stack; the set of rooms in use is one integer's bits."""
    order = np.argsort(-sizes, kind="stable")
    bin_of = np.empty(len(sizes), dtype=np.int64)
    offset = np.empty(len(sizes), dtype=np.int64)
    fill: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i, n in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = rooms >> n
        if fit:
            room = n + ((fit & -fit).bit_length() - 1)
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            open_bins[room - n].append(b)
            rooms |= 1 << (room - n)
    return bin_of, offset, np.array(fill, dtype=np.int64)


def pack_group(capacity: int, slack: int):
    """One group of open bins, given as the rows of their pieces, packed by best fit."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "offset"], kind="stable").reset_index(drop=True)
        items, of = np.unique(rows["item"].to_numpy(), return_inverse=True)
        size = np.bincount(of, weights=rows["length"].to_numpy()).astype(np.int64)
        bin_of, offset, fill = best_fit(size, capacity)
        # the new bin's id is the smallest id among its items: unique, as items are
        name = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(name, bin_of, items)
        rows["item"] = name[bin_of][of]
        rows["offset"] = rows["offset"].to_numpy() + offset[of]
        rows["final"] = (capacity - fill <= slack)[bin_of][of]
        return rows

    return run


def pack(pieces: DataFrame, capacity: int = SEQUENCE, slack: int = 8, fan_in: int = 8, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces (with length <= capacity) -> the same rows and sequence_id, offset.

    Pieces that fill a sequence alone are final at once. ``item`` numbers the current bins: a
    piece's own id at first, later its bin's."""
    cols = pieces.columns
    tagged = cut(pieces.withColumn("item", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))
    full = tagged.where(F.col("length") >= capacity).withColumn("sequence_id", F.col("item"))
    done = [full.select(*cols, "sequence_id", "offset")]
    open_rows = tagged.where(F.col("length") < capacity)
    n_items = open_rows.count()
    groups = max(1, ceil_div(n_items, group_rows))
    schema = StructType([*open_rows.schema.fields, StructField("final", BooleanType())])
    rounds = 0
    while n_items:
        rounds += 1
        g = F.pmod(F.xxhash64("item", F.lit(rounds)), F.lit(groups))
        packed = cut(open_rows.groupBy(g.alias("g")).applyInPandas(pack_group(capacity, slack), schema))
        left = packed.where(~F.col("final")).agg(F.count_distinct("item")).first()[0]
        last = groups == 1 or left >= n_items
        now = packed if last else packed.where("final")
        done.append(now.withColumn("sequence_id", F.col("item")).select(*cols, "sequence_id", "offset"))
        if last:
            break
        open_rows = packed.where(~F.col("final")).drop("final")
        n_items, groups = left, max(ceil_div(groups, fan_in), ceil_div(left, group_rows))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def sequences(docs: DataFrame, tokenizer_file: str | None = None, ranks_file: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = str(public_tokenizers.path("byte_bpe_50k.json"))
        ranks_file = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with small_batches(docs.sparkSession):
        out = pack(tokenize(docs, tokenizer_file, ranks_file))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    return sequences(table(spark, sf_dir, "documents"))
