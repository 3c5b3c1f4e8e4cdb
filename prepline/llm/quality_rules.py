"""Operator 6, quality rules: repetition by suffix array.

The words of many documents are one array with the document as part of every symbol, so
suffixes of different documents differ at once. Prefix doubling ranks the suffixes: after k
steps equal ranks mean equal runs of 2^k words, and only suffixes that still share a rank go
on, so ordinary text is done after a few steps. Suffixes that share ``MIN_REPEAT`` words with
another one are sorted in full; the longest common prefixes of neighbours are read off the
ranks from long to short, or, where these would need more than ``LEVEL_RANKS`` numbers (very
long texts that repeat throughout), found in text order, each from the one before. A suffix's
deepest LCP interval is its longest maximal repeat, so the union of those spans is the union
over all maximal repeats of at least ``MIN_REPEAT`` words; with ``BASE_WINDOW`` words it is the
union of the base rule's windows.

Verdict: a document fails the base rules (too few words, or repeated 8-word windows over 30 %
of the words), or the method's limits: maximal repeats of ``MIN_REPEAT`` words or more cover
more than ``MAX_COVERED`` of the words (phrases said again and again, too short for the base
rule's windows), or one repeat is longer than ``MAX_LONGEST`` of the words (and than
``LONGEST_FLOOR`` words).

Defined results: a null or empty text has no words and fails the base rules; repeated rows
each keep their row; an empty table gives no rows. Texts are taken whole; tasks work through
blocks of about ``BLOCK_CHARS`` characters, a longer text is a block of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_WINDOW = 8
MIN_REPEAT = 4  # a power of two
MAX_COVERED = 0.50
MAX_LONGEST = 0.20
LONGEST_FLOOR = 50
MIN_WORDS = 20
SYMBOLS = "#*$%&|<>"
BLOCK_CHARS = 2_000_000
LEVEL_RANKS = 64_000_000

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_BLANKS = " \t\n\x0b\x0c\r"


def repeats(symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents laid end to end (``symbols`` distinct between documents, ``ends`` the end of
    each position's document, ``lengths`` of the documents), of each document: the words covered
    by maximal repeats of at least BASE_WINDOW words, the same of at least MIN_REPEAT words, and
    the longest of these repeats."""
    n, m = len(symbols), len(lengths)
    none = np.zeros(m, dtype=np.int64)
    if n == 0:
        return none, none, none
    counts = np.bincount(symbols)
    rank = (np.cumsum(counts) - counts)[symbols]  # a class's rank: its first place in sorted order
    active = np.flatnonzero(counts[symbols] > 1)
    levels, step, shared = [rank.copy()], 1, active
    while len(active):
        after = active + step
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        at, first, second = active[order], rank[active][order], second[order]
        new_first = np.r_[True, first[1:] != first[:-1]]
        new = new_first | np.r_[True, second[1:] != second[:-1]]
        here = np.arange(len(at))
        start = here[new][np.cumsum(new) - 1]
        rank[at] = first + start - here[new_first][np.cumsum(new_first) - 1]
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        active = at[size > 1]
        step *= 2
        if levels is not None:
            levels = [*levels, rank.copy()] if (len(levels) + 1) * n <= LEVEL_RANKS else None
        if step == MIN_REPEAT:
            shared = active
    if step < MIN_REPEAT or not len(shared):
        return none, none, none
    sa = shared[np.argsort(rank[shared], kind="stable")]
    lcp = prefixes_in_text_order(symbols, ends, sa) if levels is None else prefixes_by_levels(levels, ends, sa)
    longest = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    doc = np.repeat(np.arange(m), lengths)

    def covered(least: int) -> np.ndarray:
        edge = np.zeros(n + 1, dtype=np.int64)
        keep = longest >= least
        np.add.at(edge, sa[keep], 1)
        np.add.at(edge, sa[keep] + longest[keep], -1)
        return np.bincount(doc[np.cumsum(edge[:n]) > 0], minlength=m).astype(np.int64)

    most = none.copy()
    keep = longest >= MIN_REPEAT
    np.maximum.at(most, doc[sa[keep]], longest[keep])
    return covered(BASE_WINDOW), covered(MIN_REPEAT), most


def prefixes_by_levels(levels: list[np.ndarray], ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """The longest common prefixes of neighbours in ``sa``, from the ranks after every step."""
    i, j = sa[:-1], sa[1:]
    last = len(ends) - 1
    lcp = np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (i + lcp < ends[i]) & (j + lcp < ends[j])
        same = ok & (levels[k][np.minimum(i + lcp, last)] == levels[k][np.minimum(j + lcp, last)])
        lcp[same] += 1 << k
    return lcp


def prefixes_in_text_order(symbols: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """The same without ranks: a suffix has at most one word less in common with its neighbour than
    the suffix one word before it (which holds as long as both are in ``sa``)."""
    place = np.full(len(symbols), -1, dtype=np.int64)
    place[sa] = np.arange(len(sa))
    lcp = np.zeros(max(0, len(sa) - 1), dtype=np.int64)
    words, stop = memoryview(np.ascontiguousarray(symbols)), memoryview(np.ascontiguousarray(ends))
    h, before = 0, -2
    for i in np.flatnonzero(place >= 0).tolist():
        p = place[i]
        h = h - 1 if i == before + 1 and h > MIN_REPEAT else 0
        before = i
        if p == 0:
            h = 0
            continue
        j = int(sa[p - 1])
        room = min(stop[i] - i, stop[j] - j)
        while h < room and words[i + h] == words[j + h]:
            h += 1
        lcp[p - 1] = h
    return lcp


def measure(texts: list[str]) -> pd.DataFrame:
    rows, symbols, base = [], [], 0
    for t in texts:
        words = _WORDS.findall(t)
        known: dict[str, int] = {}
        symbols.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64) + base)
        base += len(known)
        lines = [x for x in t.split("\n") if _WORDS.search(x)]
        rows.append((len(words), len(t) - sum(map(t.count, _BLANKS)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines))))
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines"], dtype=np.int64)
    lengths = out["n_words"].to_numpy()
    base_covered, covered, longest = repeats(np.concatenate(symbols), np.repeat(np.cumsum(lengths), lengths), lengths)
    return out.assign(n_repeat_words=base_covered, n_phrase_words=covered, longest_repeat=longest)


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = chars = 0
    for k, t in enumerate(texts):
        if chars and chars + len(t) > BLOCK_CHARS:
            yield lo, k
            lo, chars = k, 0
        chars += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def judge(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the counts, base_failed, covered_fraction, longest_repeat, kept."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for lo, hi in blocks(texts):
                yield measure(texts[lo:hi]).assign(doc_id=b["doc_id"].array[lo:hi])

    m = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        run, "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_phrase_words long, longest_repeat long"
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    covered = F.when(F.col("n_words") > 0, F.col("n_phrase_words") / F.col("n_words")).otherwise(F.lit(0.0))
    limit = F.greatest(F.lit(float(LONGEST_FLOOR)), F.col("n_words") * MAX_LONGEST)
    return m.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & (covered <= MAX_COVERED) & (F.col("longest_repeat") <= limit)).alias("kept"),
        covered.alias("covered_fraction"),
        "longest_repeat",
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    return judge(table(spark, sf_dir, "documents"))
