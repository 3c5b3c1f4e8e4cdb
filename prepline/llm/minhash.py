"""Operator 8, near-duplicates: one-permutation hashing with optimal densification.

A document's shingles are hashed once; the hash picks one of ``BINS`` bins and the smallest
hash of each bin is its signature there. An empty bin takes the value of a full bin found by
its own sequence of probes (optimal densification). Bands of ``BAND`` bins give bucket keys.

Documents with equal shingle sets are one class, represented by its smallest id, so groups
of copies cost one row. Inside a bucket no pairs are formed: every class gets one edge to the
bucket's hub, the class whose buckets are largest in sum (in a group of near copies the text
they come from), so a group of n classes costs n - 1 edges. Edges are confirmed on full
shingle sets, read again for the classes that have an edge. Buckets whose classes are still
in several components go into further rounds with new hubs; as a star may meet a bucket's
members in the wrong order, what is then left of a bucket is compared by signatures in
blocks, in arrays inside tasks: by a signature of ``FINE_BINS`` bins without densification,
which for short texts holds nearly the whole set; only pairs that it leaves possible become
edges to confirm. Components follow by large and small stars.

Defined results: words are separated by ASCII white space, A-Z are lower-cased; a text of
fewer than ``shingle`` words is one shingle; null texts and texts without words have no
shingles and are linked with nothing; repeated rows are linked as equal sets; a null doc_id
keeps its row and its component is null unless an equal or similar text has an id; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.llm.common import HEAVY_SHARE, components, cut, cut_narrow, keyed_join, small_batches

SHINGLE = 3
THRESHOLD = 85  # per cent
BINS = 256
BAND = 8
PROBES = 64
STAR_ROUNDS = 4
BLOCK = 1024
FINE_BINS = 1024
SALT_ROWS = 2_000
DEVIATIONS = 4.0

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))
TABLED = 64  # bytes of a word that the table of random numbers covers
CHUNK = 1 << 20  # bytes that are hashed at once
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (murmur's finaliser)."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: a random number for each byte at each place of a word
_TABLE = _mix(np.arange(1, TABLED * 256 + 1, dtype=np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``data`` (ASCII letters in lower case already): where they start, and their
    hashes, by tabulation: the sum of the random numbers of their bytes."""
    b = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(~_IS_BLANK[b], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    length = end - start
    lead = int(start[0]) if len(start) else len(b)  # white space before the first word
    at = np.arange(len(b)) - np.r_[np.zeros(lead, dtype=np.int64), np.repeat(start, np.diff(np.r_[start, len(b)]))]
    sums = np.r_[_U(0), np.cumsum(_TABLE[np.minimum(at, TABLED - 1) * 256 + b], dtype=np.uint64)]
    h = _mix(sums[end] - sums[start] + length.astype(np.uint64))
    for k in np.flatnonzero(length > TABLED):
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]])
    return start, h


class Shingler:
    """The distinct shingles of whole texts as sorted 64-bit hashes."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __call__(self, text: object) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: Iterable[object]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held, size = [], 0
        for t in texts:
            data = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t if isinstance(t, bytes) else b""
            if held and size + len(data) > CHUNK:
                out += self._sets(held)
                held, size = [], 0
            held.append(data.lower())
            size += len(data) + 1
        return out + self._sets(held) if held else out

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > CHUNK:
            words, bounds = self._long(texts[0])
        else:
            start, words = word_hashes(b"\n".join(texts) + b"\n")
            ends = np.cumsum([len(x) + 1 for x in texts])
            bounds = np.r_[0, np.searchsorted(start, ends)]
        width = self.n
        rolled = np.full(max(0, len(words) - width + 1), width, dtype=np.uint64)
        for k in range(width):
            rolled = _mix(rolled * _U(0x9E3779B97F4A7C15) + words[k : k + len(rolled)])
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= width:
                out.append(np.unique(rolled[lo : hi - width + 1]))
            elif hi > lo:  # fewer words: all of them are one shingle
                one = np.full(1, hi - lo, dtype=np.uint64)
                for w in words[lo:hi]:
                    one = _mix(one * _U(0x9E3779B97F4A7C15) + w)
                out.append(one)
            else:
                out.append(np.empty(0, dtype=np.uint64))
        return out

    def _long(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The words of a text of more than CHUNK bytes, in pieces that end at white space."""
        parts, lo = [], 0
        while lo < len(data):
            stop = _BLANK.search(data, lo + CHUNK)
            hi = stop.end() if stop else len(data)
            parts.append(word_hashes(data[lo:hi])[1])
            lo = hi
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])


def _probe_table() -> np.ndarray:
    """probes[i, t]: the bin that empty bin i tries at step t; after that, the next full bin."""
    i, t = np.arange(BINS, dtype=np.uint64)[:, None], np.arange(PROBES, dtype=np.uint64)[None, :]
    return (_mix(i * _U(1_000_003) + t + _U(1)) % _U(BINS)).astype(np.int64)


def signatures(sets: list[np.ndarray], probes: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin, empty bins densified, one row per set (none is empty)."""
    h = _mix(np.concatenate(sets) + _U(0x632BE59BD9B4E019))
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = row * BINS + (h >> _U(56)).astype(np.int64) % BINS
    sig = np.full(len(sets) * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(sig, flat, h)
    full = np.zeros(len(sets) * BINS, dtype=bool)
    full[flat] = True
    sig, full = sig.reshape(-1, BINS), full.reshape(-1, BINS)
    r, c = np.nonzero(~full)
    if len(r):
        # the next full bin, for those that no probe fills
        there = np.where(full, np.arange(BINS), 2 * BINS)
        after = np.minimum.accumulate(there[:, ::-1], axis=1)[:, ::-1]
        donor = np.where(after[r, c] < BINS, after[r, c], there.min(axis=1)[r])
        open_ = np.arange(len(r))
        for t in range(PROBES):
            to = probes[c[open_], t]
            hit = full[r[open_], to]
            donor[open_[hit]] = to[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        sig[r, c] = sig[r, donor]
    return sig


def band_keys(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    """The bucket keys of each row of ``sig``."""
    rows = sig[:, : BINS // band * band].reshape(len(sig), -1, band)
    key = np.broadcast_to(np.arange(rows.shape[1], dtype=np.uint64), rows.shape[:2])
    for k in range(band):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle: int, band: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, mark (a hash of the text), n_shingles, set_key (128 bits of the
    set, null if empty), bands (keys)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, probes = Shingler(shingle), _probe_table()
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                sets = shingles.many(part["text"])
                full = [x for x in sets if len(x)]
                keys = iter(band_keys(signatures(full, probes), band)) if full else iter(())
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].array,
                    "mark": part["mark"].array,
                    "n_shingles": [len(x) for x in sets],
                    "set_key": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets],
                    "bands": [next(keys) if len(x) else [] for x in sets],
                })

    text = F.col("text").cast("string")
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text")).mapInPandas(
        run, "doc_id string, mark long, n_shingles long, set_key binary, bands array<long>"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (node, text) -> node, shingles."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(shingle)
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.iloc[lo : lo + 1000]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "shingles": [x.view(np.int64) for x in shingles.many(part["text"])]})

    return docs.mapInPandas(run, "node long, shingles array<long>")


def fine_signatures(sets: DataFrame) -> DataFrame:
    """sets (node, shingles) -> node, n (set size), fine (a byte of each bin's smallest hash, 0 for
    an empty bin)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b["shingles"]:
                h = np.sort(_mix(np.asarray(x, dtype=np.int64).view(np.uint64) + _U(0x1B873593CC9E2D51)))
                bins, first = np.unique((h >> _U(54)).astype(np.int64), return_index=True)
                fine = np.zeros(FINE_BINS, dtype=np.uint8)
                fine[bins] = (h[first] % _U(255)).astype(np.uint8) + 1
                rows.append((len(h), fine.tobytes()))
            out = pd.DataFrame(rows, columns=["n", "fine"])
            out.insert(0, "node", b["node"].to_numpy())
            yield out

    return sets.mapInPandas(run, "node long, n long, fine binary")


def confirm(edges: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """edges (node, hub) whose full sets reach the threshold. A hub may have any number of edges:
    its set is dealt out in copies, one for every SALT_ROWS edges."""
    load = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    salted = edges.join(load, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    hubs = load.join(sets.withColumnsRenamed({"node": "hub", "shingles": "hub_set"}), "hub").select(
        "hub", "hub_set", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    pairs = salted.select("node", "hub", "salt").join(sets, "node").join(hubs, ["hub", "salt"])
    both = F.size(F.array_intersect("shingles", "hub_set"))
    either = F.size("shingles") + F.size("hub_set") - both
    return pairs.where(100 * both >= threshold * either).select("node", "hub")


def hubs_of(members: DataFrame, weight: DataFrame) -> DataFrame:
    """members (band, node), weight (node, w) -> (band, hub): the heaviest node of each bucket."""
    best = members.join(weight, "node").groupBy("band").agg(F.max(F.struct("w", (-F.col("node")).alias("m"))).alias("best"))
    return best.select("band", (-F.col("best.m")).alias("hub"))


def leftover_pairs(open_members: DataFrame, marks: DataFrame, threshold: int, deviations: float = DEVIATIONS) -> DataFrame:
    """open_members (band, node, component), marks (node, n, fine) -> candidate edges between
    components of a bucket.

    A bucket is cut into blocks; every pair of blocks is one group, in which signatures are
    compared as arrays, a quarter of their bins first; pairs of one component or with too few
    equal bins are never rows. The bounds lie ``deviations`` below the threshold, for the number
    of shingles that the signatures have drawn from sets of this size; with infinite deviations
    every pair of a bucket whose sizes allow a link goes on to be confirmed."""
    share = threshold / 100
    spread = np.sqrt(share * (1 - share))
    size = open_members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    m = open_members.join(size, "band").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    m = m.select("band", "node", "component", "block", other)
    # signatures join last: they are shuffled once to their members and once to the groups
    m = m.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).join(marks.select("node", "n", "fine"), "node")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fine = np.frombuffer(b"".join(rows["fine"]), dtype=np.uint8).reshape(len(rows), FINE_BINS)
        some = np.ascontiguousarray(fine[:, : FINE_BINS // 4])
        node, comp, block, n = (rows[c].to_numpy() for c in ("node", "component", "block", "n"))

        def near(sig: np.ndarray, k: int, rest: np.ndarray) -> np.ndarray:
            theirs = sig[rest]
            used = np.maximum(((theirs | sig[k]) != 0).sum(axis=1), 1)
            agree = ((theirs == sig[k]) & (theirs != 0)).sum(axis=1) / used
            # drawn without replacement from a union that is this large at the threshold
            drawn = np.minimum(used * (1 + share) / (n[rest] + n[k]), 1)
            slack = deviations * spread * np.sqrt((1 - drawn) / used) if np.isfinite(deviations) else np.inf
            return rest[agree >= share - slack - 2 / used]

        one_block = (block == block[0]).all()
        out = []
        for k in range(len(rows) - 1):
            rest = np.arange(k + 1, len(rows))
            rest = rest[(comp[rest] != comp[k]) & (100 * np.minimum(n[rest], n[k]) >= threshold * np.maximum(n[rest], n[k]))]
            if not one_block:
                rest = rest[block[rest] != block[k]]
            for sig in (some, fine):
                if len(rest):
                    rest = near(sig, k, rest)
            out += [(min(node[k], node[r]), max(node[k], node[r])) for r in rest]
        return pd.DataFrame(out, columns=["node", "hub"], dtype=np.int64)

    return m.groupBy("band", "lo", "hi").applyInPandas(run, "node long, hub long").distinct()


def numbered(classes: DataFrame, ids: DataFrame) -> DataFrame:
    """classes (set_key, first (doc_id, mark), ..) -> with ``node``: the smallest doc_id where no other
    class has the same; classes without an id, or that share it, get a number above all ids."""
    own = F.col("first.doc_id")
    shared = cut(classes.groupBy(own.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select("id"))
    if shared.isEmpty():
        return classes.withColumn("node", own)
    top = ids.agg(F.max("doc_id")).first()[0] or 0
    marked = classes.join(shared, own.eqNullSafe(F.col("id")), "left_semi").withColumn("node", F.try_add(F.lit(top + 1), F.monotonically_increasing_id()))
    return cut(classes.join(shared, own.eqNullSafe(F.col("id")), "left_anti").withColumn("node", own).unionByName(marked))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, band: int = BAND, deviations: float = DEVIATIONS
) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept, mark (a hash of the text), one
    row per document.

    Two sets of similarity s share a bucket with probability 1 - (1 - s^band)^(BINS / band):
    0.99996 at 0.85 with bands of 8, 0.999997 at 0.80 with bands of 6."""
    with small_batches(docs.sparkSession):
        marks = cut(sketches(docs, shingle, band))
    filled = marks.where(F.col("set_key").isNotNull())
    # classes of equal sets: the smallest id stands for them; no row of a class is expanded
    classes = cut(
        filled.groupBy("set_key").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("first"), F.min("mark").alias("any"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    )
    classes = numbered(classes.withColumn("first", F.coalesce("first", F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("any").alias("mark")))).drop("any"), marks)
    nodes = classes.where(F.col("node").isNotNull())
    members = nodes.select("node", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(members.join(sizes, "band"))  # only buckets of two or more classes go on
    weight = members.groupBy("node").agg(F.sum("n").alias("w"))
    members = members.select("band", "node")
    label = None
    links = None
    tried = None
    sets = None
    if not members.isEmpty():
        involved = cut_narrow(members.select("node").distinct())
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").cast("binary").alias("text"))
        wanted = nodes.join(involved, "node", "left_semi").select("node", "first")
        # a class is read by the id and the text that stand for it; repeated rows give the text once
        found = texts.join(wanted, F.col("id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
        one = found.select("node", "text").dropDuplicates(["node"])
        with small_batches(docs.sparkSession):
            sets = cut(shingle_sets(one, shingle))
        label = involved.withColumn("component", F.col("node"))
        for turn in range(STAR_ROUNDS):
            if turn:
                # another hub in each further round: the heaviest among those not yet linked
                # to the bucket's first component
                w = label.join(weight, "node")
                part = members.join(w, "node")
            else:
                part = members.join(weight, "node").withColumn("component", F.col("node"))
            per = part.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"))
            open_ = part.join(per.where("a <> b"), "band")
            if turn:
                # the largest component's members have met their hub: a hub of another one
                most = open_.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("w", (-F.col("node")).alias("m"))).alias("best"))
                ranked = most.groupBy("band").agg(F.max(F.struct("c", "component")).alias("top"))
                cand = most.join(ranked, "band").where("component <> top.component")
                hubs = cand.groupBy("band").agg(F.max("best").alias("best")).select("band", (-F.col("best.m")).alias("hub"))
            else:
                hubs = hubs_of(members, weight)
            star = open_.join(hubs, "band").where("node <> hub")
            star = star.select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub")).distinct()
            star = cut_narrow(star if tried is None else star.join(tried, ["node", "hub"], "left_anti"))
            if star.isEmpty():
                break
            tried = star if tried is None else tried.unionByName(star)
            good = cut_narrow(confirm(star, sets, threshold))
            if good.isEmpty():
                break  # nothing changes: other hubs of these buckets are left to the blocks
            links = good if links is None else links.unionByName(good)
            label = _labels(involved, links)
        part = members.join(label, "node")
        per = part.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
        left = cut_narrow(part.join(per.select("band"), "band"))
        marked = fine_signatures(sets.join(left.select("node").distinct(), "node", "left_semi"))
        rest = cut_narrow(leftover_pairs(left, marked, threshold, deviations).join(tried, ["node", "hub"], "left_anti"))
        if not rest.isEmpty():
            good = cut_narrow(confirm(rest, sets, threshold))
            if not good.isEmpty():
                links = good if links is None else links.unionByName(good)
                label = _labels(involved, links)
    group = classes.select("set_key", "node", "copies", F.col("first.doc_id").alias("least"))
    if label is not None:
        group = group.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        group = group.withColumn("component", F.col("node"))
    # the smallest id of a component; its node is that already unless classes share or lack ids
    group = cut(group.select("set_key", "component", "copies", "least"))
    odd = group.groupBy("component").agg(F.min("least").alias("id")).where("id is null or id <> component")
    odd = cut(odd.select(F.col("component").alias("odd"), "id"))
    if not odd.isEmpty():
        group = cut(group.join(odd, F.col("component") == F.col("odd"), "left").withColumn("component", F.when(F.col("odd").isNotNull(), F.col("id")).otherwise(F.col("component"))).drop("odd", "id"))
    total = marks.count()
    heavy = group.where(F.col("copies") * HEAVY_SHARE >= total)
    linked = keyed_join(marks.where(F.col("set_key").isNotNull()).select("doc_id", "n_shingles", "mark", "set_key"), group.select("set_key", "component"), "set_key", heavy)
    alone = marks.where(F.col("set_key").isNull()).select("doc_id", "n_shingles", "mark", F.col("doc_id").alias("component"))
    out = linked.select("doc_id", "n_shingles", "mark", "component").unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"), "mark")


def _labels(involved: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links.select(F.col("node").alias("src"), F.col("hub").alias("dst")))
    return cut_narrow(involved.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
