"""Operator 10, approximate nearest neighbours: balanced posting lists.

Lists: a hash sample of at most ``SAMPLE_ROWS`` vectors is halved again and again at the median
along the line between two far means, so all leaves hold equally many sampled vectors; a
leaf's mean is a list's centroid. Every vector of the table goes to its nearest list, and
boundary vectors also to further lists whose centroid is at most ``1 + REPLICATE`` times as
far, up to ``COPIES`` in all. A query finds its lists by a walk over a graph of the centroids (at
most ``MAX_LISTS``, a bounded broadcast): each is linked with its ``DEGREE`` nearest ones and the
next leaf of the halving, so all are connected. The walk goes on from every centroid among the
``WALK`` nearest met so far, or within the ratio below, until none of them is left; it has no limit
of steps. The query probes all lists met that are at most ``1 + ratio`` times as far as the nearest
one, however many these are, and no fewer than ``LEAST_PROBES``. The ratio is the least one at which
the lists hold ``RECALL`` of the true neighbours within a hash sample of ``TUNE_ROWS`` further vectors
(the same as above if there are no others), asked for the neighbours of ``TUNE_QUERIES`` of them.

Work is dealt out by shelves of ``SHELF`` lists: a vector is one row of each shelf that holds
one of its lists, a query one of each shelf that holds a list it probes, both with the bits of
those lists, and they are compared if they have one in common. A shelf of more than ``BLOCK``
vectors or queries is cut into blocks on both sides, so a vector that a third of all rows
hold, or a third of all queries probe, is many groups. Each group keeps each query's k
nearest, measured in double precision on the original vectors; a last grouping keeps the k
nearest of each query. Queries for which fewer than k were found although there are more
candidates probe all lists in a second turn.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, as queries or as candidates; rows with a null vec_id take
no part; a query's own row is any row of its vec_id; ties go to the smaller vec_id; with
fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepline.llm.common import ceil_div, cut

SAMPLE_ROWS = 20_000
LIST_ROWS = 400
MAX_LISTS = 2_048
COPIES = 4
REPLICATE = 0.2
TUNE_ROWS = 10_000
TUNE_QUERIES = 500
RECALL = 0.99
DEGREE = 16
WALK = 32
LEAST_PROBES = 12
SHELF = 16
BLOCK = 4_096


def usable(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) -> those that take part, as arrays of doubles."""
    v = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    width = v.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    return v.where(F.size("v") == (width[0]["w"] if width else 0))


def balanced_means(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of equally full leaves: each part is halved at the median along the line between two
    means of it, the larger parts first."""
    parts = [np.arange(len(sample))]
    while len(parts) < lists:
        parts.sort(key=len)
        p = parts.pop()
        if len(p) < 2:
            parts.append(p)
            break
        x = sample[p]
        far = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        other = x[((x - far) ** 2).sum(axis=1).argmax()]
        line = far - other
        for _ in range(4):
            order = np.argsort(x @ line, kind="stable")
            low, high = x[order[: len(p) // 2]].mean(axis=0), x[order[len(p) // 2 :]].mean(axis=0)
            line = high - low
        order = np.argsort(x @ line, kind="stable")
        parts += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
    return np.array([sample[p].mean(axis=0) for p in parts])


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def shelved(keep: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """keep (rows x lists, which lists a row takes) -> per row its shelves and their lists' bits."""
    shelves = ceil_div(keep.shape[1], SHELF)
    full = np.zeros((len(keep), shelves * SHELF), dtype=np.int32)
    full[:, : keep.shape[1]] = keep
    bits = (full.reshape(len(keep), shelves, SHELF) << np.arange(SHELF, dtype=np.int32)).sum(axis=2, dtype=np.int32)
    at = [np.flatnonzero(x).astype(np.int32) for x in bits]
    return at, [x[i] for x, i in zip(bits, at, strict=True)]


def posting_lists(v: DataFrame, centroids: np.ndarray) -> DataFrame:
    """v (vec_id, v) -> shelves and bits added: of the nearest list, and near ones for boundary vectors."""
    shared = v.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            for lo in range(0, len(b), 2048):
                part = b.iloc[lo : lo + 2048]
                shelves, bits = shelved(lists_held(np.array(part["v"].tolist()), c))
                yield part.assign(shelves=shelves, bits=bits)

    return v.mapInPandas(run, "vec_id long, v array<double>, shelves array<int>, bits array<int>")


def centroid_graph(centroids: np.ndarray) -> list[np.ndarray]:
    """Per centroid the others it is linked with: its DEGREE nearest, those it is near to, and the
    leaves before and after it."""
    n = len(centroids)
    d = square_distances(centroids, centroids)
    np.fill_diagonal(d, np.inf)
    degree = min(DEGREE, n - 1)
    linked = np.zeros((n, n), dtype=bool)
    if degree:
        np.put_along_axis(linked, np.argpartition(d, degree - 1, axis=1)[:, :degree], True, axis=1)
        linked[np.arange(n - 1), np.arange(1, n)] = True
    return [np.flatnonzero(x) for x in linked | linked.T]


def walk(x: np.ndarray, centroids: np.ndarray, graph: list[np.ndarray], ratio: float) -> np.ndarray:
    """The distances of x to the centroids that its walk over the graph meets, infinite for all others."""
    dist = np.full(len(centroids), np.inf)
    gone_on = np.zeros(len(centroids), dtype=bool)
    new = np.unique(np.linspace(0, len(centroids) - 1, WALK).astype(int))  # leaves far apart
    few = min(WALK, len(centroids)) - 1
    while True:
        dist[new] = np.sqrt(((centroids[new] - x) ** 2).sum(axis=1))
        limit = max(np.partition(dist, few)[few], dist.min() * (1 + ratio))
        at = np.flatnonzero(~gone_on & (dist <= limit) & np.isfinite(dist))
        if not len(at):
            return dist
        gone_on[at] = True
        new = np.unique(np.concatenate([graph[i] for i in at]))
        new = new[np.isinf(dist[new])]


def selected(dist: np.ndarray, ratio: float) -> np.ndarray:
    """Which lists a query probes: by the ratio to the nearest, and the LEAST_PROBES nearest."""
    least = min(LEAST_PROBES, len(dist)) - 1
    return (dist <= max(dist.min() * (1 + ratio), np.partition(dist, least)[least])) & np.isfinite(dist)


def lists_held(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """rows x lists: the nearest list of each row, and near ones for boundary rows."""
    take = min(COPIES, len(centroids))
    d = np.sqrt(square_distances(rows, centroids))
    at = np.argpartition(d, take - 1, axis=1)[:, :take]
    near = np.take_along_axis(d, at, axis=1)
    keep = np.zeros(d.shape, dtype=bool)
    np.put_along_axis(keep, at, near <= near.min(axis=1)[:, None] * (1 + REPLICATE), axis=1)
    return keep


def tuned_ratio(rows: np.ndarray, centroids: np.ndarray, k: int) -> float:
    """The least ratio at which the probed lists hold RECALL of the k nearest rows of TUNE_QUERIES rows."""
    if len(rows) < 2:
        return 0.0
    held = lists_held(rows, centroids)
    needed = []
    for i in range(min(TUNE_QUERIES, len(rows))):
        far = ((rows - rows[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        true = np.argpartition(far, min(k, len(rows) - 1) - 1)[: min(k, len(rows) - 1)]
        dist = np.sqrt(((centroids - rows[i]) ** 2).sum(axis=1))
        if dist.min() == 0:
            continue  # a row that is a centroid itself has no ratio
        over = np.where(selected(dist, 0.0), 0.0, dist / dist.min() - 1)
        needed.append(np.where(held[true], over, np.inf).min(axis=1))
    if not needed:
        return 0.0
    # a little more, as the ratio is compared after another rounding
    return float(np.quantile(np.concatenate(needed), RECALL, method="higher")) * (1 + 1e-9)


def probed_lists(q: DataFrame, centroids: np.ndarray, ratio: float) -> DataFrame:
    """q (vec_id, v) -> query_id, q, shelves, bits: of all lists that the walk and the ratio select."""
    shared = q.sparkSession.sparkContext.broadcast((centroids, centroid_graph(centroids)))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, graph = shared.value
        for b in batches:
            for lo in range(0, len(b), 2048):
                part = b.iloc[lo : lo + 2048]
                shelves, bits = shelved(np.array([selected(walk(np.asarray(x), c, graph, ratio), ratio) for x in part["v"]]))
                yield pd.DataFrame({"query_id": part["vec_id"].to_numpy(), "q": part["v"].tolist(), "shelves": shelves, "bits": bits})

    return q.mapInPandas(run, "query_id long, q array<double>, shelves array<int>, bits array<int>")


def nearest(k: int):
    """One block of queries against one block of vectors: each query's k nearest."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(vectors):
            v, ids, held = np.array(vectors["v"].tolist()), vectors["vec_id"].to_numpy(), vectors["bits"].to_numpy()
            size = (v * v).sum(axis=1)
            for qid, x, bits in zip(queries["query_id"], queries["q"], queries["bits"], strict=True):
                x = np.asarray(x)
                rough = size + (x * x).sum() - 2 * (v @ x)
                rough[(ids == qid) | (held & bits == 0)] = np.inf
                limit = np.partition(rough, min(k, len(rough)) - 1)[min(k, len(rough)) - 1]
                if np.isinf(limit):
                    limit = np.partition(rough, -1)[-1] if not np.isinf(rough).any() else rough[~np.isinf(rough)].max(initial=-1.0)
                # all that rounding could put among the k nearest are measured exactly
                at = np.flatnonzero(rough <= limit + 1e-9 * (size.max() + (x * x).sum()))
                score = np.sqrt(((v[at] - x) ** 2).sum(axis=1))
                for i in np.lexsort((ids[at], score))[:k]:
                    rows.append((qid, ids[at[i]], score[i]))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": np.int64, "vec_id": np.int64, "score": np.float64})

    return run


def compare(listed: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """listed (vec_id, v, shelves, bits), probes (query_id, q, shelves, bits) -> query_id, vec_id, score."""
    one = F.explode(F.arrays_zip(F.col("shelves").alias("shelf"), F.col("bits").alias("bits"))).alias("at")
    entries = listed.select("vec_id", "v", one).select("vec_id", "v", "at.shelf", "at.bits")
    asked = probes.select("query_id", "q", one).select("query_id", "q", "at.shelf", "at.bits")
    n_v = entries.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("vs"))
    n_q = asked.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qs"))
    load = cut(n_v.join(n_q, "shelf"))  # one row per shelf, MAX_LISTS / SHELF at most
    load = F.broadcast(load)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    entries = entries.join(load, "shelf").withColumn("vb", deal("vec_id", "vs")).select("shelf", "vb", every("qs").alias("qb"), "vec_id", "v", "bits")
    asked = asked.join(load, "shelf").withColumn("qb", deal("query_id", "qs")).select("shelf", "qb", every("vs").alias("vb"), "query_id", "q", "bits")
    key = ["shelf", "vb", "qb"]
    found = asked.groupBy(*key).cogroup(entries.groupBy(*key)).applyInPandas(nearest(k), "query_id long, vec_id long, score double")
    # a vector of several shelves is found several times, with one score
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def search(vectors: DataFrame, query_step: int, k: int = 10) -> DataFrame:
    """vectors (vec_id, embedding) -> the k nearest other rows of each row whose vec_id is divisible
    by query_step: query_id, rank, vec_id, score."""
    v = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    rows = v.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema)
    some = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS + TUNE_ROWS).select("v").toPandas()["v"]
    some = np.array(some.tolist())
    sample = np.unique(some[:SAMPLE_ROWS], axis=0)
    lists = max(1, min(MAX_LISTS, ceil_div(rows, LIST_ROWS), len(sample) // 4))
    centroids = balanced_means(sample, lists)
    ratio = tuned_ratio(some[-TUNE_ROWS:], centroids, k)
    listed = cut(posting_lists(v, centroids))
    queries = v.where(F.col("vec_id") % query_step == 0)
    found = cut(compare(listed, probed_lists(queries, centroids, ratio), k))
    few = queries.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), F.col("vec_id") == F.col("query_id"), "left")
    few = cut(few.where(F.coalesce("n", F.lit(0)) < min(k, rows - 1)).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
    if not few.isEmpty():
        shelves = ceil_div(len(centroids), SHELF)
        everywhere = few.withColumn("shelves", F.sequence(F.lit(0), F.lit(shelves - 1))).withColumn("bits", F.array_repeat(F.lit((1 << SHELF) - 1), shelves))
        found = found.unionByName(compare(listed, everywhere, k)).distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 100)
