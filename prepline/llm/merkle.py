"""Operator 13, Merkle dataset manifest: octopus multiproof.

Every document is a leaf; the leaves of a source are a tree with up to 16 children per node, and
the sources' roots are the leaves of one more tree, whose root names the whole table. Leaves are
numbered by a range sort, nodes are built level by level from groups of at most 16, so neither a
hot source nor the root needs more than small groups.

Proofs: the leaves are taken in blocks of neighbours. A block computes which nodes its leaves need
that cannot be derived from the block itself (the octopus: at each level, the rest of the runs at
its ends), asks for this minimal union once, derives all interior nodes that its leaves share,
and expands each leaf's own proof locally. A block asks for about 15 nodes a level and end,
whatever its size, instead of 15 nodes a level and leaf.

Defined results: nulls are part of a leaf (``-``); a null source is a source of its own, the first;
within a source, leaves ascend by doc_id (nulls first), then by leaf; repeated rows are leaves of
their own; a null doc_id is never tampered with; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.llm.common import ascii_lower, cut

FANOUT = 16
#: leaves that make their proofs together
BLOCK = 4096
TOP = "^"
#: nodes from this level on, and the top tree, are asked for by many blocks; they are salted
HIGH_LEVEL = 3
SALTS = 16
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 length, a colon and itself; null: a hyphen."""
    v = c.cast("string")
    return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_of(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) and pos (ascending, its high bits the partition), idx (from 0 within the tree,
    by ``order``) and n (rows of the tree). The row's place in the input splits even equal rows."""
    keys = ["tree", *order, "_row"]
    sorted_rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    placed = cut(sorted_rows.withColumn("pos", F.monotonically_increasing_id())).withColumn("_pid", F.shiftright("pos", 33))
    # at most one row per tree and one more per partition
    runs = placed.groupBy("_pid", "tree").agg(F.min("pos").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    w = Window.partitionBy("tree").orderBy("_pid")
    runs = runs.withColumn("_off", F.sum("_n").over(w) - F.col("_n")).withColumn("n", F.sum("_n").over(Window.partitionBy("tree"))).drop("_n")
    return cut(placed.join(runs, ["_pid", "tree"]).withColumn("idx", F.col("_off") + F.col("pos") - F.col("_lo")).drop("_pid", "_lo", "_off"))


def levels_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def build(leaves: DataFrame) -> DataFrame:
    """leaves (tree, idx, n, hash) -> all nodes (tree, level, idx, n, hash), n being the nodes of that
    level; a tree's root is its node with n = 1."""
    level = leaves.select("tree", F.lit(0).alias("level"), "idx", "n", "hash")
    most = level.agg(F.max("n")).first()[0]
    nodes = level
    for k in range(levels_of(most or 0)):
        up = level.where("n > 1").groupBy("tree", F.shiftright("idx", 4).alias("idx"))
        up = up.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("run"))
        level = cut(
            up.select(
                "tree",
                F.lit(k + 1).alias("level"),
                "idx",
                F.shiftright(F.col("n") + (FANOUT - 1), 4).alias("n"),
                F.sha2(F.array_join(F.col("run.hash"), "").cast("binary"), 256).alias("hash"),
            )
        )
        nodes = nodes.unionByName(level)
    return nodes


@dataclass
class Manifest:
    """leaves (tree, doc_id, hash, other columns, pos, idx, n), nodes (tree, level, idx, n, hash) of all
    trees, the top tree's included, sources (tree, idx, n, hash) by their place in it, and the root."""

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    root: str | None


def manifest(leaves: DataFrame) -> Manifest:
    """leaves (source, doc_id, hash, ...) -> their manifest."""
    source = F.col("source").cast("string")
    rows = leaves.withColumn("tree", F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))).drop("source")
    rows = numbered(rows, ["doc_id", "hash"])
    nodes = build(rows)
    roots = nodes.where("n = 1").select(F.col("tree").alias("source_tree"), "hash").withColumn("tree", F.lit(TOP))
    sources = numbered(roots, ["source_tree"])
    top = build(sources)
    root = top.where("n = 1").first()
    sources = sources.select(F.col("source_tree").alias("tree"), "idx", "n", "hash")
    return Manifest(rows, nodes.unionByName(top), sources, root["hash"] if root else None)


def missing(known: Iterable[int], n: int) -> list[tuple[int, int]]:
    """(level, idx) of the fewest nodes from which, with the known leaves, the root of a tree of n
    leaves follows along with every known leaf's proof."""
    known, level, out = set(known), 0, []
    while n > 1:
        up = {i // FANOUT for i in known}
        out += [(level, i) for p in sorted(up) for i in range(p * FANOUT, min((p + 1) * FANOUT, n)) if i not in known]
        known, n, level = up, -(-n // FANOUT), level + 1
    return out


class Octopus:
    """The nodes one block knows, and its leaves' proofs."""

    def __init__(self, n_sources: int) -> None:
        self.n_sources = n_sources
        self.hash: dict[tuple[str, int, int], str] = {}
        self.size: dict[str, int] = {TOP: n_sources}
        self.place: dict[str, int] = {}
        self.rest: dict[tuple[str, int, int], str] = {}
        self.above: dict[tuple[str, int, int], str] = {}

    def run(self, tree: str, level: int, i: int) -> list[str]:
        n = -(-self.size[tree] // FANOUT**level)
        p = i // FANOUT
        return [self.hash[tree, level, k] for k in range(p * FANOUT, min((p + 1) * FANOUT, n))]

    def derive(self, tree: str, known: Iterable[int]) -> str:
        """Interior nodes above the known leaves; the root."""
        known, n, level = set(known), self.size[tree], 0
        while n > 1:
            known = {i // FANOUT for i in known}
            for p in known:
                self.hash[tree, level + 1, p] = digest(self.run(tree, level, p * FANOUT))
            n, level = -(-n // FANOUT), level + 1
        return self.hash[tree, level, 0]

    def parent(self, tree: str, level: int, i: int) -> tuple[str, int, int] | None:
        """The node that takes this one's hash up; a tree's root is a leaf of the top tree."""
        if level < levels_of(self.size[tree]):
            return tree, level + 1, i // FANOUT
        return None if tree == TOP else (TOP, 0, self.place[tree])

    def siblings(self, tree: str, level: int, i: int) -> tuple[str, str]:
        """Hashes before and after a node in its run; none at a tree's root."""
        if level >= levels_of(self.size[tree]):
            return "", ""
        run, k = self.run(tree, level, i), i % FANOUT
        return "".join(run[:k]), "".join(run[k + 1 :])

    def proof(self, node: tuple[str, int, int] | None) -> str:
        """All sibling hashes from a node up to the root, those of shared interiors made once."""
        if node is None:
            return ""
        out = self.rest.get(node)
        if out is None:
            out = "".join(self.siblings(*node)) + self.proof(self.parent(*node))
            if node[1]:
                self.rest[node] = out
        return out

    def fold(self, node: tuple[str, int, int], value: str) -> str:
        """The root that follows if ``node`` has the hash ``value``."""
        same = value == self.hash[node]
        if same and node in self.above:
            return self.above[node]
        up = self.parent(*node)
        if up is None:
            out = value
        elif up[0] != node[0]:
            out = self.fold(up, value)
        else:
            before, after = self.siblings(*node)
            out = self.fold(up, digest((before, value, after)))
        if same and node[1]:
            self.above[node] = out
        return out


def prove(m: Manifest, claimed: str = "hash", with_proofs: bool = False) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256 (of all sibling hashes, level by level),
    folded_root (from the leaf's column ``claimed`` and the true siblings), verified; with
    ``with_proofs`` the sibling hashes themselves too, as one text."""
    n_sources = m.sources.count()
    leaves = m.leaves.withColumn("g", F.floor(F.col("pos") / BLOCK))
    place = m.sources.select("tree", F.col("idx").alias("place"))
    ranges = cut(leaves.groupBy("g", "tree").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.first("n").alias("n")).join(place, "tree"))

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(t, *c) for t, lo, hi, n in zip(rows["tree"], rows["lo"], rows["hi"], rows["n"], strict=True) for c in missing(range(lo, hi + 1), n)]
        out += [(TOP, *c) for c in missing(rows["place"], n_sources)]
        out = pd.DataFrame(out, columns=["tree", "level", "idx"])
        out.insert(0, "g", rows["g"].iloc[0])
        return out

    asked = ranges.groupBy("g").applyInPandas(ask, "g long, tree string, level int, idx long")
    high = (F.col("level") >= HIGH_LEVEL) | (F.col("tree") == TOP)
    asked = asked.withColumn("salt", F.when(high, F.pmod("g", F.lit(SALTS))).otherwise(0).cast("int"))
    held = m.nodes.select("tree", "level", "idx", "hash")
    held = held.withColumn("salt", F.explode(F.when(high, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    fetched = asked.join(held, ["tree", "level", "idx", "salt"]).select("g", "tree", "level", "idx", "hash")
    # a block's sources and their places come along as rows of level -1
    fetched = fetched.unionByName(ranges.select("g", "tree", F.lit(-1).alias("level"), F.col("place").alias("idx"), F.lit(None).cast("string").alias("hash")))

    def expand(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        block = Octopus(n_sources)
        for t, level, i, h in zip(others["tree"], others["level"], others["idx"], others["hash"], strict=True):
            if level < 0:
                block.place[t] = i
            else:
                block.hash[t, level, i] = h
        trees: dict[str, list[int]] = {}
        for t, i, n, h in zip(rows["tree"], rows["idx"], rows["n"], rows["hash"], strict=True):
            block.hash[t, 0, i] = h
            block.size[t] = n
            trees.setdefault(t, []).append(i)
        subroot = {t: block.derive(t, ids) for t, ids in trees.items()}
        for t, s in subroot.items():
            block.hash[TOP, 0, block.place[t]] = s
        block.derive(TOP, [block.place[t] for t in trees])
        proofs, folded = [], []
        for t, i, c in zip(rows["tree"], rows["idx"], rows["claimed"], strict=True):
            proofs.append(block.proof((t, 0, i)))
            folded.append(block.fold((t, 0, i), c))
        out = pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["hash"], "subroot": rows["tree"].map(subroot)})
        out["proof_sha256"], out["folded_root"] = [digest((p,)) for p in proofs], folded
        if with_proofs:
            out["proof"] = proofs
        return out

    cols = leaves.select("g", F.col("doc_id").cast("string").alias("doc_id"), "tree", "idx", "n", "hash", F.col(claimed).alias("claimed"))
    schema = "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string" + (", proof string" if with_proofs else "")
    out = cols.groupBy("g").cogroup(fetched.groupBy("g")).applyInPandas(expand, schema)
    root = F.lit(m.root).cast("string")
    return out.select(
        F.col("doc_id").cast(m.leaves.schema["doc_id"].dataType).alias("doc_id"),
        "leaf",
        "subroot",
        root.alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
        *(["proof"] if with_proofs else []),
    )


def document_leaves(docs: DataFrame) -> DataFrame:
    """docs -> source, doc_id, hash, and claimed: the leaf after A-Z of the text were lower-cased
    where 5 divides the unsigned crc32 of the decimal doc_id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    cols = {c: F.col(c) for c in LEAF_COLUMNS}
    own = leaf_of(cols.values())
    changed = leaf_of((cols | {"text": ascii_lower(F.col("text").cast("string"))}).values())
    return docs.select("source", "doc_id", own.alias("hash"), F.when(hit, changed).otherwise(own).alias("claimed"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    return prove(manifest(document_leaves(table(spark, sf_dir, "documents"))), "claimed")


def _sql(levels: int = 6, top_levels: int = 5) -> str:
    """The rows by definition: 16 ** levels documents a source and 16 ** top_levels sources at most."""

    def leaf(text: str) -> str:
        one = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
        return "sha256(" + " || ".join(one.format(text if c == "text" else c) for c in LEAF_COLUMNS) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(str_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    ctes = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS f FROM documents)",
        "t0 AS (SELECT source AS k, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n, h, doc_id, f FROM d"
        " WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, h))",
    ]

    def tree(name: str, depth: int) -> None:
        for k in range(depth):
            ctes.append(
                f"{name}s{k} AS (SELECT a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS p,"
                f" coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS s FROM {name}{k} a JOIN {name}{k} b"
                f" ON a.k IS NOT DISTINCT FROM b.k AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL)"
            )
            ctes.append(
                f"{name}{k + 1} AS (SELECT k, i // 16 AS i, (any_value(n) + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h"
                f" FROM {name}{k} WHERE n > 1 GROUP BY k, i // 16)"
            )

    tree("t", levels)
    ctes.append("r AS (" + " UNION ALL ".join(f"SELECT k, h FROM t{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    ctes.append("u0 AS (SELECT 0 AS k, row_number() OVER (ORDER BY encode(k) NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, k AS src FROM r)")
    tree("u", top_levels)
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT h FROM u{k} WHERE n = 1" for k in range(top_levels + 1)) + ")")
    ctes.append("p AS (SELECT t.doc_id, t.h AS leaf, u.h AS subroot, t.k, t.i, t.f AS f0, '' AS q0, u.i AS j FROM t0 t JOIN u0 u ON t.k IS NOT DISTINCT FROM u.src)")
    last = "p"
    for k, (name, key, at) in enumerate([("t", "s.k IS NOT DISTINCT FROM x.k", "x.i // {0}")] * levels + [("u", "true", "x.j // {0}")] * top_levels):
        level = k if name == "t" else k - levels
        on = f"{key} AND s.i = {at.format(16**level)}"
        ctes.append(
            f"p{k} AS (SELECT x.doc_id, x.leaf, x.subroot, x.k, x.i, x.j, CASE WHEN s.i IS NULL THEN f0 ELSE sha256(s.p || f0 || s.s) END AS f0,"
            f" q0 || coalesce(s.p || s.s, '') AS q0 FROM {last} x LEFT JOIN {name}s{level} s ON {on})"
        )
        last = f"p{k}"
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root.h AS root, sha256(q0) AS proof_sha256, f0 AS folded_root,"
        f" f0 = root.h AS verified FROM {last}, root"
    )


OP13_SQL = _sql()
