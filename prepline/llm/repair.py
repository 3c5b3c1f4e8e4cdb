"""Operator 12, conversation structure repair: rank-convergence parallel Viterbi.

The cheapest edits that give a conversation's roles the form ``(s?(ua)+)?`` follow from a dynamic
program from its last row to its first: the cost to go from each of four states (start, after
system, after user, after assistant). Adding a constant to all four costs changes no decision, and
there are only a few cost vectors up to such a constant (``SHAPES``), so a row is one step between
shapes.

Rows are range-sorted, so a conversation of any size is dealt over partitions and cut there into
chunks. Chunks run at the same time, each from a speculative cost vector at its right end. The fix-up
passes then rerun it from the other vectors that may arrive, each rerun only until its vector differs
from the speculative one by a constant (mostly two rows). That makes a chunk a small map from the
vector that arrives to the one that leaves; the maps are stitched in groups of up to 512 neighbours,
level by level, so the passes grow with the logarithm of the chunks even where vectors never
converge. The stitched backward costs then drive the tracing of the audit, the least of the cheapest
ones, in the other direction in the same way: from each state that may arrive, then stitched.
A conversation that lies inside one partition is one chunk, whose true vector is known.

A conversation's digest and audit are one value each by contract: its repaired chunks meet in one
task in order and are hashed as a stream, never held together.

Defined results: a null conv_id is one conversation; null roles and texts are one space, null turns
come first; rows of one turn are ordered by role, then by text (its first 64 characters, then its
digest); repeated rows stay and are duplicates of each other; a conversation without rows after damage
has zeros, an empty audit and the hash of nothing; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.llm.common import cut

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
CHUNK_ROWS = 4096
CHUNK_CHARS = 4_000_000
#: neighbours stitched at once: 2 ** FAN_BITS
FAN_BITS = 9
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

# states: 0 start, 1 after system, 2 after user, 3 after assistant
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_TURN_TO = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: rows as symbols: role initial (x: another), upper case if truncated; D: must go
SYMBOLS = "suaxSUAXD"


def _closed(v: list[int]) -> tuple[int, ...]:
    """Costs to go if rows may also be inserted first."""
    one = [min(c, INSERT + v[_TURN_TO[q]]) for q, c in enumerate(v)]
    return tuple(min(c, INSERT + one[_TURN_TO[q]]) for q, c in enumerate(one))


def _options(symbol: str, v: tuple[int, ...], q: int) -> list[tuple[str, int, int]]:
    """(initial, cost to go with it, next state) of the edits that take a row in state q."""
    out = [("D", DELETE + v[q], q)]
    if symbol != "D":
        more = TRUNCATED if symbol.isupper() else 0
        kept = _KEEP.get((q, symbol.lower()))
        if kept is not None:
            out.append(("K", more + v[kept], kept))
        out.append(("R", REROLE + more + v[_TURN_TO[q]], _TURN_TO[q]))
    return out


def _step(symbol: str, v: tuple[int, ...]) -> tuple[int, ...]:
    return _closed([min(c for _, c, _ in _options(symbol, v, q)) for q in range(4)])


def _walk(symbol: str, v: tuple[int, ...], q: int) -> tuple[str, int]:
    """The least audit of the cheapest edits up to and with this row, and the state after it."""
    here, out = _step(symbol, v), ""
    while True:
        ways = [(a, to, True) for a, c, to in _options(symbol, v, q) if c == here[q]]
        if INSERT + here[_TURN_TO[q]] == here[q]:
            ways.append(("I", _TURN_TO[q], False))
        a, q, took = min(ways)
        out += a
        if took:
            return out, q


def _automaton() -> tuple[list, list, list]:
    """Shapes that occur, from the end's; for each shape and symbol the next shape and the constant, and
    for each shape, symbol and state the traced edits."""
    shapes = [_closed([0, 10**6, 10**6, 0])]
    at, step, walk = {shapes[0]: 0}, [], []
    for v in shapes:  # grows while it is read
        row = {}
        for s in SYMBOLS:
            w = _step(s, v)
            low = min(w)
            shape = tuple(c - low for c in w)
            if shape not in at:
                at[shape] = len(shapes)
                shapes.append(shape)
            row[s] = (at[shape], low)
        step.append(row)
        walk.append({s: [_walk(s, v, q) for q in range(4)] for s in SYMBOLS})
    return shapes, step, walk


SHAPES, STEP, WALK = _automaton()
#: edits after the last row, by state
LAST = ("", "II", "I", "")


def faults(roles: list[str], texts: list[str], first: Callable[[int], bool]) -> tuple[str, int, int, int, int]:
    """Rows as symbols; blank, duplicate and truncated rows; pairs of neighbours in illegal order.
    ``first(i)`` tells whether row i's role and text were not seen before."""
    code, blank, duplicate, truncated = [], 0, 0, 0
    for i, (r, t) in enumerate(zip(roles, texts, strict=True)):
        t = t.rstrip(SPACE)
        if not t:
            blank += 1
            code.append("D")
        elif not first(i):
            duplicate += 1
            code.append("D")
        else:
            c = r[0] if r[:1] in ("s", "u", "a") else "x"
            if t[-1] not in ".!?":
                truncated += 1
                c = c.upper()
            code.append(c)
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    return "".join(code), blank, duplicate, truncated, illegal


def backward(code: str, shape: int) -> tuple[list[int], list[int]]:
    """Shape and total constant at each border between rows, from the last to the first."""
    shapes, total, sums = [shape], 0, [0]
    for s in reversed(code):
        shape, c = STEP[shape][s]
        total += c
        shapes.append(shape)
        sums.append(total)
    return shapes, sums


def left_of(code: str) -> list[int]:
    """For each shape that may arrive at the right end, the one that leaves at the left: one run from
    a speculative vector, fixed up from the others until they differ by a constant only."""
    base, _ = backward(code, 0)
    out = [base[-1]]
    for shape in range(1, len(SHAPES)):
        for k, s in enumerate(reversed(code)):
            if shape == base[k]:
                shape = base[-1]
                break
            shape = STEP[shape][s][0]
        out.append(shape)
    return out


def right_of(code: str, shape: int) -> list[int]:
    """For each state that may arrive at the left end, the one at the right, under ``shape`` there."""
    shapes, _ = backward(code, shape)
    out = []
    for q in range(4):
        for k, s in enumerate(code):
            q = WALK[shapes[len(code) - 1 - k]][s][q][1]
        out.append(q)
    return out


def edit(code: str, roles: list[str], texts: list[str], shape: int, q: int) -> tuple[str, int, int, int, list[str]]:
    """(audit, constant, left shape, last state, repaired rows) of a chunk under the shape at its right
    end and the state at its left."""
    shapes, sums = backward(code, shape)
    audit, rows = [], []
    for k, s in enumerate(code):
        letters, end = WALK[shapes[len(code) - 1 - k]][s][q]
        for a in letters:
            if a == "I":
                q = _TURN_TO[q]
                rows.append(f"{_ROLE[q]}:")
            elif a == "R":
                rows.append(f"{_ROLE[_TURN_TO[q]]}:{texts[k]}")
            elif a == "K":
                rows.append(f"{roles[k]}:{texts[k]}")
        audit.append(letters)
        q = end
    return "".join(audit), sums[-1], shapes[-1], q, rows


def last_rows(q: int) -> list[str]:
    out = []
    for _ in LAST[q]:
        q = _TURN_TO[q]
        out.append(f"{_ROLE[q]}:")
    return out


RESULT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NUMBERS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _batches(rows: Iterable[dict], fields: dict[str, pa.DataType], weight: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    some, size = [], 0
    schema = pa.schema(list(fields.items()))
    for r in rows:
        some.append(r)
        size += 100 + weight(r)
        if size > CHUNK_CHARS:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _whole(key: str, roles: list[str], texts: list[str]) -> dict:
    """The result of a conversation that is one chunk."""
    seen: set[tuple[str, str]] = set()

    def first(i: int) -> bool:
        pair = (roles[i], texts[i])
        return pair not in seen and not seen.add(pair)

    code, *counts = faults(roles, texts, first)
    audit, cost, shape, q, rows = edit(code, roles, texts, 0, 0)
    rows += last_rows(q)
    numbers = dict(zip(_NUMBERS, [*counts, cost + SHAPES[shape][0]], strict=True))
    return {"key": key, **numbers, "audit": audit + LAST[q], "repaired_sha256": hashlib.sha256("\n".join(rows).encode()).hexdigest()}


_LIST = pa.list_(pa.string())
_PIECES = {"key": pa.string(), **dict.fromkeys(_NUMBERS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string(), "pid": pa.int64(), "c": pa.int64(), "roles": _LIST, "texts": _LIST}


def _cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: results of the conversations inside it, chunks of its first, its last and
    its long ones, which may go on elsewhere."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()

    def rows() -> Iterator[dict]:
        key, roles, texts, size, edge, c = None, [], [], 0, True, 0
        for b in batches:
            for k, r, t in zip(*(b.column(n).to_pylist() for n in ("key", "role", "text")), strict=True):
                if k != key:
                    if key is not None:
                        yield {"key": key, "pid": pid, "c": c, "roles": roles, "texts": texts} if edge else _whole(key, roles, texts)
                        edge = False
                    key, roles, texts, size = k, [], [], 0
                    c += 1
                elif len(roles) >= CHUNK_ROWS or size > CHUNK_CHARS:
                    yield {"key": key, "pid": pid, "c": c, "roles": roles, "texts": texts}
                    roles, texts, size, edge = [], [], 0, True
                    c += 1
                roles.append(r)
                texts.append(t)
                size += len(r) + len(t)
        if key is not None:
            yield {"key": key, "pid": pid, "c": c, "roles": roles, "texts": texts}

    yield from _batches(rows(), _PIECES, lambda r: sum(map(len, r["texts"])) if "texts" in r else len(r["audit"]))


def stitch(maps: DataFrame, first: int, backwards: bool) -> DataFrame:
    """maps (key, pid, c, f: array of where each value leads) -> key, pid, c, arrives: the value that
    arrives at each chunk, ``first`` being that of a key's first chunk in walking order."""
    most = maps.agg(F.max("pid")).first()[0] or 0
    levels, rows, shift = [], maps.select("key", F.col("pid").alias("g"), F.col("c").alias("o"), "f"), 0
    while True:
        run = rows.groupBy("key", "g").agg(F.sort_array(F.collect_list(F.struct("o", "f")), asc=not backwards).alias("run"))
        through = F.aggregate(F.slice("run", 2, CHUNK_CHARS), F.get("run", F.lit(0)).f, lambda at, x: F.transform(at, lambda i: F.get(x.f, i)))
        levels.append(cut(run.withColumn("f", through)))
        if most >> shift == 0:
            break
        # groups of partitions; the last level has one group per key
        rows = levels[-1].select("key", F.shiftright("g", FAN_BITS).alias("g"), F.col("g").alias("o"), "f")
        shift += FAN_BITS
    arrives = levels[-1].select("key", "g", F.lit(first).alias("arrives"))
    for level in reversed(levels):
        w = level.join(arrives, ["key", "g"])
        path = F.aggregate("run", F.array("arrives"), lambda acc, x: F.concat(acc, F.array(F.get(x.f, F.element_at(acc, -1)))))
        w = w.select("key", "g", F.explode(F.arrays_zip(F.col("run.o").alias("o"), F.slice(path, F.lit(1), F.size("run")).alias("a"))).alias("e"))
        arrives = w.select("key", F.col("g").alias("pid"), F.col("e.o").alias("g"), F.col("e.a").alias("arrives"))
    return arrives.withColumnRenamed("g", "c")


def _first_places(pieces: DataFrame) -> DataFrame:
    """For each chunk the places of rows whose role and text no earlier row of the conversation has."""
    row = F.posexplode(F.arrays_zip(F.col("roles").alias("r"), F.col("texts").alias("t")))
    rows = pieces.select("key", "pid", "c", row.alias("i", "e"))
    same = F.sha2(F.concat(F.length("e.r").cast("string"), F.lit(":"), F.col("e.r"), F.col("e.t")).cast("binary"), 256)
    firsts = rows.groupBy("key", same.alias("same")).agg(F.min(F.struct("pid", "c", "i")).alias("p"))
    return firsts.groupBy("key", "p.pid", "p.c").agg(F.collect_list("p.i").alias("firsts"))


def _coded(pieces: DataFrame) -> DataFrame:
    """pieces with firsts -> key, pid, c, code, blank, duplicate, truncated, illegal, left (a map of shapes)."""
    fields = {"key": pa.string(), "pid": pa.int64(), "c": pa.int64(), "code": pa.string(), **dict.fromkeys(_NUMBERS[:4], pa.int64()), "f": pa.list_(pa.int32())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for i in range(b.num_rows):
                    (r,) = b.slice(i, 1).to_pylist()
                    code, *counts = faults(r["roles"], r["texts"], set(r["firsts"] or ()).__contains__)
                    yield {"key": r["key"], "pid": r["pid"], "c": r["c"], "code": code, **dict(zip(_NUMBERS, counts, strict=False)), "f": left_of(code)}

        yield from _batches(rows(), fields, lambda r: len(r["code"]))

    return pieces.mapInArrow(run, "key string, pid long, c long, code string, blank long, duplicate long, truncated long, illegal long, f array<int>")


def _forward(coded: DataFrame) -> DataFrame:
    """(key, pid, c, code, shape) -> key, pid, c, f: a map of states."""
    fields = {"key": pa.string(), "pid": pa.int64(), "c": pa.int64(), "f": pa.list_(pa.int32())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"key": r["key"], "pid": r["pid"], "c": r["c"], "f": right_of(r["code"], r["shape"])} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(fields.items())))

    return coded.mapInArrow(run, "key string, pid long, c long, f array<int>")


def _edited(chunks: DataFrame) -> DataFrame:
    """Chunks with code, shape and state -> their part of the audit and of the repaired rows."""
    extra = {"audit": pa.string(), "cost": pa.int64(), "left": pa.int64(), "q": pa.int64(), "rows": pa.string(), "a": pa.string(), "z": pa.string()}
    fields = {"key": pa.string(), "pid": pa.int64(), "c": pa.int64(), **dict.fromkeys(_NUMBERS[:4], pa.int64()), **extra}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for i in range(b.num_rows):
                    (r,) = b.slice(i, 1).to_pylist()
                    audit, cost, left, q, rows = edit(r["code"], r["roles"], r["texts"], r["shape"], r["state"])
                    r |= {"audit": audit, "cost": cost, "left": left, "q": q, "rows": "\n".join(rows), "a": r["roles"][0][:1], "z": r["roles"][-1][:1]}
                    yield {k: r[k] for k in fields}

        yield from _batches(rows(), fields, lambda r: len(r["rows"]) + len(r["audit"]))

    ddl = "key string, pid long, c long, blank long, duplicate long, truncated long, illegal long, audit string, cost long, left long, q long, rows string, a string, z string"
    return chunks.mapInArrow(run, ddl)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order -> one result per conversation; rows are hashed as they come."""

    def rows() -> Iterator[dict]:
        out, sha, audit, q, z, some = None, hashlib.sha256(), [], 0, "", False

        def done() -> dict:
            for r in last_rows(q):
                sha.update(f"\n{r}".encode() if some else r.encode())
            return out | {"audit": "".join(audit) + LAST[q], "repaired_sha256": sha.hexdigest()}

        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                if out is None or r["key"] != out["key"]:
                    if out is not None:
                        yield done()
                    out, sha, audit, some = {"key": r["key"], **dict.fromkeys(_NUMBERS, 0)}, hashlib.sha256(), [], False
                    out["cost"] = SHAPES[r["left"]][0]
                elif z + r["a"] not in LEGAL:
                    out["illegal"] += 1
                for k in _NUMBERS:
                    out[k] += r[k]
                if r["rows"]:
                    sha.update(f"\n{r['rows']}".encode() if some else r["rows"].encode())
                    some = True
                audit.append(r["audit"])
                q, z = r["q"], r["z"]
        if out is not None:
            yield done()

    fields = {k: _PIECES[k] for k in ("key", *_NUMBERS, "audit", "repaired_sha256")}
    yield from _batches(rows(), fields, lambda r: len(r["audit"]))


def repair(turns: DataFrame) -> DataFrame:
    """turns (key: not null, turn, role, text) -> one row per key: blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select("key", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    rows = rows.withColumn("_head", F.substring("text", 1, 64)).withColumn("_sha", F.sha2(F.col("text").cast("binary"), 256))
    order = ["key", "turn", "role", "_head", "_sha", "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    columns = f"key string, {RESULT}, pid long, c long, roles array<string>, texts array<string>"
    found = cut(rows.select("key", "role", "text").mapInArrow(_cut_up, columns))

    at = ["key", "pid", "c"]
    pieces = found.where("pid is not null").select(*at, "roles", "texts")
    coded = cut(_coded(pieces.join(_first_places(pieces), at, "left")))
    shapes = cut(stitch(coded, 0, backwards=True).withColumnRenamed("arrives", "shape"))
    states = stitch(cut(_forward(coded.join(shapes, at).select(*at, "code", "shape"))), 0, backwards=False)
    chunks = pieces.join(coded.drop("f"), at).join(shapes, at).join(states.withColumnRenamed("arrives", "state"), at)
    joined = _edited(chunks).repartition("key").sortWithinPartitions(*at).mapInArrow(_joined, f"key string, {RESULT}")
    return found.where("pid is null").select(*joined.columns).unionByName(joined)


def damaged(turns: DataFrame) -> DataFrame:
    """conversations -> key, conv_id, turn, role, text and copies (0 to 2), by the crc32 of conv_id:turn."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said["text"], ".!?", "")).otherwise(said["text"])
    return turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(said["role"]).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    rows = damaged(table(spark, sf_dir, "conversations"))
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max(turn)) - wide(F.min(turn)) + 1 - F.count_distinct(turn)
    conversations = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.coalesce(gaps.cast("long"), F.lit(0)).alias("gaps"))
    fixed = repair(rows.select(F.explode(F.array_repeat("key", F.col("copies"))).alias("key"), "turn", "role", "text"))
    out = conversations.join(fixed, "key", "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id",
        "gaps",
        *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in _NUMBERS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
