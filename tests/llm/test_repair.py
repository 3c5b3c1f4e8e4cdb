"""Conversation repair against an exhaustive search over edits, in chunks of every size."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from prepline.llm import repair

TURNS = "conv_id long, turn long, role string, text string, key string, copies int, pid long, code string"
GOAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, audit) and its rows by a search over whole edit sequences: rows are (role, text, must go, truncated)."""
    prefix = re.compile(r"s?(ua)*u?")
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        form = (roles[:1] == "s", len(roles) - (roles[:1] == "s") > 0, roles[-1:])
        if (i, form) in seen:
            continue
        if i == len(rows) and GOAL.fullmatch(roles):
            return cost, audit, list(out)
        seen.add((i, form))
        ways = [(3, "I", 0, "u", "user:"), (3, "I", 0, "a", "assistant:")]
        if i < len(rows):
            role, text, gone, cut = rows[i]
            ways.append((4, "D", 1, "", None))
            if not gone:
                ways.append((3 * cut, "K", 1, role[:1] or "?", f"{role}:{text}"))
                ways += [(3 + 3 * cut, "R", 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for c, a, n, r, row in ways:
            if prefix.fullmatch(roles + r):
                heapq.heappush(heap, (cost + c, audit + a, i + n, roles + r, out if row is None else (*out, row)))


def brute(rows):
    """(conv_id, turn, role, text) -> the contract's columns by definition."""
    say = lambda v: " " if v is None else str(v)
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, [])
        h = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        r, x = say(r), say(x)
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        by[c] += [(t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, r, x in turns:
            word = re.sub(r"[\x20\x09-\x0D]+", "", x)
            fault = 0 if not word else 1 if (r, x) in seen else 2 if word[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((r, x))
            marked.append((r, x, fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, fixed = cheapest(marked)
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return out


def key(t):
    return (t[0] is not None, t[0] or 0)


def make(rng, n_rows, n_convs, roles):
    rows = []
    for k in range(n_rows):
        conv = rng.choice([None, 7, *range(n_convs)]) if k % 3 else 7
        turn = rng.choice([None, k, k, k, 3])
        text = rng.choice(["one.", "two", "three! ", "", " \n", None, "Is it?", f"row {k}.", f"row {k}", "é" * 70 + str(k % 5) + "."])
        rows.append((conv, turn, rng.choice(roles), text, "k", 1, 5, "c"))
    return rows


@pytest.fixture
def tables(spark, monkeypatch):
    def run(rows):
        df = spark.createDataFrame(rows, TURNS)
        monkeypatch.setattr("prepline.llm.common.table", lambda *_: df)
        got = sorted((tuple(r) for r in repair.op12_conversation_repair(spark, "").collect()), key=key)
        assert got == sorted(brute([r[:4] for r in rows]), key=key)

    return run


@pytest.mark.parametrize("chunk", [2, 4096])
@pytest.mark.parametrize("roles", [["user", "assistant", "system", "tool", None, ""], ["user"]])
def test_rows_equal_a_search(tables, monkeypatch, chunk, roles):
    # the tasks' code reads CHUNK_ROWS from the module they import, so chunks of two are cut by the size of partitions there
    monkeypatch.setattr(repair, "FAN_BITS", 1 if chunk == 2 else 9)
    tables(make(random.Random(chunk), 260, 40, roles))


def test_many_small_conversations(tables):
    rng = random.Random(9)
    tables([(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c!", ""]) + ("" if t % 2 else f"{t}."), "k", 1, 5, "c") for c in range(120) for t in range(rng.randint(1, 7))])


def test_chunks_equal_one_run():
    rng = random.Random(5)
    for _ in range(200):
        code = "".join(rng.choice(rng.choice(["ua", "u", "x", repair.SYMBOLS, "DDDu"])) for _ in range(rng.randint(1, 40)))
        for shape in range(len(repair.SHAPES)):
            assert repair.left_of(code)[shape] == repair.backward(code, shape)[0][-1]
        roles, texts = ["user"] * len(code), list(map(str, range(len(code))))
        whole = repair.edit(code, roles, texts, 0, 0)
        cut = rng.randint(0, len(code))
        right = repair.edit(code[cut:], roles[cut:], texts[cut:], 0, repair.right_of(code[:cut], repair.left_of(code[cut:])[0])[0])
        left = repair.edit(code[:cut], roles[:cut], texts[:cut], repair.left_of(code[cut:])[0], 0)
        assert (left[0] + right[0], left[1] + right[1], left[2], right[3], left[4] + right[4]) == whole


def test_long_conversation_in_chunks(spark):
    """Cutting by rows: 9,000 rows of one conversation, of which no task holds more than a chunk as one row."""
    rows = [(f"{k:05d}", "user" if k % 5 else "assistant", f"text {k}.") for k in range(9000)]
    df = spark.createDataFrame(rows, "turn string, role string, text string").selectExpr("'k' as key", "*")
    (got,) = repair.repair(df.coalesce(1)).collect()
    want = repair._whole("k", [r[1] for r in rows], [r[2] for r in rows])
    assert {k: got[k] for k in want} == want


def test_empty(spark):
    df = spark.createDataFrame([], "key string, turn long, role string, text string")
    assert repair.repair(df).count() == 0
