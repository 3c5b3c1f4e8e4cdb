"""Chat, mixing, packing, line dedup, quality rules, classifier, near-duplicates: brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepline.llm import chat, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules
from prepline.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id long, take long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    base = [" ".join(rng.choice(vocab) + str(rng.randint(0, 40)) for _ in range(60)) for _ in range(12)]
    rows = []
    for k in range(60):
        words = base[k % 12].split()
        if k >= 12 and k % 3:
            words[rng.randrange(60)] = "changed"
        text = " ".join(words[:30]) + "\n" + " ".join(words[30:])
        rows.append((k, text, "en" if k % 4 else None, f"s{k % 5}" if k % 7 else None, len(text), 1, 2))
    rows += [(100, None, None, None, None, 1, 2), (101, "", "en", "s1", 0, 1, 2), (102, " \n\t", "en", "s1", 3, 1, 2), (103, "one", "en", "z", 3, 1, 2), (104, "one", "en", "z", 3, 1, 2)]
    rows += [(None, "no id at all, a text by itself that nobody else has", "en", "s2", 50, 1, 2), (5, rows[5][1], "en", "s2", 9, 1, 2), (106, "x" * 50_000 + " end", "en", "s3", 50_004, 1, 2)]
    return spark.createDataFrame(rows, DOCS)


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|turn|>", "a\nb", "", None, "<\\\\|x", "<|nl|>", "é" * 3, "<", "|"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", None, "<|r"]), rng.choice(texts)) for c in (1, 2, None) for t in [0, 0, None, 3, 4, 5, 6, 7]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for c in (1, 2, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for cc, t, r, x in rows if cc == c))
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(turns)
        assert g["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_mixing_targets_and_order(docs):
    sized = mixing.sized(docs)
    got = mixing.taken(mixing.mix(sized)).toPandas()
    assert len(got) == docs.count()
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby(got["source"].fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((by["taken"] - by["target"]).abs() <= len(by)).all()
    assert by["taken"].sum() == got["size"].sum()
    # water filling: no target above 3 x, the others in proportion to their weights
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(x for x in by.index if x != "~") + ["~"])}
    level = {s: by.loc[s, "target"] / weight[s] for s in by.index if by.loc[s, "target"] < 3 * by.loc[s, "size"]}
    assert max(level.values()) - min(level.values()) < 1e-6
    order = mixing.mix(sized, budget=200).where("take > 0").toPandas().sort_values("mix_start")
    assert order["mix_start"].tolist() == [0, *np.cumsum(order["take"]).tolist()[:-1]]
    assert order["take"].sum() == 200
    assert mixing.taken(mixing.mix(sized.limit(0))).count() == 0


def test_encoder_equals_tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    enc = packing.Encoder(str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")))
    rng = random.Random(5)
    al = ["a", "B", "é", " ", "  ", "\n", "\t", " ", "1", "!", "'s", "<|endoftext|>", "\x1c", "\x85", "字", ".", ",", ". ", ".\n", "\xa0", "\r\n"]
    texts = ["".join(rng.choice(al) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t, x in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_encoder_takes_new_parts_of_a_block_in_one_call():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    enc = packing.Encoder(str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")))
    plain, calls = enc.plain, []
    enc.plain = lambda text: calls.append(text) or plain(text)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(8)) for _ in range(2000)]
    texts = [" ".join(words[k : k + 50]) + ".\n" + words[k] + ", it's" for k in range(0, 2000, 20)]
    for t, x in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert len(calls) < 5  # one per distinct part, 2,000 and more, before
    enc.encode(texts)
    assert len(calls) < 5


def test_encoder_blocks_slices_and_full_cache(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    enc = packing.Encoder(str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")))
    monkeypatch.setattr(packing, "BLOCK", 40)
    monkeypatch.setattr(packing, "CACHE_WORDS", 30)
    rng = random.Random(7)
    al = ["a", "Be", "é", "ʰ", "ȿ", "ɏ", "“", "字", "×", " ", "  ", "\n", "\n\n", "\t", "\u3000", "\u2003", "\xa0", "\xad", "\x7f", "\x00", "1", "!", ".", ",", "'", "'re", "<|", "|>", "<|endoftext|>", "😀"]
    texts = ["", " ", "\n", "\na", "a\n", ". a", "a", "", *("".join(rng.choice(al) for _ in range(rng.randint(0, 40))) for _ in range(1500)), ""]
    for kind in (pa.string(), pa.large_string()):
        got = []
        for first, data, at in packing.blocks(pa.array(["left out", *texts], kind).slice(1)):
            assert first == len(got)
            ids, where = enc.encode_block(data, at)
            got += [np.frombuffer(ids[lo:hi], "<u4").tolist() for lo, hi in zip(where[:-1], where[1:], strict=True)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert not list(packing.blocks(pa.array([], pa.string())))
    # long parts are forgotten by their bytes, however few they are
    monkeypatch.setattr(packing, "CACHE_BYTES", 4000)
    enc.forget()
    for k in range(20):
        enc.encode([f"{k}{'字' * 500}"])
        assert enc.parts.nbytes < 4000 + 2 * 1500


def test_best_fit_by_definition():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 400)
    bin_of, offset, fill = packing.best_fit(sizes, 64)
    assert (fill <= 64).all() and (np.bincount(bin_of, weights=sizes) == fill).all()
    rooms = []  # the plain method: the fullest bin that still fits, longest first
    for n in sorted(sizes.tolist(), reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(64 - n)
    assert sorted(64 - f for f in fill.tolist()) == sorted(rooms)


def test_packing_pieces_and_places(docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    got = packing.sequences(docs).toPandas()
    ids = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    for k, g in got[got["doc_id"].notna() & (got["doc_id"] != 5)].groupby("doc_id"):
        g = g.sort_values("piece")
        assert g["start"].tolist() == [0, *np.cumsum(g["length"]).tolist()[:-1]] and g["length"].sum() == len(ids[k])
        assert (g["length"].iloc[1:] == 1024).all()
        for s, n, c in zip(g["start"], g["length"], g["ids_crc32"], strict=True):
            assert zlib.crc32(np.array(ids[k][s : s + n], "<u4").tobytes()) == c
    assert (got["doc_id"] == 5).sum() == 2 and got["doc_id"].isna().sum() == 1
    s = got.sort_values(["sequence_id", "offset"])
    assert (s["offset"] == s.groupby("sequence_id")["length"].cumsum() - s["length"]).all()
    assert s.groupby("sequence_id")["length"].sum().max() <= 1024
    many = packing.pack(docs.sparkSession.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 700 + 1).alias("length")), group_rows=500)
    fill = many.groupBy("sequence_id").agg(F.sum("length").alias("f")).toPandas()["f"]
    assert fill.max() <= 1024 and len(fill) <= 1.02 * sum(k % 700 + 1 for k in range(3000)) / 1024 + 1
    assert packing.sequences(docs.limit(0)).count() == 0


def _edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("hot_pairs", [line_dedup.HOT_PAIRS, 2])
def test_line_dedup_by_definition(spark, monkeypatch, hot_pairs):
    monkeypatch.setattr(line_dedup, "HOT_PAIRS", hot_pairs)  # 2: nearly every group is split by its rests
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeé fgh") for _ in range(rng.randint(24, 40))).strip() + "xyz" for _ in range(15)]
    base += ["one template of some words: " + "".join(rng.choice("0123456789") for _ in range(rng.randint(3, 30))) for _ in range(15)]
    base += ["ab" * 15 + "c" * k for k in range(3)]
    rows = []
    for k in range(40):
        ls = []
        for _ in range(rng.randint(1, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                i = rng.randrange(len(x))
                x[i : i + 1] = rng.choice([[], ["q"], ["q", x[i]]])
            ls.append("".join(x))
        rows.append((k, "\n".join(ls + [rng.choice(["", "short", "  "])])))
    rows += [(50, None), (51, ""), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("kept"))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    firsts = {}
    for k, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        for i, x in enumerate((t or "").split("\n")):
            n = x.strip(" \t\n\r\x0b\x0c")
            if len(n) >= line_dedup.MIN_CHARS:
                firsts.setdefault(n, (-1 if k is None else k, i))
    near = {y for y, b in firsts.items() for x, a in firsts.items() if a < b and min(len(x), len(y)) >= line_dedup.NEAR_CHARS and abs(len(x) - len(y)) <= 2 and _edits(x, y) <= 2}
    assert near
    for k, t in rows:
        if t is None:
            assert got[k]["text"] is None
            continue
        keep = []
        for i, x in enumerate(t.split("\n")):
            n = x.strip(" \t\n\r\x0b\x0c")
            if len(n) < line_dedup.MIN_CHARS or (n not in near and firsts[n] == (-1 if k is None else k, i)):
                keep.append(x)
        assert got[k]["text"] == "\n".join(keep), k
        assert got[k]["mark"] == "kept"
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def _repeat_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)

    def covered(n):
        at = defaultdict(list)
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].append(i)
        return len({j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + n)})

    longest = 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
    ls = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), covered(8), covered(4), longest if longest >= 4 else 0


def test_quality_rules_by_definition(docs, monkeypatch):
    rng = random.Random(2)
    texts = []
    for _ in range(200):
        w = [rng.choice("abcdefg"[: rng.choice([2, 3, 6])]) for _ in range(rng.randint(0, 50))]
        texts.append("".join(x + rng.choice([" ", "\n", "  ", "\t", "# "]) for x in w + w[: rng.choice([0, len(w)])]))
    want = [_repeat_counts(t) for t in texts]
    assert want == [tuple(r) for r in quality_rules.measure(texts).itertuples(index=False)]
    monkeypatch.setattr(quality_rules, "LEVEL_RANKS", 0)  # as for texts whose ranks would be too many
    assert want == [tuple(r) for r in quality_rules.measure(texts).itertuples(index=False)]
    got = quality_rules.judge(docs).toPandas()
    assert len(got) == docs.count() and got["base_failed"].sum() == (got["n_words"] < 20).sum()
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_quality_verdicts_by_definition(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    phrases = [" ".join(word() for _ in range(5)) for _ in range(4)]
    texts = {k: " ".join(word() for _ in range(150)) for k in range(3)}  # clean
    for k in range(3, 6):  # phrases of five words said again and again: no window of eight repeats
        texts[k] = " ".join(f"{rng.choice(phrases)} {word()}" for _ in range(25))
    texts[6] = " ".join([texts[0]] * 2)  # the base rule's own case
    copied = " ".join(word() for _ in range(60))
    texts[7] = " ".join([copied, *[word() for _ in range(290)], copied])  # under 30 %, one repeat of 60 words
    texts[8] = " ".join([copied, *[word() for _ in range(100)], copied, *[word() for _ in range(190)]])
    texts[9] = " ".join(["same"] * 50_000)
    texts[10] = None
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for k, t in texts.items():
        if k == 9:
            assert got[k]["n_repeat_words"] == 50_000 and got[k]["longest_repeat"] == 49_999 and not got[k]["kept"]
            continue
        n, _, _, _, base, phrase, longest = _repeat_counts(t or "")
        failed = n < 20 or 100 * base > 30 * n
        kept = not failed and phrase <= 0.5 * n and longest <= max(50, 0.2 * n)
        assert (got[k]["base_failed"], got[k]["kept"]) == (failed, kept), k
    assert all(got[k]["kept"] for k in range(3))
    assert not any(got[k]["base_failed"] or got[k]["kept"] for k in range(3, 6))


def test_classifier_held_out(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(30, 80))]
        poor, toxic = k % 5 == 0, k % 7 == 0
        if poor:
            w = [x + "***" for x in w]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "scumbag", "trashy"])
        rows.append((k, " ".join(w), "en", f"s{k % 3}", 1))
        if k < 250:
            labels.append((k, 0 if poor else 1, int(toxic)))
    rows += [(1000, None, None, None, 2), (1001, "", None, "s1", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept_before int")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(d, lab).toPandas()
    assert len(got) == len(rows) and set(d.columns) < set(got.columns)
    held = got[(got["doc_id"] >= 250) & (got["doc_id"] < 400)]
    right = held["kept"] == ((held["doc_id"] % 5 != 0) & (held["doc_id"] % 7 != 0))
    assert right.mean() > 0.97
    assert quality_classifier.classify(d, lab.limit(0)).where("kept").count() == len(rows)
    assert quality_classifier.classify(d.limit(0), lab).count() == 0


def test_classifier_scores_each_text_once_for_its_rows(spark):
    """Keeping the good documents must not run the scoring again, nor twice: the plan has no Python left,
    and the texts come in small batches whatever the session says."""
    rows = [(k, ("good words here " if k % 2 else "*** ### $$$ ") * 5, "en", "s") for k in range(40)] + [(7, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    out = quality_classifier.classify(d, lab)
    assert spark.conf.get(key) == before
    kept = out.where("kept").select(*d.columns)
    assert "EvalPython" not in kept._jdf.queryExecution().executedPlan().toString()
    narrow = quality_classifier.classify(d, lab, with_text=False).where("kept")
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, (r["doc_id"] for r in narrow.collect())))
    assert {r["doc_id"] for r in kept.collect()} >= set(range(9, 40, 2))


def test_small_batches_end_with_the_block(spark):
    from prepline.llm.common import TEXT_ROWS, cut, small_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = lambda batches: (b.iloc[:1].assign(id=len(b)) for b in batches)
    try:
        for given, most in (("10000", TEXT_ROWS), ("70", 70), ("0", TEXT_ROWS)):
            spark.conf.set(key, given)
            with small_batches(spark):
                got = [r["id"] for r in cut(spark.range(0, 2500, 1, 1).mapInPandas(sizes, "id long")).collect()]
            assert sum(got) == 2500 and max(got) == most and spark.conf.get(key) == given
    finally:
        spark.conf.set(key, before)


def test_site_posteriors_by_definition(spark):
    rng = random.Random(21)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.choice(["en", "de", None]), rng.gauss(0, 2) + 3 * (k % 3 == 0)) for k in range(600)]
    rows += [(600, "rare", "fr", 1.0), (601, "rare", "fr", -4.0), (None, "a", "en", 0.5)]
    labels = [(k, rng.random() < 0.6, rng.random() < 0.3) for k in range(0, 600, 4)]
    scored = spark.createDataFrame(rows, "doc_id long, source string, lang string, own_poor double")
    known = spark.createDataFrame([(k, int(q), int(t)) for k, q, t in labels] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    sites = quality_classifier.sites_of(scored, known, ["poor"])
    got = {(r["doc_id"], r["source"], r["lang"]): r for r in quality_classifier.decide(scored, sites, ["poor"]).collect()}

    p = lambda x: 1 / (1 + np.exp(-x))
    poor = {k: float(not q) for k, q, _ in labels}
    paths, hosts = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    for k, source, lang, own in rows:
        n, y = (1.0, poor[k]) if k in poor else (quality_classifier.SOFT, p(own))
        for c in (paths[source, lang], hosts[source]):
            c[0] += n
            c[1] += n * y

    def prior(counts):
        n, k = np.array(list(counts.values())).T
        m = k.sum() / n.sum()
        between = (n * (k / n) ** 2).sum() / n.sum() - m * m - m * (1 - m) * len(n) / n.sum()
        return m, min(1e6, max(2.0, m * (1 - m) / between - 1)) if between > 1e-12 else 1e6

    logit = lambda x: np.log(x / (1 - x))
    (m, a), (_, b) = prior(hosts), prior(paths)
    host = {h: (k + a * m) / (n + a) for h, (n, k) in hosts.items()}
    for doc, source, lang, own in rows:
        n, k = paths[source, lang]
        want = p(own + logit((k + b * host[source]) / (n + b)) - logit(m))
        assert got[doc, source, lang]["p_poor"] == pytest.approx(want, abs=1e-9)
        assert got[doc, source, lang]["kept"] == (want < quality_classifier.REJECT_AT)
    assert len(got) == len(rows)


def test_near_duplicates_by_definition(docs):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())
        if r["doc_id"] is not None:
            sets[r["doc_id"]] = frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for k, s in sets.items():
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (len(s), find(k), find(k) == k)
    assert len({find(k) for k in sets}) < len(sets) - 10
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_without_or_with_shared_ids(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a, b = [[word() for _ in range(120)] for _ in range(2)]
    near = lambda w, i: " ".join([*w[:i], "changed", *w[i + 1 :]])
    rows = [(7, " ".join(a)), (None, near(a, 5)), (9, near(a, 100)), (20, " ".join(b)), (20, "some other words under one id"), (21, near(b, 50)), (22, "Some other words under one id")]
    rows += [(None, "alone without an id or a partner"), (None, None), (7, " ".join(a))]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(7, 118, 7), (None, 118, 7), (9, 118, 7), (20, 118, 20), (21, 118, 20), (20, 4, 20), (22, 4, 20), (None, 5, None), (None, 0, None)}
    assert got == want


def test_shingles_by_definition(monkeypatch):
    rng = random.Random(3)
    al = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "word", "\u2028", "x" * 70, "x" * 64, "\r", "\x0b\x0c"]
    texts = ["".join(rng.choice(al) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", " ", "a a a a a a", "A b", " a  B ", "x" * 71]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for n in (1, 3, 5):
        known = {}
        for chunk in (1 << 20, 60, 1):
            monkeypatch.setattr(minhash, "CHUNK", chunk)
            for t, got in zip(texts, minhash.Shingler(n).many(texts), strict=True):
                w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
                want = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
                assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
                assert known.setdefault(frozenset(want), got.tobytes()) == got.tobytes()
        assert len(set(known.values())) == len(known)


def test_signatures_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in [1, 2, 3, 30, 200, 5000, 1, 700]]
    probes = minhash._probe_table()
    many = minhash.signatures(sets, probes)
    for x, got in zip(sets, many, strict=True):
        assert np.array_equal(minhash.signatures([x], probes)[0], got)
        h = minhash._mix(x + np.uint64(0x632BE59BD9B4E019))
        own = {}
        for v in h.tolist():
            own[v >> 56] = min(v, own.get(v >> 56, 1 << 64))
        for i in range(minhash.BINS):
            donor = next((p for p in [i, *probes[i].tolist(), *range(i, minhash.BINS), *range(i)] if p in own))
            assert got[i] == own[donor], i


def test_leftover_pair_whose_earlier_band_agrees_in_bytes_only(spark):
    n = minhash.BINS // minhash.BAND
    bits, fine = bytes(range(256)), bytes(minhash.FINE_BINS)
    fine = bytes([1]) + fine[1:]
    keys = {1: [10, *range(101, 100 + n)], 2: [20, *range(101, 100 + n)]}  # bucket 0 differs, all others are shared
    marks = spark.createDataFrame([(k, bits, keys[k], 500, fine) for k in (1, 2)], "node long, bits binary, keys array<long>, n long, fine binary")
    members = [(keys[k][p], p, k, k) for k in (1, 2) for p in range(1, n)]
    members = spark.createDataFrame(members, "band long, place int, node long, component long")
    got = [{r["node"], r["hub"]} for r in minhash.leftover_pairs(members, marks, 85).collect()]
    assert got == [{1, 2}]


def test_components_of_a_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert components(e).agg(F.max("component"), F.count("*")).first() == (0, 201)
