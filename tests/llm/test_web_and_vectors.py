"""URL filter, HTML extraction, vector search, the pipeline."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepline.llm import ann, html_extract, url_filter


def _rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
    host = re.sub("[A-Z]", lambda m: m.group(0).lower(), host)
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda r: len(r[0])) if fits else None


def test_url_rules_and_templates(spark):
    rows = [(k, f"https://News.example.com/{'de' if k % 3 else 'fr'}/{k}") for k in range(60)]
    rows += [(100 + k, f"http://a.example.org/en/{k}?x=/es/") for k in range(20)]
    rows += [(200, None), (201, "no scheme"), (202, "x://"), (203, "http://ORG/"), (204, "http://org"), (205, "http://example.org?/es/"), (206, "http://news.example.com/en/7"), (207, "http://h.net/a/b/c/d/e/f/g"), (207, "http://h.net/a/b/c/d/e/f/g")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    got = url_filter.judge(df).toPandas()
    assert len(got) == len(rows)
    urls = dict(rows)
    for r in got.itertuples():
        host, path, rule = _rule(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert r.verdict == rule[1] if rule else r.rule is None
        assert rule is None or r.rule == rule[0]
    by = got.set_index("page_id")
    assert by.loc[206, "verdict"] == "block"  # two thirds of its host's labelled urls are blocked
    assert url_filter.judge(df.limit(0)).count() == 0


def test_tree_keeps_branches_that_differ(spark):
    rows = [("h", ["good", "{n}"], 40, 0, 40), ("h", ["bad", "{n}"], 40, 40, 0), ("h", ["same", "{n}"], 40, 1, 39), ("h", ["new"], 2, 0, 0)]
    tree = {tuple(r["segs"]): r["purity"] for r in url_filter.template_tree(spark.createDataFrame(rows, "host string, segs array<string>, n long, bad long, good long")).collect()}
    assert tree["bad", "{n}"] < 0.2 < 0.8 < tree["good", "{n}"]
    assert tree["same", "{n}"] > 0.8 and 0.2 < tree["new",] < 0.9


def test_tree_is_as_deep_as_its_branches(spark, monkeypatch):
    deep = ["a", "b", "c", "d"]
    rows = [("h", [*deep, "good", f"x{k}", "y"], 8, 0, 8) for k in range(5)] + [("h", [*deep, "spam", f"x{k}", "y"], 8, 8, 0) for k in range(5)]
    rows += [("h", [*deep, "spam", "x1", "y", *["z"] * 60], 8, 8, 0), ("h", [*deep, "good", "x1", "y", "w", "v"], 8, 0, 8), ("h", ["a"], 2, 0, 0), ("g", [""], 1, 0, 0)]
    df = spark.createDataFrame(rows, "host string, segs array<string>, n long, bad long, good long")
    tree = {(r["host"], *r["segs"]): (r["purity"], r["branch"]) for r in url_filter.template_tree(df).collect()}
    assert len(tree) == len(rows)
    for _, s, *_ in rows[:12]:
        assert tree["h", *s][0] > 0.8 if "good" in s else tree["h", *s][0] < 0.2
    # the same as with every level built one by one
    rows = [("h", ["a", "b", c, d], 8, 8 * (c == "x"), 8 * (c != "x")) for c in "xyz" for d in "uv"] + [("h", ["a", "e", "f", "g"], 5, 2, 3), ("h", ["a"], 2, 0, 0)]
    df = spark.createDataFrame(rows, df.schema)
    whole = {tuple(r["segs"]): (r["purity"], r["branch"]) for r in url_filter.template_tree(df).collect()}
    monkeypatch.setattr(url_filter, "LEVELS", 1)
    steps = {tuple(r["segs"]): (r["purity"], r["branch"]) for r in url_filter.template_tree(df).collect()}
    assert whole.keys() == steps.keys() and len(whole) == len(rows)
    assert all(whole[k][1] == steps[k][1] and abs(whole[k][0] - steps[k][0]) < 1e-12 for k in whole)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a>More</a></li></ul></nav>
<header><p>Welcome to this site, reader.</p></header><div class="ad">Buy this now, it is cheap.</div><article><h1>Title &amp; more</h1><p><b>First   one &eacute;&#33;<br><p>Second <i>par</i>t, here.</p><p>Short.</p></article>
<div class="cookie-notice"><p>We use cookies, as all do.</p></div><aside>Related, other things.</aside><form><p>Your mail, please.</p></form><section class="comments"><p>I liked this, said one.</p></section><footer>&copy; site</footer>"""


def test_extraction(spark):
    rows = [(k, "u", PAGE) for k in range(5)] + [(6, None, None), (7, "u", ""), (8, "u", "<p>unclosed <b>text, by itself, long enough to be one"), (9, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    model = html_extract.fit(df)
    got = {r["page_id"]: r for r in html_extract.extract(df, model).collect()}
    want = "Title & more First one é! Second part, here. Short."
    assert got[0]["text"] == want and got[0]["n_chars"] == len(want)
    assert (got[6]["text"], got[7]["text"], got[7]["n_chars"]) == ("", "", 0)
    assert len(got) == len(rows)
    assert html_extract.extract(df.limit(0), html_extract.fit(df.limit(0))).count() == 0


def test_silent_elements_without_end():
    body = "<h1>Title here</h1><p>First part, which is long enough to count.</p>"
    want = "Title here First part, which is long enough to count."
    model = html_extract.Model()
    # both end tags of the head and the body's tags may be left out
    assert model.text_of(f"<html><head><meta charset=x><title>T</title><style>p{{}}</style><article>{body}</article>") == want
    for tag in ("button", "select", "noscript", "svg", "object", "canvas", "template"):
        before, inside = f"<body><{tag}>Menu<article>{body}</article>", f"<article>{body}<div><{tag}>Share</div><p>Last words, at the end.</p></article>"
        assert model.text_of(before) == want, tag
        assert model.text_of(inside) == f"{want} Last words, at the end.", tag
        assert model.text_of(f"<article>{body}<p>One <{tag}><p>not</p><div>this</{tag}> line, as it was.</p></article>") == f"{want} One line, as it was.", tag


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    parent = [-1, 0, 0, 1, 1, 2, 4]
    odds, tie = rng.normal(size=7), np.array([[0.7, 0.3], [0.2, 0.8]])
    own = 1 / (1 + np.exp(-odds))
    total = np.zeros(7)
    z = 0.0
    for s in itertools.product([0, 1], repeat=7):
        w = np.prod([own[i] if s[i] else 1 - own[i] for i in range(7)]) * np.prod([tie[s[parent[i]], s[i]] for i in range(1, 7)])
        z += w
        total += w * np.array(s)
    assert np.allclose(html_extract.marginals(parent, odds, tie), total / z)


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) + rng.integers(0, 8, 3000)[:, None]
    x[1000:1900] = x[1000]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [1.0, None] + [0.0] * 14), (5300, [float("nan")] * 16), (5400, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("list", F.lit(1))
    got = ann.search(df, 100).toPandas()
    assert got["query_id"].nunique() == 30 and (got.groupby("query_id").size() == 10).all()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert np.array_equal(g.sort_values("rank")["score"].to_numpy(), d[g.sort_values("rank")["vec_id"]])
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(3000), d))[:10]) & set(g["vec_id"]))
    assert hit >= 0.9 * 300
    few = ann.search(df.where("vec_id in (0, 100, 200)"), 100).toPandas()
    assert len(few) == 6
    assert ann.search(df.limit(0), 100).count() == 0


def _probed(rows, k=10):
    """Share of lists that queries probe, and the share of true neighbours those lists hold."""
    sample, rest = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    c = ann.balanced_means(sample, max(1, len(sample) // 40))
    ratio = ann.tuned_ratio(rest, c, k)
    graph, held = ann.centroid_graph(c), ann.lists_held(rows, c)
    share, recall = [], []
    for i in range(0, len(rows), 97):
        met = ann.walk(rows[i], c, graph, ratio)
        probed = ann.selected(met, ratio)
        exact = np.sqrt(((c - rows[i]) ** 2).sum(axis=1))
        assert np.allclose(met[np.isfinite(met)], exact[np.isfinite(met)])
        far = ((rows - rows[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        recall.append((held[np.argsort(far)[:k]] & probed).any(axis=1).mean())
        share.append(probed.mean())
    return np.mean(share), np.mean(recall)


def test_ratio_prunes_where_vectors_have_structure():
    rng = np.random.default_rng(5)
    means = rng.normal(size=(150, 32)) * 3
    share, recall = _probed(means[rng.integers(0, 150, 12_000)] + rng.normal(size=(12_000, 32)))
    assert recall >= 0.95 and share < 0.3, (share, recall)
    share, recall = _probed(rng.normal(size=(6_000, 32)))  # no structure: nearly all lists, none lost
    assert recall >= 0.95, (share, recall)


def test_walk_meets_what_the_ratio_selects():
    rng = np.random.default_rng(6)
    c = np.concatenate([rng.normal(size=(200, 8)), rng.normal(size=(200, 8)) + 50])
    graph = ann.centroid_graph(c)
    for x in rng.normal(size=(50, 8)) + 50 * rng.integers(0, 2, size=(50, 1)):
        exact = np.sqrt(((c - x) ** 2).sum(axis=1))
        assert (ann.selected(ann.walk(x, c, graph, 0.5), 0.5) == ann.selected(exact, 0.5)).all()
    assert ann.walk(c[0], c[:1], ann.centroid_graph(c[:1]), 0.5).tolist() == [0.0]


def test_search_at_most_lists(spark, monkeypatch):
    # unit vectors without any structure: the ratio rule selects far more than 64 of the lists
    monkeypatch.setattr(ann, "LIST_ROWS", 4)
    x = np.random.default_rng(3).normal(size=(4 * ann.MAX_LISTS + 8, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, 200).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & set(g["vec_id"]))
    assert got["query_id"].nunique() == 41 and len(got) == 410
    assert hit >= 0.99 * 410, hit


def test_pipeline_near_duplicates_of_shared_and_missing_ids(spark):
    import corpus_pipeline as cp

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a, b, c = ([word() for _ in range(150)] for _ in range(3))
    near = lambda w, i: " ".join([*w[:i], "changed", *w[i + 1 :]])
    rows = [(1, " ".join(a), "x"), (1, " ".join(a), "x"), (2, near(a, 9), "x"), (None, near(a, 90), "x"), (3, " ".join(b), "x"), (3, near(a, 30), "y"), (None, " ".join(c), "z"), (None, " ".join(c), "z"), (4, None, "x"), (5, "", "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, df, "").collect()), key=str)
    want = [(1, rows[0][1]), (3, rows[4][1]), (None, rows[6][1]), (4, None), (5, ""), (5, "")]
    assert got == sorted(want, key=str)
    assert cp.near_duplicates(spark, df.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    before = docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_chars", F.col("n_chars"))
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(cp.STAGES) - 1:
            assert out.columns == before.columns, name
            assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0, name
        docs, last = out, docs
    packed = docs.toPandas()
    assert set(packed["doc_id"]) == {r[0] for r in last.select("doc_id").distinct().collect()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    copies = last.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= copies <= 3
    with pytest.raises(Exception):  # the guard against a missing input is not swallowed
        cp.run(spark, "/root/testdata/none").count()
    _ = random
