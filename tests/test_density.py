import numpy as np

from prepline.operators.density import dbscan


def brute_dbscan(X, keys, eps, m):
    n = len(X)
    d2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    nb = d2 <= eps * eps
    core = nb.sum(1) >= m
    label = {}
    # components over core points; id = min core key
    seen = np.zeros(n, bool)
    for i in np.argsort(keys):
        if not core[i] or seen[i]:
            continue
        comp, stack = [], [i]
        seen[i] = True
        while stack:
            j = stack.pop()
            comp.append(j)
            for q in np.where(nb[j] & core & ~seen)[0]:
                seen[q] = True
                stack.append(q)
        cid = min(keys[c] for c in comp)
        for c in comp:
            label[c] = cid
    out = {}
    for i in range(n):
        if core[i]:
            out[keys[i]] = (label[i], True)
        else:
            cands = [j for j in np.where(nb[i] & core)[0]]
            if cands:
                j = min(cands, key=lambda c: keys[c])
                out[keys[i]] = (label[j], False)
            else:
                out[keys[i]] = (-1, False)
    return out


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    blobs = [rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (4, 4), (0, 5))]
    X = np.vstack(blobs + [rng.uniform(-3, 8, (30, 2)), np.repeat([[4.0, 4.0]], 40, axis=0)])  # a hot duplicate point
    X = np.round(X, 2)
    keys = np.arange(len(X)) * 3 + 1
    df = spark.createDataFrame([(int(k), [float(a), float(b)]) for k, (a, b) in zip(keys, X)], "k long, v array<double>")
    got = {r["k"]: (r["cluster"], r["is_core"]) for r in dbscan(df, "k", "v", eps=0.6, min_samples=8).collect()}
    exp = brute_dbscan(X, keys, 0.6, 8)
    assert got == exp


def test_orders_are_clustered_by_raw_values(spark, tmp_path):
    import datetime as dt

    from prepline.catalog.q_models import t9

    # 39 orders at one place and one 0.54 away, which is 0.5, and so near, only if rounded
    rows = [(k, 0.0 if k else 5400.0, dt.date(1995, 1, 1)) for k in range(40)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: (r["cluster"], r["is_core"]) for r in t9(spark, str(tmp_path)).collect()}
    assert got == {k: (-1, False) for k in range(40)}


def test_dense_cells_split_into_boxes(spark, monkeypatch):
    """Crowded cells beside each other, some within eps and some just not; missing vectors are noise."""
    from prepline.operators import density

    monkeypatch.setattr(density, "LEAF", 4)
    rng = np.random.default_rng(5)
    eps = 1.0
    X = np.vstack([rng.uniform((0, 0), (0.5, 0.5), (150, 2)), rng.uniform((1.2, 0), (1.7, 0.5), (150, 2)), rng.uniform((3.0, 0.0), (3.3, 0.3), (100, 2)), rng.uniform(-2, 6, (60, 2))])
    X = np.vstack([X, X[:20] * [1, -1], [[0.0, 0.0], [-0.0, 0.0]]])
    keys = np.arange(len(X)) * 7 % 1009 + 1
    rows = [(int(k), [float(a), float(b)]) for k, (a, b) in zip(keys, X)]
    gone = [(5000, None), (5001, [None, 1.0]), (5002, [float("nan"), 0.0])]
    got = {r["k"]: (r["cluster"], r["is_core"]) for r in density.dbscan(spark.createDataFrame(rows + gone, "k long, v array<double>"), "k", "v", eps, 12).collect()}
    assert {k: got.pop(k) for k in (5000, 5001, 5002)} == dict.fromkeys((5000, 5001, 5002), (-1, False))
    assert got == brute_dbscan(X, keys, eps, 12)


def test_two_dense_cells_meet_in_boxes_not_in_pairs(spark):
    """Two neighbouring cells of 4,000 points each: 16 million pairs of points, a few pairs of boxes."""
    from prepline.operators.density import _touching, _tree

    rng = np.random.default_rng(6)
    side = 1 / np.sqrt(2)
    rows = [([0, 0], [float(a), float(b)], 1, k) for k, (a, b) in enumerate(rng.uniform(0, 0.7, (4000, 2)))]
    rows += [([2, 0], [float(a) + 1.45, float(b)], 1, 9000 + k) for k, (a, b) in enumerate(rng.uniform(0, 0.6, (4000, 2)))]
    tree, depth = _tree(spark.createDataFrame(rows, "cell array<long>, x array<double>, w long, pid long"), 2, float(side))
    assert depth >= 3 and tree.where("size(pts) > 32").count() == 0
    pairs = spark.createDataFrame([([0, 0], [2, 0])], "cell array<long>, ncell array<long>")
    assert _touching(pairs, tree, 1.0).count() == 1
    assert _touching(pairs, tree, 0.5).count() == 0


def test_long_chains_of_cells_keep_the_planner_small(spark, monkeypatch):
    """A chain of 120 cells in random key order takes several rounds; the estimated size of the labels stays
    that of a table, and nothing as large as the points is broadcast."""
    from prepline.operators import density

    rng = np.random.default_rng(8)
    keys = rng.permutation(120)
    rows = [(int(k), [0.6 * i, 0.0]) for i, k in enumerate(keys)]
    rounds, seen = [], density.cut_round

    def watched(df):
        rounds.append(seen(df))
        return rounds[-1]

    monkeypatch.setattr(density, "cut_round", watched)
    out = density.dbscan(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 1.0, 2)
    assert {tuple(r) for r in out.select("cluster", "is_core").distinct().collect()} == {(0, True)}
    assert len(rounds) > 3
    at = rounds[-1].groupBy().count()
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        at.explain("cost")
        out.explain()
    assert all(u not in text.getvalue() for u in (" TiB", " PiB", " EiB", "E+"))
    assert "BroadcastExchange" not in text.getvalue()
