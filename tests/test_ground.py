"""Floods, nearest points, visibility and segmentation against plain versions."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import flood, graph, horizon, nearest, regions, surface


def grid(spark, z):
    """Cells of a list of rows; ``None`` is a hole or, if at the end, a null height."""
    rows = [(x, y, None if v is None else float(v)) for y, row in enumerate(z) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "x long, y long, z double")


def noise(seed, w, h, high=9):
    r = random.Random(seed)
    return [[r.randrange(high) for _ in range(w)] for _ in range(h)]


def around(x, y):
    return [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def flooded(z, outlets=None):
    """Plain priority flood: the level of each cell."""
    at = {(x, y): v for y, row in enumerate(z) for x, v in enumerate(row) if v is not None}
    start = [p for p in at if any(q not in at for q in around(*p))] if outlets is None else [p for p in outlets if p in at]
    level, heap = {}, [(at[p], p) for p in start]
    heapq.heapify(heap)
    while heap:
        v, p = heapq.heappop(heap)
        if p in level:
            continue
        level[p] = v
        for q in around(*p):
            if q in at and q not in level:
                heapq.heappush(heap, (max(v, at[q]), q))
    return at, level


def nested():
    """A pit in a pit beside a pit, behind walls of different heights."""
    z = [[9] * 13 for _ in range(11)]
    for y in range(1, 10):
        for x in range(1, 12):
            z[y][x] = 6 if x != 6 else 8
    for y in range(3, 8):
        for x in range(2, 5):
            z[y][x] = 3
    z[5][3], z[4][3], z[5][9], z[6][9], z[0][6] = 0, 4, 1, 2, 7
    return z


@pytest.mark.parametrize("z", [nested(), noise(2, 9, 9, 3), [[5]], [[None, 1], [2, None]], [[*r[:4], None, *r[5:]] for r in noise(3, 9, 7)]], ids=range(5))
def test_depressions(spark, z):
    at, level = flooded(z)
    got = {(r.x, r.y): r for r in flood.fill_depressions(grid(spark, z), "z", len(z[0])).collect()}
    assert {p: r.filled for p, r in got.items()} == level
    assert all(r.depth == level[p] - at[p] for p, r in got.items())
    sunk = {p for p in at if level[p] > at[p]}
    assert {p for p, r in got.items() if r.depression is not None} == sunk
    for p in sunk:
        for q in set(around(*p)) & sunk:
            assert got[p].depression == got[q].depression
    size = {d: sum(r.depression == d for r in got.values()) for d in {r.depression for r in got.values()}}
    for r in flood.fill_depressions(grid(spark, z), "z", len(z[0]), most_cells=2).collect():
        assert r.filled == (level[r.x, r.y] if r.depression is not None and size[r.depression] <= 2 else at[r.x, r.y])


def test_depressions_without_an_outlet(spark):
    z = noise(4, 8, 8)
    seeds = [(3, 3), (3, 3), (99, 99)]
    _, level = flooded(z, seeds)
    got = flood.spill_levels(grid(spark, z), "z", 8, spark.createDataFrame(seeds, "x long, y long"))
    assert {(r.x, r.y): r.level for r in got.collect()} == level
    cells = grid(spark, [[1, 2, None, 3, 0, 3]])
    got = flood.spill_levels(cells, "z", 6, spark.createDataFrame([(0, 0)], "x long, y long"))
    assert {(r.x, r.level) for r in got.collect()} == {(0, 1.0), (1, 2.0), (3, None), (4, None), (5, None)}
    assert flood.fill_depressions(cells.where("x > 9"), "z", 6).count() == 0
    lake = flood.lake_series(grid(spark, z), "z", 8, spark.createDataFrame([(3, 3)], "x long, y long"), [2, 5, 20])
    for w in (2, 5, 20):
        at, level = flooded(z, [(3, 3)])
        assert {(r.x, r.y): r.depth for r in lake.where(F.col("level") == w).collect()} == {p: w - at[p] for p in at if level.get(p, 99) < w}


def test_ends_of_long_paths(spark):
    n = 3000
    chain = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS to", "1.0D AS w").unionByName(spark.createDataFrame([(n, 10**9, 1.0), (n + 1, n, 2.0)], "id long, to long, w double"))
    got = {r.id: (r.root, r.path_w) for r in flood.ends(chain, "id", "to", ["w"]).collect()}
    assert got == {i: (0, float(i)) for i in range(n)} | {n: (n, 0.0), n + 1: (n, 2.0)}
    with pytest.raises(ValueError, match="loop"):
        flood.ends(spark.createDataFrame([(1, 2), (2, 1)], "id long, to long"), "id", "to")


def test_streams(spark):
    z = noise(5, 10, 10, 50)
    f = flood.flow_pointers(grid(spark, z), "z", 10).cache()
    at = {y * 10 + x: z[y][x] for x in range(10) for y in range(10)}
    down = {}
    for i in at:
        low = min((at[q], q) for q in (b * 10 + a for a, b in around(i % 10, i // 10) if 0 <= a < 10 and 0 <= b < 10))
        down[i] = low[1] if low < (at[i], i) else None
    assert {r.id: r.to for r in f.collect()} == down
    streams = {i for i in at if at[i] < 5}
    on = spark.createDataFrame([(i,) for i in streams], "id long")
    for r in flood.stream_distances(f, "id", "to", "length", "z", on).collect():
        i, way = r.id, 0.0
        while i not in streams and down[i] is not None:
            way += math.hypot(i % 10 - down[i] % 10, i // 10 - down[i] // 10)
            i = down[i]
        want = (i, pytest.approx(way), at[r.id] - at[i]) if i in streams else (None, None, None)
        assert (r.stream, r.distance, r.difference) == want
    basins = {r.id: r.basin for r in flood.stream_basins(f, "id", "to", on.withColumn("outlet", F.col("id") * 2)).collect()}
    assert {i for i, b in basins.items() if b is not None} >= streams
    assert all(basins[i] == 2 * i for i in streams)


# --- nearest points


def clustered(seed, n=300):
    r = random.Random(seed)
    far = [(1e6, -1e6), (-5e5, 3.0), (0.5, 0.5), (0.5, 0.5), (0.5, 0.5)]
    tight = [(100 + r.random() * 1e-6, 100 + r.random() * 1e-6) for _ in range(n // 3)]
    loose = [(r.randrange(40) / 2, r.randrange(40) / 2) for _ in range(n // 3)]
    return [(i, x, y, float(i % 7)) for i, (x, y) in enumerate(far + tight + loose + [(r.gauss(0, 50), r.gauss(0, 50)) for _ in range(n // 3)])]


@pytest.mark.parametrize("k", [1, 5])
def test_k_nearest_is_exact_whatever_the_density(spark, k):
    rows = clustered(k)
    p = spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0), (None, 0.0, 0.0, 1.0)], "id long, x double, y double, v double")
    got = nearest.k_nearest(p.select(F.col("id").alias("t"), "x", "y").where("t IS NOT NULL"), p, k, ["t"], "id", columns=["v"], other=True)
    assert got.columns == ["t", "rank", "id", "distance", "v"]
    found = {}
    for r in got.collect():
        found.setdefault(r.t, []).append((r["rank"], r.distance, r.id, r.v))
    for i, x, y, _ in rows:
        want = sorted((math.hypot(x - u, y - w), j) for j, u, w, _ in rows if j != i)[:k]
        assert [(a, b, c) for a, b, c, _ in sorted(found[i])] == [(n + 1, pytest.approx(d, abs=1e-9), j) for n, (d, j) in enumerate(want)]
        assert all(c % 7 == v for *_, c, v in found[i])


def test_candidates_grow_with_the_points(spark):
    """Also in a dense cluster: what a target meets doesn't grow with the number of points."""
    met = []
    for n in (300, 1200):
        r = random.Random(n)
        rows = [(i, r.random() * (1e-4 if i % 2 else 1.0), r.random() * (1e-4 if i % 2 else 1.0)) for i in range(n)]
        p = spark.createDataFrame(rows, "key long, c0 double, c1 double")
        squares = nearest._Squares(2, [0.0, 0.0], 1.0)
        level = math.ceil(math.log2(n / nearest.LEAF) / 2)
        tree, leaves = nearest._tree(p, squares, level)
        t = p.select(F.struct("key").alias("key"), "c0", "c1")
        met.append(nearest._met(t, tree, leaves, squares, level, 1).count() / n)
    assert met[1] < 1.5 * met[0] < 150


def test_k_nearest_of_few_points(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 9.0, 9.0, 9.0)], "t long, x double, y double, z double")
    p = spark.createDataFrame([(5, 1.0, 0.0, 2.0), (6, 1.0, 0.0, 2.0), (7, 0.0, 0.0, 1.0)], "id long, x double, y double, z double")
    got = sorted(tuple(r)[:3] for r in nearest.k_nearest(t, p, 9, ["t"], "id", ["x", "y", "z"]).collect())
    assert got == [(1, 1, 7), (1, 2, 5), (1, 3, 6), (2, 1, 5), (2, 2, 6), (2, 3, 7)]
    assert nearest.k_nearest(t, p.limit(0), 2, ["t"], "id").count() == 0
    assert nearest.k_nearest(t.limit(0), p, 2, ["t"], "id").count() == 0


def test_inverse_distance_reaches_far(spark):
    cells = spark.createDataFrame([(49, 0), (0, 0), (3, 4)], "x long, y long")
    p = spark.createDataFrame([(1, 0, 0, 5.0), (2, 0, 0, 7.0), (3, 100, 0, None)], "id long, x long, y long, v double")
    got = {(r.x, r.y): r.v for r in nearest.inverse_distance(cells, p, "v", 2).collect()}
    assert got == {(49, 0): 6.0, (0, 0): 6.0, (3, 4): 6.0}
    q = p.unionByName(spark.createDataFrame([(4, 3, 0, 1.0)], "id long, x long, y long, v double"))
    got = {(r.x, r.y): r.v for r in nearest.inverse_distance(cells, q, "v", 3).collect()}
    assert got[3, 4] == pytest.approx((5 / 25 + 7 / 25 + 1 / 16) / (2 / 25 + 1 / 16))


def test_variogram_is_that_of_all_pairs(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(12), r.randrange(12), r.random()) for i in range(80)]
    p = spark.createDataFrame([*rows, (99, 1, 1, None)], "id long, x long, y long, v double")
    got = {g.bin: (g.pairs, g.distance, g.gamma) for g in nearest.variogram(p, "v", 1.0, 2.0, 4).collect()}
    want = {}
    for a, b in itertools.combinations(rows, 2):
        d = math.hypot(a[1] - b[1], a[2] - b[2])
        if d < 8:
            want.setdefault(int(d // 2), []).append((d, (a[3] - b[3]) ** 2 / 2))
    assert got == {k: (len(x), pytest.approx(np.mean([d for d, _ in x])), pytest.approx(np.mean([g for _, g in x]))) for k, x in want.items()}


def test_variogram_makes_no_row_for_each_pair_of_squares(spark):
    """Pairs of squares were rows of a broadcast table, as many as squares times the 1,400 within reach of each."""
    p = spark.range(900).selectExpr("id", "id % 30 - 15.0D AS x", "id div 30 - 15.0D AS y", "cast(id * 37 % 101 AS double) AS v")
    g = nearest.variogram(p, "v", 0.5, 1.5, 10)
    assert "Broadcast" not in g._jdf.queryExecution().executedPlan().toString()
    got = {r.bin: (r.pairs, r.gamma) for r in g.collect()}
    x, y, v = (np.array(c) for c in zip(*((r.x, r.y, r.v) for r in p.collect()), strict=True))
    i, j = np.triu_indices(900, 1)
    d = np.hypot(x[i] - x[j], y[i] - y[j])
    for k in range(10):
        near = (d < 15) & (d // 1.5 == k)
        assert got.get(k, (0, None)) == (near.sum(), pytest.approx(((v[i] - v[j]) ** 2 / 2)[near].mean()) if near.any() else None)
    cube = [(i, i % 6, i // 6 % 6, i // 36, float(i * 7 % 11)) for i in range(216)]
    deep = nearest.variogram(spark.createDataFrame(cube, "id long, x long, y long, z long, v double"), "v", 1.0, 1.0, 3, ("x", "y", "z"))
    want = {}
    for a, b in itertools.combinations(cube, 2):
        if (d := math.dist(a[1:4], b[1:4])) < 3:
            want.setdefault(int(d), []).append((a[4] - b[4]) ** 2 / 2)
    assert {r.bin: (r.pairs, r.gamma) for r in deep.collect()} == {k: (len(w), pytest.approx(np.mean(w))) for k, w in want.items()}


def test_kriging(spark):
    r = random.Random(4)
    rows = [(i, r.random() * 10, r.random() * 10) for i in range(60)]
    value = lambda x, y: math.sin(x) + y / 3
    p = spark.createDataFrame([(i, x, y, value(x, y)) for i, x, y in rows] + [(70, rows[0][1], rows[0][2], value(*rows[0][1:]) + 2)], "id long, x double, y double, v double")
    t = spark.createDataFrame([(100, 5.0, 5.0), (101, 500.0, 5.0), (102, rows[3][1], rows[3][2]), (103, rows[0][1], rows[0][2])], "t long, x double, y double")
    model = (0.1, 1.0, 4.0)
    got = {g.t: g for g in nearest.krige(t, p, "v", model, 8, ["t"]).collect()}
    assert (got[102].estimate, got[102].variance) == (pytest.approx(value(*rows[3][1:])), 0)
    assert got[103].estimate == pytest.approx(value(*rows[0][1:]) + 1)  # two values at one place
    for k, x, y in ((100, 5.0, 5.0), (101, 500.0, 5.0)):
        near = sorted((math.hypot(x - u, y - w), u, w, value(u, w) + (i == 0)) for i, u, w in rows)[:8]
        a = np.ones((9, 9))
        for i, j in itertools.product(range(8), range(8)):
            a[i, j] = nearest.spherical(np.array([math.dist(near[i][1:3], near[j][1:3])]), *model)[0]
        a[8, 8] = 0
        b = np.array([*nearest.spherical(np.array([q[0] for q in near]), *model), 1.0])
        w = np.linalg.solve(a, b)
        assert w[:8].sum() == pytest.approx(1)
        assert (got[k].estimate, got[k].variance, got[k].n) == (pytest.approx(w[:8] @ [q[3] for q in near]), pytest.approx(w @ b), 8)
    assert nearest.krige(t, p, "v", (0.0, 0.0, 1.0), 1, ["t"]).count() == 4
    assert nearest.krige(t, p.limit(0), "v", model, 3, ["t"]).count() == 0


def test_fitted_model():
    h = np.arange(1.0, 12)
    bins = list(zip([5.0] * 11, h, nearest.spherical(h, 0.5, 2.0, 6.0), strict=True))
    assert nearest.fit_spherical(bins, [3.0, 6.0, 9.0]) == (pytest.approx(0.5), pytest.approx(2.0), 6.0)
    assert nearest.fit_spherical([(1.0, 2.0, 3.0), (1.0, 4.0, 1.0)], [5.0])[1] == 0


# --- visibility


def test_horizons_and_sky(spark):
    z = [[*r[:5], None, *r[6:]] for r in noise(6, 11, 9, 20)]
    at = {(x, y): v for y, row in enumerate(z) for x, v in enumerate(row) if v is not None}
    ways = horizon.rays(2)
    assert len(ways) == 8
    got = {(r.x, r.y, r.dx, r.dy): r.rise for r in horizon.horizons(grid(spark, z), "z", ways).collect()}
    want = {}
    for (x, y), v in at.items():
        for dx, dy in [w for i, j in ways for w in ((i, j), (-i, -j))]:
            rises = [(at[x + k * dx, y + k * dy] - v) / (k * math.hypot(dx, dy)) for k in range(1, 20) if (x + k * dx, y + k * dy) in at]
            want[x, y, dx, dy] = pytest.approx(max(rises)) if rises else None
    assert got == want
    sky = {(r.x, r.y): r for r in horizon.sky_view(grid(spark, z), "z", horizon.rays(1)).collect()}
    for (x, y), r in sky.items():
        rises = [got[x, y, dx, dy] or 0.0 for i, j in horizon.rays(1) for dx, dy in ((i, j), (-i, -j))]
        assert r.openness == pytest.approx(1 - np.mean([math.sin(math.atan(s)) for s in rises]))
        assert r.sky == pytest.approx(1 - np.mean([max(0, math.sin(math.atan(s))) for s in rises]))


def seen(at, ox, oy, eye, reach):
    """Plain line of sight: every cell against all nearer ones that the line to its centre passes over."""
    out = {}
    oz = at[ox, oy] + eye
    for (x, y), v in at.items():
        dx, dy = x - ox, y - oy
        d2 = dx * dx + dy * dy
        if d2 > reach * reach:
            continue
        rise = (v - oz) / math.sqrt(d2) if d2 else None
        hidden = False
        for (a, b), w in at.items():
            ex, ey = a - ox, b - oy
            if not 0 < ex * ex + ey * ey < d2:
                continue
            turns = [math.atan2(dx * (ey + j) - dy * (ex + i), dx * (ex + i) + dy * (ey + j)) for i in (-0.5, 0.5) for j in (-0.5, 0.5)]
            ahead = dx * ex + dy * ey > 0
            hidden |= ahead and min(turns) < -1e-9 and max(turns) > 1e-9 and (w - oz) / math.hypot(ex, ey) >= rise
        if not hidden:
            out[x, y] = rise
    return out


@pytest.mark.parametrize("sectors", [1, 64])
def test_viewsheds(spark, sectors):
    z = noise(7, 15, 13, 12)
    z[4][4] = None
    at = {(x, y): v for y, row in enumerate(z) for x, v in enumerate(row) if v is not None}
    who = [(1, 7, 6), (2, 0, 0), (3, 4, 4), (4, 99, 0), (5, 7, 6)]
    observers = spark.createDataFrame(who, "o long, x long, y long")
    got = {}
    for r in horizon.viewsheds(observers, "o", grid(spark, z), "z", 3.0, 8, sectors=sectors).collect():
        got.setdefault(r.o, {})[r.x, r.y] = r.rise
    want = {o: seen(at, x, y, 3.0, 8) for o, x, y in who if (x, y) in at}
    assert {o: set(v) for o, v in got.items()} == {o: set(v) for o, v in want.items()}
    for o, v in want.items():
        assert got[o] == {p: s if s is None else pytest.approx(s) for p, s in v.items()}


def test_what_observers_see(spark):
    views = spark.createDataFrame([(1, 0, 0, 0.0, None), (1, 1, 0, 1.0, 0.5), (1, 3, 0, 3.0, 0.5), (1, 0, -4, 4.0, -1.0), (2, 3, 0, 2.0, 0.1)], "o long, x long, y long, distance double, rise double")
    at = spark.createDataFrame([(1, 0, 0), (2, 5, 0)], "o long, x long, y long")
    assert sorted(tuple(r) for r in horizon.visibility(views, "o").collect()) == [(0, -4, 1, 4.0), (0, 0, 1, 0.0), (1, 0, 1, 1.0), (3, 0, 2, 2.0)]
    assert sorted(tuple(r) for r in horizon.skyline(views, "o", 4, at).collect()) == [(1, 0, 1, 0, 0.5, 1.0, 3.0), (1, 3, 0, -4, -1.0, 4.0, 4.0), (2, 2, 3, 0, 0.1, 2.0, 2.0)]
    weights = spark.createDataFrame([(1, 2.0), (2, 8.0)], "o long, w double")
    assert {(r.x, r.y): r.exposure for r in horizon.exposure(views, "o", weights, "w", 1.0).collect()}[3, 0] == pytest.approx(2 / 9 + 8 / 4)


# --- segmentation


def grown(at, thresholds, least, close):
    """Plain mutual best neighbours, and those that follow their best."""
    group = {i: i for i in at}
    out = []

    def state():
        members = {}
        for i, g in group.items():
            members.setdefault(g, []).append(i)
        mean = {g: sum(at[i] for i in m) / len(m) for g, m in members.items()}
        edges = {tuple(sorted((group[i], group[j]))) for i in at for j in (i + 1, i + 100) if j in at and (j % 100 or j != i + 1) and group[i] != group[j]}
        return members, {e: (abs(mean[e[0]] - mean[e[1]]), *e) for e in edges}

    def best(apart, allowed):
        found = {}
        for e, d in apart.items():
            for g in e:
                if allowed(g, d[0]) and (g not in found or d < found[g]):
                    found[g] = d
        return {g: d[2] if d[1] == g else d[1] for g, d in found.items()}, {g: d[0] for g, d in found.items()}

    def joined(b, alone):
        moves = {g: o for g, o in b.items() if b.get(o) == g or alone(g)}

        def root(g):
            while g in moves and not (b.get(b[g]) == g and g < b[g]):
                g = b[g]
            return g

        return {i: root(g) for i, g in group.items()}

    for t in thresholds:
        while True:
            _, apart = state()
            b, far = best(apart, lambda g, d: d <= t)  # noqa: B023
            if not b:
                break
            group = joined(b, lambda g: far[g] <= close * t)  # noqa: B023
        while least > 1:
            members, apart = state()
            b, _ = best(apart, lambda g, d: len(members[g]) < least)  # noqa: B023
            if not b:
                break
            group = joined(b, lambda g: True)
        names = {}
        for i, g in group.items():
            names.setdefault(g, set()).add(i)
        out.append({frozenset(s) for s in names.values()})
    return out


@pytest.mark.parametrize(("least", "close"), [(1, 0.0), (3, 0.2)])
def test_grown_regions(spark, least, close):
    z = noise(8, 9, 8, 30)
    z[2][2] = None
    at = {y * 100 + x: float(v) for y, row in enumerate(z) for x, v in enumerate(row) if v is not None}
    got = regions.grow_regions(grid(spark, z), ["z"], 100, [2.0, 6.0], least, close).collect()
    for t, want in zip([2.0, 6.0], grown(at, [2.0, 6.0], least, close), strict=True):
        found = {}
        for r in got:
            if r.threshold == t:
                found.setdefault(r.region, set()).add(r.y * 100 + r.x)
        assert {frozenset(s) for s in found.values()} == want
        assert all(k in s for k, s in found.items())


def test_rounds_of_growing_are_few(spark):
    """Two halves of noise: rounds grow with the logarithm of the cells."""
    r = random.Random(1)
    z = [[r.random() + 50 * (x > 15) for x in range(32)] for _ in range(32)]
    grower = regions._Regions(grid(spark, z), ["z"], 32, False)
    assert grower.grow(5.0, 1.0) <= math.ceil(math.log2(32 * 32))
    assert grower.now.count() == 2
    assert regions.grow_regions(grid(spark, z).limit(0), ["z"], 32, [1.0]).count() == 0


def test_superpixels(spark):
    z = noise(9, 12, 10, 20)
    at = {(x, y): float(v) for y, row in enumerate(z) for x, v in enumerate(row)}
    first = {}
    for x, y in sorted(at, key=lambda p: (p[1], p[0])):
        first.setdefault((x // 4, y // 4), (y, x))
    held = {(x, y): first[x // 4, y // 4] for x, y in at}
    for _ in range(3):
        centre = {}
        for p, k in held.items():
            centre.setdefault(k, []).append((*p, at[p]))
        centre = {k: np.mean(v, axis=0) for k, v in centre.items()}
        for x, y in at:
            near = [(round(((x - c[0]) ** 2 + (y - c[1]) ** 2) * (2.0 / 4) ** 2 + (at[x, y] - c[2]) ** 2, 9), k) for k, c in centre.items() if abs(x - c[0]) <= 4 and abs(y - c[1]) <= 4]
            held[x, y] = min(near)[1] if near else held[x, y]
    got = {(r.x, r.y): r.superpixel for r in regions.superpixels(grid(spark, z), ["z"], 4, 2.0, 3).collect()}
    assert got == {p: f"{k[1]}_{k[0]}" for p, k in held.items()}


# --- small mends


def test_attributes_are_scaled_in_decimals(spark):
    zones = spark.createDataFrame([(0, 0, 1), (1, 0, 2)], "x long, y long, zone int")
    values = spark.createDataFrame([(1, 4564.275), (2, None)], "zone int, v double")
    assert sorted(tuple(r) for r in surface.attributes_to_cells(zones, values, "zone", ["v"], 2).collect()) == [(0, 0, 1, 456428), (1, 0, 2, None)]


def test_colours_of_no_edges(spark):
    from cellweave.operators import convert

    assert convert.colour(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_cost_over_more_rounds_than_cells_wide(spark):
    """A winding corridor: as many rounds as it is long."""
    z = [[1.0] * 6, [None] * 5 + [1.0], [1.0] * 6, [1.0] + [None] * 5, [1.0] * 6]
    got = {(r.x, r.y): r.d for r in graph.cost_distance(grid(spark, z), "z", spark.createDataFrame([(0, 0)], "x long, y long")).collect()}
    assert got[5, 4] == pytest.approx(4 + 2**0.5 * 2 + 3 + 2**0.5 * 2 + 4)


# --- graphs


def drawn(seed, n):
    r = random.Random(seed)
    at = [(r.randrange(30), r.randrange(30)) for _ in range(n)]
    return [(i, j, math.dist(at[i], at[j])) for i in range(n) for j in range(i + 1, n) if math.dist(at[i], at[j]) < 9]


def kruskal(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    out = set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(b)] = find(a)
            out.add((a, b, w))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forest(spark, seed):
    from cellweave.operators import networks

    edges = drawn(seed, 60)
    many = [(b, a, w) for a, b, w in edges] + [(a, b, w + 1) for a, b, w in edges] + [(1, 1, 0.0), (None, 2, 1.0), (5, 6, None)]
    df = spark.createDataFrame(many, "a long, b long, w double")
    assert {tuple(r) for r in networks.spanning_forest(df).collect()} == kruskal(edges)
    assert networks.spanning_forest(df.limit(0)).count() == 0


def test_neighbourhood_graphs(spark):
    from cellweave.operators import networks

    edges = drawn(5, 50)
    df = spark.createDataFrame(edges, "a long, b long, w double")
    w = {(a, b): x for a, b, x in edges} | {(b, a): x for a, b, x in edges}
    nodes = {i for e in edges for i in e[:2]}
    third = lambda a, b, test: any(test(w[a, c], w[b, c], w[a, b]) for c in nodes if (a, c) in w and (b, c) in w)
    kept = {(r.a, r.b) for r in networks.neighbourhood_graph(df, "gabriel").collect()}
    assert kept == {(a, b) for a, b, _ in edges if not third(a, b, lambda p, q, d: p * p + q * q < d * d)}
    close = {(r.a, r.b) for r in networks.neighbourhood_graph(df, "relative").collect()}
    assert close == {(a, b) for a, b, _ in edges if not third(a, b, lambda p, q, d: max(p, q) < d)}
    assert {(a, b) for a, b, _ in kruskal(edges)} <= close <= kept
    nearest_ = {(r.a, r.b) for r in networks.neighbourhood_graph(df, "nearest").collect()}
    assert nearest_ == {tuple(sorted((a, min((w[a, b], b) for b in nodes if (a, b) in w)[1]))) for a in nodes}
    with pytest.raises(ValueError, match="other"):
        networks.neighbourhood_graph(df, "other")


def test_indices_of_a_graph(spark):
    from cellweave.operators import networks

    nodes = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "k long, s double")
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 4)], "a long, b long")
    assert tuple(networks.graph_indices(nodes, "k", "s", e).first()) == (5, 2, 3, 0.2, 3, pytest.approx(5 / 3), 6.0, 5.0)
    assert networks.graph_indices(nodes.limit(0), "k", "s", e.limit(0)).first().nodes == 0


# --- areas of all sizes


def boxes_of_all_sizes(seed, n=80):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w, h = (4 ** r.uniform(-2, 6) for _ in range(2))
        x, y = r.uniform(-500, 500), r.uniform(-500, 500)
        out.append((i, round(x, 3), round(x + w, 3), round(y, 3), round(y + h, 3)))
    return [*out, (n, 0.0, 4000.0, 0.0, 4000.0), (n + 1, 8.0, 8.0, 8.0, 8.0), (n + 2, 8.0, 12.0, 4.0, 8.0)]


def test_large_areas_touch_few_squares(spark):
    boxes = boxes_of_all_sizes(1)
    df = spark.createDataFrame(boxes, "k int, _x1 double, _x2 double, _y1 double, _y2 double")
    dealt = surface.squares(surface.levelled(df, 4.0), 4.0)
    assert dealt.count() <= 4 * len(boxes)
    ring = "array(named_struct('x', _x1, 'y', _y1), named_struct('x', _x2, 'y', _y1), named_struct('x', _x2, 'y', _y2), named_struct('x', _x1, 'y', _y2), named_struct('x', _x1, 'y', _y1)) AS ring"
    areas = df.selectExpr("k", ring)
    pairs = {(a[0], b[0]) for a, b in itertools.combinations(boxes, 2) if a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]}
    got = [(r.a, r.b) for r in surface.overlapping_boxes(areas, "k", "ring", 4.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs
    r = random.Random(3)
    at = [(i, r.uniform(-500, 900), r.uniform(-500, 900)) for i in range(150)]
    points = spark.createDataFrame([*at, (999, None, 1.0)], "id int, x double, y double")
    inside = {(i, b[0]) for i, x, y in at for b in boxes if b[1] < x < b[2] and b[3] < y < b[4]}
    assert {(p.id, p.k) for p in surface.points_in_areas(points, areas, "ring", 4.0).collect()} == inside
    assert surface.points_in_areas(points, areas.limit(0), "ring", 4.0).count() == 0
    assert surface.overlapping_boxes(areas.limit(0), "k", "ring", 4.0).count() == 0


def test_pairs_of_equal_boxes_are_dealt_over_tasks(spark):
    """3,000 areas of two boxes that overlap met in one square, so one task made all pairs."""
    box = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D + id % 2, 'y', 0D), named_struct('x', 2D, 'y', 2D), named_struct('x', 0D, 'y', 0D)) AS ring"
    pairs = surface.overlapping_boxes(spark.range(3000).selectExpr("id", box), "id", "ring", 4.0)
    row = pairs.agg(F.count(F.lit(1)), F.countDistinct("a", "b"), F.count(F.when(F.col("a") < F.col("b"), 1))).first()
    assert tuple(row) == (3000 * 2999 // 2,) * 3
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 3000 * 2999 // 4


def crowded(spark, folder):
    """40,000 events at 32 places and 20,000 suppliers of six shapes: 100 million or more pairs, had they to be made."""
    spark.range(40_000).selectExpr("id AS event_id", "id % 32 AS user_id", "TIMESTAMP '2024-01-01' AS ts", "cast(id % 5 AS double) AS value").write.parquet(f"{folder}/events.parquet")
    spark.range(20_000).selectExpr("id * 24 + id % 3 AS s_suppkey", "cast(id % 2 AS int) AS s_nationkey", "0.0D AS s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    rows = spark.read.parquet(f"{folder}/events.parquet").selectExpr("user_id % 64 + 0.31D AS x", "event_id % 64 + 0.17D AS y", "value").groupBy("x", "y").agg(F.count("value").alias("n"), F.sum("value").alias("t")).collect()
    want = {}
    for k in (i * 24 + i % 3 for i in range(20_000)):
        cx, cy, r = k * 7 % 56 + 4, k // 24 % 2 * 2 + 6, k % 3 + 1
        if (cx, cy, r) not in want:
            inside = [p for p in rows if abs(p.x - cx) + abs(p.y - cy) < r]
            want[cx, cy, r] = sum(p.n for p in inside), sum(p.t for p in inside)
        want[k] = want[cx, cy, r]
    return {k: v for k, v in want.items() if isinstance(k, int) and v[0]}


@pytest.mark.parametrize("name", ["points_in_areas", "spatial_join"])
def test_points_at_one_place_meet_areas_of_one_ring_once(name, spark, tmp_path):
    from cellweave.plans import catalog

    want = crowded(spark, tmp_path)
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert {r.s_suppkey: (r.n, r.total) for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.rindex("Join Inner") :].count("- Aggregate [") == 2  # places on one side, rings on the other


def test_categories_are_filled_from_outside(spark):
    from cellweave.operators import fitting

    r = random.Random(11)
    z = [[0 if 2 <= x < 11 and 2 <= y < 10 else r.choice([1, 2, 2, 3, None]) for x in range(13)] for y in range(12)]
    z[5][5] = 7
    at = {(x, y): v for y, row in enumerate(z) for x, v in enumerate(row)}
    now = {p: None if v == 0 else v for p, v in at.items()}
    while True:
        new = {}
        for p, v in at.items():
            if v == 0 and now[p] is None:
                seen_ = [now[q] for q in around(*p) if now.get(q) is not None]
                if seen_:
                    new[p] = min(set(seen_), key=lambda c: (-seen_.count(c), c))  # noqa: B023
        if not new:
            break
        now |= new
    cells = spark.createDataFrame([(x, y, v) for (x, y), v in at.items()], "x long, y long, c int")
    assert {(c.x, c.y): c.c for c in fitting.fill_category(cells, "c", 0).collect()} == now
    lonely = spark.createDataFrame([(0, 0, 0), (5, 5, None)], "x long, y long, c int")
    assert sorted(tuple(c) for c in fitting.fill_category(lonely, "c", 0).collect()) == [(0, 0, 0), (5, 5, None)]


# --- orders


def test_orders_of_streams(spark):
    """A main stem of 5,000 confluences, which would take as many rounds level by level, and random trees."""
    n = 5000
    stem = [(i, i - 1 if i else None) for i in range(n)] + [(n + i, i) for i in range(n)]
    r = random.Random(5)
    wild = [(20_000 + i, 20_000 + r.randrange(i) if i and r.random() < 0.97 else (-5 if i % 2 else None)) for i in range(400)]
    got = {s.id: (s.strahler, s.shreve) for s in graph.stream_orders(spark.createDataFrame(stem + wild, "id long, to long"), "id", "to").collect()}
    above = {}
    for i, to in stem + wild:
        above.setdefault(to, []).append(i)
    want = {}
    for i, _ in sorted(wild, reverse=True) + sorted(stem, reverse=True):
        up = sorted((want[k] for k in above.get(i, [])), reverse=True)
        top = up[0][0] if up else 1
        want[i] = (top + (len(up) > 1 and up[1][0] == top), sum(s for _, s in up) or 1)
    assert got == want
    assert graph.stream_orders(spark.createDataFrame([], "id long, to long"), "id", "to").count() == 0


def test_streams_are_joined_without_broadcasts(spark, monkeypatch):
    """Each join of each round sent a table through the driver."""
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    net = spark.range(1, 2000).selectExpr("id", "CASE WHEN id > 1 THEN id div 2 END AS to")
    out = graph.stream_orders(net, "id", "to")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) > 10 and not any("Broadcast" in p for p in plans)
    assert {(r.strahler, r.shreve) for r in out.where("id = 1").collect()} == {(10, 1000)}


def test_percolation_follows_squares_of_all_thresholds_together(spark, monkeypatch):
    """Components were sought in a run for each threshold, with an edge for each point."""
    seen, find = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda edges: seen.append(edges.count()) or find(edges))
    r = random.Random(8)
    at = [(i, r.random() * 3, r.random() * 3) for i in range(300)] + [(300 + i, 10 + r.random() / 9, 10.0) for i in range(300)]
    got = {g.threshold: (g.groups, g.largest) for g in graph.point_percolation(spark.createDataFrame(at, "k long, x double, y double"), "k", [1e-7, 0.1, 0.3, 9.0]).collect()}
    assert len(seen) == 1 and seen[0] < 2000
    for t in (1e-7, 0.1, 0.3, 9.0):
        left, sizes = {i: (x, y) for i, x, y in at}, []
        while left:
            new = group = [left.popitem()[1]]
            while new:
                near = [i for i, q in left.items() if any(math.dist(p, q) <= t for p in new)]
                new = [left.pop(i) for i in near]
                group = group + new
            sizes.append(len(group))
        sizes = [n for n in sizes if n > 1]
        assert got[t] == (len(sizes), max(sizes, default=0))
