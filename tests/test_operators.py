"""Small exact grids and series, with nulls, ties and empty inputs."""

import collections
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import fuzzy, indices
from cellweave.operators import decision, focal, graph, series, sites, surface, tables, temporal, zonal
from cellweave.plans import catalog
from cellweave.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_zonal_skips_nulls(spark):
    c = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, None), (2, 5.0), (3, None)], "z int, v double")
    got = {r.z: r for r in zonal.univar(c, ["z"], "v").collect()}
    assert (got[1].n, got[1].null_cells, got[1].cells, got[1].mean) == (3, 1, 4, 2.0)
    assert (got[3].n, got[3].mean) == (0, None)
    m = {r.z: r for r in zonal.moments(c, ["z"], "v").collect()}
    assert m[1].variance == pytest.approx(1)
    assert m[2].variance is None
    assert 3 not in m


def test_kappa(spark):
    pairs = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [(None, "a")]
    m = zonal.confusion(spark.createDataFrame(pairs, "c string, r string"), "c", "r")
    got = {r["class"]: r for r in zonal.accuracies(m).collect()}
    assert (got["a"].overall_accuracy, got["a"].kappa, got["a"].user_accuracy) == (70.0, 0.4, 80.0)


def test_bins_are_closed_on_the_right(spark):
    v = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 2.5, 2.6, 10.0, 10.1)], "v double")
    assert [r[0] for r in v.select(zonal.histogram_bin(F.col("v"), 0, 10, 4)).collect()] == [0, 1, 1, 2, 4, 5]


def test_mode_takes_the_smallest_of_ties(spark):
    v = spark.createDataFrame([(1, x) for x in (3, 1, 1, 3, 2, None)], "k int, v int")
    assert rows(tables.mode(v, ["k"], "v"), "k") == [(1, 1, 2)]


def test_diversity(spark):
    v = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 0.0), (2, 0.0)], "k int, v double")
    (r,) = zonal.diversity(v, ["k"], "v").collect()
    assert (r.richness, r.gini_simpson) == (2, pytest.approx(0.5))
    assert r.shannon == pytest.approx(math.log(2))


def test_lookup_takes_one_match_and_leaves_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (3, "z")], "j int, v string")
    assert sorted(map(tuple, tables.lookup_join(a, b, "k", "j", ["v"]).collect()), key=str) == [(1, "x"), (2, None), (None, None)]


def test_names():
    assert tables.clean_names(["a b", "1x", "", None, "and", "a_b"]) == ["a_b", "v_1x", "column", "column_1", "and_", "a_b_1"]
    with pytest.raises(ValueError):
        tables.in_categories(None, "1-x")


def test_sort_wants_numbers(spark):
    with pytest.raises(ValueError):
        tables.sort_points(spark.createDataFrame([("a", 1)], "v string, k int"), "v", "k")


def test_overlay_and_differences(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ((1, 2, 2), (2, 3)))
    for how, want in (("and", [2]), ("or", [1, 2, 3]), ("xor", [1, 3]), ("not", [1])):
        assert [r[0] for r in rows(tables.overlay(a, b, how), "k")] == want
    assert rows(tables.differences(a, b), "k") == [(1, "left", 1), (2, "left", 1), (3, "right", 1)]


def test_regression(spark):
    s = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 6.0), (1, 4.0, None), (2, 1.0, 1.0)], "k int, x double, y double")
    got = {r.k: r for r in series.regression(s, ["k"], "x", "y").collect()}
    assert (got[1].n, got[1].slope, got[1].offset, got[1].r2) == (3, pytest.approx(2), pytest.approx(0), pytest.approx(1))
    assert got[2].slope is None
    many = {r.k: r for r in series.multiple_regression(s, ["k"], ["x"], "y").collect()}
    assert many[1].b_x == pytest.approx(2)


def test_reference_quantile(spark):
    v = spark.createDataFrame([(x, [1.0, 2.0, 2.0, 4.0]) for x in (2.0, 3.0, 0.0, 9.0)] + [(1.0, [1.0, None]), (5.0, [5.0])], "v double, r array<double>")
    got = [r[0] for r in v.select(series.reference_quantile(F.col("v"), F.col("r"))).collect()]
    assert got == [0.5, pytest.approx(2.5 / 3), -1.0, 2.0, None, 0.5]


def test_seasons(spark):
    s = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate((0, 1, 1, 0, 1, 1, 1, 0), 1)], "k int, t int, v double")
    assert rows(series.islands(s, ["k"], "t", "v", 1), "start") == [(1, 2, 3, 2), (1, 5, 7, 3)]
    assert rows(series.islands(s, ["k"], "t", "v", 1, max_gap=1), "start") == [(1, 2, 7, 3)]


def test_theil_sen_of_series_of_any_length(spark, monkeypatch):
    s = spark.createDataFrame([(1, t, float(t)) for t in range(5)] + [(2, 7, 1.0), (3, 1, 4.0), (3, 1, 2.0), (4, 2, None)], "k int, t int, v double")
    assert rows(series.theil_sen(s, ["k"], "t", "v"), "k") == [(1, 5, 1.0, 10), (2, 1, None, 0), (3, 2, None, 1)]
    assert series.theil_sen(s.limit(0), ["k"], "t", "v").count() == 0
    rng = np.random.default_rng(3)
    for n in (2, 3, 40, 61):
        t, v = np.sort(rng.integers(0, 50, n)).astype(float), rng.integers(-9, 9, n) * 0.37
        slopes = sorted((v[j] - v[i]) / (t[j] - t[i]) for i in range(n) for j in range(i + 1, n) if t[i] != t[j])
        want = slopes[len(slopes) // 2] if slopes else None, sum(int(np.sign(v[j] - v[i])) for i in range(n) for j in range(i + 1, n))
        assert series.middle_slope(t, v) == want
        with monkeypatch.context() as m:  # histograms instead of all slopes at once
            m.setattr(series, "SLOPES_AT_ONCE", 7)
            assert series.middle_slope(t, v) == want


def test_instants_fall_into_half_open_intervals(spark):
    maps = spark.sql("SELECT timestamp_ntz'2001-01-01' AS s UNION ALL SELECT timestamp_ntz'2001-04-01'")
    points = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2000-12-31 23:59:59'), (2, timestamp_ntz'2001-01-01'), (3, timestamp_ntz'2001-03-31 23:59:59'), (4, timestamp_ntz'2001-04-01'), (5, timestamp_ntz'2003-01-01') p(id, ts)")
    got = temporal.instant_join(points, temporal.registry(maps, "s"), "ts", "month").select("id", "map")
    assert rows(got, "id") == [(2, 1), (3, 1), (4, 2), (5, 2)]


def test_adjacency_counts_borders(spark):
    grid = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (0, 1, 3), (1, 1, 4)], "x int, y int, c int")
    assert focal.adjacency(grid, "c").count() == 8
    assert focal.adjacency(grid, "c", True).count() == 12


def test_fuzzy(spark):
    v = spark.createDataFrame([(0.0, 0.0), (0.25, 0.5), (None, 1.0)], "p double, q double")
    assert [r[0] for r in v.select(fuzzy.fuzzy_and(F.col("p"), F.col("q"), "hamacher")).collect()] == [0.0, pytest.approx(0.2), None]
    assert [r[0] for r in v.select(fuzzy.fuzzy_or(F.col("p"), F.col("q"), "product")).collect()] == [0.0, pytest.approx(0.625), None]
    with pytest.raises(Exception, match="between 0 and 1"):
        v.select(fuzzy.fuzzy_not(F.col("q") + 1)).collect()


def test_normalized_difference_of_nothing(spark):
    assert spark.range(1).select(indices.normalized(F.lit(0.0), F.lit(0.0))).first()[0] == -1.0


def test_promethee_without_pairs(spark):
    a = spark.createDataFrame([(i, float(v), float(w)) for i, v, w in ((1, 3, 1), (2, 3, 5), (3, 7, 2))], "k int, v double, w double")
    got = {r.k: r for r in decision.promethee(a, "k", {"v": 1, "w": 1}).collect()}
    for r in a.collect():
        up = sum(0.5 * max(r.v - o.v, 0) + 0.5 * max(r.w - o.w, 0) for o in a.collect()) / 2
        assert got[r.k].positive == pytest.approx(up)
    with pytest.raises(ValueError):
        decision.electre(a, "k", {"v": 1}, most=2)


def test_hierarchy_weights():
    w, ratio = decision.comparison_weights([[1, 2, 4], [0.5, 1, 2], [0.25, 0.5, 1]])
    assert w == [pytest.approx(4 / 7), pytest.approx(2 / 7), pytest.approx(1 / 7)]
    assert ratio == pytest.approx(0, abs=1e-9)


def test_stepwise_inflation(spark):
    d = spark.createDataFrame([(float(i), float(2 * i + i % 2), float(i * i % 7)) for i in range(40)], "a double, b double, c double")
    assert [s[1] for s in decision.stepwise_vif(d, ["a", "b", "c"], 10)] in (["a"], ["b"])


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (None, 1)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stream_orders(spark):
    net = spark.createDataFrame([(1, 3), (2, 3), (3, 7), (4, 6), (5, 6), (6, 7), (7, 9), (8, 9), (9, None)], "id long, to long")
    assert rows(graph.stream_orders(net, "id", "to"), "id") == [(1, 1, 1), (2, 1, 1), (3, 2, 2), (4, 1, 1), (5, 1, 1), (6, 2, 2), (7, 3, 4), (8, 1, 1), (9, 3, 5)]


def test_flow_accumulates_along_a_path(spark):
    flow = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 5)], "id long, to long")
    got = dict(rows(graph.flow_accumulation(flow, "id", "to"), "id"))
    assert (got[4], got[5], got[8], got[20]) == (5.0, 7.0, 10.0, 1.0)
    with pytest.raises(ValueError):
        graph.flow_accumulation(spark.createDataFrame([(1, 2), (2, 1)], "id long, to long"), "id", "to", steps=3)


def test_patches(spark):
    grid = spark.createDataFrame([(x, y, 1 if (x, y) in {(0, 0), (1, 0), (3, 3)} else 0) for x in range(4) for y in range(4)], "x int, y int, c int")
    got = {r.clump: r for r in graph.patch_indices(graph.clumps(grid, "c", 4), "c").collect()}
    assert (got[0].area, got[0].perimeter, got[15].area) == (2, 6, 1)
    assert got[15].fractal is None


def test_csv_round_trip(spark, tmp_path):
    from cellweave.sources import files

    (tmp_path / "in.csv").write_text("a b,1x,,n\n x  y ,2,z,5\n , ,,\nq,,w,no\n")
    df = files.read_csv(spark, f"file://{tmp_path}/in.csv", ints=["n"], reals=["v_1x"])
    assert df.columns[0] == "a_b"
    assert [(r["a_b"], r["v_1x"], r["n"]) for r in df.collect()] == [("x y", 2.0, 5), ("q", None, None)]
    files.write_csv(df.withColumn("l", F.array("n")), f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 2


def test_features(spark, tmp_path):
    from cellweave.sources import files

    p = spark.createDataFrame([(1, 2.0, 3.5), (2, -1.0, 0.0)], "id int, x double, y double")
    files.write_point_features(p, f"file://{tmp_path}/f", ["id"])
    got = files.read_point_features(spark, f"file://{tmp_path}/f")
    assert sorted((r.properties["id"], r.x, r.y) for r in got.collect()) == [("1", 2.0, 3.5), ("2", -1.0, 0.0)]
    esri = spark.createDataFrame([('{"x":1,"y":2}',), ('{"rings":[[[0,0],[1,0],[1,1]]]}',), (None,), ("{",)], "g string")
    assert [None if r.vertices is None else len(r.vertices) for r in files.esri_to_points(esri, "g").collect()] == [1, 3, None, None]


def test_warehouse(spark):
    from cellweave.sources import warehouse

    for t in ("cw_one", "cw_one_copy"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    warehouse.create_table(spark, "cw_one", {"k": "int", "v": "string", "d": "string"}, partitioned=["d"])
    rows_ = spark.createDataFrame([("x", 1, "p"), ("y", 2, "q")], "v string, k int, d string")
    warehouse.load(rows_, "cw_one")
    warehouse.load(rows_.where("k = 1"), "cw_one")
    assert spark.table("cw_one").count() == 3
    assert warehouse.copy_matching(spark, "cw_one", "_copy") == ["cw_one_copy"]
    warehouse.load(rows_.where("k = 1"), "cw_one", overwrite=True)
    assert (spark.table("cw_one").count(), spark.table("cw_one_copy").count()) == (1, 3)
    for t in ("cw_one", "cw_one_copy"):
        spark.sql(f"DROP TABLE {t}")


def test_formulas(spark):
    from cellweave.functions import formulas

    r = spark.range(1).select(
        formulas.ricker_growth(F.lit(10.0), 0.5, 100, 2), formulas.polynomial(F.lit(2.0), (1, 2, 3)), formulas.net_present_value(F.lit(10.0), F.lit(6.0), 0.0, 2), formulas.disjoint_restrictions(F.lit(3.0), F.lit(None).cast("boolean"), F.lit(True))
    ).first()
    n = 10 * math.exp(0.5 * 0.9)
    assert r[0] == pytest.approx(n * math.exp(0.5 * (1 - n / 100)))
    assert r[1:] == (17.0, 2.0, 0.0)


def test_cost_distance_goes_round_walls(spark):
    grid = spark.createDataFrame([(x, y, None if (x == 1 and y < 2) else 1.0) for x in range(3) for y in range(3)], "x int, y int, c double")
    got = {(r.x, r.y): r.d for r in graph.cost_distance(grid, "c", grid.where("x = 0 AND y = 0")).collect()}
    assert (1, 0) not in got
    assert got[0, 0] == 0
    assert got[2, 0] == pytest.approx(2 + 2 * math.sqrt(2))


def test_fill_category(spark):
    from cellweave.operators import fitting

    grid = spark.createDataFrame([(x, y, 9 if 0 < x < 4 and 0 < y < 4 else 1 + (x > 2)) for x in range(5) for y in range(5)], "x int, y int, c int")
    got = {(r.x, r.y): r.c for r in fitting.fill_category(grid, "c", 9).collect()}
    assert 9 not in got.values()
    assert (got[1, 1], got[3, 3]) == (1, 2)


def test_demand_falls_back_to_density(spark):
    from cellweave.operators import fitting

    seen = spark.createDataFrame([(1, y, 100.0 + y, 50.0 - y) for y in range(5)], "r int, year int, pop double, dev double")
    new = spark.createDataFrame([(1, 6, 208.0)], "r int, year int, pop double")
    (row,) = fitting.project_demand(seen, new, "r", "year", "pop", "dev").collect()
    assert (row.method, row.projected) == ("density", pytest.approx(46 / 104 * 208))


def test_learners_leave_nulls(spark):
    from cellweave.operators import learning

    d = spark.createDataFrame([("a" if i % 2 else "b", float(i % 2), float(i)) for i in range(40)] + [("a", None, 1.0)], "k string, u double, v double")
    got = learning.classify(learning.train_classifier(d, "k", ["u", "v"], "tree"), d).collect()
    assert sum(r.predicted == r.k for r in got) == 40
    assert [r.predicted for r in got if r.u is None] == [None]


def test_colours_differ_between_neighbours(spark):
    from cellweave.operators import convert

    edges = [(i, (i * k) % 23) for i in range(23) for k in (2, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.colour for r in convert.colour(df).collect()}
    assert all(got[a] != got[b] for a, b in edges if a != b)
    assert set(got.values()) <= set(range(1, 8))


def test_null_values_and_snapping(spark):
    from cellweave.operators import convert

    d = spark.createDataFrame([(1, 0.0), (2, None), (3, 5.0)], "k int, v double")
    assert rows(convert.null_values(d, ["v"], (0.0,)), "k") == [(1, None), (2, None), (3, 5.0)]
    assert rows(convert.null_values(d, ["v"], (), -1.0), "k") == [(1, 0.0), (2, -1.0), (3, 5.0)]
    grid = spark.createDataFrame([(0, 0, 9.0), (5, 5, 9.0), (2, 2, 1.0)], "x long, y long, v double")
    p = spark.createDataFrame([(1, 1, 1), (2, 20, 20)], "k int, x long, y long")
    assert rows(convert.snap(p, grid, "k", "v", 5, 3), "k") == [(1, 0, 0, pytest.approx(math.sqrt(2))), (2, 20, 20, None)]


def test_discard_deletes_intermediate_tables_only(spark, sf_dir):
    from cellweave.sources.shared import discard, materialize

    table = materialize(spark.range(5).repartition(2), "x")
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    discard(table)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError):
        discard(spark.read.parquet(f"{sf_dir}/region.parquet"))


def test_percolation_joins_through_any_near_point(spark):
    four = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0), (3, 0.031, 0.0), (4, 0.032, 0.0), (5, None, 0.0)], "k long, x double, y double")
    assert rows(graph.point_percolation(four, "k", [0.002, 0.05]), "threshold") == [(0.002, 2, 2), (0.05, 1, 4)]
    rng = random.Random(5)
    places = [(rng.gauss(0, 0.2), rng.gauss(0, 0.2)) for _ in range(250)] + [(-0.1 + i / 4000, 0.05) for i in range(60)] + [(0.9, 0.9)] * 3 + [(0.9 + 0.25, 0.9), (0.9, 0.9 + 0.03125)]
    got = {r.threshold: (r.groups, r.largest) for r in graph.point_percolation(spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "k long, x double, y double"), "k", [0.01, 0.03125, 0.25]).collect()}
    for t, found in got.items():
        root = list(range(len(places)))
        for i, p in enumerate(places):
            for j, q in enumerate(places[:i]):
                if math.hypot(p[0] - q[0], p[1] - q[1]) <= t and root[i] != root[j]:
                    root = [root[j] if r == root[i] else r for r in root]
        sizes = [n for n in collections.Counter(root).values() if n > 1]
        assert found == (len(sizes), max(sizes))


def test_cost_distance_query_takes_all_cells(spark, sf_dir):
    from cellweave.plans import catalog, views

    cells = views.cells(catalog.table(spark, sf_dir, "lineitem")).select("x", "y")
    got = catalog.QUERIES["cost_distance"](spark, sf_dir)
    assert got.join(cells, ["x", "y"], "left_semi").where("x >= 24 OR y >= 24").count() > 0


def test_isolated_points_have_neighbours(spark):
    at = [(1, 0.0, 0.0), (2, 0.1, 0.0), (3, 5.0, 0.0), (4, 5.0, 40.0), (5, -300.0, 0.0)]
    p = spark.createDataFrame([*at, (6, None, 1.0), (7, 1.0, float("nan"))], "k long, x double, y double")
    want = {k: min((math.hypot(x - u, y - v), j) for j, u, v in at if j != k) for k, x, y in at}
    got = {r.k: (r.distance, r.nearest) for r in graph.nearest_neighbours(p, "k").collect()}
    assert got == {k: (pytest.approx(d), j) for k, (d, j) in want.items()}
    (r,) = graph.clark_evans(p, "k", 100.0).collect()
    assert (r.n, r.observed) == (5, pytest.approx(sum(d for d, _ in want.values()) / 5))
    assert r.ratio == pytest.approx(r.observed / (0.5 / math.sqrt(5 / 100)))
    assert graph.nearest_neighbours(p.where("k = 1"), "k").count() == 0
    assert graph.clark_evans(p.where("k = 1"), "k", 100.0).first().n == 1


def test_columns_come_from_the_data(spark):
    from cellweave.operators import vector

    s = spark.createDataFrame([(0, t, float(t)) for t in (12, 2, 28)] + [(1, 28, 5.0), (2, None, 1.0)], "k int, t int, v double")
    out = vector.to_columns(s, ["k"], "t", F.max("v"))
    assert out.columns == ["k", "2", "12", "28"]
    assert rows(out, "k") == [(0, 2.0, 12.0, 28.0), (1, None, None, 5.0), (2, None, None, None)]


def test_classify_pixels_uses_all_components(spark, tmp_path):
    from cellweave.plans import catalog

    e = spark.createDataFrame([(i, i // 2 % 2, [0.0] * 9 + [float(i // 2 % 2)]) for i in range(80)], "vec_id long, label int, embedding array<double>")
    e.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["classify_pixels"](spark, f"file://{tmp_path}").collect()
    assert all(int(r.predicted) == r.label for r in got)


def test_electre_against_all_pairs(spark):
    rng = random.Random(3)
    a = [(i, rng.choice([None, *range(6)]), float(rng.randrange(9)), rng.random()) for i in range(40)] + [(None, 1, 2.0, 0.5)]
    df = spark.createDataFrame(a, "k int, u int, v double, w double")
    conc = lambda p, q: sum(s for x, y, s in zip(p[1:], q[1:], (0.5, 0.3, 0.2), strict=True) if None not in (x, y) and x >= y)
    disc = lambda p, q: max(max(y - x, 0.0) if None not in (x, y) else 0.0 for x, y in zip(p[1:], q[1:], strict=True))
    got = {r.k: (r.concordance, r.discordance) for r in decision.electre(df, "k", {"u": 5, "v": 3, "w": 2}).collect()}
    assert len(got) == 40
    for p in a[:-1]:
        assert got[p[0]] == pytest.approx((sum(conc(p, q) - conc(q, p) for q in a[:-1]), sum(disc(q, p) - disc(p, q) for q in a[:-1])))


def test_electre_takes_any_number(spark):
    df = spark.range(10_001).select("id", (F.col("id") % 50).alias("v"), (F.col("id") % 7).alias("w"))
    assert decision.electre(df, "id", {"v": 3, "w": 1}).count() == 10_001


def test_electre_of_two_makes_no_pairs(spark):
    """Ties, nulls, copies and one criterion against all pairs; the pairs of 40,000 distinct alternatives were 1,600 million."""
    rng = random.Random(4)
    some = lambda: rng.choice([None, -0.0, *[float(x) for x in range(-3, 5)], rng.random() * 4])
    a = [(i, some(), some()) for i in range(150)]
    gap = lambda p, q: max([0.0, *[x - y for x, y in zip(p, q, strict=True) if None not in (x, y)]])
    df = spark.createDataFrame(a, "k int, u double, v double")
    for names in (["u", "v"], ["u"]):
        at = [r[1 : 1 + len(names)] for r in a]
        got = {r.k: r.discordance for r in decision.electre(df, "k", dict.fromkeys(names, 1)).collect()}
        assert got == {i: pytest.approx(sum(gap(p, q) - gap(q, p) for q in at), abs=1e-9) for i, p in enumerate(at)}
    assert decision.electre(df.limit(0), "k", {"u": 1, "v": 1}).count() == 0
    assert [r.discordance for r in decision.electre(df.limit(3).selectExpr("k", "cast(null AS double) AS u", "cast(null AS double) AS v"), "k", {"u": 1, "v": 1}).collect()] == [0.0] * 3
    odd = spark.createDataFrame([(1, float("inf"), 1.0), (2, 2.0, 3.0)], "k int, u double, v double")
    got = {r.k: r.discordance for r in decision.electre(odd, "k", {"u": 1, "v": 1}).collect()}
    assert math.isnan(got[1]) and got[2] == float("-inf")
    many = spark.range(40_000).selectExpr("id", "id * 7919 % 40009 * 0.5D AS u", "cast(id % 25 AS double) AS v")
    out = decision.electre(many, "id", {"u": 3, "v": 1})
    assert not any(j in out._jdf.queryExecution().executedPlan().toString() for j in ("CartesianProduct", "Cross"))
    assert out.agg(F.sum("discordance")).first()[0] == pytest.approx(0, abs=1)


@pytest.mark.parametrize("name", ["stream_sessions", "stream_tumbling", "stream_sliding"])
def test_streams_are_written_where_executors_write(spark, sf_dir, name):
    """Rows were gathered in a table in the driver's memory."""
    from cellweave.plans import catalog

    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.inputFiles() and all("/cellweave/" in f for f in df.inputFiles())
    assert not spark.catalog.tableExists(name)


def test_focal_square_on_a_grid_with_holes(spark):
    cells = [(0, 0, 1.0), (1, 1, 10.0), (4, 0, 5.0), (5, 2, None), (9, 9, 2.0)]
    got = {(r.x, r.y): (r.sum, r.n, r.min, r.max, r.mean) for r in focal.focal(spark.createDataFrame(cells, "x int, y int, v double"), "v", 2).collect()}
    assert len(got) == len(cells)
    for x, y, _ in cells:
        near = [v for a, b, v in cells if abs(a - x) <= 2 and abs(b - y) <= 2 and v is not None]
        assert got[x, y] == ((sum(near), len(near), min(near), max(near), sum(near) / len(near)) if near else (None, 0, None, None, None))


def test_esri_keeps_every_part(spark):
    rings = '{"rings":[[[0,0],[1,0],[1,1]],[[5,5],[6,5]]]}'
    (row,) = files.esri_to_points(spark.createDataFrame([(rings,)], "g string"), "g").collect()
    assert [(v.x, v.y) for v in row.vertices] == [(0, 0), (1, 0), (1, 1), (5, 5), (6, 5)]
    assert row.parts == [0, 0, 0, 1, 1]


def test_points_in_areas(spark):
    """A ring with a bay and one that overlaps it; points in the bay and outside belong to none or one."""
    ring = lambda *p: [{"x": float(a), "y": float(b)} for a, b in (*p, p[0])]
    areas = spark.createDataFrame([("u", ring((0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9))), ("s", ring((5, 5), (12, 5), (12, 12), (5, 12))), ("line", ring((0, 0), (5, 5)))], "name string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 4.5, 6.5), (3, 7.5, 7.5), (4, 11.5, 11.5), (5, -1.0, 4.0), (6, 5.5, 5.5)], "id int, x double, y double")
    got = sorted((r.id, r.name) for r in surface.points_in_areas(points, areas, "ring", 2.5).collect())
    assert got == [(1, "u"), (3, "s"), (3, "u"), (4, "s"), (6, "s")]
    assert {(r.a, r.b) for r in surface.overlapping_boxes(areas, "name", "ring", 2.5).collect()} == {("s", "u"), ("line", "s"), ("line", "u")}


def test_rounds_for_comparison_are_not_nudged():
    assert catalog.nudged("round(a - b, 9) + round(round(c, 6), 2)") == "round(a - b, 9) + round((round((c) + 1e-09, 6)) + 1e-09, 2)"


def test_percentiles_over_several_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(None if k == 3 else int(k), None if rng.random() < 0.1 else float(v)) for k, v in zip(rng.integers(0, 4, 600), rng.integers(-40, 40, 600), strict=True)] + [(9, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # so that zones do spread over ranges
    try:
        df = spark.createDataFrame(rows, "z int, v double")
        got = {r.z: r for r in zonal.quartiles(df, ["z"], "v", (0, 25, 50, 90, 100)).collect()}
        boxes = {r.z: r for r in zonal.boxplot(df, ["z"], "v", 0.2).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {None, 0, 1, 2, 9} and set(boxes) == {None, 0, 1, 2}
    assert list(got[9])[1:] == [None] * 5
    for z in boxes:
        v = np.array([b for a, b in rows if a == z and b is not None])
        assert list(got[z])[1:] == pytest.approx(np.percentile(v, (0, 25, 50, 90, 100)))
        q1, q3 = np.percentile(v, (25, 75))
        assert boxes[z].n == len(v) and boxes[z].outliers == ((v < q1 - 0.2 * (q3 - q1)) | (v > q3 + 0.2 * (q3 - q1))).sum()


def test_flood_prone_keeps_large_areas(spark):
    wet = {(x, y) for x in range(4) for y in range(3)} | {(8, 8)}
    cells = spark.createDataFrame([(x, y, 1e6 if (x, y) in wet else 0.0, 0.5 if (x, y) in wet else 60.0) for x in range(10) for y in range(10)], "x long, y long, acc double, slope double")
    got = {(r.x, r.y) for r in sites.flood_prone(cells, "acc", "slope", 300.0, 10).collect()}  # 11 cells are a square kilometre
    assert got == wet - {(8, 8)}


def test_boxes_that_hold_every_point(spark):
    p = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (9.0, 9.0), (None, 2.0)], "x double, y double")
    b = spark.createDataFrame([("all", 0.0, 10.0, 0.0, 10.0), ("edge", 1.0, 9.0, 1.0, 9.0), ("one", 0.0, 5.0, 0.0, 5.0), ("none", 2.0, 3.0, 2.0, 3.0)], "k string, x1 double, x2 double, y1 double, y2 double")
    assert rows(sites.boxes_holding(p, b, "k", 4.0, every=True), "k") == [("all", 2), ("edge", 2)]
    assert rows(sites.boxes_holding(p, b, "k", 4.0, every=False), "k") == [("all", 2), ("edge", 2), ("one", 1)]


def test_rules_rain_and_folds(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, None, 9.0), (3, 0.0, 0.0)], "k int, a double, b double")
    rules = [("low", [("a", "<", 6.0), ("b", "<", 2.0)]), ("high", [("b", ">", 8.0)]), ("low", [("a", "=", 0.0)])]
    assert rows(sites.rule_classes(df, ["k"], rules), "k", "class") == [(1, "low"), (2, "high"), (3, "low")]
    rain = {r.k: r.rain_20 for r in sites.design_rainfall(df, "k", {20: "a"}, 40.0, "b", 0.5).collect()}
    assert rain[1] == -1 and rain[2] == -1 and rain[3] == 0
    assert sites.design_rainfall(df, "k", {20: "a"}, 40.0).where("k = 1").first().rain_20 == pytest.approx(5 * 0.3 * 40**0.197)
    with pytest.raises(ValueError):
        sites.design_rainfall(df, "k", {2: "a"}, 1440)
    many = sites.folds(spark.range(2000), "id", 4)
    assert sorted(n for _, n in many.groupBy("fold").count().collect())[0] > 400
    assert many.exceptAll(sites.folds(spark.range(2000).repartition(7), "id", 4)).count() == 0
    line = sites.regression_residuals(df, ["k"], "a", "b").collect()
    assert len(line) == 2 and all(abs(r.residual) < 1e-9 for r in line)
