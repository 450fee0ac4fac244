"""Edges and lines, wavelets, fuzzy systems, spatial SQL and surfaces from areas against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import fuzzy, wavelets
from cellweave.functions.spatial import register_spatial
from cellweave.operators import areal, edges


def grid(spark, z):
    return spark.createDataFrame([(x, y, None if v is None else float(v)) for y, row in enumerate(z) for x, v in enumerate(row)], "x long, y long, z double")


@pytest.mark.parametrize("name", ["haar", "d4", "d6"])
def test_wavelets_come_back(spark, name):
    low = wavelets.low_pass(name)
    assert sum(low) == pytest.approx(math.sqrt(2))
    assert sum(x * x for x in low) == pytest.approx(1)
    r = random.Random(1)
    arrays = [[r.random() for _ in range(n)] for n in (1, 2, 3, 7, 8, 21, 64)] + [[5.0] * 16, [], None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, s array<double>")
    got = df.select("i", wavelets.recomposed(wavelets.decomposed(F.col("s"), name, 3), name, 3).alias("b")).collect()
    for row in got:
        want = arrays[row.i]
        assert row.b == (want if want is None else [pytest.approx(x, abs=1e-9) for x in want])
    flat = df.where("i = 7").select(wavelets.decomposed(F.col("s"), name, 1).alias("w")).first().w
    assert flat.details[0] == [pytest.approx(0, abs=1e-12)] * 8
    assert flat.approximation == [pytest.approx(5 * math.sqrt(2))] * 8
    x = arrays[4]
    one = df.where("i = 4").select(wavelets.decomposed(F.col("s"), name, 1).alias("w")).first().w
    assert one.approximation == [pytest.approx(sum(f * x[(2 * i + k) % 8] for k, f in enumerate(low))) for i in range(4)]


def test_fused_series(spark):
    df = spark.createDataFrame([([float(i % 4 == 0) + i // 8 for i in range(16)], [3.0] * 16)], "fine array<double>, coarse array<double>")
    got = df.select(wavelets.fused(F.col("coarse"), F.col("fine"), "haar", 2).alias("f")).first().f
    fine = df.first().fine
    assert got == [pytest.approx(3 + fine[i] - np.mean(fine[i // 4 * 4 : i // 4 * 4 + 4])) for i in range(16)]


def test_fuzzy_system(spark):
    df = spark.createDataFrame([(0.0, 10.0), (5.0, 5.0), (10.0, 0.0), (None, 1.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    sets = {"a": {"high": fuzzy.membership(a, (0.0, 10.0), "left", "linear")}, "b": {"low": fuzzy.membership(b, (0.0, 10.0), "right", "linear")}}
    out = {"good": ((0.0, 10.0), "left", "linear"), "bad": ((0.0, 10.0), "right", "linear")}
    rules = [(("and", ("a", "high"), ("b", "low")), "good"), (("not", ("a", "high")), "bad")]

    def plain(good, bad, how, cut):
        y = [i / 2 for i in range(21)]
        h = [max(cut(good, v / 10), cut(bad, 1 - v / 10)) for v in y]
        top = [v for v, x in zip(y, h, strict=True) if x == max(h)]
        half = next(v for v, s in zip(y, np.cumsum(h), strict=True) if s >= sum(h) / 2)
        return {"centroid": np.dot(y, h) / sum(h), "bisector": half, "min_of_highest": top[0], "max_of_highest": top[-1], "mean_of_highest": np.mean(top)}[how]

    for how in ("centroid", "bisector", "min_of_highest", "max_of_highest", "mean_of_highest"):
        for implication, cut in (("minimum", min), ("product", lambda t, m: t * m)):
            got = [r.v for r in df.select(fuzzy.fuzzy_system(rules, sets, out, 0.0, 10.0, 20, "zadeh", implication, how).alias("v")).collect()]
            assert got == [pytest.approx(plain(*t, how, cut)) for t in ((0.0, 1.0), (0.5, 0.5), (1.0, 0.0))] + [None]
    with pytest.raises(ValueError, match="no set low of a"):
        fuzzy.fuzzy_system([(("a", "low"), "good")], sets, out, 0.0, 1.0)
    with pytest.raises(ValueError, match="no output set"):
        fuzzy.fuzzy_system([(("a", "high"), "fine")], sets, out, 0.0, 1.0)


def test_spatial_functions(spark):
    assert "ST_Contains" in register_spatial(spark)
    one = lambda e: spark.sql(f"SELECT {e} AS v").first().v
    ring = "ST_LineFromText('POLYGON ((0 0, 4 0, 4 2, 2 2, 2 4, 0 4, 0 0))')"
    line = "ST_LineFromText('linestring(0 0,3 4, 3 0)')"
    assert (one(f"ST_Area({ring})"), one(f"ST_Length({line})"), one(f"ST_NumPoints({line})")) == (12, 9, 3)
    assert one(f"ST_Centroid({ring})").asDict() == {"x": pytest.approx(5 / 3), "y": pytest.approx(5 / 3)}
    assert (one(f"ST_IsClosed({ring})"), one(f"ST_IsClosed({line})")) == (True, False)
    assert one(f"ST_AsText({line})") == "LINESTRING (0.0 0.0, 3.0 4.0, 3.0 0.0)"
    assert one(f"ST_AsText(ST_Envelope({line}))") == "POLYGON ((0.0 0.0, 3.0 0.0, 3.0 4.0, 0.0 4.0, 0.0 0.0))"
    assert [one(f"ST_Contains({ring}, ST_Point({p}))") for p in ("1D, 3D", "3D, 3D", "3D, 1D", "9D, 1D")] == [True, False, True, False]
    assert one(f"ST_Contains({ring}, NULL)") is None
    assert (one(f"ST_EnvIntersects({ring}, {line})"), one(f"ST_EnvIntersects({ring}, ST_LineFromText('LINESTRING (5 0, 6 1)'))")) == (True, False)
    assert (one("ST_Distance(ST_Point(0D, 0D), ST_Point(3D, 4D))"), one("ST_DWithin(ST_Point(0D, 0D), ST_Point(3D, 4D), 4.9D)")) == (5, False)
    assert (one(f"ST_EndPoint({line}).x"), one("ST_Area(array())"), one("ST_Distance(NULL, ST_Point(1D, 1D))")) == (3, 0, None)
    plan = spark.range(3).selectExpr("ST_Distance(ST_Point(CAST(id AS DOUBLE), 0D), ST_Point(0D, 0D)) AS d")._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "sqrt" in plan.lower()


def test_areas_keep_their_totals(spark):
    r = random.Random(2)
    cells = [(x, y, (x // 4) + 3 * (y // 4)) for x in range(12) for y in range(12) if r.random() < 0.9] + [(50, 50, None), (51, 50, 77)]
    df = spark.createDataFrame(cells, "x long, y long, zone int")
    given = {k: float(v) for k, v in enumerate((10, 0, 500, -4, 30, 30, 1, 9, 80))}
    totals = spark.createDataFrame([*given.items(), (77, None), (99, 5.0)], "zone int, t double")
    for negative in (False, True):
        got = {(c.x, c.y): (c.zone, c.value) for c in areal.mass_preserving(df, "zone", totals, "t", 5, negative=negative).collect()}
        assert len(got) == len(cells) - 2
        for k, t in given.items():
            assert sum(v for z, v in got.values() if z == k) == pytest.approx(t, abs=1e-6)
        assert negative or all(v >= 0 for z, v in got.values() if given[z] >= 0)
    at = {(x, y): z for x, y, z in cells if z in given}
    value = {p: given[z] / sum(q == z for q in at.values()) for p, z in at.items()}
    for _ in range(5):
        near = {(x, y): [value[q] for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if q in value] for x, y in at}
        m = {p: max(0.0, np.mean(v) if v else value[p]) for p, v in near.items()}
        s = {k: sum(m[p] for p in at if at[p] == k) for k in given}
        n = {k: sum(z == k for z in at.values()) for k in given}
        value = {p: m[p] * given[z] / s[z] if s[z] and given[z] / s[z] >= 0 else given[z] / n[z] for p, z in at.items()}
    got = {(c.x, c.y): c.value for c in areal.mass_preserving(df, "zone", totals, "t", 5).collect()}
    assert got == {p: pytest.approx(v, abs=1e-9) for p, v in value.items()}
    few = areal.mass_preserving(df, "zone", totals, "t", 40, change=1e9)
    assert few.columns == ["x", "y", "zone", "value"]
    assert areal.mass_preserving(df.limit(0), "zone", totals, "t", 2).count() == 0


def test_edges_of_a_step(spark):
    """A bright square on a dark ground has one closed edge; a faint one has none."""
    z = [[100 * (5 <= x < 15 and 5 <= y < 15) + 3 * (20 <= x < 24 and 8 <= y < 12) for x in range(28)] for y in range(20)]
    got = edges.canny(grid(spark, z), "z", 28, 1.0, 5.0, 20.0).collect()
    assert len({r.edge for r in got}) == 1
    assert all(min(abs(r.x - 4.5), abs(r.x - 14.5), abs(r.y - 4.5), abs(r.y - 14.5)) <= 1 for r in got)
    assert all(4 <= r.x <= 15 and 4 <= r.y <= 15 for r in got)
    left = next(r for r in got if r.y == 10 and r.x < 8)
    assert left.angle == pytest.approx(0)
    weak = edges.canny(grid(spark, z), "z", 28, 1.0, 0.2, 20.0).collect()
    assert not any(r.x > 18 for r in weak)
    assert edges.canny(grid(spark, z).limit(0), "z", 28, 1.0, 1.0, 2.0).count() == 0


def test_smoothing_is_that_of_the_window(spark):
    r = random.Random(3)
    z = [[r.random() if r.random() < 0.9 else None for _ in range(9)] for _ in range(8)]
    at = {(x, y): v for y, row in enumerate(z) for x, v in enumerate(row) if v is not None}
    got = {(c.x, c.y): c.smooth for c in edges.smoothed(grid(spark, z), "z", 0.7).collect()}
    for (x, y), v in got.items():
        w = {p: math.exp(-((p[0] - x) ** 2 + (p[1] - y) ** 2) / (2 * 0.7**2)) for p in at if max(abs(p[0] - x), abs(p[1] - y)) <= 3}
        assert v == pytest.approx(sum(at[p] * k for p, k in w.items()) / sum(w.values()))
    assert set(got) == set(at)


def test_lines_through_cells(spark):
    cells = [(x, 7) for x in range(20)] + [(k, k) for k in range(30, 45)] + [(3, 40)]
    df = spark.createDataFrame(cells, "x long, y long")
    votes = {(r.angle, r.rho): r.votes for r in edges.hough_votes(df, 12).collect()}
    want = {}
    for x, y in cells:
        for k in range(12):
            p = (k, math.floor(x * math.cos(math.pi * k / 12) + y * math.sin(math.pi * k / 12) + 0.5 + 1e-9))
            want[p] = want.get(p, 0) + 1
    assert votes == want
    lines = [tuple(r) for r in edges.hough_lines(df, 12, 2).collect()]
    assert lines == [(6, 7, 20), (9, 0, 16)]  # one cell is on both
    assert edges.hough_lines(df.limit(0), 12, 2).count() == 0
