"""Dominance-based rough sets against all pairs of rows, and zeros around a picture."""

import random

import pytest

from cellweave.operators import regions, rough

KIND = "a int, b int, c double, grade int, other string"


def plain(rows):
    whole = [r for r in rows if None not in r[:4]]
    better = lambda x, y: x[0] >= y[0] and x[1] <= y[1] and x[2] >= y[2]
    return [(r, min(o[3] for o in whole if better(o, r)), max(o[3] for o in whole if better(r, o))) for r in whole]


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_and_approximations(spark, seed):
    rng = random.Random(seed)
    rows = [(a := rng.randrange(4), b := rng.randrange(3), c := rng.choice([-0.5, 0.25, 9.0]), 10 * ((a - b + int(c > 0) + (rng.random() < 0.1)) // 2), "x") for _ in range(60)]
    rows += rows[:5] + [(None, 1, 0.25, 0, "x"), (1, None, 0.25, 20, "x"), (1, 1, None, 20, "x"), (3, 0, 9.0, None, None)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    bounds = rough.class_bounds(df, {"a": True, "b": False, "c": True}, "grade")
    want = {}
    for r, low, high in plain(rows):
        n = want.get(r[:4], (0,))[0]
        want[r[:4]] = (n + 1, low, high)
    assert {(r.a, r.b, r.c, r.grade): (r.n, r.low, r.high) for r in bounds.collect()} == want
    each = plain(rows)
    got = {(r["class"], r.side): (r["size"], r.lower, r.upper, r.boundary, r.accuracy) for r in rough.approximations(bounds, "grade").collect()}
    expected = {}
    for t in {r[3] for r, _, _ in each}:
        for side, size, lower, upper in (
            ("at_least", sum(r[3] >= t for r, _, _ in each), sum(low >= t for _, low, _ in each), sum(high >= t for _, _, high in each)),
            ("at_most", sum(r[3] <= t for r, _, _ in each), sum(high <= t for _, _, high in each), sum(low <= t for _, low, _ in each)),
        ):
            expected[t, side] = (size, lower, upper, upper - lower, lower / upper)
    assert got == expected
    assert rough.quality(bounds).first().quality == pytest.approx(sum(low == high for _, low, high in each) / len(each))


def test_no_rows(spark):
    bounds = rough.class_bounds(spark.createDataFrame([], KIND), {"a": True, "b": False}, "grade")
    assert bounds.count() == 0
    assert rough.approximations(bounds, "grade").count() == 0
    assert rough.quality(bounds).first().quality is None


def test_zeros_around_and_within(spark):
    picture = ["0011", "0102", "3N00", "3340"]  # N is null; three zeros hold the corner (0, 0), four do not
    rows = [(x, y, None if v == "N" else int(v)) for y, line in enumerate(picture) for x, v in enumerate(line)]
    rows += [(x, y, 0 if (x, y) == (6, 2) else 7 + x) for x in (5, 6, 7) for y in (1, 2, 3)] + [(9, 3, 5)]
    got = {(r.x, r.y): r.z for r in regions.zero_to_null(spark.createDataFrame(rows, "x int, y int, z int"), "z", 16).collect()}
    # of cells equally near the one with the smallest number counts
    want = {(x, y): z or None for x, y, z in rows} | {(2, 1): 1, (2, 2): 4, (3, 2): 2, (3, 3): 4, (6, 2): 13}
    assert got == want
    blank = spark.createDataFrame([(x, y, 0) for x in range(3) for y in range(3)], "x int, y int, z int")
    assert {r.z for r in regions.zero_to_null(blank, "z", 8).collect()} == {None}
    assert regions.zero_to_null(blank.limit(0), "z", 8).count() == 0
