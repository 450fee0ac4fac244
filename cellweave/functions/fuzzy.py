"""Fuzzy membership and fuzzy logic of values from 0 to 1."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shaped(t: Column, shape: str) -> Column:
    """A rise from 0 to 1 over t from 0 to 1."""
    if shape == "linear":
        return t
    if shape == "s":
        return F.pow(F.sin(t * F.pi() / 2), 2)
    if shape == "j":
        return F.pow(F.tan(t * F.pi() / 4), 2)
    if shape == "g":
        return F.tan(t * F.pi() / 4)
    raise ValueError(shape)


def membership(v: Column, points: Sequence[float], side: str = "both", shape: str = "s") -> Column:
    """Membership that rises between the first two of four points and falls between the last two; ``left`` and ``right`` take two."""
    if side == "both":
        a, b, c, d = points
    elif side == "left":
        (a, b), c, d = points, None, None
    else:
        (c, d), a, b = points, None, None
    out = F.when(v.isNull(), None)
    if a is not None:
        out = out.when(v <= a, 0.0).when(v < b, _shaped((v - a) / (b - a), shape))
    if c is not None:
        out = out.when(v >= d, 0.0).when(v > c, _shaped((d - v) / (d - c), shape))
    return out.otherwise(1.0)


def _checked(x: Column) -> Column:
    return F.when((x >= 0) & (x <= 1), x).when(x.isNotNull(), F.raise_error(F.lit("fuzzy values lie between 0 and 1")).cast("double"))


def fuzzy_and(x: Column, y: Column, family: str = "zadeh") -> Column:
    """Conjunction by family; values outside of 0 to 1 raise an error."""
    x, y = _checked(x), _checked(y)
    if family == "zadeh":
        return F.when(x.isNull() | y.isNull(), None).otherwise(F.least(x, y))
    if family == "product":
        return x * y
    if family == "drastic":
        return F.when(x == 1, y).when(y == 1, x).when(x.isNotNull() & y.isNotNull(), 0.0)
    if family == "lukasiewicz":
        return F.when(x + y > 1, x + y - 1).when((x + y).isNotNull(), 0.0)
    if family == "fodor":
        return F.when(x + y > 1, F.least(x, y)).when((x + y).isNotNull(), 0.0)
    if family == "hamacher":
        return F.when((x == 0) & (y == 0), 0.0).otherwise(F.try_divide(x * y, x + y - x * y))
    raise ValueError(family)


def fuzzy_not(x: Column, sugeno: bool = False) -> Column:
    """Negation, plain or after Sugeno."""
    x = _checked(x)
    return (1 - x) / (1 + x) if sugeno else 1 - x


def fuzzy_or(x: Column, y: Column, family: str = "zadeh") -> Column:
    """Disjunction: the dual of the family's conjunction."""
    return 1 - fuzzy_and(1 - x, 1 - y, family)


def fuzzy_implies(x: Column, y: Column, family: str = "zadeh") -> Column:
    """Implication by family."""
    a, b = _checked(x), _checked(y)
    if family == "zadeh":
        return F.when(a <= b, 1.0).when((a + b).isNotNull(), b)
    if family == "lukasiewicz":
        return F.least(F.lit(1.0), 1 - a + b)
    if family == "product":
        return F.when(a <= b, 1.0).otherwise(F.try_divide(b, a))
    if family == "fodor":
        return F.when(a <= b, 1.0).when((a + b).isNotNull(), F.greatest(1 - a, b))
    raise ValueError(family)


Rule = tuple[object, str]


def rule_truth(rule: object, sets: Mapping[str, Mapping[str, Column]], family: str = "zadeh") -> Column:
    """How far a rule's condition holds: ``(variable, set)``, ``("not", rule)``, ``("and", rule, rule, ...)`` or ``("or", rule, rule, ...)``, nested at will.

    ``sets`` holds the membership column of each variable's sets. An unknown variable or set is an error.
    """
    head, *rest = rule
    if head == "not":
        return fuzzy_not(rule_truth(rest[0], sets, family))
    if head in ("and", "or"):
        join = fuzzy_and if head == "and" else fuzzy_or
        out = rule_truth(rest[0], sets, family)
        for r in rest[1:]:
            out = join(out, rule_truth(r, sets, family), family)
        return out
    if head not in sets or rest[0] not in sets[head]:
        raise ValueError(f"no set {rest[0]} of {head}")
    return sets[head][rest[0]]


def fuzzy_system(
    rules: Sequence[Rule],
    sets: Mapping[str, Mapping[str, Column]],
    output: Mapping[str, tuple[Sequence[float], str, str]],
    low: float,
    high: float,
    steps: int = 100,
    family: str = "zadeh",
    implication: str = "minimum",
    defuzzification: str = "centroid",
) -> Column:
    """The value that rules ``(condition, output set)`` infer, between ``low`` and ``high``, as one expression over the row.

    ``output`` gives each output set's points, side and shape (as for ``membership``). Rules of one set are joined by the family's disjunction. The set's membership is cut at
    (``minimum``) or multiplied by (``product``) the truth, sets are joined by their maximum over ``steps`` + 1 values, and the result is the
    ``centroid``, the ``bisector``, or the ``min_of_highest``, ``mean_of_highest`` or ``max_of_highest`` value. Null where a truth is null or nothing holds.
    """
    truth: dict[str, Column] = {}
    for condition, name in rules:
        if name not in output:
            raise ValueError(f"no output set {name}")
        now = rule_truth(condition, sets, family)
        truth[name] = fuzzy_or(truth[name], now, family) if name in truth else now
    names = list(truth)
    known = F.lit(True)
    for n in names:
        known = known & truth[n].isNotNull()
    held = F.struct(*[truth[n].alias(f"t{i}") for i, n in enumerate(names)])

    def height(y: Column, t: Column) -> Column:
        cut = [F.least(t[f"t{i}"], membership(y, *output[n])) if implication == "minimum" else t[f"t{i}"] * membership(y, *output[n]) for i, n in enumerate(names)]
        return F.greatest(*cut) if len(cut) > 1 else cut[0]

    place = lambda i: F.lit(low) + i * ((high - low) / steps)
    # The truths are computed once a row: they are the one element that the outer function goes over.
    curve = F.flatten(F.transform(F.array(held), lambda t: F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(place(i).alias("y"), height(place(i), t).alias("h")))))
    add = lambda key: lambda a, p: F.struct((a["s"] + p["h"]).alias("s"), (a["m"] + key(p)).alias("m"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("m"))

    def settled(points: Column) -> Column:
        top = F.array_max(F.transform(points, lambda p: p["h"]))
        highest = F.transform(F.filter(points, lambda p: p["h"] == top), lambda p: p["y"])
        if defuzzification == "centroid":
            return F.aggregate(points, zero, add(lambda p: p["h"] * p["y"]), lambda a: F.try_divide(a["m"], a["s"]))
        if defuzzification == "bisector":
            whole = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["h"])
            start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("y"))
            return F.aggregate(points, start, lambda a, p: F.struct((a["s"] + p["h"]).alias("s"), F.when(a["y"].isNull() & (a["s"] + p["h"] >= whole / 2), p["y"]).otherwise(a["y"]).alias("y")), lambda a: a["y"])
        if defuzzification in ("min_of_highest", "max_of_highest"):
            return (F.array_min if defuzzification[:3] == "min" else F.array_max)(highest)
        if defuzzification == "mean_of_highest":
            return F.aggregate(highest, F.lit(0.0), lambda a, y: a + y) / F.size(highest)
        raise ValueError(defuzzification)

    return F.when(known, F.get(F.transform(F.filter(F.array(curve), lambda c: F.exists(c, lambda p: p["h"] > 0)), settled), F.lit(0)))
