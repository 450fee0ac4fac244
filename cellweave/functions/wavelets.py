"""Wavelet transforms of arrays, as column expressions, with an exact inverse."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def low_pass(name: str) -> list[float]:
    """Low-pass filters of the orthogonal wavelets ``haar``, ``d4`` and ``d6``, from their closed forms."""
    r = math.sqrt
    if name == "haar":
        return [1 / r(2)] * 2
    if name == "d4":
        return [x / (4 * r(2)) for x in (1 + r(3), 3 + r(3), 3 - r(3), 1 - r(3))]
    if name == "d6":
        s, t = r(10), r(5 + 2 * r(10))
        return [x / (16 * r(2)) for x in (1 + s + t, 5 + s + 3 * t, 10 - 2 * s + 2 * t, 10 - 2 * s - 2 * t, 5 + s - 3 * t, 1 + s - t)]
    raise ValueError(name)


def high_pass(low: Sequence[float]) -> list[float]:
    """The filter that finds what the low pass loses."""
    return [(-1) ** k * x for k, x in enumerate(reversed(low))]


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it: the one element that a transform goes over."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _at(x: Column, i: Column) -> Column:
    """The element at a place counted from 0, round the ends."""
    return F.element_at(x, (F.pmod(i, F.size(x)) + 1).cast("int"))


def even(x: Column) -> Column:
    """An array of odd length with its last value repeated."""
    return F.when(F.size(x) % 2 == 1, F.concat(x, F.slice(x, -1, 1))).otherwise(x)


def analysed(x: Column, filter_: Sequence[float]) -> Column:
    """One level: every second value of the filtered array, half as long. The array's length is even."""
    half = F.sequence(F.lit(0), (F.size(x) / 2 - 1).cast("int"))
    return F.when(F.size(x) > 0, F.transform(half, lambda i: sum((_at(x, 2 * i + k) * f for k, f in enumerate(filter_)), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))


def synthesised(approximation: Column, detail: Column, low: Sequence[float]) -> Column:
    """The inverse of one level: an array twice as long."""
    both = ((approximation, low), (detail, high_pass(low)))
    places = F.sequence(F.lit(0), 2 * F.size(approximation) - 1)

    def value(j: Column) -> Column:
        """Taps of the same parity as the place, of the halves that reach it."""
        out = F.lit(0.0)
        for part, taps in both:
            for k, f in enumerate(taps):
                i = ((j - k) / 2).cast("int")
                out = out + F.when(F.pmod(j - k, F.lit(2)) == 0, _at(part, i) * f).otherwise(0.0)
        return out

    return F.when(F.size(approximation) > 0, F.transform(places, value)).otherwise(F.array().cast("array<double>"))


def decomposed(x: Column, wavelet: str, levels: int) -> Column:
    """``approximation``, ``details`` (finest first) and ``sizes`` of an array of doubles; arrays of odd length are made even at each level, so any length will do."""
    low = low_pass(wavelet)
    high = high_pass(low)

    def level(now: Column, details: list[Column], sizes: list[Column]) -> Column:
        if len(details) == levels:
            return F.struct(now.alias("approximation"), F.array(*details).alias("details"), F.array(*sizes).alias("sizes"))
        halves = lambda whole: F.struct(analysed(whole, low).alias("a"), analysed(whole, high).alias("d"))
        return _let(even(now), lambda whole: _let(halves(whole), lambda p: level(p["a"], [*details, p["d"]], [*sizes, F.size(now)])))

    return _let(x, lambda now: level(now, [], []))


def recomposed(parts: Column, wavelet: str, levels: int) -> Column:
    """The array that ``decomposed`` made the parts from."""
    low = low_pass(wavelet)

    def level(now: Column, p: Column, k: int) -> Column:
        if not k:
            return now
        longer = F.slice(synthesised(now, F.element_at(p["details"], k), low), F.lit(1), F.element_at(p["sizes"], k))
        return _let(longer, lambda x: level(x, p, k - 1))

    return _let(parts, lambda p: _let(p["approximation"], lambda x: level(x, p, levels)))


def fused(coarse: Column, fine: Column, wavelet: str, levels: int) -> Column:
    """An array with the coarse course of one series and the details of another; both have the same length."""
    both = F.struct(decomposed(coarse, wavelet, levels).alias("a"), decomposed(fine, wavelet, levels).alias("b"))
    return _let(both, lambda p: recomposed(F.struct(p["a"]["approximation"].alias("approximation"), p["b"]["details"].alias("details"), p["b"]["sizes"].alias("sizes")), wavelet, levels))
