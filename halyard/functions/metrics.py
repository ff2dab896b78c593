"""Distances as Column builders, by name; new ones are registered the same way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _fold(a: Column, b: Column, f: Metric) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def cos(a: Column, b: Column) -> Column:
    """1 - cosine; null where either vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2sq(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def _bits(a: Column, b: Column, of: Callable[[Column, int], Column]) -> Column:
    parts = [of(a["words"][i].bitwiseXOR(b["words"][i]), i) for i in range(4)]
    return (parts[0] + parts[1] + parts[2] + parts[3]).cast("double")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed codes of the same length."""
    return _bits(a, b, lambda x, _: F.bit_count(x))


def nphd(a: Column, b: Column) -> Column:
    """Share of differing bits in the common prefix of two packed codes; null where that is empty."""
    common = F.least(a["bits"], b["bits"])

    def part(x: Column, i: int) -> Column:
        here = F.least(F.greatest(common - 64 * i, F.lit(0)), F.lit(64))
        # A shift by 64 is a shift by 0, so a word outside the prefix needs a case of its own.
        return F.when(here > 0, F.bit_count(F.call_function("shiftrightunsigned", x, 64 - here))).otherwise(0)

    return F.try_divide(_bits(a, b, part), common)


METRICS: dict[str, Metric] = {"cos": cos, "l2sq": l2sq, "hamming": hamming, "nphd": nphd}


#: For distances of your own: the function of arrays that computes them in blocks.
ARRAYS: dict[Metric, Callable] = {}


def register(name: str, metric: Metric, arrays: Callable | None = None) -> None:
    """Make a distance of your own known by name; `arrays` of queries (n x d) and items (m x d) gives all n x m distances at once."""
    METRICS[name.lower()] = metric
    if arrays is not None:
        ARRAYS[metric] = arrays


def metric(which: str | Metric) -> Metric:
    if callable(which):
        return which
    try:
        return METRICS[which.lower()]
    except KeyError:
        raise ValueError(f"unknown metric {which!r}; known: {', '.join(sorted(METRICS))}") from None
