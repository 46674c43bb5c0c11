"""Grids of rules answered from one pass over the rows.

The cut points of all rules divide the rows into cells, one axis for each quantity that the rules look at.
Rows are counted by cell, once; running sums along every axis then give the number of rows in any box of
cells as a signed sum of the box's corners. A rule is a few boxes that don't meet. The work after the pass
depends on the rules only: cells are bounded by their cut points, corners by their number.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelight.functions import metrics as M


@dataclass(frozen=True)
class Axis:
    """`passed` says of a row whether it is at or beyond a cut, as the rule itself would compare it.

    Cuts stand in order: who has passed one must have passed those before it. Null counts as not passed.
    """

    name: str
    cuts: tuple
    passed: Callable[[Column], Column]

    @property
    def col(self) -> str:
        """Its column, which no parameter has."""
        return f"__gl_axis_{self.name}"

    def index(self) -> Column:
        """Number of cuts passed, by bisection."""

        def between(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(self.passed(F.lit(self.cuts[mid])), between(mid + 1, hi)).otherwise(between(lo, mid))

        return between(0, len(self.cuts)).cast("int")

    def place(self, cut: Column) -> Column:
        """Which cut it is, from 1; null stays null."""
        at = F.array_position(F.array(*map(F.lit, self.cuts)), cut)
        return F.when(cut.isNotNull(), F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit(f"no cut of {self.name}: "), cut.cast("string"))))).cast("int")


@dataclass(frozen=True)
class Box:
    """Rows that have passed `low` and not `high` of each named axis; both are columns over the rule's
    parameters, and None or null where a side is open. The box belongs to the rules for which `when` holds."""

    bounds: dict[str, tuple[Column | None, Column | None]] = field(default_factory=dict)
    when: Column | None = None


def flag(name: str, cond: Column) -> Axis:
    """An axis of two cells; see `yes` and `no`."""
    return Axis(name, (1,), lambda c: cond)


def yes(*names: str) -> dict:
    return {n: (F.lit(1), None) for n in names}


def no(*names: str) -> dict:
    return {n: (None, F.lit(1)) for n in names}


def cells(rows: DataFrame, axes: list[Axis], counted: dict[str, Column]) -> DataFrame:
    """Sums of `counted` by cell."""
    return rows.groupBy(*[a.index().alias(a.col) for a in axes]).agg(*[F.sum(c).alias(n) for n, c in counted.items()])


def running(spark: SparkSession, counts: DataFrame, axes: list[Axis], counted: list[str]) -> DataFrame:
    """For every cell the sums over all cells that are not beyond it on any axis."""
    whole = spark.range(1).select()
    for a in axes:
        whole = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(a.cuts)))).alias(a.col))
    out = whole.join(counts, [a.col for a in axes], "left").na.fill(0, counted)
    for a in axes:
        others = [b.col for b in axes if b is not a] or [F.lit(0)]
        upto = Window.partitionBy(*others).orderBy(a.col).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.sum(c).over(upto) for c in counted})
    return out


def _placed(rules: DataFrame, axes: list[Axis], boxes: list[Box]) -> tuple[DataFrame, list[Box]]:
    """`rules` with the place of each bound as a column, and the boxes by these."""
    by_name, places, out = {a.name: a for a in axes}, {}, []
    for box in boxes:
        bounds = {}
        for name, sides in box.bounds.items():
            for side in sides:
                if side is not None and (name, str(side)) not in places:
                    places[name, str(side)] = f"__gl_place_{len(places)}"
                    rules = rules.withColumn(places[name, str(side)], by_name[name].place(side))
            bounds[name] = tuple(None if side is None else F.col(places[name, str(side)]) for side in sides)
        out.append(Box(bounds, box.when))
    return rules, out


def _corners(axes: list[Axis], box: Box, last: bool = False) -> Column:
    """Array of (sign, last, cell) of a box's corners: the last cell inside, and on each axis with a lower side the last one before it."""
    sides = []
    for a in axes:
        low, high = box.bounds.get(a.name, (None, None))
        end = F.coalesce(high - 1, F.lit(len(a.cuts))) if high is not None else F.lit(len(a.cuts))
        sides.append([(1, end)] + ([(-1, F.coalesce(low, F.lit(0)) - 1)] if low is not None else []))
    corners = []
    for pick in itertools.product(*sides):
        sign = reduce(lambda s, p: s * p[0], pick, 1)
        corners.append(F.struct(F.lit(sign).alias("sign"), F.lit(last).alias("last"), *[p[1].cast("int").alias(a.col) for a, p in zip(axes, pick)]))
    return F.array(*corners) if box.when is None else F.when(box.when, F.array(*corners))


def answer(rows: DataFrame, axes: list[Axis], rules: DataFrame, params: list[str], boxes: list[Box], counted: dict[str, Column]) -> DataFrame:
    """(*params, *counted, all_*): what each rule's boxes hold, and the sums over all rows.

    Boxes of a rule mustn't meet. Rules without a box hold nothing; parameters are a rule's key.
    """
    cube = running(rows.sparkSession, cells(rows, axes, counted), axes, list(counted))
    rules, boxes = _placed(rules, axes, boxes)
    each = [*(_corners(axes, b) for b in boxes), _corners(axes, Box(), last=True)]  # the last cell has the sums over all
    corners = rules.select(*params, F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("__gl_c")).select(*params, "__gl_c.*")
    # corners before the first cell, as of open sides, hold nothing
    corners = corners.where(reduce(lambda x, y: x & y, [F.col(a.col) >= 0 for a in axes]))
    got = corners.join(cube, [a.col for a in axes])
    own = [F.coalesce(F.sum(F.when(~F.col("last"), F.col("sign") * F.col(c))), F.lit(0)).alias(c) for c in counted]
    return got.groupBy(*params).agg(*own, *[F.sum(F.when(F.col("last"), F.col(c))).alias(f"all_{c}") for c in counted])


def rule_metrics(rows: DataFrame, axes: list[Axis], rules: DataFrame, params: list[str], boxes: list[Box]) -> DataFrame:
    """(*params, rr, frr, contest) of rules whose boxes hold the rejected rows; `rows` has `present`.

    Without absent rows rr is 1, without present ones frr is 0. Rows of null `present` take no part.
    """
    p = F.col("present")
    out = answer(rows, axes, rules, params, boxes, {"fr": p.cast("long"), "rj": (~p).cast("long")})
    rr, frr = M.rate(F.col("rj"), F.col("all_rj"), 1.0), M.rate(F.col("fr"), F.col("all_fr"), 0.0)
    return out.select(*params, F.round(rr, 9).alias("rr"), F.round(frr, 9).alias("frr"), F.round(M.contest(rr, frr), 9).alias("contest"))
