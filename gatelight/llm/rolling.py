"""Exact rolling median and MAD over a span of time, by a sliding sparse two-level histogram.

A value is an integer; its high digit (value // DIGIT) has a coarse count, its low digits have fine counts
under it, and only digits that occur are kept. As the window slides, entering values are added and leaving
ones taken off. The median is walked to by the coarse counts, then within one coarse digit by the fine
ones. For the median absolute deviation the walk goes outward from the median, one more coarse digit at
either side at a time, and only the digits at the rim are looked into.

A series is cut into chunks of time that overlap by the window (the halo), so chunks need nothing of each
other. Chunks with up to DENSE rows go as they are. In denser ones equal values at one time are merged,
the changes (a value enters or leaves) are counted by small units of time, and runs of units with about
DENSE changes become groups of their own; the histogram that such a run begins with is summed up by value
before it is sent. So no group grows with the table: where rows get denser, there are more groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelight.llm import common as C

#: Size of the low digit.
DIGIT = 1024
#: Rows of a chunk beyond which it is split.
DENSE = 1 << 16
#: Length of a chunk, in windows.
CHUNK_WINDOWS = 24
#: Units of time in a window, by which a dense chunk is split.
UNITS = 1 << 14
#: Times evaluated at once, and cells of their fine counts.
BLOCK, CELLS = 256, 1 << 21
OWN, FOUND = ["id", "series", "cents"], ["n", "median2", "mad4"]


def _counts(rows: int, at: np.ndarray, of: np.ndarray, change: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Counts at each of the evaluated times, of each of `width` bins; `first` is what the block begins with."""
    out = np.bincount(at * width + of, weights=change, minlength=rows * width).reshape(rows, width).astype(np.int64)
    out[0] += first.astype(np.int64)
    return np.cumsum(out, axis=0, out=out)


def _running(counts: np.ndarray) -> np.ndarray:
    """Running sums along the bins, from 0."""
    out = np.zeros((len(counts), counts.shape[1] + 1), np.int64)
    np.cumsum(counts, axis=1, out=out[:, 1:])
    return out


class Histogram:
    """The two levels over the times of one block: coarse counts whole, fine counts for the digits asked for."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, at: np.ndarray, cents: np.ndarray, change: np.ndarray, rows: int):
        self.values = np.unique(np.concatenate((values, cents)))
        self.rows, self.at, self.change = rows, at, change
        self.place = np.searchsorted(self.values, cents)
        self.first = np.zeros(len(self.values))
        self.first[np.searchsorted(self.values, values)] = counts
        self.digits, self.begin, self.digit = np.unique(self.values // DIGIT, return_index=True, return_inverse=True)
        first = np.bincount(self.digit, weights=self.first, minlength=len(self.digits))
        self.coarse = _running(_counts(rows, at, self.digit[self.place], change, first, len(self.digits)))

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Values and counts after the block."""
        counts = self.first + np.bincount(self.place, weights=self.change, minlength=len(self.values))
        return self.values[counts > 0], counts[counts > 0]

    def fine(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the values under the wanted digits, running sums of their counts)."""
        cols = np.flatnonzero(wanted[self.digit])
        col = np.full(len(self.values), -1)
        col[cols] = np.arange(len(cols))
        own = col[self.place]
        some = own >= 0
        return cols, _running(_counts(self.rows, self.at[some], own[some], self.change[some], self.first[cols], len(cols)))

    def value_at(self, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of a rank (from 0) at each row: the coarse digit first, then the fine one in it."""
        digit = np.sum(self.coarse[row, 1:] <= rank[:, None], axis=1)
        wanted = np.zeros(len(self.digits), bool)
        wanted[digit] = True
        cols, sums = self.fine(wanted)
        lo = np.searchsorted(cols, self.begin[digit])
        hi = np.searchsorted(cols, np.append(self.begin, len(self.values))[digit + 1]) - 1
        goal = sums[row, lo] + rank - self.coarse[row, digit]
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            enough = sums[row, mid + 1] > goal
            hi, lo = np.where(open_ & enough, mid, hi), np.where(open_ & ~enough, mid + 1, lo)
        return self.values[cols[lo]]

    def deviation_at(self, row: np.ndarray, rank: np.ndarray, middle2: np.ndarray) -> np.ndarray:
        """|2 * value - middle2| of a rank, at each row."""
        digits, end = self.digits, len(self.digits)
        middle = middle2 // (2 * DIGIT)
        lo, hi = np.searchsorted(digits, middle), np.searchsorted(digits, middle, side="right")
        reach = np.zeros_like(middle)
        far = np.iinfo(np.int64).max
        while True:  # outward, to the next digit on whichever side is nearer
            left = np.flatnonzero(self.coarse[row, hi] - self.coarse[row, lo] <= rank)
            if not len(left):
                break
            below = np.where(lo[left] > 0, middle[left] - digits[lo[left] - 1], far)
            above = np.where(hi[left] < end, digits[np.minimum(hi[left], end - 1)] - middle[left], far)
            reach[left] = np.minimum(below, above)
            lo[left] -= below == reach[left]
            hi[left] += above == reach[left]
        # digits nearer than reach - 1 hold smaller deviations only, digits beyond reach + 1 larger ones only
        inner = reach >= 2
        in_lo = np.searchsorted(digits, middle - np.where(inner, reach - 2, 0))
        in_hi = np.where(inner, np.searchsorted(digits, middle + reach - 2, side="right"), in_lo)
        out_lo, out_hi = np.searchsorted(digits, middle - reach - 1), np.searchsorted(digits, middle + reach + 1, side="right")
        marks = np.zeros(end + 1, np.int64)
        for places, step in ((out_lo, 1), (in_lo, -1), (in_hi, 1), (out_hi, -1)):
            np.add.at(marks, places, step)
        cols, sums = self.fine(np.cumsum(marks)[:end] > 0)
        begin = np.append(self.begin, len(self.values))
        c_lo, c_hi = np.searchsorted(cols, begin[in_lo]), np.searchsorted(cols, begin[in_hi])
        base = self.coarse[row, in_hi] - self.coarse[row, in_lo] - (sums[row, c_hi] - sums[row, c_lo])
        values = self.values[cols]
        least, most = np.where(reach > 0, (reach - 1) * 2 * DIGIT, -1), (reach + 1) * 2 * DIGIT
        while (open_ := most - least > 1).any():
            mid = (least + most) // 2
            a = np.searchsorted(values, -((mid - middle2) // 2))  # rounded up
            b = np.searchsorted(values, (middle2 + mid) // 2, side="right")
            enough = base + sums[row, np.maximum(a, b)] - sums[row, a] > rank
            most, least = np.where(open_ & enough, mid, most), np.where(open_ & ~enough, mid, least)
        return most


def _doubled(found: np.ndarray, even: np.ndarray, n: int) -> np.ndarray:
    """Upper middles plus lower ones, which are the upper ones again where the number is odd."""
    out = 2 * found[:n]
    out[even] += found[n:] - found[even]
    return out


def sweep(at: np.ndarray, cents: np.ndarray, change: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, doubled median, doubled median of |2 * cents - doubled median|) at each of the sorted times `ask`.

    `change` copies of `cents` enter (or leave, where negative) at the times `at`, which are sorted; a time
    sees all changes up to it. Where n is 0 the medians are 0.
    """
    n, median2, mad4 = (np.zeros(len(ask), np.int64) for _ in range(3))
    values, counts = np.zeros(0, np.int64), np.zeros(0)
    done = begin = 0
    while begin < len(ask):
        end = min(len(ask), begin + max(8, min(BLOCK, CELLS // (len(values) + BLOCK))))
        upto = int(np.searchsorted(at, ask[end - 1], side="right"))
        own = slice(done, upto)
        held = Histogram(values, counts, np.searchsorted(ask[begin:end], at[own]), cents[own], change[own], end - begin)
        total = held.coarse[:, -1]
        n[begin:end] = total
        row = np.flatnonzero(total)
        if len(row):
            even = np.flatnonzero(total[row] % 2 == 0)  # these have two middle places
            both, ranks = np.concatenate((row, row[even])), np.concatenate((total[row] // 2, total[row[even]] // 2 - 1))
            middle2 = _doubled(held.value_at(both, ranks), even, len(row))
            median2[begin + row] = middle2
            mad4[begin + row] = _doubled(held.deviation_at(both, ranks, np.concatenate((middle2, middle2[even]))), even, len(row))
        values, counts = held.rest()
        done, begin = upto, end
    return n, median2, mad4


def _numpy(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _evaluate(t: pa.Table, new: np.ndarray, width: int, length: int) -> pa.RecordBatch:
    """Whole chunks one after the other, as rows (at < 0 is the halo); `new` marks where a chunk begins.

    A value stands from its time until `width` later. Chunks get times of their own, so far apart that one is
    empty again before the next begins, and are swept at once.
    """
    at = _numpy(t, "at") + np.cumsum(new) * (length + 3 * width)
    own = t.filter(pa.array(_numpy(t, "at") >= 0))
    ask, place = np.unique(at[_numpy(t, "at") >= 0], return_inverse=True)
    some = t.column("cents").is_valid().to_numpy()
    at, cents = at[some], _numpy(t.filter(pa.array(some)), "cents")
    both, ones = np.concatenate((at, at + width)), np.ones(len(at))
    order = np.argsort(both, kind="stable")
    found = sweep(both[order], np.concatenate((cents, cents))[order], np.concatenate((ones, -ones))[order], ask)
    out = pa.table([own.column(k) for k in OWN] + [pa.array(x[place]) for x in found], names=[*OWN, *FOUND])
    return out.combine_chunks().to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], out.schema)


def _chunks(width: int, length: int):
    """For rows sorted by series and chunk: a chunk is held until its last row has come."""

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            new = _beginnings(held)
            cut = int(np.flatnonzero(new)[-1]) if len(new) else 0
            if cut:
                yield _evaluate(held.slice(0, cut), new[:cut], width, length)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _evaluate(held, _beginnings(held), width, length)

    return C.streaming(run)


def _beginnings(t: pa.Table) -> np.ndarray:
    """Where series or chunk differ from the row before."""
    series = t.column("series").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    chunk = _numpy(t, "chunk")
    return np.concatenate((np.ones(min(1, len(chunk)), bool), (series[1:] != series[:-1]) | (chunk[1:] != chunk[:-1])))


def _run(t: pa.Table) -> pa.Table:
    """Changes of a run of units in a dense chunk: one row for each time asked for."""
    t = t.sort_by("at")
    asks = t.filter(t.column("asked"))
    _, first = np.unique(_numpy(asks, "at"), return_index=True)
    asks = asks.take(pa.array(first))
    some = t.filter(pa.compute.not_equal(t.column("change"), 0))
    n, median2, mad4 = sweep(_numpy(some, "at"), _numpy(some, "cents"), _numpy(some, "change").astype(float), _numpy(asks, "at"))
    return pa.table([asks.column("series"), asks.column("chunk"), asks.column("at"), pa.array(n), pa.array(median2), pa.array(mad4)], names=["series", "chunk", "at", "n", "median2", "mad4"])


def micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970, with or without a zone, whatever the session's zone is."""
    if df.schema[col].dataType.typeName() == "timestamp":
        return F.unix_micros(F.col(col))
    since = F.col(col) - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def cents_of(value: Column) -> Column:
    """Hundredths, halves upwards; none for null and NaN, or from 10**15 on, as deviations must fit a long."""
    return F.when(F.abs(value) < 1e15, F.floor(100 * value + F.lit(0.5)))


def _dense(rows: DataFrame, dense: DataFrame, width: int, limit: int) -> DataFrame:
    """What `_chunk` gives, for the rows of chunks that are split into runs."""
    key, unit = ["series", "chunk"], max(1, width // UNITS)
    long = F.lit(0).cast("long")
    rows = rows.join(dense.select(*[F.col(k).alias(f"d_{k}") for k in key]), F.col("series").eqNullSafe(F.col("d_series")) & (F.col("chunk") == F.col("d_chunk"))).drop("d_series", "d_chunk")
    merged = rows.groupBy(*key, "at", "cents").agg(F.count("*").alias("c"))
    c = F.when(F.col("cents").isNull(), long).otherwise(F.col("c"))
    # halo values are there from the chunk's beginning on, before its first unit
    enter = F.struct(F.col("at"), F.coalesce("cents", long).alias("cents"), c.alias("change"), (F.col("at") >= 0).alias("asked"))
    leave = F.struct((F.col("at") + width).alias("at"), F.coalesce("cents", long).alias("cents"), (-c).alias("change"), F.lit(False).alias("asked"))
    changes = merged.select(*key, F.explode(F.array(enter, leave)).alias("x")).select(*key, "x.*")
    changes = changes.withColumn("unit", F.greatest(F.lit(-1), F.floor(F.col("at") / unit)))
    counts = changes.groupBy(*key, "unit").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*key).orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    within = F.sum(F.when(F.col("unit") >= 0, F.col("c"))).over(upto)
    runs = counts.withColumn("run", F.when(F.col("unit") < 0, -1).otherwise(F.floor(F.coalesce(within, long) / limit))).drop("c")
    runs = runs.withColumn("last", F.max("run").over(Window.partitionBy(*key)))
    runs = runs.select(*[F.col(k).alias(f"r_{k}") for k in [*key, "unit"]], "run", "last")
    on = F.col("series").eqNullSafe(F.col("r_series")) & (F.col("chunk") == F.col("r_chunk")) & (F.col("unit") == F.col("r_unit"))
    changes = changes.join(runs, on).select(*key, "run", "last", "at", "cents", "change", "asked")
    # what earlier runs leave behind, value by value; a run's own sums go on to all later ones
    net = changes.groupBy(*key, "run", "last", "cents").agg(F.sum("change").alias("change")).where("change <> 0 AND run < last")
    net = net.select(*key, F.explode(F.sequence(F.col("run") + 1, F.col("last"))).alias("run"), "cents", "change")
    net = net.groupBy(*key, "run", "cents").agg(F.sum("change").alias("change")).where("change <> 0")
    before = net.select(*key, "run", F.lit(-(1 << 62)).alias("at"), "cents", "change", F.lit(False).alias("asked"))
    both = changes.where("run >= 0").drop("last").unionByName(before)
    found = both.groupBy(*key, "run").applyInArrow(C.grouped(_run), "series string, chunk long, at long, n long, median2 long, mad4 long")
    found = found.select(*[F.col(k).alias(f"f_{k}") for k in [*key, "at"]], "n", "median2", "mad4")
    own = rows.where("at >= 0")
    on = F.col("series").eqNullSafe(F.col("f_series")) & (F.col("chunk") == F.col("f_chunk")) & (F.col("at") == F.col("f_at"))
    return own.join(found, on).select("id", "series", "cents", "n", "median2", "mad4")


def rolling_mad(rows: DataFrame, width_us: int = 900_000_000, id_col: str = "click_id", time_col: str = "ts", series_col: str = "kind", value_col: str = "value",
                dense: int = DENSE, chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """(id, series, cents, n, median2, mad4, far): for each id the window of its series that ends with its time.

    The window holds the cents (see `cents_of`) of the series' rows later than `width_us` microseconds
    before the row's time and up to it, all rows at its time included. n counts them, median2 is the sum of
    the two middle ones (twice the only middle one), mad4 the same of |2 * cents - median2|, and far says
    whether the row's own cents are more than mad4 / 2 off the median. With n = 0 the last three are null, and
    so is far of a row without cents.

    Rows without a time are dropped first, then an id counts once: the least of its rows by time, series and
    cents, nulls first. A null id is an id, a null series a series, texts may be of any length. An empty
    table gives no rows; other columns, whatever their names, aren't read.
    """
    width, length = width_us, width_us * chunk_windows
    base = rows.select(F.col(id_col).alias("id"), micros(rows, time_col).alias("t"), F.col(series_col).cast("string").alias("series"), cents_of(F.col(value_col).cast("double")).alias("cents")).where("t IS NOT NULL")
    one = base.groupBy("id").agg(F.min(F.struct("t", "series", "cents")).alias("x")).select("id", "x.*")
    chunk, at = F.floor(F.col("t") / length), F.pmod("t", F.lit(length))

    def haloed(df: DataFrame, *cols: str) -> DataFrame:
        """Each row in its chunk, and before the beginning of the next where it still counts there."""
        here = F.struct(chunk.alias("chunk"), at.alias("at"))
        next_ = F.struct((chunk + 1).alias("chunk"), (at - length).alias("at"))
        places = F.when(at > length - width, F.array(here, next_)).otherwise(F.array(here))
        return df.select(*cols, F.explode(places).alias("p")).select(*cols, "p.chunk", "p.at")

    counts = haloed(base, "series").groupBy("series", "chunk").agg(F.count("*").alias("c"))
    # behind an exchange, so that its size is known before the join is planned: mostly it is empty
    split = counts.where(F.col("c") > dense).select(F.col("series").alias("s_series"), F.col("chunk").alias("s_chunk")).repartition("s_series", "s_chunk")
    placed = haloed(one, "id", "series", "cents")
    thin = placed.join(split, F.col("series").eqNullSafe(F.col("s_series")) & (F.col("chunk") == F.col("s_chunk")), "left_anti")
    schema = f"id {one.schema['id'].dataType.simpleString()}, series string, cents long, n long, median2 long, mad4 long"
    out = thin.repartition("series", "chunk").sortWithinPartitions("series", "chunk").mapInArrow(_chunks(width, length), schema)
    thick = _dense(placed, split.select(F.col("s_series").alias("series"), F.col("s_chunk").alias("chunk")), width, dense)
    out = out.unionByName(thick)
    there = F.col("n") > 0
    far = F.when(there & F.col("cents").isNotNull(), 2 * F.abs(2 * F.col("cents") - F.col("median2")) > 2 * F.col("mad4"))
    return out.select("id", "series", "cents", "n", F.when(there, F.col("median2")).alias("median2"), F.when(there, F.col("mad4")).alias("mad4"), far.alias("far"))


def op11_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`rolling_mad` over `clicks`: 15 minutes of each kind."""
    found = rolling_mad(C.table(spark, sf_dir, "clicks"))
    return found.select(F.col("id").alias("click_id"), F.col("series").alias("kind"), "n", "median2", "mad4", "far")


OP11_SQL = """
WITH once AS (
  SELECT click_id, min(struct_pack(t := epoch_us(ts), k := kind,
    c := CASE WHEN abs(value) < 1e15 THEN CAST(floor(100 * value + 0.5) AS BIGINT) END)) AS x
  FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
flat AS (SELECT click_id, x.t AS t, x.k AS kind, x.c AS c FROM once),
seen AS (
  SELECT click_id, kind, c, list(c) OVER (
    PARTITION BY kind ORDER BY t RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) AS w FROM flat),
sorted AS (SELECT *, list_sort([v FOR v IN w IF v IS NOT NULL]) AS l FROM seen),
middle AS (SELECT *, len(l) AS n, l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] AS median2 FROM sorted),
off AS (SELECT *, list_sort([abs(2 * v - median2) FOR v IN l]) AS d FROM middle),
done AS (SELECT *, d[(n + 1) // 2] + d[n // 2 + 1] AS mad4 FROM off)
SELECT click_id, kind, n, CASE WHEN n > 0 THEN median2 END AS median2, CASE WHEN n > 0 THEN mad4 END AS mad4,
  CASE WHEN n > 0 THEN 2 * abs(2 * c - median2) > 2 * mad4 END AS far
FROM done
"""
