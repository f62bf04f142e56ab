"""Exact positions in a total order, without sorting everything in one task.

Two tools:

* ``keys_at_ranks`` finds the keys at a few given ranks by refining a histogram. Each round is one
  aggregation whose result has at most ``BUCKETS`` rows, and the filter of the next round reaches
  the scan. Rows never move, so wide columns are never shuffled.
* ``with_dense_index`` numbers every row 0..n-1 with one range shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridprobe.session import pin

BUCKETS = 4096
DIRECT_ROWS = 1_000_000
# monotonically_increasing_id puts the partition number above bit 33.
PARTITION_BITS = 33


@dataclass(frozen=True)
class _Stretch:
    """Rows that lie together in the order, with the wanted ranks counted from their start.

    ``low`` and ``high`` bound the key. Once the key is a single value they bound the tie instead.
    """

    n: int
    low: float
    high: float
    wanted: dict[int, int]
    key: float | None = None

    def holds(self, key: Column, tie: Column) -> Column:
        if self.key is None:
            return key.between(F.lit(self.low), F.lit(self.high))
        return (key == F.lit(self.key)) & tie.between(F.lit(self.low), F.lit(self.high))

    def bucket(self, key: Column, tie: Column) -> Column:
        value = key if self.key is None else tie
        if isinstance(self.low, int) and self.high - self.low < 2**62:
            # Exact for integers beyond the precision of a double.
            step = (self.high - self.low) // BUCKETS + 1
            return F.call_function("div", value.cast("bigint") - F.lit(self.low), F.lit(step))
        width = max(float(self.high) - float(self.low), 5e-324)
        share = (value.cast("double") - float(self.low)) / width
        return F.greatest(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0))

    def parts(self, histogram: list[Row]) -> list[_Stretch]:
        """The buckets that hold wanted ranks, from this stretch's histogram in order."""
        found, start = [], 0
        for row in histogram:
            inside = {r: at - start for r, at in self.wanted.items() if start <= at < start + row["n"]}
            if inside:
                found.append(_Stretch(row["n"], row["low"], row["high"], inside, self.key))
            start += row["n"]
        return found


def keys_at_ranks(
    df: DataFrame, key: str, tie: str, ranks: list[int] | Callable[[int], list[int]],
    bounds: tuple[int, int] | None = None, computed: bool = False,
) -> tuple[int, dict[int, tuple]]:
    """The row count, and the (key, tie) pair at each 0-based rank of the order by (key, tie).

    ``key`` and ``tie`` are numeric and ``tie`` is unique. Rows without a key have no rank and do not
    count. Ranks may be computed from the count; those at or beyond it have no entry.

    ``bounds`` are for a computed key that is never NULL and whose range is known, such as a hash. They
    save the pass that looks for the range. ``computed`` says of a key without bounds that it is an expression
    which should be evaluated once per row and pass, and is never NULL.
    """
    if isinstance(df.schema[key].dataType, (T.DoubleType, T.FloatType)):
        known = df.select(key, tie).filter(F.col(key).isNotNull())
        coded = known.select(_sortable(F.col(key).cast("double")).alias(key), tie)
        n, found = keys_at_ranks(coded, key, tie, ranks, computed=True)
        return n, {rank: (_unsorted(k), t) for rank, (k, t) in found.items()}
    k, t = F.col(key), F.col(tie)
    scope = df.select(key, tie)
    if not (computed or bounds):
        scope = scope.filter(k.isNotNull())
    computed = computed or bounds is not None
    if bounds is None:
        n, low, high = scope.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
        wanted = ranks(n) if callable(ranks) else ranks
        open_ = [_Stretch(n, low, high, {r: r for r in wanted if r < n})]
    else:
        histogram = _counted(scope.withColumn("_bucket", _Stretch(0, *bounds, {}).bucket(k, t)), k, "_bucket")
        n = sum(row["n"] for row in histogram)
        wanted = ranks(n) if callable(ranks) else ranks
        open_ = _Stretch(n, *bounds, {r: r for r in wanted if r < n}).parts(histogram)
    found: dict[int, tuple] = {}
    # A job per round for the stretches that are still long, and one for those that are short.
    while open_ := [s for s in open_ if s.wanted]:
        short = [s for s in open_ if s.n <= DIRECT_ROWS]
        if short:
            found.update(_sorted_keys(scope, key, tie, short, computed))
        long_ = [_by_tie(scope, s, key, tie) if s.key is None and s.low == s.high else s
                 for s in open_ if s.n > DIRECT_ROWS]
        open_ = []
        for alike in ([s for s in long_ if s.key is None], [s for s in long_ if s.key is not None]):
            if alike:
                open_ += [part for s, h in zip(alike, _histograms(scope, k, t, alike, computed)) for part in s.parts(h)]
    return n, found


_FRACTION = 1 << 52


def _sortable(x: Column) -> Column:
    """An integer in the order of the numbers: exponent and fraction of a double as one number, with its sign.

    Histograms over it split any distribution in a few rounds, whatever lies between the largest and the least.
    Infinity comes after all finite numbers, and NaN last.
    """
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e)
    # The logarithm may be off by one next to a power of two.
    exponent = F.when(power(guess) > size, guess - 1).when(size / power(guess) >= 2, guess + 1).otherwise(guess)
    normal = (exponent + 1023) * _FRACTION + ((size / power(exponent) - 1) * float(_FRACTION)).cast("bigint")
    small = (size / 5e-324).cast("bigint")
    code = F.when(size < 2.0**-1022, small).when(size == float("inf"), F.lit(2047 * _FRACTION)).otherwise(normal)
    return F.when(F.isnan(x), F.lit(2047 * _FRACTION + 1)).otherwise(F.when(x < 0, -code).otherwise(code)).cast("bigint")


def _unsorted(code: int) -> float:
    """The number behind a sortable integer."""
    exponent, fraction = divmod(abs(code), _FRACTION)
    if exponent == 2047:
        size = math.nan if fraction else math.inf
    elif exponent == 0:
        size = math.ldexp(fraction, -1074)
    else:
        size = math.ldexp(_FRACTION + fraction, exponent - 1075)
    return -size if code < 0 else size


def _by_tie(scope: DataFrame, stretch: _Stretch, key: str, tie: str) -> _Stretch:
    """A stretch whose rows all share one key goes on by tie."""
    low, high = scope.filter(F.col(key) == F.lit(stretch.low)).agg(F.min(tie), F.max(tie)).first()
    return _Stretch(stretch.n, low, high, stretch.wanted, stretch.low)


def _choose(stretches: list[_Stretch], k: Column, t: Column, what: Callable[[int], Column]) -> Column:
    """``what(i)`` for rows of stretch i, NULL for all others."""
    chosen = F.when(stretches[0].holds(k, t), what(0))
    for i, stretch in enumerate(stretches[1:], 1):
        chosen = chosen.when(stretch.holds(k, t), what(i))
    return chosen


def _within(scope: DataFrame, k: Column, t: Column, stretches: list[_Stretch], computed: bool) -> DataFrame:
    """Rows of the stretches, numbered by stretch."""
    held = lambda a, b: reduce(lambda x, y: x | y, [s.holds(a, b) for s in stretches])
    if computed:
        # The filter is pushed below the column it tests and would compute the key once per comparison.
        # Bound to a lambda variable it is computed once.
        pair = F.struct(k.alias("k"), t.alias("t"))
        rows = scope.filter(F.exists(F.array(pair), lambda p: held(p["k"], p["t"])))
    else:
        rows = scope.filter(held(k, t))
    return rows.withColumn("_stretch", _choose(stretches, k, t, lambda i: F.lit(i)))


def _counted(rows: DataFrame, value: Column, *groups: str) -> list[Row]:
    counted = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    return counted.orderBy(*groups).collect()


def _histograms(scope, k: Column, t: Column, stretches: list[_Stretch], computed: bool) -> list[list[Row]]:
    """At most ``BUCKETS`` counted buckets per stretch, in order; all stretches go by key or all by tie."""
    bucket = _choose(stretches, k, t, lambda i: stretches[i].bucket(k, t))
    inside = _within(scope, k, t, stretches, computed).withColumn("_bucket", bucket)
    rows = _counted(inside, k if stretches[0].key is None else t, "_stretch", "_bucket")
    return [[r for r in rows if r["_stretch"] == i] for i in range(len(stretches))]


def _sorted_keys(scope, key: str, tie: str, stretches: list[_Stretch], computed: bool) -> dict[int, tuple]:
    """Wanted keys of stretches that were counted to be short enough to sort in one task each."""
    k, t = F.col(key), F.col(tie)
    position = F.row_number().over(Window.partitionBy("_stretch").orderBy(key, tie)) - 1
    places = [F.struct(F.lit(i), F.lit(at)) for i, s in enumerate(stretches) for at in set(s.wanted.values())]
    hits = (
        _within(scope, k, t, stretches, computed)
        .withColumn("_at", position)
        .filter(F.struct("_stretch", "_at").isin(*places))
        .collect()
    )
    keys = {(r["_stretch"], r["_at"]): (r[key], r[tie]) for r in hits}
    return {rank: keys[i, at] for i, s in enumerate(stretches) for rank, at in s.wanted.items()}


def before(key: Column, tie: Column, cut: tuple | None) -> Column:
    """True for rows that sort before the cut; without a cut, for every row."""
    if cut is None:
        return F.lit(True)
    return (key < F.lit(cut[0])) | ((key == F.lit(cut[0])) & (tie < F.lit(cut[1])))


def with_dense_index(df: DataFrame, *keys: str, name: str = "row_id") -> DataFrame:
    """Number the rows 0..n-1 in the order of ``keys``, which together are unique.

    A range shuffle orders the partitions, and a row's place inside its sorted partition comes for
    free. The result is pinned before it is read twice, because a range shuffle samples its bounds
    and may cut elsewhere when it runs again.
    """
    placed = pin(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", PARTITION_BITS))
    )
    # One row per partition, so neither the window nor the broadcast grows with the data.
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("_start")
    )
    inside = F.col("_at") - F.shiftleft(F.col("_part"), PARTITION_BITS)
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + inside)
        .drop("_part", "_at", "_start")
    )
