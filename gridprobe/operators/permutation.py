"""A keyed permutation of dense row ids, so that random batches are arithmetic instead of a sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
# A value outside the table is permuted again. A try lands inside with more than one in four, so that this many
# fail for one value in 10^15.
WALKS = 128


def half_bits(n: int) -> int:
    """Bits of each half of the domain, the least power of four that has ``n`` values."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _mixed(seed: int, number: Column, half: Column, mask: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), number.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(mask).cast("long"))


def permuted(position: Column, n: int, seed: int) -> Column:
    """The place of ``position`` in a permutation of 0 .. n - 1 that depends on ``seed`` alone.

    Four rounds swap the halves of the bits and mix one with a hash of the other, which is a permutation of
    the whole domain; values that fall outside the table walk on along their cycle. A NULL stays NULL; a position
    outside the table is an error.
    """
    bits = half_bits(n)
    mask, size = (1 << bits) - 1, 1 << bits

    def once(value: Column) -> Column:
        start = F.struct(F.floor(value / F.lit(size)).cast("long").alias("l"), value.bitwiseAND(F.lit(mask).cast("long")).alias("r"))
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start,
            lambda a, k: F.struct(a["r"].alias("l"), a["l"].bitwiseXOR(_mixed(seed, k, a["r"], mask)).alias("r")),
            lambda a: a["l"] * size + a["r"],
        )

    given = position.cast("long")
    inside = F.when((given < 0) | (given >= n), F.raise_error(F.lit(f"a position outside 0 .. {n - 1}")).cast("long")).otherwise(given)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), once(inside), lambda value, _: F.when(value >= n, once(value)).otherwise(value)
    )
    return F.when(walked >= n, F.raise_error(F.lit("the walk did not end inside the table")).cast("long")).otherwise(walked)


def batch_range(n: int, size: int, step: int) -> tuple[int, int, int]:
    """(epoch, first position, position behind the last) of a step; an epoch is all rows once, its last batch may be short."""
    steps = max(1, -(-n // size))
    epoch, at = divmod(step, steps)
    return epoch, at * size, min((at + 1) * size, n)


def permuted_sql(source: str, n: str, bits: str, seed: int, name: str = "walk") -> str:
    """Common table expressions that end in ``{name}_out(pos, value)`` for ``source``, a query of (pos)."""
    return f"""{name}(pos, k, l, r) AS (
    SELECT pos, 0, CAST(pos >> {bits} AS BIGINT), CAST(pos & ((1 << {bits}) - 1) AS BIGINT) FROM ({source})
    UNION ALL
    SELECT pos, k + 1, r, xor(l, CAST('0x' || substr(md5('{seed}:' || CAST(k % {ROUNDS} AS VARCHAR) || ':' || CAST(r AS VARCHAR)), 1, 8) AS BIGINT) & ((1 << {bits}) - 1))
    FROM {name} WHERE k = 0 OR k % {ROUNDS} <> 0 OR (l << {bits}) + r >= {n}
),
{name}_out AS (SELECT pos, (l << {bits}) + r AS value FROM {name} WHERE k > 0 AND k % {ROUNDS} = 0 AND (l << {bits}) + r < {n})"""
