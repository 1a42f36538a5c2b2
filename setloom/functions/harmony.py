"""Keys and tempos as Columns: wheel codes, compatibility, transposition, stretch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cost of each semitone of a key shift, and the largest shift.
SHIFT_PENALTY = 0.03
MAX_SHIFT = 3
STRETCH_BUDGET = 0.08


def key_number(root: Column, mode: Column) -> Column:
    """The wheel number 1-12 of a root 0-11; mode B is major, A minor."""
    return F.pmod(7 * root + F.when(mode == "B", 7).otherwise(4), F.lit(12)) + 1


def key_root(number: Column, mode: Column) -> Column:
    """The inverse of ``key_number``: 7 is its own inverse modulo 12."""
    return F.pmod(7 * (number - 1 - F.when(mode == "B", 7).otherwise(4)), F.lit(12))


def transpose(number: Column, mode: Column, semitones: Column) -> Column:
    """The wheel number after a shift; the mode stays."""
    return key_number(F.pmod(key_root(number, mode) + semitones, F.lit(12)), mode)


def wheel_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 12 - d)


def key_compatibility(na: Column, ma: Column, nb: Column, mb: Column) -> Column:
    """How well two keys go together, 0 to 1; null if a part is."""
    d, same = wheel_distance(na, nb), ma == mb
    return (
        F.when(same & (d == 0), 1.0)
        .when(~same & (d == 0), 0.9)
        .when(same & (d == 1), 0.8)
        .when(same & (d == 2), 0.6)
        .when(~same & (d == 1), 0.5)
        .when(same & (d == 3), 0.3)
        .when(d.isNotNull() & same.isNotNull(), 0.0)
    )


def best_shift(na: Column, ma: Column, nb: Column, mb: Column) -> Column:
    """(score, n) of the shift of b, within three semitones, that helps most; of equals the smallest, then the downward one.

    Null where no shift is better than none.
    """
    base = key_compatibility(na, ma, nb, mb)
    tried = F.array(*[F.struct(key_compatibility(na, ma, transpose(nb, mb, F.lit(n)), mb).alias("score"), F.lit(-abs(n)).alias("near"), F.lit(-n).alias("low"), F.lit(n).cast("long").alias("n")) for n in range(-MAX_SHIFT, MAX_SHIFT + 1) if n])
    best = F.array_max(tried)
    return F.when(best["score"] > base, F.struct(best["score"].alias("score"), best["n"].alias("n")))


def tempo_compatibility(a: Column, b: Column) -> Column:
    """Of tempo b to tempo a, at equal, double or half time; not symmetric."""

    def at(ratio: Column) -> Column:
        off = F.abs(ratio - 1.0)
        return F.when(off <= 0.06, 1.0 - off / 0.06 * 0.2).when(off <= 0.12, 0.8 - (off - 0.06) / 0.06 * 0.5).otherwise(0.0)

    return F.when((a > 0) & (b > 0), F.greatest(at(b / a), at(2.0 * b / a), at(b / (2.0 * a)))).otherwise(0.0)


def stretch_offset(a: Column, b: Column) -> Column:
    """How far b has to be stretched to meet a, at equal, half or double time."""
    return F.least(F.abs(a / b - 1.0), F.abs(a / (2.0 * b) - 1.0), F.abs(2.0 * a / b - 1.0))


def beatmatchable(a: Column, b: Column, budget: float = STRETCH_BUDGET) -> Column:
    return F.coalesce((a > 0) & (b > 0) & (stretch_offset(a, b) <= budget), F.lit(False))


def fold_tempo(bpm: Column, low: float = 90.0) -> Column:
    """Doubled or halved into [low, 2 * low); 0 for tempos that are not positive."""
    return F.when(bpm > 0, bpm * F.pow(F.lit(2.0), -F.floor(F.log2(bpm / low)))).otherwise(0.0)
