"""Fade and energy curves, lanes, gains: scalar formulas over a phase from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FADES = ("equal_power", "linear", "exp", "log", "scurve", "hold", "slam")
ARCS = ("build", "steady", "wave", "peak")


def fade(shape: Column, x: Column) -> Column:
    """The incoming gain of a fade at phase x."""
    return (
        F.when(shape == "equal_power", F.sin(x * F.pi() / 2))
        .when(shape == "linear", x)
        .when(shape == "exp", F.pow(x, F.lit(2.5)))
        .when(shape == "log", 1 - F.pow(1 - x, F.lit(2.5)))
        .when(shape == "scurve", x * x * (3 - 2 * x))
        .when(shape == "hold", F.least(F.lit(1.0), 4 * x))
        .when(shape == "slam", F.least(F.lit(1.0), 12 * x))
    )


def arc_target(arc: Column, p: Column) -> Column:
    """The energy an arc asks for at progress p; an unknown arc asks for a flat 0.7."""
    return (
        F.when(arc == "build", 0.2 + 0.8 * p)
        .when(arc == "steady", F.lit(0.7))
        .when(arc == "wave", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 + 0.5 * F.sin(2 * F.pi() * p))))
        .when(arc == "peak", F.when(p < 0.6, 0.3 + p / 0.6 * 0.7).otherwise(1.0 - (p - 0.6) / 0.4 * 0.6))
        .otherwise(F.lit(0.7))
    )


def energy_fit(target: Column, energy: Column) -> Column:
    """1 at the target, 0 half away or more; a half for unknown energy."""
    return F.when(energy.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - 2 * F.abs(target - energy)))


def lane_value(lane: Column, x: Column) -> Column:
    """Linear interpolation over an array of (x, y) structs in order of x, flat beyond its ends."""
    low = F.try_element_at(F.filter(lane, lambda p: p["x"] <= x), F.lit(-1))
    high = F.try_element_at(F.filter(lane, lambda p: p["x"] > x), F.lit(1))
    between = low["y"] + (high["y"] - low["y"]) * (x - low["x"]) / (high["x"] - low["x"])
    return F.when(F.size(F.filter(lane, lambda p: p["x"] <= x)) == 0, F.element_at(lane, 1)["y"]).when(F.size(F.filter(lane, lambda p: p["x"] > x)) == 0, F.element_at(lane, -1)["y"]).otherwise(between)


#: Half the width of a bass swap, the longest hold or lead of a fade, and the middle of an equal-power fade.
SWAP_WIDTH, LONGEST_HOLD, HALF_POWER = 0.12, 0.8, 0.707


def swap_out(x: Column, centre: Column, width: float = SWAP_WIDTH) -> Column:
    """The outgoing bass around a swap: full, then down within the swap; the incoming one is what is left of 1."""
    at = F.greatest(F.lit(width), F.least(F.lit(1.0 - width), centre))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at + width - x) / (2 * width)))


def held_fade(x: Column, hold: Column) -> Column:
    """A fall from 1 to 0 that starts at ``hold``, in two straight parts that meet at half power."""
    h = F.greatest(F.lit(0.0), F.least(F.lit(LONGEST_HOLD), hold))
    part = F.greatest(F.lit(0.0), (x - h) / (1.0 - h))
    return F.when(part < 0.5, 1.0 - (1.0 - HALF_POWER) * 2.0 * part).otherwise(HALF_POWER * 2.0 * (1.0 - F.least(part, F.lit(1.0))))


def led_rise(x: Column, lead: Column) -> Column:
    """A rise from 0 to 1 that starts at ``lead``, through the same half power."""
    h = F.greatest(F.lit(0.0), F.least(F.lit(LONGEST_HOLD), lead))
    part = F.greatest(F.lit(0.0), (x - h) / (1.0 - h))
    return F.when(part < 0.5, HALF_POWER * 2.0 * part).otherwise(HALF_POWER + (1.0 - HALF_POWER) * (2.0 * F.least(part, F.lit(1.0)) - 1.0))


def profile(x: Column, centre: Column, mid_lead: Column, high_lead: Column, mid_hold: Column | None = None, high_hold: Column | None = None) -> dict[str, Column]:
    """The band gains of a crossfade at phase ``x``. A style of the older kind has one delay for both leads and no holds."""
    none = F.lit(0.0)
    out = swap_out(x, centre)
    return {"out_low": out, "out_mid": held_fade(x, none if mid_hold is None else mid_hold), "out_high": held_fade(x, none if high_hold is None else high_hold), "in_low": 1.0 - out, "in_mid": led_rise(x, mid_lead), "in_high": led_rise(x, high_lead)}
