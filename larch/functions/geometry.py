"""Grid arithmetic on columns: slots, cell rectangles, clamped crops and size rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larch.functions.basics import clamp, col, round_even

#: Pixels of a slot at the usual scale, and the bounds of a slot and of a pitch.
SLOT, SLOT_LOW, SLOT_HIGH = 63.0, 16, 64
PITCH_LOW, PITCH_HIGH = 24, 200
SQUARENESS, STRENGTH = 0.10, 1.6
#: Label cutoffs, the longest short label, and the least occupied share of a footprint.
AGREE, OVER, NEAR_EXACT, SHORT_LABEL, OCCUPIED = 78.0, 84.0, 99.0, 3, 0.72


def slot_size(pixels: Column | str) -> Column:
    return F.greatest(F.lit(1), round_even((col(pixels) - 1) / SLOT).cast("int"))


def slot_pixels(pitch: Column | str) -> Column:
    return clamp(round_even(col(pitch)).cast("int"), F.lit(SLOT_LOW), F.lit(SLOT_HIGH))


def cell_rect(grid: Column, c: Column, r: Column, w: Column, h: Column, pad: int = 0) -> Column:
    """struct(x0, y0, x1, y1) of cells; every edge is rounded by itself."""
    edge = lambda origin, size, k: round_even(origin + k * size).cast("int")
    return F.struct(
        (edge(grid["origin_x"], grid["cell_w"], c) - pad).alias("x0"), (edge(grid["origin_y"], grid["cell_h"], r) - pad).alias("y0"),
        (edge(grid["origin_x"], grid["cell_w"], c + w) + pad).alias("x1"), (edge(grid["origin_y"], grid["cell_h"], r + h) + pad).alias("y1"),
    )


def crop(region: Column, height: Column, width: Column) -> Column:
    """A region clamped to a frame; null if nothing is left."""
    x0, x1 = (clamp(region[k], F.lit(0), width) for k in ("x0", "x1"))
    y0, y1 = (clamp(region[k], F.lit(0), height) for k in ("y0", "y1"))
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def valid_grid(grid: Column, low: float = PITCH_LOW, high: float = PITCH_HIGH) -> Column:
    """Pitch in range (by one pixel more), cells nearly square, and decisive if a strength is known."""
    w, h = grid["cell_w"], grid["cell_h"]
    fits = (w >= low - 1) & (w <= high + 1) & (h >= low - 1) & (h <= high + 1)
    square = F.abs(w - h) <= SQUARENESS * F.greatest(w, h)
    return F.coalesce(fits & square & (grid["strength"].isNull() | (grid["strength"] >= STRENGTH)), F.lit(False))


def least_score(w: Column | str, h: Column | str) -> Column:
    """Least match score of a footprint: small ones may score lower."""
    area = col(w) * col(h)
    return F.when(area == 1, 0.35).when(area <= 2, 0.40).otherwise(0.50)


def label_mode(pitch: Column | str) -> Column:
    """How far labels are trusted at a pitch: full, agree or off."""
    return F.when(col(pitch) >= 40, "full").when(col(pitch) >= 30, "agree").otherwise("off")


def label_accepted(agrees: Column, score: Column, text: Column, contained: Column, exact: Column, mode: Column) -> Column:
    """Whether a label's item may stand: agreeing ones easily, overriding ones at full legibility only, short ones if certain."""
    over = F.when(F.length(text) <= SHORT_LABEL, score >= NEAR_EXACT).otherwise((score >= F.when(exact, NEAR_EXACT).otherwise(OVER)) & contained)
    return F.coalesce(F.when(agrees, score >= AGREE).when(mode != "full", F.lit(False)).otherwise(over), F.lit(False))


def footprint_fits(share: Column, w: Column | str, h: Column | str) -> Column:
    """Whether enough of a footprint is occupied; single cells need none, and a negative share (out of the panel, or claimed) never fits."""
    return (share >= 0) & ((share >= OCCUPIED) | (col(w) * col(h) == 1))
