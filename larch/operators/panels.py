"""Finding grids and panels in frames from the periodicity of their edges, one frame at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larch.functions.geometry import PITCH_HIGH, PITCH_LOW, SQUARENESS, STRENGTH
from larch.operators.images import decode, grey
from larch.operators.series import period_of, spans_of

#: Tolerances of a panel's pitch against the frame's, and the share that makes a panel part of another.
PITCH_X, PITCH_Y, CONTAINED = 0.06, 0.10, 0.6
PANELS = "frame_id string, panel int, cell_w double, cell_h double, origin_x double, origin_y double, strength double, x0 int, y0 int, x1 int, y1 int, src string"


def edges(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """|horizontal|, |vertical| 3 x 3 Sobel responses; the border is mirrored without its edge pixel."""
    g = np.pad(grey(image), 1, mode="reflect")
    down = g[:-2] + 2 * g[1:-1] + g[2:]
    across = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    return np.abs(down[:, 2:] - down[:, :-2]), np.abs(across[2:] - across[:-2])


def fold_phase(values: np.ndarray, period: int) -> int:
    sums = np.bincount(np.arange(len(values)) % period, weights=values, minlength=period)
    return int(np.argmax(sums))


def comb(values: np.ndarray, origin: float, period: float) -> float:
    at = np.rint(origin + np.arange(int((len(values) - origin) / period) + 1) * period).astype(int)
    at = at[(at >= 0) & (at < len(values))]
    return float(values[at].mean()) if len(at) >= 3 else -1.0


def refine(values: np.ndarray, period: float, phase: int) -> tuple[float, float]:
    """(origin, period) of the best comb within 0.75 of the period and 3 of the phase; the coarse one wins ties."""
    choices = [(float(phase), float(period))] + [(float(o), float(p)) for p in period + np.arange(-6, 7) * 0.125 if p >= 0.8 * PITCH_LOW for o in phase + np.arange(-6, 7) * 0.5]
    scores = [comb(values, *c) for c in choices]
    return choices[int(np.argmax(scores))]


def detect_grid(image: np.ndarray, low: int = PITCH_LOW, high: int = PITCH_HIGH) -> dict | None:
    """The grid of an image: pitch, origin and strength (the weaker axis); None without a period on both axes."""
    gx, gy = edges(image)
    out: dict = {}
    strength = []
    for axis, values in (("x", gx.sum(axis=0)), ("y", gy.sum(axis=1))):
        period, s = period_of(values, low, high)
        if not period:
            return None
        out[f"origin_{axis}"], out["cell_w" if axis == "x" else "cell_h"] = refine(values, period, fold_phase(values, round(period)))
        strength.append(s)
    return out | {"strength": min(strength)}


def plausible(grid: dict | None) -> bool:
    if not grid:
        return False
    w, h, s = grid["cell_w"], grid["cell_h"], grid.get("strength")
    inside = all(PITCH_LOW - 1 <= x <= PITCH_HIGH + 1 for x in (w, h))
    return inside and abs(w - h) <= SQUARENESS * max(w, h) and (s is None or s >= STRENGTH)


def _overlap(a: dict, b: dict) -> tuple[int, int]:
    return min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])


def drop_contained(panels: list[dict]) -> list[dict]:
    """From the strongest on, panels that lie mostly inside a kept one go."""
    kept: list[dict] = []
    for p in sorted(panels, key=lambda p: -p["strength"]):
        area = (p["x1"] - p["x0"]) * (p["y1"] - p["y0"])
        if all(max(0, (o := _overlap(p, k))[0]) * max(0, o[1]) <= CONTAINED * area for k in kept):
            kept.append(p)
    return kept


def trim(panels: list[dict]) -> list[dict]:
    """Overlapping pairs are parted, along the thinner side, at the first grid line of the later one."""
    panels = [dict(p) for p in panels]
    for i, a in enumerate(panels):
        for b in panels[i + 1 :]:
            dx, dy = _overlap(a, b)
            if dx <= 0 or dy <= 0:
                continue
            k, origin = ("x", "origin_x") if dx <= dy else ("y", "origin_y")
            before, after = sorted((a, b), key=lambda p: p[f"{k}0"])
            at = int(max(before[f"{k}0"] + 1, after[origin] - 2))
            before[f"{k}1"] = min(before[f"{k}1"], at)
            after[f"{k}0"] = max(after[f"{k}0"], min(at, int(after[origin])))
    return panels


def large_enough(p: dict) -> bool:
    return p["x1"] - p["x0"] >= 2 * p["cell_w"] and p["y1"] - p["y0"] >= 2 * p["cell_h"]


def detect_panels(image: np.ndarray) -> list[dict]:
    """Panels in reading order: stable spans across, then down within each, and a grid in every rectangle."""
    height, width = image.shape[:2]
    gx, gy = edges(image)
    across = gx.sum(axis=0)
    pitch, _ = period_of(across)
    if not pitch:
        return []
    found = []
    for a, b in spans_of(across, pitch):
        down = gy[:, a:b].sum(axis=1)
        pitch_y, _ = period_of(down)
        if not pitch_y:
            continue
        for c, d in spans_of(down, pitch_y):
            # Spans are as coarse as the pitch; one pitch around takes in the first and last lines.
            box = {"x0": max(0, a - round(pitch)), "x1": min(width, b + round(pitch)), "y0": max(0, c - round(pitch_y)), "y1": min(height, d + round(pitch_y))}
            grid = detect_grid(image[box["y0"] : box["y1"], box["x0"] : box["x1"]])
            if not plausible(grid) or abs(grid["cell_w"] - pitch) > PITCH_X * pitch or abs(grid["cell_h"] - pitch) > PITCH_Y * pitch:
                continue
            panel = {**grid, **box, "origin_x": grid["origin_x"] + box["x0"], "origin_y": grid["origin_y"] + box["y0"]}
            if large_enough(panel):
                found.append(panel)
    return sorted((p for p in trim(drop_contained(found)) if large_enough(p)), key=lambda p: (p["y0"], p["x0"]))


def resolve_grid(detected: Column, persisted: Column, fallback: Column) -> Column:
    """struct(grid, src): the first of detected, persisted and fallback grids that is there; each already checked."""
    src = F.when(detected.isNotNull(), "auto").when(persisted.isNotNull(), "persisted").otherwise("fallback")
    return F.struct(F.coalesce(detected, persisted, fallback).alias("grid"), src.alias("src"))


def resolve_panels(frames: DataFrame, cell_size: float = 63.0) -> DataFrame:
    """Panels of frames (frame_id, height, width, channels, data); a frame without any is one panel by its own grid or by cell_size."""
    names = [x.split()[0] for x in PANELS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                image = decode(f.height, f.width, f.channels, f.data)
                panels, src = detect_panels(image), "panels"
                if not panels:
                    whole = {"x0": 0, "y0": 0, "x1": f.width, "y1": f.height}
                    grid, src = detect_grid(image), "auto"
                    if not plausible(grid):
                        grid, src = {"cell_w": cell_size, "cell_h": cell_size, "origin_x": 0.0, "origin_y": 0.0, "strength": None}, "fallback"
                    panels = [{**grid, **whole}]
                rows += [(f.frame_id, k, *(p[n] for n in names[2:-1]), src) for k, p in enumerate(panels)]
            yield pd.DataFrame(rows, columns=names)

    return frames.select("frame_id", "height", "width", "channels", "data").mapInPandas(run, PANELS)
