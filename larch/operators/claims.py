"""Greedy claims: scored candidates become detections that share no cell.

All scores come relationally before; what is left is truly sequential - a claim takes cells away from
later anchors - and runs in reading order over one panel of one frame at a time, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from larch.functions.geometry import AGREE, NEAR_EXACT, OCCUPIED, OVER, SHORT_LABEL
from larch.operators.vectors import EXACT_SCORE, MARGIN

#: Bonuses of size and source.
AREA_BONUS, CACHED_BONUS, EXACT_BONUS = 0.012, 0.02, 0.04
FOUND = "frame_id string, panel int, row int, col int, w int, h int, item_id string, score double, margin double, rotated boolean, how string"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def occupied_share(occupied: np.ndarray, claimed: np.ndarray, row: int, col: int, w: int, h: int) -> float:
    """Occupied share of a footprint, -1 if it leaves the panel or meets a claim."""
    rows, cols = occupied.shape
    if row + h > rows or col + w > cols or claimed[row : row + h, col : col + w].any():
        return -1.0
    return float(occupied[row : row + h, col : col + w].mean())


def least_score(w: int, h: int) -> float:
    return 0.35 if w * h == 1 else 0.40 if w * h <= 2 else 0.50


def label_passes(label: dict, item_id: str | None, exact: bool, mode: str) -> bool:
    """Whether a label's item may stand: agreeing ones easily, overriding ones only at full legibility."""
    if item_id is not None and label["item_id"] == item_id:
        return label["score"] >= AGREE
    if mode != "full":
        return False
    if len(label["text"]) <= SHORT_LABEL:
        return label["score"] >= NEAR_EXACT
    return label["score"] >= (NEAR_EXACT if exact else OVER) and bool(label["contained"])


def claim_panel(cells: pd.DataFrame, scores: pd.DataFrame, labels: pd.DataFrame | None = None, mode: str = "off") -> list[tuple]:
    """(row, col, w, h, item_id, score, margin, rotated, how) in reading order.

    cells: row, col, occupied; scores: the best item by (row, col, w, h) with score, margin, cached, exact,
    rotated; labels: (row, col, w, h) -> item_id, score, text, contained.
    """
    if not len(cells):
        return []
    shape = int(cells["row"].max()) + 1, int(cells["col"].max()) + 1
    occupied, claimed = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
    occupied[cells["row"], cells["col"]] = cells["occupied"]
    by_anchor: dict[tuple[int, int], list[dict]] = {}
    # Larger footprints first; equal areas by width then, for a defined order.
    for s in sorted(scores.to_dict("records"), key=lambda s: (-s["w"] * s["h"], -s["w"])):
        by_anchor.setdefault((s["row"], s["col"]), []).append(s)
    read: dict[tuple, dict] = {}
    if labels is not None and mode != "off":
        read = {(r["row"], r["col"], r["w"], r["h"]): r for r in labels.to_dict("records")}
    out = []

    def take(row: int, col: int, w: int, h: int, *rest) -> None:
        claimed[row : row + h, col : col + w] = True
        out.append((row, col, w, h, *rest))

    for row, col in zip(*np.nonzero(occupied), strict=True):
        row, col = int(row), int(col)
        if claimed[row, col]:
            continue
        best, top = None, 0.0
        for s in by_anchor.get((row, col), []):
            share = occupied_share(occupied, claimed, row, col, s["w"], s["h"])
            if share < 0 or (share < OCCUPIED and s["w"] * s["h"] > 1):
                continue
            value = s["score"] + (s["w"] * s["h"] - 1) * AREA_BONUS + (CACHED_BONUS if s["cached"] or s["exact"] else 0) + (EXACT_BONUS if s["exact"] else 0)
            if best is None or value > top:
                best, top = s, value
        w, h = (best["w"], best["h"]) if best else (1, 1)
        item, exact = (best["item_id"], bool(best["exact"])) if best else (None, False)
        label = read.get((row, col, w, h))
        if label and label_passes(label, item, exact, mode):
            how = "label+score" if label["item_id"] == item else "label"
            take(row, col, w, h, label["item_id"], float(label["score"]), None, bool(best["rotated"]) if best else False, how)
            continue
        # A footprint that is too large garbles its label: one more try on the single cell.
        label = read.get((row, col, 1, 1)) if w * h > 1 and mode == "full" else None
        if label and label_passes(label, None, False, mode):
            take(row, col, 1, 1, label["item_id"], float(label["score"]), None, False, "label")
            continue
        if best is None:
            continue
        least = least_score(w, h)
        sure = exact and best["score"] >= max(least, EXACT_SCORE)
        if best["score"] >= least and (best["margin"] >= MARGIN or sure):
            source = "exact" if exact else "cached" if best["cached"] else "score"
            take(row, col, w, h, item, round(float(best["score"]) * 100, 1), float(best["margin"]), bool(best["rotated"]), source)
    return out


def claim(cells: DataFrame, scores: DataFrame, labels: DataFrame | None = None, mode: str = "off") -> DataFrame:
    """Detections of each (frame_id, panel); see claim_panel for the columns of the three inputs."""
    keys = ["frame_id", "panel"]
    both = cells.select(*keys, "row", "col", "occupied")
    columns = ["row", "col", "w", "h", "item_id", "score", "margin", "cached", "exact", "rotated"]
    scored = scores.select(*keys, *columns)
    if labels is not None:
        # Labels travel with the scores, in one group, told apart by `text`.
        scored = scored.unionByName(labels.select(*keys, "row", "col", "w", "h", "item_id", "score", "text", "contained"), allowMissingColumns=True)

    def run(key: tuple, c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        read, s = None, s if len(s) else pd.DataFrame(columns=[*columns, "text", "contained"])
        if labels is not None:
            is_label = s["text"].notna()
            read, s = s[is_label], s[~is_label]
        return pd.DataFrame([(*key, *r) for r in claim_panel(c, s, read, mode)], columns=_NAMES)

    return both.groupBy(*keys).cogroup(scored.groupBy(*keys)).applyInPandas(run, FOUND)
