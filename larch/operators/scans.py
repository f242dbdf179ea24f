"""From frames to detections: panels, occupied cells, scored footprints, claims and corner marks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larch.operators import claims, images, vectors
from larch.operators.ranking import best_with_margin

CELLS = "frame_id string, panel int, row int, col int, occupied boolean"
VECTORS = "cell_id string, frame_id string, panel int, row int, col int, w int, h int, shift int, vec array<float>"


def _panel_frames(frames: DataFrame, panels: DataFrame) -> DataFrame:
    return frames.select("frame_id", "height", "width", "channels", "data").join(panels, "frame_id")


def _local(r) -> tuple[np.ndarray, dict, int, int]:
    """(pixels of the panel, its grid, rows, columns)."""
    image = images.decode(r.height, r.width, r.channels, r.data)[r.y0 : r.y1, r.x0 : r.x1]
    grid = {"cell_w": r.cell_w, "cell_h": r.cell_h, "origin_x": r.origin_x - r.x0, "origin_y": r.origin_y - r.y0}
    rows, cols = (max(0, int((n - grid[o]) // grid[c])) for n, o, c in ((image.shape[0], "origin_y", "cell_h"), (image.shape[1], "origin_x", "cell_w")))
    return image, grid, rows, cols


def cells(frames: DataFrame, panels: DataFrame) -> DataFrame:
    """Every cell of every panel, and whether something lies in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                image, grid, n, m = _local(r)
                rows += [(r.frame_id, r.panel, y, x, not images.is_empty(image, grid, x, y)) for y in range(n) for x in range(m)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])

    return _panel_frames(frames, panels).mapInPandas(run, CELLS)


def footprints(frames: DataFrame, panels: DataFrame, sizes: list[tuple[int, int]], slot: int, shifts: int = 0) -> DataFrame:
    """Vectors of every footprint of the given sizes whose anchor is occupied and which is occupied enough.

    shift numbers the crops moved by up to `shifts` pixels; 0 is the one in place.
    """
    moves = [(0, 0), *((dx, dy) for dx in range(-shifts, shifts + 1) for dy in range(-shifts, shifts + 1) if dx or dy)]
    names = [c.split()[0] for c in VECTORS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                image, grid, n, m = _local(r)
                full = np.array([[not images.is_empty(image, grid, x, y) for x in range(m)] for y in range(n)], dtype=bool).reshape(n, m)
                none = np.zeros_like(full)
                rows = []
                for y, x in zip(*np.nonzero(full), strict=True):
                    y, x = int(y), int(x)
                    for w, h in sizes:
                        share = claims.occupied_share(full, none, y, x, w, h)
                        if share < 0 or (share < claims.OCCUPIED and w * h > 1):
                            continue
                        for k, (dx, dy) in enumerate(moves):
                            vec = images.cell_vector(image, grid, x, y, w, h, slot, dx, dy)
                            if vec is not None:
                                rows.append((f"{r.frame_id}|{r.panel}|{y}|{x}|{w}|{h}|{k}", r.frame_id, r.panel, y, x, w, h, k, vec))
                yield pd.DataFrame(rows, columns=names)

    return _panel_frames(frames, panels).mapInPandas(run, VECTORS)


def scan(frames: DataFrame, panels: DataFrame, templates: DataFrame, slot: int, shifts: int = vectors.SHIFT, labels: DataFrame | None = None, mode: str = "off") -> DataFrame:
    """Detections with place in pixels and the corner mark: see claims.FOUND, then px, py, pw, ph, fir.

    All scoring is relational and parallel by footprint; the claim loop only reads its result.  Weak or
    ambiguous winners are tried again at shifted places, against all templates of their size.
    """
    sizes = [(r["w"], r["h"]) for r in templates.select("w", "h").distinct().collect()]
    place = ["frame_id", "panel", "row", "col", "w", "h"]
    still = footprints(frames, panels, sizes, slot)
    names = templates.select("template", "source", "rotated")
    scores = _best(vectors.score_cells(still, templates, top_items=2), still, place)
    weak = scores.filter((F.col("score") < vectors.GOOD) | (F.col("margin") < vectors.MARGIN))
    if shifts:
        moved = footprints(frames, panels, sizes, slot, shifts).join(weak.select(*place), place, "left_semi")
        again = _best(vectors.score_cells(moved, templates, top_items=2), moved, place).select(*place, *[F.col(c).alias(f"n_{c}") for c in ("item_id", "template", "score", "margin")])
        scores = scores.join(again, place, "left")
        better = F.col("n_score") > F.col("score")
        scores = scores.select(*place, *[F.when(better, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("item_id", "template", "score", "margin")])
    scores = scores.join(F.broadcast(names), "template").withColumn("cached", F.col("source") == "cache").withColumn("exact", F.col("source") == "cache-exact")
    found = claims.claim(cells(frames, panels), scores, labels, mode)
    return marked(frames, panels, found)


def _best(scored: DataFrame, cells_: DataFrame, place: list[str]) -> DataFrame:
    """The best item by footprint, over all shifts, with its margin over any other item and its template."""
    at = scored.join(cells_.select("cell_id", *place), "cell_id").withColumn("at", F.concat_ws("|", *place))
    top = best_with_margin(at, "at")
    which = at.groupBy("at", "item_id").agg(F.max(F.struct("score", (-F.col("template")).alias("t"))).alias("m")).select("at", "item_id", (-F.col("m.t")).alias("template"))
    keys = at.select("at", *place).distinct()
    return top.join(which, ["at", "item_id"]).join(keys, "at").select(*place, "item_id", "template", "score", "margin")


def marked(frames: DataFrame, panels: DataFrame, found: DataFrame) -> DataFrame:
    """Detections with px, py, pw, ph in the frame and fir: whether the corner bears the mark (null: can't tell)."""
    rows = found.join(panels.drop("src", "strength"), ["frame_id", "panel"]).join(frames.select("frame_id", "height", "width", "channels", "data"), "frame_id")
    names = [c.split()[0] for c in claims.FOUND.split(", ")]
    schema = claims.FOUND + ", px int, py int, pw int, ph int, fir boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                image, grid, _, _ = _local(r)
                x0, x1 = (round(grid["origin_x"] + c * grid["cell_w"]) for c in (r.col, r.col + r.w))
                y0, y1 = (round(grid["origin_y"] + c * grid["cell_h"]) for c in (r.row, r.row + r.h))
                out.append((*(getattr(r, n) for n in names), x0 + r.x0, y0 + r.y0, x1 - x0, y1 - y0, images.corner_mark(image, grid, r.col, r.row, r.w, r.h)))
            yield pd.DataFrame(out, columns=[*names, "px", "py", "pw", "ph", "fir"])

    return rows.mapInPandas(run, schema)
