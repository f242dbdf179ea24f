"""Masked normalised cross-correlation, in Arrow batches of one footprint, and shortlist-then-rerank search.

Cells meet the templates of their footprint only.  Cells and templates are dealt to a grid of blocks, so
that a group is bounded on both sides; each side is copied once per block of the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Variance floor, least mask sum of a template and overlap of a pair, shortlist lengths.
VARIANCE, LEAST_MASK, LEAST_OVERLAP, NORM = 1e-6, 16, 32, 1e-6
SHORTLIST, RESCUE, SHIFT, GOOD = 12, 64, 2, 0.90
GROUP_CELLS, GROUP_TEMPLATES = 4_096, 8_192
MARGIN, EXACT_SCORE = 0.04, 0.75
SCORES = "cell_id string, item_id string, template long, score double"


def finalise(templates: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit templates, mask sums): mean taken out inside each mask, zero outside, length 1."""
    counts = masks.sum(axis=1)
    mean = np.einsum("ij,ij->i", masks, templates) / np.maximum(counts, 1.0)
    flat = masks * (templates - mean[:, None])
    length = np.linalg.norm(flat, axis=1)
    return flat / np.where(length > NORM, length, 1.0)[:, None], counts


def masked_ncc(cells: np.ndarray, unit: np.ndarray, masks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(cells, templates) scores by three matrix products."""
    total = cells @ masks.T
    spread = (cells * cells) @ masks.T - total * total / np.maximum(counts, 1.0)
    return (cells @ unit.T) / np.sqrt(np.maximum(spread, VARIANCE))


def pair_correlation(a: np.ndarray, ma: np.ndarray, b: np.ndarray, mb: np.ndarray) -> float:
    """Masked correlation over the part both masks cover; -1 if that is too small or flat."""
    both = ma * mb
    n = both.sum()
    if n < LEAST_OVERLAP:
        return -1.0
    x, y = ((v - (v * both).sum() / n) * both for v in (a, b))
    length = np.linalg.norm(x), np.linalg.norm(y)
    return -1.0 if min(length) < NORM else float(x @ y / (length[0] * length[1]))


def best_items(scores: np.ndarray, items: np.ndarray, n: int, digits: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the best template of each row's n best items, of all items that tie with the n-th to `digits` places."""
    kinds, code = np.unique(items, return_inverse=True)
    by = np.argsort(code, kind="stable")
    head = np.searchsorted(code[by], np.arange(len(kinds)))
    most = np.maximum.reduceat(scores[:, by], head, axis=1)
    shown = np.round(most, digits)
    bar = -np.partition(-shown, min(n, len(kinds)) - 1, axis=1)[:, min(n, len(kinds)) - 1]
    i, k = np.nonzero(shown >= bar[:, None])
    ends = np.append(head[1:], len(by))
    column = np.array([by[head[b] + int(np.argmax(scores[a, by[head[b] : ends[b]]]))] for a, b in zip(i.tolist(), k.tolist(), strict=True)], dtype=np.int64)
    return i, column


def score_cells(cells: DataFrame, templates: DataFrame, top: int | None = None, top_items: int | None = None) -> DataFrame:
    """cell_id, item_id, template, score of cells (cell_id, w, h, vec) against templates (w, h, template, item_id, vec, mask).

    Templates whose mask holds fewer than 16 samples are left out.  top: keep the best so many by cell.  top_items: give
    out only the best template of a cell's so many best items in each block; two are enough for a best item and its
    margin, as only the best item can stand before the rival in the rival's block.
    """
    salts, blocks = max(1, -(-cells.count() // GROUP_CELLS)), max(1, -(-templates.count() // GROUP_TEMPLATES))
    left = cells.select(F.col("cell_id").cast("string").alias("cell_id"), "w", "h", F.col("vec").cast("array<double>").alias("vec")).withColumn("salt", F.pmod(F.xxhash64("cell_id"), F.lit(salts)).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = templates.select("w", "h", F.col("template").cast("long").alias("template"), F.col("item_id").cast("string").alias("item_id"), F.col("vec").cast("array<double>").alias("vec"), F.col("mask").cast("array<double>").alias("mask"))
    right = right.withColumn("block", F.pmod(F.xxhash64("template"), F.lit(blocks)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(t):
            return pd.DataFrame(columns=["cell_id", "item_id", "template", "score"])
        t = t.sort_values("template")
        masks = np.stack(t["mask"].to_numpy()).astype(float)
        ok = masks.sum(axis=1) >= LEAST_MASK
        t, masks = t[ok], masks[ok]
        if not len(t):
            return pd.DataFrame(columns=["cell_id", "item_id", "template", "score"])
        unit, counts = finalise(np.stack(t["vec"].to_numpy()).astype(float), masks)
        out = []
        for lo in range(0, len(c), 256):
            part = c.iloc[lo : lo + 256]
            s = masked_ncc(np.stack(part["vec"].to_numpy()).astype(float), unit, masks, counts)
            if top_items is not None:
                i, j = best_items(s, t["item_id"].to_numpy(), top_items)
                out.append(pd.DataFrame({"cell_id": part["cell_id"].to_numpy()[i], "item_id": t["item_id"].to_numpy()[j], "template": t["template"].to_numpy()[j], "score": s[i, j]}))
                continue
            k = len(t) if top is None else min(top, len(t))
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"cell_id": np.repeat(part["cell_id"].to_numpy(), k), "item_id": t["item_id"].to_numpy()[best.reshape(-1)], "template": t["template"].to_numpy()[best.reshape(-1)], "score": np.take_along_axis(s, best, axis=1).reshape(-1)}))
        return pd.concat(out)

    keys = ["w", "h", "salt", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, SCORES)
    if top is None or blocks == 1:
        return found
    w = Window.partitionBy("cell_id").orderBy(F.desc("score"), "template")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).drop("_n")


def accepted(score: Column, margin: Column, least: Column, exact: Column) -> Column:
    """Accepted if it scores enough and stands out, or is an exact template with a high score."""
    return (score >= least) & ((margin >= MARGIN) | (exact & (score >= F.greatest(least, F.lit(EXACT_SCORE)))))


def adjusted(score: Column, w: Column, h: Column, cached: Column, exact: Column) -> Column:
    """Score with the size's and the source's bonus, by which footprints compete."""
    return score + (w * h - 1) * 0.012 + F.when(cached, 0.02).otherwise(0.0) + F.when(exact, 0.04).otherwise(0.0)


def pool_rows(m: np.ndarray, group: int) -> np.ndarray:
    """Means of each `group` consecutive entries of rows, centred and of unit length (if not flat)."""
    n = m.shape[1] // group
    means = m[:, : n * group].reshape(len(m), n, group).sum(axis=2) / group
    flat = means - means.sum(axis=1, keepdims=True) / max(n, 1)
    length = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return flat / np.where(length > NORM, length, 1.0)


def pooled(vec: Column, group: int) -> Column:
    """pool_rows() of a column of vectors; each batch is one matrix by length of vector."""

    @F.pandas_udf("array<double>")
    def udf(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        sizes = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for n in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == n)
            rows = pool_rows(np.stack([np.asarray(vectors.iloc[i], dtype=float) for i in at]), group)
            for i, row in zip(at.tolist(), rows, strict=True):
                out.iloc[i] = row
        return out

    return udf(vec)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def shortlist(queries: DataFrame, references: DataFrame, bucket: str, short: int = SHORTLIST, unlike: bool = False) -> DataFrame:
    """id, match_id, near, place: the `short` references of each query's bucket with the largest pooled cosine (to 9 places), the smaller id on ties.

    Queries and references of a bucket are dealt to a grid of blocks; a block gives `short` rows a query, which meet by query.
    """
    salts, blocks = max(1, -(-queries.count() // GROUP_CELLS)), max(1, -(-references.count() // GROUP_TEMPLATES))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("id", bucket, "pool").withColumn("salt", deal(salts)).withColumn("block", each(blocks))
    # Both sides may come from one table: new names keep their columns apart in the cogroup.
    r = references.select("id", bucket, "pool").withColumn("block", deal(blocks)).withColumn("salt", each(salts))
    r = r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": np.zeros(0, np.int64), "match_id": np.zeros(0, np.int64), "near": np.zeros(0)})
        if not len(a) or not len(b):
            return none
        b = b.sort_values("r_id")
        ids, pool, out = b["r_id"].to_numpy(), np.stack(b["r_pool"].to_numpy()).astype(float), []
        for lo in range(0, len(a), 256):
            part = a.iloc[lo : lo + 256]
            near = np.round(np.stack(part["pool"].to_numpy()).astype(float) @ pool.T, 9)
            if unlike:
                near[part["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            best = np.argsort(-near, axis=1, kind="stable")[:, :short]
            got = pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), best.shape[1]), "match_id": ids[best].reshape(-1), "near": np.take_along_axis(near, best, axis=1).reshape(-1)})
            out.append(got[np.isfinite(got["near"])])
        return pd.concat(out)

    keys = [bucket, "salt", "block"]
    found = q.groupBy(*keys).cogroup(r.groupBy(*[f"r_{k}" for k in keys])).applyInPandas(run, "id long, match_id long, near double")
    w = Window.partitionBy("id").orderBy(F.desc("near"), "match_id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= short)


def _pair_scores(rows: pd.DataFrame) -> list[float]:
    return [pair_correlation(*(np.asarray(v, dtype=float) for v in r)) for r in zip(rows["va"], rows["ma"], rows["vb"], rows["mb"], strict=True)]


def shortlist_rerank(queries: DataFrame, references: DataFrame, bucket: str, short: int = SHORTLIST, unlike: bool = False) -> DataFrame:
    """Per query the best of its shortlist: pooled cosine first, the masked pair correlation of the best few then.

    queries, references: id (not null), bucket, vec, mask, pool.  An empty bucket gives (null, -1).  unlike: a
    reference of the query's own id is left out, for searches of a table in itself.  Ties go to the place on the shortlist.
    """
    few = shortlist(queries, references, bucket, short, unlike)
    pairs = few.join(queries.select("id", F.col("vec").alias("va"), F.col("mask").alias("ma")), "id").join(references.select(F.col("id").alias("match_id"), F.col("vec").alias("vb"), F.col("mask").alias("mb")), "match_id")

    def run(batches):
        for batch in batches:
            yield batch[["id", "match_id", "place"]].assign(score=np.array(_pair_scores(batch), dtype=float))

    scored = pairs.select("id", "match_id", "place", "va", "ma", "vb", "mb").mapInPandas(run, "id long, match_id long, place int, score double").filter("round(score, 9) > -1")
    best = scored.groupBy("id").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("place")).alias("p"), "match_id", "score")).alias("m"))
    best = best.select(F.col("id").alias("_id"), F.col("m.match_id").alias("match_id"), F.col("m.score").alias("score"))
    return queries.select(F.col("id").cast("long").alias("id")).join(best, F.col("id") == F.col("_id"), "left").select("id", "match_id", F.coalesce("score", F.lit(-1.0)).alias("score"))


def shift_rescue(scores: DataFrame, shifted: DataFrame) -> DataFrame:
    """Per cell and template the larger of the score and its best shifted score; scores only rise."""
    best = shifted.groupBy("cell_id", "template").agg(F.max("score").alias("_b"))
    return scores.join(best, ["cell_id", "template"], "left").withColumn("score", F.greatest("score", F.coalesce("_b", F.col("score")))).drop("_b")
