"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of copies, target / source size, at most 3.
The whole part is taken as it is; the fractions are rounded dependently: two documents of a source
meet, words (not copies) move at random from one to the other until one fraction is 0 or 1, and the
other stays for the next meeting.  A move keeps the sum of words, and each fraction's expectation.

The reduction tree: leaves are (source, size class, hash bucket) groups of a bounded number of rows;
each leaves one open document, and the open ones meet again in ever fewer buckets until LEAVE per
source and size class (the bit length of the size, so at most 64) are left.  At a source's root these
meet, small ones first, until OPEN are left, the largest, and those are drawn together: among all
their subsets whose words come next to the target (or within NEAR of it) one is drawn with the chance
that independent rounding gives it.  So OPEN documents a source depart from their exact expectation,
and buy that its words come near the target; all others are rounded by meetings alone.

All randomness comes from hashes of the document's row, so reruns agree under any partitioning.

Defined cases: null text has size 0; documents of size 0 take 0; a null source is a source of its
own, last in order; repeated rows (and null doc_ids) count each on its own; an empty table gives no
rows; very long texts only count; other columns are not read by mix_sources() and kept by repeat().
If all sizes are 0, all targets are 0.  Ids never leave Arrow, so they are exact beside nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larch.llm.common import cut, drop

#: Weights by the order of sources, repeating; the most copies; rows that meet in one leaf.
WEIGHTS = (5, 2, 1)
MOST = 3
LEAF_ROWS = 20_000
FAN_IN = 256
#: Documents that the root of a size class leaves, those that a source's root draws together, and the miss of its
#: target, as a share, that counts as none.
LEAVE, OPEN, NEAR = 4, 16, 0.001
#: Sources up to this number travel by broadcast (each takes under 200 bytes), more by a join.
BROADCAST_SOURCES = 10_000

#: part: number of the source and size class.
_STATE = "doc_id long, key long, tie long, size long, source string, source_size long, target double, whole long, p double, part long"
CLASSES = 64


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target, number: the share of all words by weight, none above `most` times its own.

    Water filling: sources sorted by cap / weight fill up first.  The number of filled ones follows
    from running sums, so no loop is needed; the running sums are over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("number", (F.row_number().over(order) - 1).cast("long"))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
        .withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    )
    per = per.withColumn("share", F.min(F.when(~F.col("full"), F.struct(F.col("cap_before"), F.col("level")))).over(whole).getField("level"))
    return per.select("source", "source_size", "number", F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") * F.col("w")).alias("target"))


def _coin(tie: int, other: int) -> float:
    """A number in [0, 1) from the two rows that meet."""
    x = (tie * 0x9E3779B97F4A7C15 + other * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return ((x ^ (x >> 31)) >> 11) / 2**53


def meet(size: list[int], p: list[float], tie: list[int], leave: int = 1) -> list[float]:
    """Pivotal rounding of one group: returns fractions, all 0 or 1 but `leave` at most.

    Words d move from one document to the other, up to the room of both; with the two possible moves
    d1 (a up, b down) and d2 (a down, b up), the first has the chance d2 / (d1 + d2).
    """
    p = list(p)
    a, left = -1, sum(0.0 < x < 1.0 for x in p)
    for b in range(len(p)):
        if left <= leave:
            break
        if p[b] <= 0.0 or p[b] >= 1.0:
            continue
        if a < 0:
            a = b
            continue
        sa, sb = size[a], size[b]
        up, down = min((1 - p[a]) * sa, p[b] * sb), min(p[a] * sa, (1 - p[b]) * sb)
        if _coin(tie[a], tie[b]) * (up + down) < down:
            full = (1 - p[a]) * sa <= p[b] * sb
            pa, pb = (1.0, p[b] - up / sb) if full else (p[a] + up / sa, 0.0)
        else:
            full = p[a] * sa <= (1 - p[b]) * sb
            pa, pb = (0.0, p[b] + down / sb) if full else (p[a] - down / sa, 1.0)
        p[a], p[b] = (x if 1e-12 < x < 1 - 1e-12 else float(round(x)) for x in (pa, pb))
        left -= (not 0.0 < p[a] < 1.0) + (not 0.0 < p[b] < 1.0)
        if not 0.0 < p[a] < 1.0:
            a = b if 0.0 < p[b] < 1.0 else -1
    return p


def settle(size: list[int], p: list[float], tie: list[int], target: float) -> list[float]:
    """A source's root: meetings from the smallest on until OPEN are left, and one draw of all that are."""
    order = sorted(range(len(p)), key=lambda i: (size[i], tie[i]))
    met = meet([size[i] for i in order], [p[i] for i in order], [tie[i] for i in order], OPEN)
    out = [0.0] * len(p)
    for i, x in zip(order, met, strict=True):
        out[i] = x
    left = [i for i in order if 0 < out[i] < 1]
    if left:
        words, chance = np.array([size[i] for i in left], dtype=float), np.array([out[i] for i in left])
        taken = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        miss = np.abs(taken @ words - chance @ words)
        near = np.flatnonzero(miss <= max(miss.min() + 1e-6, NEAR * target))
        weight = np.cumsum(np.where(taken[near], chance, 1 - chance).prod(axis=1))
        drawn = near[min(int(np.searchsorted(weight, _coin(tie[left[0]], tie[left[-1]]) * weight[-1], side="right")), len(near) - 1)]
        for i, x in zip(left, taken[drawn].tolist(), strict=True):
            out[i] = float(x)
    return out


def _grouped(rule: Callable[..., list[float]], per_source: bool):
    """Rows sorted by (part, _at) with p as the rule gives it for each group; one group and one batch are held at a time."""
    names = [x.split()[0] for x in _STATE.split(", ")]

    def judged(rows: pa.Table, heads: list[int]) -> pa.RecordBatch:
        size, p, tie, target = (rows.column(c).to_pylist() for c in ("size", "p", "tie", "target"))
        out = []
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            if any(0 < x < 1 for x in p[a:b]):
                out += rule(size[a:b], p[a:b], tie[a:b], target[a])
            else:
                out += p[a:b]
        rows = rows.select(names)
        rows = rows.set_column(names.index("p"), "p", pa.array(out, pa.float64()))
        return rows.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            if rows.num_rows:
                part, at = rows.column("part").to_numpy(), rows.column("_at").to_numpy()
                part = part // CLASSES if per_source else part
                heads = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (at[1:] != at[:-1])) + 1).tolist()]
                if len(heads) > 1:
                    yield judged(rows.slice(0, heads[-1]), heads)
                held = rows.slice(heads[-1])
        if held is not None and held.num_rows:
            yield judged(held, [0, held.num_rows])

    return run


def _level(state: DataFrame, at: Column, rule: Callable[..., list[float]], per_source: bool = False) -> DataFrame:
    state = state.withColumn("_at", at.cast("long"))
    by = [F.floor(F.col("part") / CLASSES)] if per_source else [F.col("part"), F.col("_at")]
    rows = state.repartition(*by).sortWithinPartitions(*by, "tie", "doc_id", "key", "size")
    return rows.mapInArrow(_grouped(rule, per_source), _STATE)


def _row_hash(columns: list[Column]) -> Column:
    """A hash of values and of which of them are null, as Spark's hash passes over nulls."""
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def _mixed(docs: DataFrame, key: Column, weights: tuple[int, ...], most: int, leaf_rows: int) -> DataFrame:
    """mix_sources() with a column key, which tells rows of one doc_id and text apart."""
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    slim = cut(docs.select(doc_id.alias("doc_id"), key.alias("key"), _row_hash([doc_id, F.col("text")]).alias("tie"), n_words(F.col("text")).alias("size"), source.alias("source")))
    per = cut(targets(slim, weights, most))
    few = per.count() <= BROADCAST_SOURCES
    rows = slim.count()
    side = F.broadcast(per) if few else per
    state = slim.join(side.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.least(ratio, F.lit(float(most)))
    whole = F.when(F.col("size") > 0, F.floor(ratio + 1e-12)).otherwise(0).cast("long")
    p = F.when((F.col("size") > 0) & (ratio - F.floor(ratio + 1e-12) > 1e-12), ratio - F.floor(ratio + 1e-12)).otherwise(0.0)
    state = state.withColumn("whole", whole).withColumn("p", p).withColumn("part", F.col("number") * CLASSES + F.length(F.bin("size")))
    state = state.select(*[x.split()[0] for x in _STATE.split(", ")])
    buckets = max(1, -(-rows // leaf_rows))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    out, level = [], 0
    while True:
        spread = F.pmod(F.xxhash64("tie", "doc_id", F.lit(level)), F.lit(buckets))
        last = cut(_level(state, spread, (lambda size, p, tie, _: meet(size, p, tie)) if buckets > 1 else lambda size, p, tie, _: meet(size, p, tie, LEAVE)))
        out.append(last.filter(~open_))
        state = last.filter(open_)
        level += 1
        if buckets == 1:
            break
        buckets = -(-buckets // FAN_IN)
    out.append(_level(state, F.lit(0), settle, per_source=True))
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    copies = (F.col("whole") + F.col("p")).cast("long")
    drop(slim)
    return both.select("doc_id", "key", "tie", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Of each row of docs (doc_id, text, source): doc_id, tie, source, size, source_size, target, copies and taken.

    tie is the hash of doc_id and text, and taken is size x copies.
    """
    return _mixed(docs, F.lit(0).cast("long"), weights, most, leaf_rows).drop("key")


def _hashable(docs: DataFrame) -> list[Column]:
    """All columns by place (names may repeat in case); maps, which Spark can't hash, as JSON."""
    has_map = lambda t: isinstance(t, T.MapType) or any(has_map(x) for x in ([f.dataType for f in t.fields] if isinstance(t, T.StructType) else [t.elementType] if isinstance(t, T.ArrayType) else []))
    return [F.to_json(F.struct(f"`{f.name}`")) if has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields]


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it (rows of no words stay as they are), all columns kept.

    Rows are told apart by all their columns, so a text in two sources is taken by each source's own count.
    """
    key = _row_hash(_hashable(docs))
    took = _mixed(docs, key, weights, most, LEAF_ROWS)
    took = took.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(1)).alias("_n"))
    # The row travels as one struct, so its columns' names clash with none here.
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_r"))
    rows = rows.join(took, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))).filter("_n > 0")
    # Rows equal in all columns share a count, which the first of them carries.
    rows = rows.dropDuplicates(["_d", "_k"])
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select("_r.*")
