"""Sharding by balanced label propagation.

Law `rows`: the shards' row counts differ by one at most.  Documents with equal texts are linked.
All documents of one group in one shard are alike, so the state is a table of cells (group, shard,
rows) of the groups of two or more; a document alone has no edge to cut and fills up the shards at
the end.  Each round every cell looks for the shard where most of its group is, and moves there as
far as that shard's quota allows; whatever of a group finds no room goes on from where it is, and
what remains over quota afterwards is drained to shards with room, so no cell grows past a quota.

No step gathers a group or a shard: cells number shards x groups at most, numbering is two-level
(see common.numbered), and quotas are granted by running sums over hash buckets.

Defined cases: a null text has size 16, crc32 0 and no links; the empty text links as any other;
null doc_ids and repeated rows are rows like others, in no shard by themselves; empty tables give
no rows; fewer rows than shards leave shards empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larch.llm.common import cut, drop, numbered

SHARDS = 40
ROUNDS = 4
BUCKETS = 64
ROW_BYTES = 16


def _running(cells: DataFrame, weight: str, order: list, out: str, buckets: int) -> DataFrame:
    """Sum of `weight` of the cells before each one of the same target, in bucket order; two-level as numbered()."""
    cells = cells.withColumn("_b", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int"))
    head = cells.groupBy(F.col("want").alias("_w"), F.col("_b").alias("_c")).agg(F.sum(weight).alias("_n"))
    w = Window.partitionBy("_w").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    head = head.select("_w", "_c", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_head"))
    inner = Window.partitionBy("want", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cells.withColumn("_in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .join(F.broadcast(head), (F.col("want") == F.col("_w")) & (F.col("_b") == F.col("_c")))
        .withColumn(out, F.col("_head") + F.col("_in"))
        .drop("_w", "_c", "_b", "_in", "_head")
    )


def _round(cells: DataFrame, room: int, buckets: int) -> DataFrame:
    """One round of propagation: cells (g, shard, n) move towards their group's fullest shard with room."""
    group = Window.partitionBy("g")
    want = F.max(F.struct(F.col("n"), (-F.col("shard")).alias("s"))).over(group)
    cells = cells.withColumn("want", -want.getField("s"))
    load = cells.groupBy(F.col("shard").alias("_shard")).agg(F.sum("n").alias("_load"))
    stay = cells.filter("shard = want").select("g", "shard", "n")
    # Quotas: a shard gives what is free plus nothing on account of leavers, so it is never over its quota.
    movers = cells.filter("shard <> want")
    movers = _running(movers, "n", ["g", "shard"], "ahead", buckets).join(F.broadcast(load), F.col("want") == F.col("_shard"), "left")
    free = F.greatest(F.lit(0), F.lit(room) - F.coalesce(F.col("_load"), F.lit(0)))
    go = F.greatest(F.lit(0), F.least(F.col("n"), free - F.col("ahead")))
    parts = F.array(F.struct(F.col("want").alias("shard"), go.alias("n")), F.struct(F.col("shard"), (F.col("n") - go).alias("n")))
    moved = movers.select("g", F.explode(parts).alias("x")).select("g", "x.shard", "x.n").filter("n > 0")
    return stay.unionByName(moved).groupBy("g", "shard").agg(F.sum("n").alias("n"))


def shards_of_groups(groups: DataFrame, room: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Cells (g, shard, n) for groups (g, n): n rows of g go to that shard; no shard holds more than `room`.

    Start: the groups stand in one line in hash order and the line is cut every `room` rows, so a group
    lies in consecutive shards and every shard but the last is full; then `rounds` of propagation, for which
    the line is thinned (cut every ceil(total / shards) rows) so that shards have room to take cells in.
    """
    if not room:
        return groups.select("g", F.lit(0).alias("shard"), "n").limit(0)
    total = int(groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    if not total:
        return groups.select("g", F.lit(0).alias("shard"), "n")
    step = max(1, min(room, -(-total // shards)))
    buckets = min(4096, max(BUCKETS, total // 100_000))
    line = _running(groups.withColumn("want", F.lit(0)), "n", ["g"], "head", buckets).drop("want")
    first, last = F.floor(F.col("head") / step), F.floor((F.col("head") + F.col("n") - 1) / step)
    cells = line.withColumn("shard", F.explode(F.sequence(first, last))).filter(F.col("shard") < shards)
    start, stop = F.greatest(F.col("head"), F.col("shard") * step), F.least(F.col("head") + F.col("n"), (F.col("shard") + 1) * step)
    cells = cut(cells.select("g", F.col("shard").cast("int").alias("shard"), (stop - start).alias("n")))
    for _ in range(rounds):
        after = cut(_round(cells, room, buckets))
        drop(cells)
        cells = after
    return cells


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text), under the law `rows`."""
    text = F.col("text")
    slim = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(text.isNull(), None).otherwise(F.concat(F.md5(text.cast("binary")), F.hex(F.octet_length(text)))).alias("g"),
        )
    )
    total = slim.count()
    room = total // shards
    identity = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    groups = cut(slim.filter("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    cells = cut(shards_of_groups(groups, room, shards, rounds))
    # Linked rows: the k-th row of a group goes where the cells' running sum reaches past k.
    over = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = cells.withColumn("upto", F.sum("n").over(over)).groupBy(F.col("g").alias("pg")).agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("plan"))
    # A hot group is numbered in salts: (g, salt) offsets come from counts of at most BUCKETS rows a group.
    linked = slim.join(groups.select("g"), "g", "left_semi").withColumn("salt", F.pmod(F.xxhash64(*identity), F.lit(BUCKETS)).cast("int"))
    heads = linked.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("head", F.coalesce(F.sum("c").over(before), F.lit(0))).join(plan, F.col("g") == F.col("pg"), "left").select(F.col("g").alias("hg"), F.col("salt").alias("hs"), "head", "plan")
    inner = Window.partitionBy("g", "salt").orderBy(*identity)
    linked = linked.withColumn("k", F.row_number().over(inner) - 1).join(heads, (F.col("g") == F.col("hg")) & (F.col("salt") == F.col("hs")))
    linked = linked.withColumn("k", F.col("k") + F.col("head")).withColumn("shard", F.get(F.filter("plan", lambda x: x["upto"] > F.col("k")), F.lit(0))["shard"])
    linked = linked.select("doc_id", "size", "text_crc32", "shard")
    # Rows alone fill every shard up to its quota: total // shards, and one more in the first total % shards.
    loads = {int(r[0]): int(r[1]) for r in cells.groupBy("shard").agg(F.sum("n")).collect()}
    bounds, upto = [], 0
    for s in range(shards):
        upto += room + (s < total % shards) - loads.get(s, 0)
        bounds.append(upto)
    # Fewer than `shards` linked rows can be left over when nearly all rows are linked; they are placed like these.
    alone = slim.join(groups.select("g"), "g", "left_anti").select(*identity).unionByName(linked.filter("shard is null").select(*identity)).withColumn("one", F.lit(0))
    alone = numbered(alone, "one", identity, max(BUCKETS, total // 100_000), "k")
    place = sum((F.col("k") >= b).cast("int") for b in bounds)
    alone = alone.select("doc_id", "size", "text_crc32", place.cast("int").alias("shard"))
    placed = cut(linked.filter("shard is not null").unionByName(alone))
    return numbered(placed, "shard", identity, max(8, total // (shards * 50_000)), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
