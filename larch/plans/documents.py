"""Named queries of sources and stores: documents and tables are written to the shared folder and read back, with their SQL.

Documents of one file (a snapshot, a list, an index) are made of the nations, which are 25 at every scale.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larch.operators import identity
from larch.plans.catalogue import load, query
from larch.sources import html, snapshots, stores
from larch.sources.background import BackgroundTable


def _folder(spark: SparkSession) -> str:
    """A new folder under the session's shared one; where none is set, only a local session may use its own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/larch"
    return f"{at}/larch-documents-{uuid.uuid4().hex}"


def _document(nation: DataFrame, **fields: Column) -> str:
    """Writes one JSON document of the nations' rows, and returns its path."""
    at = _folder(nation.sparkSession)
    nation.agg(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(at)
    return at


def _rows(one: Column) -> Column:
    """The nations in order, each as `one`."""
    return F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("x")))), lambda r: r["x"])


def _n() -> Column:
    return F.col("n_nationkey")


def _id() -> Column:
    return F.concat(F.lit("n"), _n().cast("string"))


@query("""select 'n' || n_nationkey as id, n_name as name, cast(n_nationkey * 100 as bigint) as "basePrice", case when n_nationkey % 3 <> 0 then cast(n_nationkey as bigint) end as "low24hPrice", cast(n_nationkey as bigint) as pos, 77.5::double as snapshot_ts, case when n_nationkey % 2 = 0 then 'V' || n_regionkey end as vendor from nation""")
def q70_price_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendor = F.struct(F.concat(F.lit("V"), F.col("n_regionkey").cast("string")).alias("name"))
    sells = F.when(_n() % 2 == 0, F.array(F.struct(vendor.alias("vendor"), F.lit(5).alias("priceRUB"))))
    item = F.struct(_id().alias("id"), F.col("n_name").alias("name"), (_n() * 100).alias("basePrice"), F.when(_n() % 3 != 0, _n()).alias("low24hPrice"), sells.alias("sellFor"), F.lit("x").alias("other"))
    at = _document(load(spark, sf_dir, "nation"), timestamp=F.lit(77.5), items=_rows(item))
    return snapshots.items(spark, at).select("id", "name", "basePrice", "low24hPrice", "pos", "snapshot_ts", F.get("sellFor", F.lit(0))["vendor"]["name"].alias("vendor"))


@query("""select 'n' || n_nationkey as id, n_name as name, cast(n_regionkey as int) as level, case when n_nationkey % 3 <> 0 then 2 else 0 end as n_objectives, cast(n_nationkey as bigint) as pos from nation""")
def q71_catalogue_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a catalogue, some with objectives; it has no stations and no errors."""
    objective = F.struct(F.lit("o").alias("id"), F.lit("giveItem").alias("type"), F.lit(1).alias("count"))
    task = F.struct(_id().alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("minPlayerLevel"), F.when(_n() % 3 != 0, F.array(objective, objective)).alias("objectives"))
    none = F.lit(None).cast("array<struct<id:string>>")
    tasks, stations = snapshots.catalogue(spark, _document(load(spark, sf_dir, "nation"), timestamp=F.lit(1.0), errors=none, tasks=_rows(task), hideoutStations=none))
    if not stations.isEmpty():
        raise ValueError("a null list has no rows")
    n = F.when(F.col("objectives").isNull(), 0).otherwise(F.size("objectives"))
    return tasks.select("id", "name", F.col("minPlayerLevel").alias("level"), n.alias("n_objectives"), "pos")


@query("""select r_name as category_label, 'r' || r_regionkey as category_id, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as bigint) as pos, 'n' || n_nationkey as id, n_name as name, n_nationkey % 2 = 0 as acquired from nation join region on n_regionkey = r_regionkey""")
def q72_kept_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(_id().alias("id"), F.col("n_name").alias("name"), (_n() % 2 == 0).alias("acquired"))
    by_region = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(_rows(entry).alias("items")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    category = F.struct(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("label"), "items")
    at = _folder(spark)
    by_region.agg(F.to_json(F.struct(F.collect_list(category).alias("categories"))).alias("value")).coalesce(1).write.text(at)
    return snapshots.keep_entries(spark, at).select("category_label", "category_id", "pos", "id", "name", "acquired")


@query("""select n_name || '.png' as filename, 'n' || n_nationkey as item_id, n_nationkey / 4.0::double as score, n_nationkey % 2 = 0 as preset from nation""")
def q73_association_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.concat("n_name", F.lit(".png")).alias("key"), F.struct(_id().alias("item_id"), (_n() / 4.0).alias("score"), (_n() % 2 == 0).alias("preset")).alias("value"))
    at = _folder(spark)
    load(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(one))).alias("value")).coalesce(1).write.text(at)
    return snapshots.associations(spark, at).select("filename", "item_id", "score", "preset")


@query("select cast(n_nationkey as bigint) * 1000 - 5000 as hash, cast(n_regionkey as bigint) as file_number from nation")
def q74_icon_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct((_n().cast("long") * 1000 - 5000).cast("string").alias("key"), F.col("n_regionkey").alias("value"))
    at = _folder(spark)
    load(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(one))).alias("value")).coalesce(1).write.text(at)
    return snapshots.icon_index(spark, at)


@query("select 'v1.2' as tag_name, 'http://x' as html_url, min(n_name) as asset_url from nation where n_nationkey % 5 = 2 and n_nationkey = (select min(n_nationkey) from nation where n_nationkey % 5 = 2)")
def q75_release_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first asset of a name, of several."""
    asset = F.struct(F.concat(F.lit("asset"), (_n() % 5).cast("string")).alias("name"), F.col("n_name").alias("browser_download_url"))
    return snapshots.release(spark, _document(load(spark, sf_dir, "nation"), tag_name=F.lit("v1.2"), html_url=F.lit("http://x"), assets=_rows(asset)), "asset2")


@query("select vec_id as template, cast(1 + vec_id % 3 as int) as w, cast(1 + label % 2 as int) as h, list_sum(embedding::double[]) as total from embeddings")
def q76_template_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates saved by footprint, in one rename, and read by their version."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("template"), (1 + F.col("vec_id") % 3).cast("int").alias("w"), (1 + F.col("label") % 2).cast("int").alias("h"), "embedding")
    at = _folder(spark)
    stores.save_templates(rows.limit(0), at)
    stores.save_templates(rows, at)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return snapshots.templates(spark, at).select("template", "w", "h", total.alias("total"))


@query("select s_suppkey as k, s_name as name from supplier")
def q86_background_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = BackgroundTable(spark, _folder(spark), lambda note: load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))
    table.start()
    table.wait()
    return table.get()


@query("select s_suppkey as k, case s_suppkey % 4 when 0 then 100.0::double when 1 then 100.0::double when 2 then 160.0::double else 100.0::double end as snapshot_ts from supplier")
def q77_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four requests see: the first fetch, a fresh table, one past its time to live, and an old one where fetching is not allowed."""
    rows, at, other = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), _folder(spark), _folder(spark)
    out = []
    for k, (path, now, allow) in enumerate(((other, 100.0, True), (other, 159.0, True), (at, 100.0, True), (other, 900.0, False))):
        got = stores.read_through(spark, path, now, 60.0, lambda: rows, allow)
        if k == 2:
            got = stores.read_through(spark, path, 160.0, 60.0, lambda: rows)
        out.append(got.filter(f"k % 4 = {k}"))
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


@query("""with x as (select doc_id, quality, toxic, (doc_id % 100) / 100.0::double as score from labels), a as (select count(*) as n, count(*) filter (score >= 0.86) as overlap, count(*) filter (score >= 0.86 and quality = toxic) as agree from x), d as (select count(*) as n from documents)
select 'hash' as provider, agree / nullif(overlap, 0)::double >= 0.95 and overlap >= 50 and a.n / d.n::double >= 0.05 as enabled, round_even(coalesce(agree / nullif(overlap, 0)::double, 0), 4) as agreement, overlap, round_even(a.n / d.n::double, 4) as coverage, 12.5::double as checked_at from a, d""")
def q78_gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's verdict saved and read back."""
    labels, at, d = load(spark, sf_dir, "labels"), _folder(spark), F.col("doc_id")
    visual = labels.select(d.alias("key"), F.col("toxic").alias("item_id"), ((d % 100) / 100.0).alias("score"), F.lit(False).alias("preset"), F.lit(False).alias("unknown"))
    stores.save_status(labels.select(d.alias("key"), F.col("quality").alias("item_id")), visual, load(spark, sf_dir, "documents").count(), "hash", 12.5, at)
    return stores.status(spark, at)


def _pages(spark: SparkSession, sf_dir: str, head: str, row: Column) -> DataFrame:
    """A page a nation: a table with nested markup, one row a supplier."""
    rows = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "").alias("body"))
    return rows.select(F.col("s_nationkey").cast("long").alias("page"), F.concat(F.lit(f"<p>x</p><table>{head}"), "body", F.lit("</table><table><tr><td>last</td></tr></table>")).alias("html"))


def _s() -> Column:
    return F.col("s_suppkey").cast("string")


def _cells() -> Column:
    return F.concat(F.lit("<tr><td> "), _s(), F.lit("</td><td>S &amp; <b>"), _s(), F.lit("</b><br>end<table><tr><td>in</td></tr></table></td></tr>"))


_SUPPLIERS_SQL = "s as (select s_nationkey::bigint as page, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) as n, count(*) over (partition by s_nationkey) as c from supplier)"


@query(f"""with {_SUPPLIERS_SQL} select page, 0 as "table", cast(n as int) as row, s_suppkey || '|S & ' || s_suppkey || ' end' as cells from s union all
select distinct page, 0, 0, 'No|Item Name' from s union all select distinct page, 1, 0, 'last' from s""")
def q79_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.tables(_pages(spark, sf_dir, "<tr><th>No</th><th>Item\n Name</th></tr>", _cells()), "page", "html")
    return rows.select("page", "table", "row", F.array_join("cells", "|").alias("cells"))


@query(f"with {_SUPPLIERS_SQL} select page, cast(n as int) as row, 'S & ' || s_suppkey || ' end' as name from s")
def q80_named_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.tables(_pages(spark, sf_dir, "<tr><th>No</th><th>Item\n Name</th></tr>", _cells()), "page", "html")
    return html.named_column(rows, "page", "item name", 1)


@query(f"with {_SUPPLIERS_SQL} select page, cast(s_suppkey as int) as level, 'lvl ' || s_suppkey as pmc_level, '' as quests, 'a b' as hideout from s where s_suppkey % 7 <> 3")
def q81_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("s_suppkey") % 7 == 3, "none").otherwise(F.concat(F.lit("Prestige "), _s()))
    row = F.concat(F.lit("<tr><td>"), number, F.lit("</td><td>lvl "), _s(), F.lit("</td><td>a<br>b</td></tr>"))
    rows = html.tables(_pages(spark, sf_dir, "<tr><th>Prestige level</th><th>PMC level needed</th><th>Hideout</th></tr>", row), "page", "html")
    return html.levels(rows, "page", least=1).select("page", "level", "pmc_level", "quests", "hideout")


@query("""select lo, count(*) as n, max(doc_id) as most from (select doc_id, doc_id % 7 as lo, quality from labels) where quality is not null group by 1""")
def q82_emitted_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections emitted as an editable table, and read again; a second emission is refused."""
    d, at = F.col("doc_id"), _folder(spark)
    rows = load(spark, sf_dir, "labels").filter("quality is not null").select((d % 7).alias("col"), d.alias("row"), F.lit(1).alias("w"), F.lit(1).alias("h"), F.col("quality").alias("item_id"), F.lit(False).alias("rotated"))
    stores.emit_truth(rows, at)
    try:
        stores.emit_truth(rows, at)
        raise ValueError("an existing truth must not be overwritten")
    except Exception as e:
        if "already exists" not in str(e).lower() and "PATH_ALREADY_EXISTS" not in str(e):
            raise
    got = spark.read.schema("col long, row long, item_id int").json(at)
    return got.groupBy(F.col("col").alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("most"))


@query("select items, count(*) as hashes, (select count(*) from (select (p_partkey * 31) % 1511 from part where p_partkey % 3 <> 1 intersect select (p_partkey * 31) % 1511 from part)) as hits from (select (p_partkey * 31) % 1511 as h, count(*) as items from part group by 1) group by 1")
def q83_probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole probe: the histogram of items by hash, with the hashes that the index has."""
    h = (F.col("p_partkey") * 31) % 1511
    part = load(spark, sf_dir, "part")
    items, index = part.select(h.alias("hash"), F.col("p_partkey").alias("item_id")), part.filter("p_partkey % 3 <> 1").select(h.alias("hash")).distinct()
    hits = identity.probe(items, index).first()["hits"]
    return identity.collisions(items).withColumn("hits", F.lit(hits).cast("long"))


_IMAGES = "p_partkey long, blended long, opaque long, coloured long, blanked long, turns long, empty boolean, block long"


@query("""with px as (select p_partkey as p, x, y, (p_partkey + 3 * y + 5 * x) % 256 as b, (2 * p_partkey + y) % 256 as g, (7 * x + p_partkey) % 256 as r, case when (p_partkey * (x + 1) + y) % 3 = 0 then 255 else 0 end as a,
  case when p_partkey % 4 = 0 then 40 + (x + y) % 3 else (p_partkey * x + y * 11) % 256 end as v from part, (select unnest(range(16)) as x), (select unnest(range(12)) as y)),
e as (select p, stddev_pop(v) as s, avg((v > 58)::int) as bright from px where x between 4 and 11 and y between 4 and 7 group by 1)
select p as p_partkey, cast(sum(case when a = 255 then b + g + r else 60 end) as bigint) as blended, cast(sum((a > 32)::int) as bigint) as opaque, cast(sum((greatest(b, g, r) - least(b, g, r) > 12)::int) as bigint) as coloured,
 cast(sum(case when y < 3 or (x >= 12 and (y < 4 or y >= 8)) then 7 else b end) as bigint) as blanked, case when p % 2 = 0 then 1 else 3 end::bigint as turns, any_value(s) < 5 and any_value(bright) < 0.04 as empty,
 cast(sum(b) filter (x >= 2 and x < 6 and y >= 4 and y < 8) as bigint) as block from px join e using (p) group by p""")
def q84_image_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images of every part: alpha blended, foreground with and without alpha, blanked, turned, emptiness and a block of a cell."""
    import numpy as np
    import pandas as pd

    from larch.operators import images

    def run(batches):
        x, y = np.meshgrid(np.arange(16), np.arange(12))
        for batch in batches:
            rows = []
            for p in batch["p_partkey"].tolist():
                bgr = [(p + 3 * y + 5 * x) % 256, (2 * p + y) % 256 + 0 * x, (7 * x + p) % 256 + 0 * y]
                image = np.stack([*bgr, np.where((p * (x + 1) + y) % 3 == 0, 255, 0)], axis=2).astype(np.uint8)
                grey = np.where(p % 4 == 0, 40 + (x + y) % 3, (p * x + y * 11) % 256).astype(np.uint8)
                block = images.cell_block(image, {"origin_x": 2.0, "origin_y": 0.4, "cell_w": 4.0, "cell_h": 4.0}, 0, 1, 1, 1)
                rows.append(
                    (
                        p, int(images.on_background(image, (10, 20, 30)).sum(dtype=np.int64)), int(images.foreground(image).sum()), int(images.foreground(image[:, :, :3]).sum()), int(images.blank(image[:, :, 0], value=7).sum(dtype=np.int64)),
                        sum(1 for _ in images.rotations(image, 1 + p % 2, 1)), images.is_empty(grey, {"origin_x": 0.0, "origin_y": 0.0, "cell_w": 16.0, "cell_h": 12.0}, 0, 0), int(block[:, :, 0].sum(dtype=np.int64)),
                    )
                )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _IMAGES.split(", ")])

    return load(spark, sf_dir, "part").select("p_partkey").mapInPandas(run, _IMAGES)
