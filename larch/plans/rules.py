"""Named queries of expressions, nested requirements, resolving, edits and small reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larch.functions import basics, geometry, hashing, predicates, text
from larch.operators import association, keeplist, lookup, panels, ranking, requirements, vectors
from larch.plans import scenarios
from larch.plans.catalogue import _CASCADE_SQL, _HASH_SQL, _HAVE_SQL, _NEEDS_SQL, _SECOND, _AGG_SQL, _entries, _have, _index, _market, _MARKET_SQL, _needs, load, query


def _p() -> Column:
    return F.col("p_partkey")


def _by(column: Column, *values) -> Column:
    """The k-th of some literals, by column modulo their number; None gives null."""
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        out = F.when(F.pmod(column, F.lit(len(values))) == k, F.lit(v)).otherwise(out)
    return out


_GRID_SQL = """g as (select p_partkey, p_partkey % 400 as px, p_partkey % 90 + 0.5::double as pitch, p_partkey % 7 + 0.5::double as ox, p_partkey % 5 + 0.25::double as oy, 40 + p_size / 4.0::double as cw,
  40 + (p_partkey % 11) / 8.0::double as ch, p_partkey % 10 as c, p_partkey % 6 as r, 1 + p_partkey % 3 as w, 1 + p_partkey % 2 as h, case when p_partkey % 4 <> 0 then (p_partkey % 30) / 10.0::double end as strength from part),
e as (select *, cast(round_even(ox + c * cw, 0) as int) - 2 as x0, cast(round_even(oy + r * ch, 0) as int) - 2 as y0, cast(round_even(ox + (c + w) * cw, 0) as int) + 2 as x1, cast(round_even(oy + (r + h) * ch, 0) as int) + 2 as y1 from g),
k as (select *, greatest(0, least(400, x0)) as cx0, greatest(0, least(400, x1)) as cx1, greatest(0, least(300, y0)) as cy0, greatest(0, least(300, y1)) as cy1 from e)"""


@query(f"""with {_GRID_SQL} select p_partkey, greatest(1, cast(round_even((px - 1) / 63.0::double, 0) as int)) as slots, greatest(16, least(64, cast(round_even(pitch, 0) as int))) as slot_px, x0, y0, x1, y1,
 case when cx1 > cx0 and cy1 > cy0 then cx0 || ',' || cy0 || ',' || cx1 || ',' || cy1 end as cropped,
 cw between 23 and 201 and ch between 23 and 201 and abs(cw - ch) <= 0.10::double * greatest(cw, ch) and (strength is null or strength >= 1.6::double) as valid,
 case when w * h = 1 then 0.35::double when w * h <= 2 then 0.40::double else 0.50::double end as least, case when pitch >= 40 then 'full' when pitch >= 30 then 'agree' else 'off' end as mode from k""")
def q35_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").withColumn("pitch", _p() % 90 + 0.5)
    grid = F.struct((_p() % 7 + 0.5).alias("origin_x"), (_p() % 5 + 0.25).alias("origin_y"), (40 + F.col("p_size") / 4.0).alias("cell_w"), (40 + (_p() % 11) / 8.0).alias("cell_h"), F.when(_p() % 4 != 0, (_p() % 30) / 10.0).alias("strength"))
    w, h = 1 + _p() % 3, 1 + _p() % 2
    rows = rows.withColumn("grid", grid).withColumn("rect", geometry.cell_rect(F.col("grid"), _p() % 10, _p() % 6, w, h, 2))
    crop = geometry.crop(F.col("rect"), F.lit(300), F.lit(400))
    return rows.select(
        "p_partkey", geometry.slot_size(_p() % 400).alias("slots"), geometry.slot_pixels("pitch").alias("slot_px"), "rect.*", F.when(crop.isNotNull(), F.concat_ws(",", crop["x0"], crop["y0"], crop["x1"], crop["y1"])).alias("cropped"),
        geometry.valid_grid(F.col("grid")).alias("valid"), geometry.least_score(w, h).alias("least"), geometry.label_mode("pitch").alias("mode"),
    )


_GAP = "[\\t\\n\\x0B\\f\\r ]"


@query(f"""select doc_id, md5(regexp_replace(replace(regexp_replace(text, '^{_GAP}+|{_GAP}+$', '', 'g'), chr(10), ' '), '^[^\\p{{L}}\\p{{N}}#]+', '')) as label_md5,
 md5(trim(regexp_replace(text, '{_GAP}+', ' ', 'g'))) as spaced_md5, try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') as bigint) as number from documents""")
def q36_clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = lambda c: F.md5(c.cast("binary"))
    return load(spark, sf_dir, "documents").select("doc_id", hashed(text.clean_label("text")).alias("label_md5"), hashed(text.one_space("text")).alias("spaced_md5"), text.first_integer("text").alias("number"))


@query("""with x as (select p_partkey, p_name, p_type, p_brand, p_size, p_partkey % 50 as have, p_size % 7 as need, (p_partkey % 997) / 997.0::double as sc, p_partkey * 1.5::double as minutes from part)
select p_partkey, case when need = 0 then 0 else cast(least(100, floor(have * 100.0::double / need + 0.5::double)) as bigint) end as pct,
 case when minutes < 60 then cast(floor(minutes + 0.5::double) as bigint) || 'm' else cast(floor(minutes / 60 + 0.5::double) as bigint) || 'h' end as age,
 p_size || '× ' || p_name || case when p_partkey % 2 = 0 then ' (FIR)' else '' end || ' · ' || '2× ' || p_type as listed,
 case p_partkey % 6 when 0 then false when 1 then false when 2 then false else true end as is_on, round_even(sc * 100, 1) as scaled, p_type as quest, cast(null as varchar) as none from x""")
def q37_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    item = lambda n, name, fir: F.struct(n.alias("count"), name.alias("name"), fir.alias("fir"))
    items = F.array(item(F.col("p_size"), F.col("p_name"), _p() % 2 == 0), item(F.lit(2), F.col("p_type"), F.lit(False)))
    fields = F.map_from_arrays(F.array(F.lit("PMC Level"), F.lit("Quest Name"), F.lit("More quests")), F.array("p_name", "p_type", "p_brand"))
    return part.select(
        "p_partkey", text.percent_done(_p() % 50, F.col("p_size") % 7).alias("pct"), text.age_label(_p() * 1.5).alias("age"), text.item_list(items).alias("listed"), text.is_on(_by(_p(), "0", "false", "False", "1", "", "yes")).alias("is_on"),
        basics.round_even((_p() % 997) / 997.0 * 100, 1).alias("scaled"), text.field_like(fields, "quest").alias("quest"), text.field_like(fields, "level up").alias("none"),
    )


@query("""select p_partkey, p_partkey % 6 in (1, 2, 4) as target, not (p_partkey % 3 = 0) and p_partkey % 4 = 0 as active, not (p_partkey % 3 = 0) as open_,
 case p_partkey % 5 when 0 then '20,19,19' when 4 then '29,32,49' else '54,54,53' end as tint, case p_partkey % 3 when 0 then '1,2,3' else '180,120,20' end as badge,
 case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 1 then p_type || '|' || p_name when p_partkey % 4 = 2 then p_name else p_name end as names,
 case when p_size % 3 = p_size % 2 then (p_size % 3) || 'x' || (p_size % 2) else (p_size % 3) || 'x' || (p_size % 2) || '|' || (p_size % 2) || 'x' || (p_size % 3) end as lies from part""")
def q38_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    types = F.when(_p() % 6 == 0, F.array(F.lit("ammo"))).when(_p() % 6 == 2, F.array().cast("array<string>")).when(_p() % 6 == 3, F.array(F.lit("barter"), F.lit("gun"))).when(_p() % 6 == 4, F.array(F.lit("food"))).when(_p() % 6 == 5, F.array(F.lit("preset")))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    required = F.when(_p() % 4 == 0, F.lit(True)).when(_p() % 4 == 1, F.lit(False))
    short = F.when(_p() % 4 == 0, F.col("p_name")).when(_p() % 4 == 1, F.col("p_type")).when(_p() % 4 == 2, F.lit(""))
    sides = F.transform(predicates.footprints(F.col("p_size") % 3, F.col("p_size") % 2), lambda s: F.concat(s["w"].cast("string"), F.lit("x"), s["h"].cast("string")))
    return part.select(
        "p_partkey", predicates.is_target(types).alias("target"), predicates.is_active(_p() % 3 == 0, required, True).alias("active"), predicates.is_active(_p() % 3 == 0, required, False).alias("open_"),
        joined(predicates.tint_of(_by(_p(), "black", "nope", "", None, "red"))).alias("tint"), joined(predicates.badge_of(_by(_p(), "Ann", "Bob", None), {"Ann": (1, 2, 3)})).alias("badge"),
        F.array_join(predicates.names_of(short, "p_name"), "|").alias("names"), F.array_join(sides, "|").alias("lies"),
    )


@query(f"""with src as (select p_partkey as id, p_type || p_partkey as s from part), {_HASH_SQL}, salts as (select p_partkey as id, (23 + p_size) << 2 as salt from part),
x as (select id, salt, xor(17::bigint, xor(hash, salt::bigint)) & 4294967295 as u from signed join salts using (id))
select id as p_partkey, salt, case when u >= 2147483648 then u - 4294967296 else u end as hash from x""")
def q39_salted_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").withColumn("salt", hashing.magazine_salt("p_size"))
    return rows.select("p_partkey", "salt", hashing.item_hash(F.concat("p_type", _p().cast("string")), F.col("salt")).alias("hash"))


def _task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks with their lines as objectives; some without an item, some of currencies, some visits."""
    lines = load(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    item = F.when(k % 17 != 0, F.struct(k.cast("string").alias("id"), F.when(k % 13 == 0, "Roubles").otherwise(F.concat(F.lit("part "), k.cast("string"))).alias("name"), F.lit("").alias("shortName")))
    one = F.struct(
        "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", F.concat(F.lit("x"), k.cast("string")).alias("id"), F.when(F.col("l_linestatus") == "O", "giveItem").otherwise("visit").alias("type"),
        F.when(k % 11 == 0, 0).otherwise(F.col("l_quantity")).cast("int").alias("count"), (F.col("l_returnflag") == "R").alias("foundInRaid"), item.alias("item"),
    )
    objectives = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda o: F.struct(o["id"].alias("id"), o["type"].alias("type"), o["count"].alias("count"), o["foundInRaid"].alias("foundInRaid"), o["item"].alias("item"))).alias("objectives"))
    orders = load(spark, sf_dir, "orders").join(objectives, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = F.col("o_orderkey")
    return orders.select(
        F.concat(F.lit("o"), o.cast("string")).alias("id"), F.concat(F.lit("Order "), o.cast("string")).alias("name"), (F.col("o_custkey") % 40).cast("int").alias("minPlayerLevel"), (F.col("o_orderpriority") == "1-URGENT").alias("kappaRequired"),
        F.struct(F.when(F.col("o_custkey") % 7 > 0, F.concat(F.lit("T"), (F.col("o_custkey") % 7).cast("string"))).alias("name")).alias("trader"), "objectives", o.alias("pos"),
    )


def _done_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))


_TASK_NEEDS_SQL = """lines as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus) - 1 as k from lineitem),
needs as (select l_partkey::varchar as item_id, 'part ' || l_partkey as name, 'o' || l_orderkey as source_id, case when o_custkey % 7 > 0 then 'T' || (o_custkey % 7) else '?' end || ' — Order ' || l_orderkey as source,
  cast(l_quantity as bigint) as cnt, l_returnflag = 'R' as fir, o_orderstatus <> 'F' as active, l_orderkey * 1000 + k as ord from lines join orders on l_orderkey = o_orderkey
  where l_linestatus = 'O' and l_partkey % 17 <> 0 and l_partkey % 13 <> 0 and l_partkey % 11 <> 0 and l_quantity > 0)"""


@query(f"with {_TASK_NEEDS_SQL} select item_id, name, source_id, source, cnt, fir, active, ord from needs")
def q40_task_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = requirements.task_needs(_task_table(spark, sf_dir), _done_tasks(spark, sf_dir), False)
    return needs.select("item_id", "name", "source_id", "source", F.col("count").alias("cnt"), "fir", "active", "ord")


@query(f"with {_TASK_NEEDS_SQL} select source_id, source, min(ord) as first_ord, bool_or(active) as active, string_agg(item_id || 'x' || cnt || case when fir then '!' else '' end, ';' order by ord) as items from needs group by source_id, source")
def q41_nested_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only tasks with an item to hand in, with their items."""
    rows = requirements.nested(requirements.task_needs(_task_table(spark, sf_dir), _done_tasks(spark, sf_dir), False))
    one = lambda i: F.concat(i["item_id"], F.lit("x"), i["count"].cast("string"), F.when(i["fir"], "!").otherwise(""))
    return rows.select("source_id", "source", "first_ord", "active", F.array_join(F.transform("items", one), ";").alias("items"))


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stations, their suppliers as levels, and parts dealt to suppliers as requirements."""
    supplier, part = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "part")
    dealt = part.withColumn("at", _p() % F.lit(supplier.count()))
    need = F.struct((F.col("p_size") % 4).alias("count"), F.struct(_p().cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("shortName")).alias("item"))
    needs = dealt.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", need.alias("need")))), lambda x: x["need"]).alias("itemRequirements"))
    levels = supplier.join(needs, F.col("s_suppkey") == F.col("at"), "left")
    level = F.struct("s_suppkey", F.concat(F.lit("l"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").cast("int").alias("level"), "itemRequirements")
    # A level's order is its supplier's number, which is unique, so the arrays are never compared.
    by_nation = levels.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(level)), lambda x: F.struct(x["id"].alias("id"), x["level"].alias("level"), x["itemRequirements"].alias("itemRequirements"))).alias("levels"))
    nation = load(spark, sf_dir, "nation").join(by_nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return nation.select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), "levels", F.col("n_nationkey").cast("long").alias("pos"))


def _done_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("l"), F.col("s_suppkey").cast("string")).alias("id"))


_STATIONS_SQL = """levels as (select n_nationkey, n_name, s_suppkey, row_number() over (partition by n_nationkey order by s_suppkey) - 1 as k from supplier join nation on n_nationkey = s_nationkey),
reqs as (select l.*, p_partkey, p_name, p_brand, p_size % 4 as cnt, row_number() over (partition by s_suppkey order by p_partkey) - 1 as j from levels l join part on p_partkey % (select count(*) from supplier) = s_suppkey)"""


@query(f"""with {_STATIONS_SQL} select p_partkey::varchar as item_id, p_name as name, p_brand as "shortName", 'l' || s_suppkey as source_id, n_name || ' L' || s_suppkey as source, cast(cnt as bigint) as cnt, s_suppkey % 3 <> 0 as active,
 1000000000000 + n_nationkey * 1000000 + k * 1000 + j as ord from reqs where cnt > 0""")
def q42_station_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = requirements.station_needs(_stations(spark, sf_dir), _done_levels(spark, sf_dir))
    return needs.select("item_id", "name", "shortName", "source_id", "source", F.col("count").alias("cnt"), "active", "ord")


@query(f"""with {_STATIONS_SQL} select n_name as name, count(*) filter (s_suppkey % 3 = 0) as done, count(*) as total from levels group by 1""")
def q43_sections_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.sections_done(_stations(spark, sf_dir), _done_levels(spark, sf_dir))


@query(f"""with {_STATIONS_SQL} select n_name as name, string_agg('l' || s_suppkey, ',' order by s_suppkey) as left_ from levels where lower(n_name) like '%at%' and s_suppkey not in (0, 3, 5) group by 1""")
def q44_open_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requirements.open_levels(_stations(spark, sf_dir), "AT", ["l0", "l3", "l5"])
    return found.select("name", F.array_join(F.transform("levels", lambda x: x["id"]), ",").alias("left_"))


@query("""with t as (select 'T' || (o_custkey % 7) as trader, o_custkey % 40 as lv, o_orderkey, o_orderstatus = 'F' as done from orders where o_custkey % 7 > 0)
select trader, count(*) filter (done) as n_done, count(*) as n, md5(string_agg('o' || o_orderkey, ',' order by lv, o_orderkey)) as ids from t where 'order ' || o_orderkey like '%11%' or lower(trader) like '%11%' group by 1""")
def q45_tasks_by_trader(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requirements.tasks_by_trader(_task_table(spark, sf_dir), "11", _done_tasks(spark, sf_dir)).filter("trader is not null")
    return found.select("trader", "n_done", "n", F.md5(F.array_join(F.transform("tasks", lambda t: t["id"]), ",").cast("binary")).alias("ids"))


@query(f"with {_NEEDS_SQL.format('', _SECOND)}, {_AGG_SQL}, {_HAVE_SQL} select item_id, total_needed from agg left join have using (item_id) where name like '%part 1%' and coalesce(have, 0) < total_needed")
def q46_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = requirements.outstanding(_needs(spark, sf_dir, False, True), _have(load(spark, sf_dir, "part")))
    return requirements.search(out, "PART 1", True).select("item_id", "total_needed")


@query(f"with {_CASCADE_SQL} select id as pos, id, f.name from found f0 join entries f using (id) where coalesce(f0.exact, f0.known, f0.alias) is null")
def q47_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return lookup.unmapped(lookup.resolve(_entries(part), _index(part)))


@query(f"""with {_CASCADE_SQL}, u as (select f.name, row_number() over (order by id) as n, count(*) over () as c from found f0 join entries f using (id) where coalesce(f0.exact, f0.known, f0.alias) is null)
select string_agg(name, ', ' order by n) filter (n <= 3) || case when max(c) > 3 then '…' else '' end as note from u having count(*) > 0""")
def q48_unmapped_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return lookup.note(lookup.unmapped(lookup.resolve(_entries(part), _index(part))))


@query(f"with {_CASCADE_SQL}, r as (select id, coalesce(exact, known, alias) as item_id from found) select item_id, max(id) as id from r where item_id is not null group by 1")
def q49_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of each item counts."""
    part = load(spark, sf_dir, "part")
    return lookup.mapped(lookup.resolve(_entries(part), _index(part))).select("item_id", "id")


@query(f"""with {_CASCADE_SQL}, n as (select id, unnest(list_prepend(name, aliases)) as n, unnest(range(len(aliases) + 1)) as k from entries)
select id, arg_min(item_id, k) as item_id from n join idx on lower(n) = key group by id""")
def q50_first_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return lookup.first_alias_hit(_entries(part), _index(part))


_PLACES_SQL = "det as (select p_partkey, p_size % 3 as panel, p_partkey // 40 as row, p_partkey % 40 as col, cast(p_partkey * 7 % 2500 as varchar) as item_id, case p_partkey % 3 when 0 then true when 1 then false end as fir from part)"


def _detections(part: DataFrame) -> DataFrame:
    fir = F.when(_p() % 3 == 0, F.lit(True)).when(_p() % 3 == 1, F.lit(False))
    return part.select(F.lit("f").alias("frame_id"), (F.col("p_size") % 3).alias("panel"), F.floor(_p() / 40).alias("row"), (_p() % 40).alias("col"), F.lit(1).alias("w"), F.lit(1).alias("h"), (_p() * 7 % 2500).cast("string").alias("item_id"), fir.alias("fir"))


@query(f"""with {_MARKET_SQL}, {_PLACES_SQL}, sells as (select l_partkey, case when l_suppkey = 0 then 'Flea Market' else 'S' || l_suppkey end as vendor, cast(floor(l_extendedprice) as bigint) as price, l_orderkey, l_linenumber, l_suppkey from lineitem),
best as (select l_partkey, vendor, price from (select *, row_number() over (partition by l_partkey order by price desc, l_orderkey, l_linenumber, l_suppkey) as n from sells where vendor <> 'Flea Market' and price > 0) where n = 1),
x as (select d.*, p.p_partkey as part, p.p_name, m.base, coalesce(nullif(low, 0), average, 0) as market, vendor, coalesce(price, 0) as price, d.item_id::bigint % 6 = 0 as guarded, not (d.item_id::bigint % 12 = 0 and fir is not distinct from false) as held
  from det d join part p on d.item_id = p.p_partkey::varchar join market m on m.p_partkey = p.p_partkey left join best on l_partkey = p.p_partkey),
y as (select *, guarded and held as keep from x)
select panel, row, col, item_id, keep, case when guarded then 'R' || item_id end as keep_reason, case when keep then 'K' else (row_number() over (partition by keep order by panel, row, col))::varchar end as number, vendor as trader_name, price as trader_price,
 case when market = 0 then 'No flea data' when price = 0 then 'No trader data' else 'both' end as known from y""")
def q51_sell_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    vendor = F.when(F.col("l_suppkey") == 0, "Flea Market").otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    offer = F.struct("l_orderkey", "l_linenumber", "l_suppkey", F.struct(F.struct(vendor.alias("name")).alias("vendor"), F.floor("l_extendedprice").cast("long").alias("priceRUB")).alias("o"))
    offers = lines.groupBy("l_partkey").agg(F.transform(F.array_sort(F.collect_list(offer)), lambda x: x["o"]).alias("sellFor"))
    market = _market(part).select(F.col("p_partkey").alias("_k"), F.col("base").alias("basePrice"), F.col("low").alias("low24hPrice"), F.col("average").alias("avg24hPrice"))
    items = part.join(market, _p() == F.col("_k")).join(offers, _p() == F.col("l_partkey"), "left").select(_p().cast("string").alias("id"), F.col("p_name").alias("name"), "basePrice", "low24hPrice", "avg24hPrice", "sellFor")
    item = _p().cast("string")
    protected = part.filter(_p() % 6 == 0).select(item.alias("item_id"), F.concat(F.lit("R"), item).alias("reason"), (_p() % 12 == 0).alias("fir_only"))
    out = scenarios.sell_scan(_detections(part), items, protected)
    known = F.when(F.col("reason").isin("No flea data", "No trader data"), F.col("reason")).otherwise("both")
    return out.select("panel", "row", "col", "item_id", "keep", "keep_reason", "number", "trader_name", "trader_price", known.alias("known"))


@query(f"""with {_CASCADE_SQL}, {_PLACES_SQL}, r as (select coalesce(exact, known, alias) as item_id, max(id) as id from found where coalesce(exact, known, alias) is not null group by 1),
seen as (select distinct r.id from r join det on det.item_id = r.item_id::varchar) select seen.id as entry_id, e.name as entry_name from seen join entries e using (id) where seen.id % 4 <> 1""")
def q52_keep_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that were seen and are not acquired, once each."""
    part = load(spark, sf_dir, "part")
    index = _index(part).withColumn("item_id", F.col("item_id").cast("string"))
    entries = _entries(part).withColumn("tdev_id", F.col("tdev_id").cast("string")).withColumn("acquired", _by(F.col("id"), "no", "yes", "no", "no") == "yes")
    return scenarios.keep_scan(_detections(part), entries, index, None)[1]


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        F.when(s % 2 == 0, "collector").otherwise("mine").alias("category_id"), s.alias("pos"), s.cast("string").alias("id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"),
        F.when(s % 5 != 0, s % 3 == 0).alias("acquired"), F.when(s % 4 == 0, "custom").otherwise("wiki").alias("source"), F.when(s % 3 == 0, "").when(s % 3 == 1, "t1").alias("tdev_id"),
    )


_KEPT_SQL = "kept as (select s_suppkey as pos, s_suppkey::varchar as id, s_name as name, case when s_suppkey % 5 <> 0 then s_suppkey % 3 = 0 end as acquired, case s_suppkey % 3 when 0 then '' when 1 then 't1' end as tdev_id from supplier)"


@query(f"with {_KEPT_SQL} select id, case when id = '5' then not coalesce(acquired, false) else acquired end as acquired from kept")
def q53_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeplist.toggle(_kept(spark, sf_dir), "5").select("id", "acquired")


@query(f"with {_KEPT_SQL}, a as (select *, pos % 2 = 0 and not coalesce(acquired, false) as updated from kept) select id, updated, updated or coalesce(acquired, false) as acquired, cast(sum(updated::bigint) over () as bigint) as n_updated from a")
def q54_batch_acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept(spark, sf_dir)
    rows = keeplist.acquire(kept, kept.filter("pos % 2 = 0").select("id"))
    return rows.select("id", "updated", "acquired", F.lit(rows.filter("updated").count()).cast("long").alias("n_updated"))


@query(f"""with {_KEPT_SQL} select id, pos, name, false as acquired, cast(null as varchar) as task, cast(null as int) as count from kept where id <> '7' union all
select substr(sha256('New thing'), 1, 8), coalesce(max(pos) filter (pos % 2 = 0 and id <> '7'), -1) + 1, 'New thing', false, 'A task', 3 from kept""")
def q55_list_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry removed, a custom one added for a task, and all flags taken back."""
    rows = keeplist.add_custom(keeplist.remove(_kept(spark, sf_dir), "7"), "collector", "New thing", ["nt"], "A task", 3)
    return keeplist.restart(rows).select("id", "pos", "name", "acquired", "task", "count")


@query("""with p as (select c_custkey as id, case when c_custkey % 9 > 0 then c_custkey % 9 end as prestige from customer) select id, least(6, coalesce(prestige, 0) + 1) as prestige, 0 as n_tasks, 0 as n_levels, 0 as n_have from p""")
def q56_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A player a customer: one level up, at most six, and all progress back to nothing."""
    c = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 9 > 0, (c % 9).cast("int")).alias("prestige"), F.array(F.lit("a")).alias("completed_tasks"), F.array(F.lit("b")).alias("completed_hideout"), F.create_map(F.lit("x"), F.lit(1)).alias("have"))
    out = keeplist.advance(rows)
    return out.select("id", F.col("prestige").cast("long").alias("prestige"), F.size("completed_tasks").alias("n_tasks"), F.size("completed_hideout").alias("n_levels"), F.size("have").alias("n_have"))


@query("""with p as (select o_custkey as id, list(o_orderkey::varchar) as done from orders group by 1) select id, array_to_string(list_sort(list_distinct(list_append(done, '100'))), ',') as added,
 array_to_string(list_sort(list_distinct(list_filter(done, lambda x: x <> '100'))), ',') as removed from p""")
def q57_completed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("done"))
    both = keeplist.set_completed(keeplist.set_completed(rows.withColumn("added", F.col("done")).withColumn("removed", F.col("done")), "added", "100", True), "removed", "100", False)
    return both.select("id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(f"with {_KEPT_SQL}, i as (select lower(p_name) as key, max(p_partkey::varchar) as item from part group by 1) select id, coalesce(nullif(tdev_id, ''), item) as tdev_id from (select id, tdev_id, lower(case when pos % 2 = 0 then 'Red Bolt' else name end) as n from kept) left join i on key = n")
def q58_backfill_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = load(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("key")).agg(F.max(_p().cast("string")).alias("item_id"))
    kept = _kept(spark, sf_dir).withColumn("name", F.when(F.col("pos") % 2 == 0, "Red Bolt").otherwise(F.col("name")))
    return keeplist.backfill_ids(kept, index).select("id", "tdev_id")


@query("""with c as (select p_partkey, p_size % 3 as panel, p_partkey // 40 as row, p_partkey % 40 as col, p_retailprice > 1500 or p_partkey % 9 = 0 as occupied from part)
select p_partkey, cast(sum(occupied::int) over (partition by panel order by row, col) as bigint) as done, cast(sum(occupied::int) over (partition by panel) as bigint) as total from c""")
def q59_running_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("panel"), F.floor(_p() / 40).alias("row"), (_p() % 40).alias("col"), ((F.col("p_retailprice") > 1500) | (_p() % 9 == 0)).alias("occupied"))
    return ranking.running_share(rows, "panel", ["row", "col"], "occupied").select("p_partkey", "done", "total")


@query("select event_id, event_type as content from events where event_id > 5000 and event_id % 3 <> 0")
def q60_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = load(spark, sf_dir, "events").select("event_id", e.cast("double").alias("ts"), F.when(e % 3 != 0, F.col("event_type")).alias("content"))
    return ranking.since(rows, "ts", 5000.0).select("event_id", "content")


@query("select case when vec_id % 4 = 0 then 'exact' when vec_id % 7 = 0 then 'unknown' when vec_id % 3 = 0 then 'preset' else 'strong' end as kind, count(*) as n from embeddings group by 1")
def q61_association_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return association.counters(load(spark, sf_dir, "embeddings").select((v % 4 == 0).alias("exact"), (v % 7 == 0).alias("unknown"), (v % 3 == 0).alias("preset")))


@query("select (select count(*) from (select distinct p_size % 4, p_size % 3 from part)) as buckets, count(*) as templates from part")
def q62_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.summary(load(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("w"), (F.col("p_size") % 3).alias("h")))


@query("select count(*) as n, min(p_retailprice) as least, max(p_retailprice) as most, round(avg(p_retailprice), 6) as mean from part")
def q62b_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.score_summary(load(spark, sf_dir, "part").select(F.col("p_retailprice").alias("score"))).withColumn("mean", F.round("mean", 6))


@query("select s_suppkey as level, s_name as name from supplier where s_suppkey = 5")
def q62c_next_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.next_level(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("level"), F.col("s_name").alias("name")), 4)


@query("""with s as (select p_partkey // 4 as anchor, 1 + p_partkey % 3 as w, 1 + p_size % 2 as h, p_partkey % 2 = 0 as cached, p_partkey % 5 = 0 as exact, p_retailprice / 4000 as sc, p_partkey from part),
a as (select *, sc + (w * h - 1) * 0.012::double + case when cached then 0.02::double else 0.0::double end + case when exact then 0.04::double else 0.0::double end as adj from s),
b as (select *, row_number() over (partition by anchor order by round(adj, 9) desc, w * h desc, p_partkey) as n from a)
select anchor, p_partkey, round(adj, 9) as adj from b where n = 1""")
def q63_best_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints compete at an anchor by their scores with bonuses, larger ones first on ties."""
    w, h = 1 + _p() % 3, 1 + F.col("p_size") % 2
    adj = F.round(vectors.adjusted(F.col("p_retailprice") / 4000, w, h, _p() % 2 == 0, _p() % 5 == 0), 9)
    rows = load(spark, sf_dir, "part").select(F.floor(_p() / 4).alias("anchor"), "p_partkey", adj.alias("adj"), (w * h).alias("area"))
    return ranking.top_n(rows, ["anchor"], [F.desc("adj"), F.desc("area"), F.col("p_partkey")], 1).select("anchor", "p_partkey", "adj")


@query("""with s as (select l_orderkey as cell_id, l_linenumber as template, max(l_discount) as score from lineitem group by 1, 2), m as (select l_orderkey as cell_id, l_linenumber as template, max(l_tax) as b from lineitem where l_partkey % 2 = 0 group by 1, 2)
select cell_id, template, greatest(score, coalesce(b, score)) as score from s left join m using (cell_id, template)""")
def q64_shift_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").alias("template"), "l_discount", "l_tax", "l_partkey")
    scores = lines.groupBy("cell_id", "template").agg(F.max("l_discount").alias("score"))
    return vectors.shift_rescue(scores, lines.filter("l_partkey % 2 = 0").select("cell_id", "template", F.col("l_tax").alias("score")))


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'auto' when p_partkey % 5 = 0 then 'persisted' else 'fallback' end as src, case when p_partkey % 3 = 0 then p_size * 1.0::double when p_partkey % 5 = 0 then 50.0::double else 63.0::double end as cell_w from part""")
def q65_resolve_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lambda w: F.struct(w.cast("double").alias("cell_w"))
    found = panels.resolve_grid(F.when(_p() % 3 == 0, grid(F.col("p_size"))), F.when(_p() % 5 == 0, grid(F.lit(50.0))), grid(F.lit(63.0)))
    return load(spark, sf_dir, "part").select("p_partkey", found.alias("r")).select("p_partkey", "r.src", F.col("r.grid.cell_w").alias("cell_w"))


@query("""with l as (select p_partkey as id, lower(p_name) as q, 1 + p_size % 3 as fw, 1 + p_partkey % 2 as fh from part), i as (select s_suppkey as item_id, lower(s_name) as a, lower(s_name || ' bolt') as b, 1 + s_suppkey % 3 as w, 1 + s_suppkey % 2 as h from supplier),
s as (select id, q, fw as w, fh as h, 0 as side from l union all select id, q, fh, fw, 1 from l where fw <> fh), k as (select item_id, a as key, w, h, 0 as k from i union all select item_id, b, w, h, 1 from i),
p as (select id, item_id, key, side, k, round((1 - levenshtein(q, key) / greatest(length(q), length(key))::double) * 100, 6) as score from s join k using (w, h))
select id, item_id, key, score from (select *, row_number() over (partition by id order by score desc, side, item_id, k) as n from p where score >= 20) where n = 1""")
def q66_match_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    labels = load(spark, sf_dir, "part").select(_p().alias("id"), F.col("p_name").alias("text"), (1 + F.col("p_size") % 3).cast("long").alias("fw"), (1 + _p() % 2).alias("fh"))
    items = load(spark, sf_dir, "supplier").select(s.alias("item_id"), F.concat("s_name", F.lit(" bolt")).alias("name"), F.col("s_name").alias("shortName"), (1 + s % 3).alias("width"), (1 + s % 2).alias("height"), s.alias("pos"))
    near = lambda a, b: F.round((1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)).cast("double")) * 100, 6)
    return lookup.match_labels(labels, items, 20.0, near).select("id", "item_id", "key", "score")


@query("""with x as (select p_partkey, p_partkey % 4 = 0 as agrees, p_size * 2.0::double as score, p_name as text, p_partkey % 3 <> 0 as contained, p_partkey % 5 = 0 as exact, case p_partkey % 3 when 0 then 'full' when 1 then 'agree' else 'full' end as mode,
 (p_size % 11 - 1) / 10.0::double as share, 1 + p_partkey % 2 as w from part), y as (select *, case when p_partkey % 6 = 0 then substr(text, 1, 3) else text end as label from x)
select p_partkey, case when agrees then score >= 78 when mode <> 'full' then false when length(label) <= 3 then score >= 99 else score >= case when exact then 99 else 84 end and contained end as accepted, share >= 0 and (share >= 0.72::double or w = 1) as fits from y""")
def q67_label_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(_p() % 6 == 0, F.substring("p_name", 1, 3)).otherwise(F.col("p_name"))
    accepted = geometry.label_accepted(_p() % 4 == 0, F.col("p_size") * 2.0, label, _p() % 3 != 0, _p() % 5 == 0, F.when(_p() % 3 == 1, "agree").otherwise("full"))
    fits = geometry.footprint_fits((F.col("p_size") % 11 - 1) / 10.0, 1 + _p() % 2, F.lit(1))
    return load(spark, sf_dir, "part").select("p_partkey", accepted.alias("accepted"), fits.alias("fits"))
