"""The named queries over the driver's tables, and the same in SQL.

Stand-ins for the domain: an item is a part, an offer a line item, a task an order, a requirement a line,
an observation or template an embedding, a series the hourly events of a type.  Every query runs over
its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larch.functions import hashing, pricing, text, versions
from larch.functions.basics import or_else
from larch.operators import claims, identity, keeplist, lookup, offers, protection, ranking, requirements, series, vectors
from larch.sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Versions that q31 compares.
VERSION_PAIRS = (("0.4.0", "0.3.1"), ("0.3.1", "0.3.1"), ("0.3.0", "0.3.1"), ("v0.4.0", "0.3.1"), ("0.4", "0.3.1"), ("0.3", "0.3.1"), ("V1.0.0-beta1", "0.9"), ("garbage", "0.1"), ("1.0", ""), ("1.2.3.4", "1.2.3"), ("10.0", "9.9.9"), ("1.0.0", "1"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _market(part: DataFrame) -> DataFrame:
    """Base, lowest and average market price in cents; some are 0, some null."""
    base = F.round(F.col("p_retailprice") * 100).cast("long")
    return part.select(
        "p_partkey", base.alias("base"), F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(base + F.col("p_size") * 9000).cast("long").alias("low"),
        F.when(F.col("p_partkey") % 5 == 0, None).otherwise(base + F.col("p_size") * 8000).cast("long").alias("average"),
    )


_MARKET_SQL = """market as (select p_partkey, base, case when p_partkey % 7 = 0 then 0 else base + p_size * 9000 end as low,
  case when p_partkey % 5 = 0 then null else base + p_size * 8000 end as average
  from (select *, cast(round(p_retailprice * 100) as bigint) as base from part))"""
_OFFERS_SQL = """offers as (select l_partkey, 'S' || l_suppkey as vendor, cast(floor(l_extendedprice * 100 / l_quantity) as bigint) as price,
  l_suppkey, l_orderkey, l_linenumber from lineitem),
best as (select l_partkey, vendor as trader_name, price as trader_price from (select *, row_number() over (partition by l_partkey
  order by price desc, l_orderkey, l_linenumber, vendor desc) as n from offers where l_suppkey <> 0 and price > 0) where n = 1)"""
_LISTED = "case when {t} <= 420 then greatest(1, {t} - 1) else {t} - (({t} - 420) % 1000) end"
_FEE = "case when {b} = 0 or {p} = 0 then 0 else cast(round_even({b} * 0.03::double * pow(4.0::double, log10({b}::double / {p})) + {p} * 0.03::double * pow(4.0::double, log10({p}::double / {b})), 0) as bigint) end"


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    rows = lines.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("vendor"), F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long").alias("price"))
    return offers.best_offers(rows, "l_partkey", "vendor", "price", ["l_orderkey", "l_linenumber"], F.col("l_suppkey") == 0)


@query(f"""with {_MARKET_SQL}, {_OFFERS_SQL},
a as (select p_partkey, base, coalesce(nullif(low, 0), average, 0) as market, trader_name, coalesce(trader_price, 0) as trader_price
  from market left join best on p_partkey = l_partkey),
b as (select *, {_LISTED.format(t="market")} as listed from a),
c as (select *, listed - {_FEE.format(b="base", p="listed")} as net, market <> 0 and trader_price <> 0 as known from b)
select p_partkey, trader_name, trader_price, case when known then listed end as flea_list, case when known then net end as flea_net,
 case when known and net - trader_price >= 10000 then 'flea' else 'trader' end as recommend,
 case when market = 0 then 'No flea data' when trader_price = 0 then 'No trader data'
  when net - trader_price >= 10000 then '+' || format('{{:,}}', net - trader_price) || ' over trader after fees'
  else 'Flea net ' || format('{{:,}}', net) || ' not 10k+ above trader' end as reason from c""")
def q01_sell_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _market(load(spark, sf_dir, "part")).join(_best(spark, sf_dir), F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select("p_partkey", pricing.recommendation("base", "low", "average", "trader_name", "trader_price").alias("r")).select("p_partkey", "r.*")


@query(f"with {_OFFERS_SQL} select l_partkey, trader_name, trader_price from best")
def q02_best_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


@query(f"""with {_MARKET_SQL}, a as (select p_partkey, base, base + p_size_ * 137 - 60000 as target from (select m.*, p.p_size as p_size_ from market m join part p using (p_partkey))),
b as (select *, {_LISTED.format(t="target")} as list_price from a)
select p_partkey, target, list_price, {_FEE.format(b="base", p="list_price")} as fee from b""")
def q03_fee_and_list_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    base = F.round(F.col("p_retailprice") * 100).cast("long")
    rows = part.select("p_partkey", base.alias("base"), (base + F.col("p_size") * 137 - 60000).alias("target"))
    rows = rows.withColumn("list_price", pricing.list_price("target"))
    return rows.select("p_partkey", "target", "list_price", pricing.listing_fee("base", "list_price").alias("fee"))


_INDEX_SQL = """idx as (select key, item_id, ord from (select *, row_number() over (partition by key order by ord desc) as n from (
  select lower(p_name) as key, p_partkey as item_id, p_partkey * 2 as ord from part union all
  select lower(p_brand) || '-' || (p_partkey % 900), p_partkey, p_partkey * 2 + 1 from part)) where n = 1)"""


def _index(part: DataFrame) -> DataFrame:
    items = part.select("p_partkey", "p_name", F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % 900).cast("string")).alias("short"), F.col("p_partkey").alias("pos"))
    return lookup.name_index(items, "p_partkey", "p_name", "short", "pos")


@query(f"with {_INDEX_SQL} select * from idx")
def q04_name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(load(spark, sf_dir, "part"))


def _needs(spark: SparkSession, sf_dir: str, required_only: bool, second: bool) -> DataFrame:
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    item = [F.col("l_partkey").cast("string").alias("item_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"), F.lit("").alias("shortName")]
    count = F.col("l_quantity").cast("long").alias("count")
    open_ = F.col("o_orderstatus") != "F"
    active = open_ & (F.col("o_orderpriority") == "1-URGENT") if required_only else open_
    tasks = lines.join(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        *item, F.lit("task").alias("type"), F.col("l_orderkey").cast("string").alias("source_id"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("source"),
        count, (F.col("l_returnflag") == "R").alias("fir"), active.alias("active"), key.alias("ord"),
    )
    if not second:
        return tasks
    stations = lines.filter("l_linestatus = 'O'").select(
        *item, F.lit("hideout").alias("type"), F.col("l_suppkey").cast("string").alias("source_id"), F.concat(F.lit("Station "), F.col("l_suppkey").cast("string")).alias("source"),
        count, F.lit(False).alias("fir"), (F.col("l_suppkey") % 2 == 0).alias("active"), (key + 1_000_000_000_000).alias("ord"),
    )
    return tasks.unionByName(stations)


_NEEDS_SQL = """needs as (select l_partkey::varchar as item_id, 'part ' || l_partkey as name, 'Order ' || l_orderkey as source, cast(l_quantity as bigint) as cnt,
  l_returnflag = 'R' as fir, o_orderstatus <> 'F'{0} as active, l_orderkey * 10 + l_linenumber as ord from lineitem join orders on l_orderkey = o_orderkey{1})"""
_SECOND = """ union all select l_partkey::varchar, 'part ' || l_partkey, 'Station ' || l_suppkey, cast(l_quantity as bigint), false, l_suppkey % 2 = 0,
  l_orderkey * 10 + l_linenumber + 1000000000000 from lineitem where l_linestatus = 'O'"""
_AGG_SQL = """agg as (select item_id, any_value(name) as name, cast(coalesce(sum(cnt) filter (active), 0) as bigint) as total_needed, cast(coalesce(sum(cnt) filter (active and fir), 0) as bigint) as fir_needed,
  count(*) filter (active) as n_sources, min(ord) as first_ord, min(source || chr(0)) as unused, arg_min(source, ord) filter (active) as first_source,
  string_agg(source || ' x' || cnt || case when fir then '!' else '' end, '; ' order by ord, source, cnt, fir) filter (active) as listed from needs group by item_id having coalesce(sum(cnt) filter (active), 0) > 0)"""
_HAVE_SQL = "have as (select p_partkey::varchar as item_id, cast(p_size * 10 as bigint) as have from part where p_partkey % 3 <> 0)"


def _have(part: DataFrame) -> DataFrame:
    return part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("item_id"), (F.col("p_size") * 10).cast("long").alias("have"))


@query(f"with {_NEEDS_SQL.format(chr(32) + "and o_orderpriority = '1-URGENT'", '')}, {_AGG_SQL} select item_id, name, total_needed, fir_needed, cast(n_sources as int) as n_sources from agg")
def q05_required_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = requirements.outstanding(_needs(spark, sf_dir, True, False))
    return out.select("item_id", "name", "total_needed", "fir_needed", F.size("sources").alias("n_sources"))


@query(f"with {_NEEDS_SQL.format('', _SECOND)}, {_AGG_SQL}, {_HAVE_SQL} select item_id, total_needed, fir_needed, coalesce(have, 0) as have, greatest(0, total_needed - coalesce(have, 0)) as remaining, first_ord from agg left join have using (item_id)")
def q06_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = requirements.outstanding(_needs(spark, sf_dir, False, True), _have(load(spark, sf_dir, "part")))
    return requirements.by_remaining(out).select("item_id", "total_needed", "fir_needed", "have", "remaining", "first_ord")


@query(f"with {_NEEDS_SQL.format('', _SECOND)}, {_AGG_SQL} select item_id, listed from agg")
def q07_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = requirements.outstanding(_needs(spark, sf_dir, False, True))
    one = lambda s: F.concat(s["name"], F.lit(" x"), s["count"].cast("string"), F.when(s["fir"], "!").otherwise(""))
    return out.select("item_id", F.array_join(F.transform("sources", one), "; ").alias("listed"))


@query(f"""with {_NEEDS_SQL.format('', _SECOND)}, {_AGG_SQL}, {_HAVE_SQL},
kept as (select p_partkey::varchar as item_id, p_brand = 'Brand#4' as fir_only from part where p_size <= 5 and p_partkey % 2 <> 0),
short as (select item_id, 'Needed: ' || first_source || ' (×' || total_needed || ')' || case when n_sources > 1 then ' +' || (n_sources - 1) || ' more' else '' end as reason,
  fir_needed >= total_needed and total_needed > 0 as fir_only from agg left join have using (item_id) where coalesce(have, 0) < total_needed)
select coalesce(k.item_id, s.item_id) as item_id, case when k.item_id is not null then 'On keep list' else s.reason end as reason,
 case when k.item_id is not null then k.fir_only else s.fir_only end as fir_only from kept k full join short s on k.item_id = s.item_id""")
def q08_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    kept = part.filter("p_size <= 5").select(F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_brand") == "Brand#4", protection.COLLECTOR).otherwise("manual").alias("category_id"), (F.col("p_partkey") % 2 == 0).alias("acquired"))
    return protection.protected(kept, requirements.outstanding(_needs(spark, sf_dir, False, True), _have(part)))


def _entries(part: DataFrame) -> DataFrame:
    p, kind = F.col("p_partkey"), F.col("p_partkey") % 4
    code = F.concat("p_brand", F.lit("-"), (p % 900).cast("string"))
    return part.select(
        p.alias("id"), p.alias("pos"), F.when(kind == 0, F.upper("p_name")).otherwise(F.concat(F.lit("unknown "), p.cast("string"))).alias("name"),
        F.when(kind == 1, p).when(kind == 2, p + 100_000_000).cast("long").alias("tdev_id"),
        F.when(kind == 3, F.array(F.upper(code), F.lit("abc"))).when(kind == 2, F.array(code, F.col("p_name"))).otherwise(F.array(F.lit("nothing like it"))).alias("aliases"),
    )


_CASCADE_SQL = f"""{_INDEX_SQL}, entries as (select p_partkey as id, case when p_partkey % 4 = 0 then upper(p_name) else 'unknown ' || p_partkey end as name,
  case p_partkey % 4 when 1 then p_partkey when 2 then p_partkey + 100000000 end as tdev_id,
  case p_partkey % 4 when 3 then [upper(p_brand) || '-' || (p_partkey % 900), 'abc'] when 2 then [p_brand || '-' || (p_partkey % 900), p_name] else ['nothing like it'] end as aliases from part),
hits as (select id, min(item_id) as lo, max(item_id) as hi from (select id, unnest(aliases) as alias from entries) join idx on lower(alias) = key where length(alias) >= 4 group by id),
found as (select e.id, x.item_id as exact, k.item_id as known, case when lo = hi then lo end as alias from entries e left join idx x on lower(e.name) = x.key
  left join (select distinct item_id from idx) k on e.tdev_id = k.item_id left join hits using (id))"""


@query(f"with {_CASCADE_SQL} select id, coalesce(exact, known, alias) as item_id, case when exact is not null then 'exact' when known is not null then 'id' when alias is not null then 'alias' end as how from found")
def q09_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return lookup.resolve(_entries(part), _index(part)).select("id", "item_id", "how")


@query("""with q as (select distinct lower(p_name) as q from part), k as (select distinct lower(p_brand || ' ' || p_name) as k from part),
g as (select q, unnest(list_distinct(list_transform(range(1, length(q)), lambda i: substr(q, i, 2)))) as g from q),
h as (select k, unnest(list_distinct(list_transform(range(1, length(k)), lambda i: substr(k, i, 2)))) as g from k),
p as (select distinct q, k from g join h using (g)),
s as (select q, k, round((1 - levenshtein(q, k) / greatest(length(q), length(k))::double) * 100, 6) as score from p)
select q as id, k as key, score from (select *, row_number() over (partition by q order by score desc, k) as n from s where score >= 50) where n = 1""")
def q10_fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    queries = part.select(F.lower("p_name").alias("id")).distinct().withColumn("name", F.col("id"))
    keys = part.select(F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("key")).distinct().select("key", F.col("key").alias("item_id"), F.col("key").alias("ord"))
    near = lambda a, b: F.round((1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)).cast("double")) * 100, 6)
    return lookup.fuzzy_lookup(queries, keys, 50.0, near).select("id", "key", "score")


@query("""with t as (select p_partkey, substr(p_name, 1, 1 + p_partkey % 9) || case when p_partkey % 5 = 0 then ' zz' else '' end as read, p_brand || ' ' || p_name as ref from part),
w as (select p_partkey, read, list_filter(regexp_split_to_array(lower(read), '[^a-z0-9]+'), lambda x: length(x) >= 2) as a, list_filter(regexp_split_to_array(lower(ref), '[^a-z0-9]+'), lambda x: x <> '') as b from t)
select p_partkey, read, len(a) > 0 and len(list_filter(a, lambda x: len(list_filter(b, lambda y: starts_with(y, x))) = 0)) = 0 as contained from w""")
def q11_token_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    read = F.concat(F.expr("substr(p_name, 1, cast(1 + p_partkey % 9 as int))"), F.when(p % 5 == 0, " zz").otherwise(""))
    rows = load(spark, sf_dir, "part").select("p_partkey", read.alias("read"), F.concat_ws(" ", "p_brand", "p_name").alias("ref"))
    return rows.select("p_partkey", "read", text.tokens_contained("read", "ref").alias("contained"))


@query("select p_partkey, p_type from part where not (p_type in ('PROMO', 'SMALL') or split_part(p_name, ' ', 2) in ('bolt', 'gear'))")
def q12_target_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array("p_type", F.element_at(F.split("p_name", " "), 2))
    excluded = F.array(*[F.lit(x) for x in ("PROMO", "SMALL", "bolt", "gear")])
    return load(spark, sf_dir, "part").filter(~F.arrays_overlap(types, excluded)).select("p_partkey", "p_type")


_HASH_SQL = """chars as (select id, string_split(s, '') as c from src), halves as (select id, list_transform(list_filter(range(len(c)), lambda i: i % 2 = 0), lambda i: c[i + 1]) as e, list_transform(list_filter(range(len(c)), lambda i: i % 2 = 1), lambda i: c[i + 1]) as o from chars),
h as (select id, list_reduce(list_transform(list_prepend('', e), lambda x: case when x = '' then 5381::bigint else unicode(x)::bigint end), lambda a, x: xor((a * 33) & 4294967295, x)) as a,
  list_reduce(list_transform(list_prepend('', o), lambda x: case when x = '' then 5381::bigint else unicode(x)::bigint end), lambda a, x: xor((a * 33) & 4294967295, x)) as b from halves),
low as (select id, (a + b * 1566083941) & 4294967295 as u from h), signed as (select id, case when u >= 2147483648 then u - 4294967296 else u end as hash from low)"""


@query(f"""with src as (select page_id as id, url as s from pages), {_HASH_SQL}, x as (select id, hash, xor(17::bigint, xor(hash, 0::bigint)) & 4294967295 as u from signed)
select id as page_id, hash, case when u >= 2147483648 then u - 4294967296 else u end as item_hash from x""")
def q13_string_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", hashing.string_hash("url").alias("hash"), hashing.PROVIDERS["item"]("url").alias("item_hash"))


def _hashed(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    h = (F.col("p_partkey") * 31) % 1511
    items = part.select(h.alias("hash"), F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("pos"))
    index = part.filter("p_partkey % 3 <> 1").select(h.alias("hash")).distinct().withColumn("file_number", F.col("hash") % 300)
    return items, index


_EXACT_SQL = """items as (select (p_partkey * 31) % 1511 as hash, p_partkey as item_id from part), idx as (select distinct (p_partkey * 31) % 1511 as hash from part where p_partkey % 3 <> 1),
single as (select hash, min(item_id) as item_id from items group by hash having count(*) = 1),
exact as (select hash % 300 as file_number, max(item_id) as item_id from single join idx using (hash) group by 1 having count(*) % 2 = 1)"""


@query(f"with {_EXACT_SQL} select * from exact")
def q14_exact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.exact_map(*_hashed(load(spark, sf_dir, "part")))


@query("with items as (select (p_partkey * 31) % 1511 as hash from part), c as (select hash, count(*) as items from items group by 1) select items, count(*) as hashes from c group by 1")
def q14b_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.collisions(_hashed(load(spark, sf_dir, "part"))[0])


@query("with items as (select distinct (p_partkey * 31) % 1511 as hash from part), idx as (select distinct (p_partkey * 31) % 1511 as h from part where p_partkey % 3 <> 1) select count(*) as total, count(h) as hits from items left join idx on hash = h")
def q14c_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.probe(*_hashed(load(spark, sf_dir, "part")))


@query("""with x as (select doc_id, quality, toxic, (doc_id % 100) / 100.0::double as score, doc_id % 11 = 0 as preset, doc_id % 13 = 0 as unknown from labels), d as (select count(*) as n from documents),
a as (select count(*) as n, count(*) filter (not preset and not unknown and score >= 0.86) as overlap, count(*) filter (not preset and not unknown and score >= 0.86 and quality = toxic) as agree from x),
b as (select coalesce(agree / nullif(overlap, 0)::double, 0) as agreement, overlap, coalesce(a.n / nullif(d.n, 0)::double, 0) as coverage from a, d)
select *, agreement >= 0.95 and overlap >= 50 and coverage >= 0.05 as enabled from b""")
def q15_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    n = load(spark, sf_dir, "documents").count()
    visual = labels.select(F.col("doc_id").alias("key"), F.col("toxic").alias("item_id"), ((F.col("doc_id") % 100) / 100.0).alias("score"), (F.col("doc_id") % 11 == 0).alias("preset"), (F.col("doc_id") % 13 == 0).alias("unknown"))
    return identity.gate(labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("item_id")), visual, n)


@query("""with t as (select doc_id % 7 as image, doc_id as row, max(quality) as t, count(*) as n from labels group by 1, 2),
d as (select image, row, max(v) as d from (select doc_id % 7 as image, case when doc_id % 5 = 0 then doc_id + 1000000000 else doc_id end as row, toxic as v from labels where doc_id % 3 <> 0) group by 1, 2),
b as (select coalesce(t.image, d.image) as image, t.t, t.n, d.d from t full join d on t.image = d.image and t.row = d.row),
r as (select image, cast(coalesce(sum(n), 0) as bigint) as n, count(*) filter (t = d) as tp, count(*) filter (t <> d) as wrong, count(*) filter (t is not null and d is null) as fn, count(*) filter (t is null and d is not null) as fp from b group by rollup(image))
select *, coalesce(tp / nullif(n, 0)::double, 0) as accuracy, coalesce(tp / nullif(tp + wrong + fp, 0)::double, 0) as precision, coalesce(tp / nullif(tp + wrong + fn, 0)::double, 0) as recall from r""")
def q16_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.score(*_judged(load(spark, sf_dir, "labels")))


def _judged(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth and detections by image from the two labels: some rows are undetected, some detected elsewhere."""
    image, d = (F.col("doc_id") % 7).alias("image"), F.col("doc_id")
    truth = labels.select(image, d.alias("row"), F.lit(0).alias("col"), F.col("quality").alias("item_id"))
    found = labels.filter("doc_id % 3 <> 0").select(image, F.when(d % 5 == 0, d + 1_000_000_000).otherwise(d).alias("row"), F.lit(0).alias("col"), F.col("toxic").alias("item_id"))
    return truth, found


@query("""with t as (select doc_id % 7 as image, doc_id as row, max(quality) as want from labels group by 1, 2),
d as (select image, row, max(v) as got from (select doc_id % 7 as image, case when doc_id % 5 = 0 then doc_id + 1000000000 else doc_id end as row, toxic as v from labels where doc_id % 3 <> 0) group by 1, 2),
b as (select coalesce(t.image, d.image) as image, coalesce(t.row, d.row) as row, 0 as col, want, got from t full join d on t.image = d.image and t.row = d.row),
k as (select *, case when got is null then 'missed' when want is null then 'extra' else 'wrong' end as kind from b where got is null or want is null or got <> want)
select * from (select *, cast(row_number() over (partition by image order by row) as int) as place from k) where place <= 40""")
def q85_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.failures(*_judged(load(spark, sf_dir, "labels")))


def _templates(emb: DataFrame, masked: bool) -> DataFrame:
    """A catalogue of one template by label: its first vector."""
    vec = F.col("embedding").cast("array<double>")
    rows = emb.groupBy("label").agg(F.min(F.struct("vec_id", vec.alias("vec"))).alias("m")).select(F.col("m.vec_id").alias("template"), F.col("label").alias("item_id"), F.col("m.vec").alias("vec"))
    mask = F.transform("vec", lambda x: F.when(F.abs(x) > 0.05, 1.0).otherwise(0.0) if masked else F.lit(1.0))
    return rows.withColumn("mask", mask).withColumn("w", F.lit(1)).withColumn("h", F.lit(1))


def _cells(emb: DataFrame) -> DataFrame:
    return emb.select(F.col("vec_id").cast("string").alias("cell_id"), F.lit(1).alias("w"), F.lit(1).alias("h"), F.col("embedding").cast("array<double>").alias("vec"))


def _ncc_sql(mask: str) -> str:
    return f"""tpl as (select arg_min(vec_id, vec_id) as template, label as item_id, arg_min(embedding, vec_id)::double[] as t from embeddings group by label),
tm as (select *, list_transform(t, lambda x: {mask}) as m from tpl), tn as (select *, list_sum(m) as c from tm where list_sum(m) >= 16),
tc as (select template, item_id, m, c, list_transform(range(1, len(t) + 1), lambda i: m[i] * (t[i] - list_dot_product(t, m) / greatest(c, 1.0))) as u from tn),
tu as (select template, item_id, m, c, list_transform(u, lambda x: x / case when sqrt(list_dot_product(u, u)) > 1e-6 then sqrt(list_dot_product(u, u)) else 1.0 end) as u from tc),
cells as (select vec_id as cell_id, embedding::double[] as v, list_transform(embedding::double[], lambda x: x * x) as vv from embeddings),
s as (select cell_id, template, item_id, round(list_dot_product(u, v) / sqrt(greatest(list_dot_product(m, vv) - list_dot_product(m, v) * list_dot_product(m, v) / greatest(c, 1.0), 1e-6)), 6) as score from cells, tu)"""


_MARGIN_SQL = """i as (select cell_id, item_id, max(score) as score from s group by 1, 2), r as (select *, row_number() over (partition by cell_id order by score desc, item_id) as n from i),
best as (select cell_id, max(item_id) filter (n = 1) as item_id, max(score) filter (n = 1) as score, round(max(score) filter (n = 1) - coalesce(max(score) filter (n = 2), 0), 6) as margin from r group by cell_id)"""


@query(f"with {_ncc_sql('1.0')}, {_MARGIN_SQL} select cell_id, item_id::varchar as item_id, score, margin from best")
def q17_best_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings")
    scores = vectors.score_cells(_cells(emb), _templates(emb, False), top_items=2).withColumn("score", F.round("score", 6))
    return ranking.best_with_margin(scores, "cell_id").select(F.col("cell_id").cast("long").alias("cell_id"), "item_id", "score", F.round("margin", 6).alias("margin"))


@query(f"""with {_ncc_sql('case when abs(x) > 0.05 then 1.0 else 0.0 end')}, {_MARGIN_SQL}
select cell_id, item_id::varchar as item_id, score, margin, score >= 0.35 and (margin >= 0.04 or (cell_id % 2 = 0 and score >= 0.75)) as accepted from best""")
def q18_masked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings")
    scores = vectors.score_cells(_cells(emb), _templates(emb, True), top_items=2).withColumn("score", F.round("score", 6))
    best = ranking.best_with_margin(scores, "cell_id").select(F.col("cell_id").cast("long").alias("cell_id"), "item_id", "score", F.round("margin", 6).alias("margin"))
    return best.withColumn("accepted", vectors.accepted(F.col("score"), F.col("margin"), F.lit(0.35), F.col("cell_id") % 2 == 0))


@query("""with v as (select vec_id as id, embedding::double[] as v, list_transform(embedding::double[], lambda x: case when abs(x) > 0.01 then 1.0::double else 0.0::double end) as m from embeddings),
p as (select *, list_transform(range(0, len(v) // 4), lambda i: (v[4 * i + 1] + v[4 * i + 2] + v[4 * i + 3] + v[4 * i + 4]) / 4) as p from v), c as (select *, list_transform(p, lambda x: x - list_sum(p) / len(p)) as f from p),
u as (select id, v, m, list_transform(f, lambda x: x / case when sqrt(list_dot_product(f, f)) > 1e-6 then sqrt(list_dot_product(f, f)) else 1.0::double end) as u from c),
near as (select q.id, r.id as rid, row_number() over (partition by q.id order by round(list_dot_product(q.u, r.u), 9) desc, r.id) as place from u q join u r on len(q.v) = len(r.v) and q.id <> r.id where q.id % 20 = 0),
pair as (select n.id, n.rid, place, a.v as va, b.v as vb, list_transform(range(1, len(a.m) + 1), lambda i: a.m[i] * b.m[i]) as k from near n join v a on n.id = a.id join v b on n.rid = b.id where place <= 12),
flat as (select *, list_transform(range(1, len(k) + 1), lambda i: k[i] * (va[i] - list_dot_product(va, k) / greatest(list_sum(k), 1))) as x, list_transform(range(1, len(k) + 1), lambda i: k[i] * (vb[i] - list_dot_product(vb, k) / greatest(list_sum(k), 1))) as y from pair),
s as (select id, rid, place, case when list_sum(k) < 32 or sqrt(list_dot_product(x, x)) < 1e-6 or sqrt(list_dot_product(y, y)) < 1e-6 then -1 else list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) end as score from flat),
b as (select *, row_number() over (partition by id order by round(score, 9) desc, place) as n from s where round(score, 9) > -1)
select v.id, rid as match_id, round(coalesce(score, -1), 6) as score, case when score >= 0.86 then 'strong' when score >= 0.55 then 'preset' else 'unknown' end as kind from v left join b on b.id = v.id and n = 1 where v.id % 20 = 0""")
def q19_shortlist_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("bucket"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = emb.withColumn("mask", F.transform("vec", lambda x: F.when(F.abs(x) > 0.01, 1.0).otherwise(0.0))).withColumn("pool", vectors.pooled(F.col("vec"), 4))
    found = vectors.shortlist_rerank(rows.filter("id % 20 = 0"), rows, "bucket", unlike=True)
    return found.select("id", "match_id", F.round("score", 6).alias("score"), identity.association(F.col("score")).alias("kind"))


@query(f"with {_ncc_sql('1.0')} select cell_id, template, score, cast(n as int) as rank from (select *, row_number() over (partition by cell_id order by score desc, template) as n from s) where n <= 5")
def q20_top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings")
    scores = vectors.score_cells(_cells(emb), _templates(emb, False)).withColumn("score", F.round("score", 6))
    return ranking.top_n(scores, ["cell_id"], [F.desc("score"), F.col("template")], 5).select(F.col("cell_id").cast("long").alias("cell_id"), "template", "score", "rank")


@query("""with e as (select user_id, event_id, cast(floor(value) as bigint) % 7 - 3 as delta, 5 + sum(cast(floor(value) as bigint) % 7 - 3) over w as s from events window w as (partition by user_id order by ts, event_id rows unbounded preceding))
select user_id, event_id, delta, cast(s - least(0, min(s) over (partition by user_id order by e2.ts, event_id rows unbounded preceding)) as bigint) as balance from e join (select event_id, ts from events) e2 using (event_id)""")
def q21_clamped_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.floor("value").cast("long") % 7 - 3).alias("delta"))
    return ranking.clamped_balance(events, "user_id", [F.col("ts"), F.col("event_id")], "delta", F.lit(5)).select("user_id", "event_id", "delta", "balance")


@query("select user_id, event_id, cast(n as int) as rank from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 3")
def q22_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keep_last(load(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "rank")


@query("""with e as (select event_id, cast(date_diff('second', timestamp '1970-01-01', date_trunc('second', ts)) as bigint) as s from events)
select event_id, 1706659200 - s < 86400 as fresh, round_even((1706659200 - s) / 60.0::double, 1) as age_min from e""")
def q23_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return ranking.freshness(events, seconds, F.lit(1_706_659_200), 86_400).select("event_id", "fresh", "age_min")


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour of the month, with empty hours."""
    events = load(spark, sf_dir, "events")
    hour = F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    counts = events.select("event_type", hour.alias("pos")).groupBy("event_type", "pos").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.groupBy("event_type").agg(F.max("pos").alias("last")).select("event_type", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("pos"))
    return grid.join(counts, ["event_type", "pos"], "left").select("event_type", "pos", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


_HOURLY_SQL = """c as (select event_type, date_diff('hour', timestamp '2024-01-01', date_trunc('hour', ts)) as pos, count(*) as n from events group by 1, 2),
g as (select event_type, unnest(range(0, max(pos) + 1)) as pos from c group by 1), hourly as (select event_type, pos, coalesce(n, 0)::double as value from g left join c using (event_type, pos))"""


@query(f"""with {_HOURLY_SQL}, m as (select *, value - avg(value) over (partition by event_type) as v from hourly), l as (select unnest(range(6, 61)) as lag),
r as (select a.event_type, lag, sum(a.v * b.v) as r from m a join l on true join m b on a.event_type = b.event_type and b.pos = a.pos + lag group by 1, 2),
x as (select *, row_number() over (partition by event_type order by round(r, 6) desc, lag) as n, median(abs(r)) over (partition by event_type) as med from r)
select event_type, cast(lag as int) as lag, round(r, 6) as r, round(round(r, 6) / med, 4) as strength from x where n = 1""")
def q24_dominant_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.dominant_lag(series.autocorrelation(_hourly(spark, sf_dir), "event_type", 6, 60), "event_type")
    return found.withColumn("strength", F.round("strength", 4))


@query(f"""with {_HOURLY_SQL}, f as (select event_type, pos % 24 as phase, sum(value) as total from hourly group by 1, 2)
select event_type, phase, total from (select *, row_number() over (partition by event_type order by total desc, phase) as n from f) where n = 1""")
def q25_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.phase(_hourly(spark, sf_dir), "event_type", 24)


@query(f"""with {_HOURLY_SQL}, f as (select event_type, pos % 24 as phase, sum(value) as total from hourly group by 1, 2),
p as (select event_type, phase from (select *, row_number() over (partition by event_type order by total desc, phase) as n from f) where n = 1),
i as (select unnest(range(0, 13)) as i), j as (select unnest(range(0, 13)) as j),
combs as (select event_type, phase + j * 0.5::double - 3 as origin, 24 + i * 0.125::double - 0.75 as period, case when i = 6 and j = 6 then -1 else i * 1000 + j end as ord from p, i, j),
n as (select event_type, max(pos) + 1 as n from hourly group by 1),
pts as (select event_type, origin, period, ord, n, unnest(range(0, cast(floor((n - origin) / period) as bigint) + 1)) as k from combs join n using (event_type)),
places as (select *, cast(round_even(origin + k * period, 0) as bigint) as pos from pts),
s as (select event_type, origin, period, ord, avg(value) as m, count(*) as c from places join hourly using (event_type, pos) where pos >= 0 and pos < n group by 1, 2, 3, 4),
x as (select *, row_number() over (partition by event_type order by round(case when c >= 3 then m else -1 end, 9) desc, ord) as r from s)
select event_type, origin, period, round(m, 9) as score from x where r = 1""")
def q26_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = _hourly(spark, sf_dir)
    coarse = series.phase(hourly, "event_type", 24).select("event_type", F.lit(24.0).alias("period"), "phase")
    return series.refine(hourly, "event_type", coarse)


@query(f"""with recursive {_HOURLY_SQL}, n as (select event_type, max(pos) + 1 as n from hourly group by 1),
hops as (select event_type, unnest(range(0, (n - 72) // 24 + 1)) as w from n where n >= 72),
v as (select event_type, w, pos % 24 as ph, sum(value) as v from hops join hourly using (event_type) where pos >= 24 * w and pos < 24 * w + 72 group by 1, 2, 3),
win as (select event_type, w, list(v order by ph) as f, arg_max(ph, (v, -ph)) as peak, max(v) as top, case when median(v) > 0 then median(v) else 1 end as level from v group by 1, 2),
run(event_type, w, phase, began) as (select event_type, w, case when top / level >= 1.6 then peak end, case when top / level >= 1.6 then 0::bigint end from win where w = 0
 union all select event_type, w, case when stays then phase when starts then peak end, case when stays then began when starts then 24 * w end from (
  select win.*, r.phase, r.began, top / level >= 1.6 as starts, r.phase is not null and list_max(list_transform(range(-2, 3), lambda d: f[(r.phase + d + 24) % 24 + 1])) / level >= 1.5 as stays
  from run r join win on win.event_type = r.event_type and win.w = r.w + 1))
select event_type, began as "start", least(max(24 * w + 72), any_value(n)) as "end" from run join n using (event_type) where began is not null group by 1, 2
union all select event_type, 0::bigint, n from n where n >= 48 and n < 72""")
def q27_phase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.phase_spans(_hourly(spark, sf_dir), "event_type", 24)


@query("""with d as (select p_partkey, p_size % 3 as panel, p_partkey // 40 as row, p_partkey % 40 as col, p_retailprice > 1500 or p_partkey % 9 = 0 as keep from part)
select p_partkey, keep, case when keep then 'K' else (row_number() over (partition by keep order by panel, row, col))::varchar end as number from d""")
def q28_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("panel"), F.floor(p / 40).alias("row"), (p % 40).alias("col"), ((F.col("p_retailprice") > 1500) | (p % 9 == 0)).alias("keep"))
    return ranking.reading_order(rows).orderBy("keep", "place").select("p_partkey", "keep", "number")


@query("""with known as (select p_partkey as key, p_brand as item, p_size::double as mtime from part where p_partkey % 3 <> 0),
files as (select p_partkey as key, p_type as item, p_size + case when p_partkey % 4 = 0 then 2.0 else 0.5 end as mtime from part where p_partkey % 5 <> 0),
fresh as (select f.* from files f left join known k using (key) where k.key is null or abs(k.mtime - f.mtime) >= 1),
u as (select * from known where key not in (select key from fresh) union all select * from fresh)
select key, item, mtime::double as mtime from u where key in (select key from files)""")
def q29_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, p = load(spark, sf_dir, "part"), F.col("p_partkey")
    known = part.filter(p % 3 != 0).select(p.alias("key"), F.col("p_brand").alias("item"), F.col("p_size").cast("double").alias("mtime"))
    files = part.filter(p % 5 != 0).select(p.alias("key"), F.col("p_type").alias("item"), (F.col("p_size") + F.when(p % 4 == 0, 2.0).otherwise(0.5)).alias("mtime"))
    return ranking.upsert(known, files, ranking.changed_files(files, known, "key", "mtime"), "key")


@query("""with mine as (select s_suppkey as pos, s_suppkey::varchar as id, s_name as name, s_suppkey % 2 = 0 as acquired, case when s_suppkey % 5 = 0 then 'custom' else 'wiki' end as source from supplier),
fresh as (select upper(s_name) as name from supplier where s_suppkey % 3 <> 0 union all select 'New ' || s_suppkey from supplier where s_suppkey % 7 = 0)
select coalesce(m.name, f.name) as name, coalesce(m.acquired, false) as acquired, case when f.name is not null then 'wiki' else m.source end as source,
 case when m.name is null then 'added' when f.name is not null or m.source = 'custom' then 'kept' else 'removed' end as status from mine m full join fresh f on lower(m.name) = lower(f.name)""")
def q30_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, s = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    mine = supplier.select(F.lit(protection.COLLECTOR).alias("category_id"), s.alias("pos"), s.cast("string").alias("id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"), (s % 2 == 0).alias("acquired"), F.when(s % 5 == 0, "custom").otherwise("wiki").alias("source"), F.lit(None).cast("string").alias("tdev_id"))
    fresh = supplier.filter(s % 3 != 0).select(s.alias("pos"), F.upper("s_name").alias("name")).unionByName(supplier.filter(s % 7 == 0).select(s.alias("pos"), F.concat(F.lit("New "), s.cast("string")).alias("name")))
    return keeplist.merge_exact(mine, fresh).select("name", "acquired", "source", "status")


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in VERSION_PAIRS)


@query(f"""with v(latest, current) as (values {_PAIRS}), x as (select *, regexp_extract(trim(latest), '^[vV]?([0-9]+(?:\\.[0-9]+)*)', 1) as a, regexp_extract(trim(current), '^[vV]?([0-9]+(?:\\.[0-9]+)*)', 1) as b from v),
y as (select *, list_transform(string_split(a, '.'), lambda t: try_cast(t as bigint)) as la, list_transform(string_split(b, '.'), lambda t: try_cast(t as bigint)) as lb from x)
select latest, current, case when a = '' or b = '' then false else list_concat(la, list_transform(range(greatest(0, len(lb) - len(la))), lambda i: 0::bigint)) > list_concat(lb, list_transform(range(greatest(0, len(la) - len(lb))), lambda i: 0::bigint)) end as newer from y""")
def q31_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(list(VERSION_PAIRS), "latest string, current string")
    return pairs.withColumn("newer", versions.is_newer("latest", "current"))


@query("""with x as (select page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) as l from pages), y as (select page_id, unnest(l) as item, unnest(range(len(l))) as place from x),
z as (select page_id, cast(place as int) as place, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(item, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) as item from y)
select * from z where item <> ''""")
def q32_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.list_items(load(spark, sf_dir, "pages"), "page_id", "html")


@query("""select event_id, coalesce(nullif(event_type, ''), '?') as name, coalesce(nullif(cast(json_extract(props, '$.k') as bigint), 0), -1) as k, coalesce(cast(json_extract(props, '$.missing') as bigint), 0) as missing from events""")
def q33_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint, missing bigint"))
    return events.select("event_id", or_else("event_type", F.lit("?")).alias("name"), or_else("p.k", F.lit(-1)).cast("long").alias("k"), F.coalesce("p.missing", F.lit(0)).cast("long").alias("missing"))


@query()
def q34_greedy_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    part = load(spark, sf_dir, "part")
    at = [F.floor(p / 400).cast("string").alias("frame_id"), F.lit(0).alias("panel"), F.floor((p % 400) / 20).cast("int").alias("row"), (p % 20).cast("int").alias("col")]
    cells = part.select(*at, (F.col("p_size") > 8).alias("occupied"))
    size = lambda k: (F.lit(1) + F.pmod(F.xxhash64("p_partkey", F.lit(k)), F.lit(2))).cast("int")
    scores = part.select(*at, size(1).alias("w"), size(2).alias("h"), F.col("p_brand").alias("item_id"), ((p * 37 % 100) / 100.0).alias("score"), (F.col("p_size") / 500.0).alias("margin"), F.lit(False).alias("cached"), F.lit(False).alias("exact"), F.lit(False).alias("rotated"))
    ones = scores.withColumn("w", F.lit(1)).withColumn("h", F.lit(1)).withColumn("score", F.col("score") * 0.9).filter("margin > 0.01")
    return claims.claim(cells, scores.unionByName(ones).dropDuplicates(["frame_id", "panel", "row", "col", "w", "h"])).select("frame_id", "panel", "row", "col", "w", "h", "item_id", F.round("score", 6).alias("score"), "how")
