"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larch.llm import licences, mixing, neardup, neighbours, pieces, quality, scoring, secrets, sharding, substrings
from larch.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat", "n_maximal_repeats")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(licences.document_files(table(spark, sf_dir, "documents")))
    return found.select(F.col("row.doc_id").alias("doc_id"), *(c for c in found.columns if c != "row"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pieces.decode(pieces.encode(docs))
    return out.select("doc_id", "n_tokens", "ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), F.length("decoded").cast("long").alias("decoded_chars"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors.filter("vec_id % 50 = 0"), vectors)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("is_secret", F.col("score") >= secrets.THRESHOLD)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_licence_scan, op3_lm_scoring, op4_sentencepiece, op5_minhash_neardup, op6_nearest_neighbours, op7_mixing, op8_sharding, op9_substring_dedup, op10_secret_scan)
}

_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

SQL: dict[str, str] = {
    "op1_quality_rules": f"""with t as (select doc_id, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w from documents),
n as (select *, len(w) as n_words, greatest({quality.LONGEST_WORDS}, cast(floor({quality.LONGEST_SHARE}::double * len(w)) as bigint)) as most from t),
five as (select doc_id, s, count(*) over (partition by doc_id, array_to_string(w[s + 1 : s + 5], ' ')) as c from (select doc_id, w, unnest(range(0, len(w) - 4)) as s from n)),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(s, s + 5)) as p from five where c > 1) group by doc_id),
long_ as (select doc_id from (select doc_id, array_to_string(w[s + 1 : s + most + 1], ' ') as x from (select doc_id, w, most, unnest(range(0, len(w) - most)) as s from n where len(w) > most)) group by doc_id, x having count(*) > 1),
lines as (select doc_id, count(*) - count(distinct l) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as l from t) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id),
b as (select n.doc_id, n_words, cast(length(text) - length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars, cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from n left join lines using (doc_id) left join rep using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and doc_id not in (select doc_id from long_) as kept from b""",
    "op5_minhash_neardup": f"""with recursive t as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
sh as (select distinct doc_id, array_to_string(w[s + 1 : s + 5], ' ') as x from (select doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) as s from t where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b using (x) where a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from pairs join n p on a = p.doc_id join n q on b = q.doc_id where 100 * c >= 75 * (p.n + q.n - c)),
reach(a, b) as (select doc_id, doc_id from t union select reach.a, link.b from reach join link on reach.b = link.a),
low as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from low left join n using (doc_id)""",
    "op6_nearest_neighbours": """with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null),
u as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e)) as score from u q join u c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, cast(n as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s) where n <= 5""",
    "op9_substring_dedup": f"""with t as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
win as (select doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') as x from (select doc_id, w, unnest(range(0, len(w) - 19)) as s from t)),
later as (select doc_id, s from (select *, row_number() over (partition by x order by doc_id, s) as n from win) where n > 1),
lost as (select distinct doc_id, unnest(range(s, s + 20)) as p from later),
kept as (select doc_id, string_agg(v, ' ' order by p) as k, count(*) as n from (select doc_id, unnest(w) as v, unnest(range(0, len(w))) as p from t) anti join lost using (doc_id, p) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from t left join kept using (doc_id)""",
}
