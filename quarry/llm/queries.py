"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import clean_name_sql
from quarry.llm import clusters, cooccurrence, encoding, mixing, terms, tokens, vectors
from quarry.session import load


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(load(spark, sf_dir, "documents"), ["doc_id"], "text")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]


def p7_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the listed sources hold: small sources reach their limit and the exponent is bisected."""
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), budget_share=1.0)[0]


def p7_budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), budget_share=1.0)[1]


def p7_entropy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponent at which the shares have the entropy 1.7."""
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), target_entropy=1.7)[1]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = terms.walk_labels(load(spark, sf_dir, "pathbased_walks"))
    return terms.term_frequencies(walks, "labels").withColumnRenamed("term", "label")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).where("mark is not null").select("label", "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("label", "n_occurrences", F.col("n_records").alias("n_walks"), F.coalesce("mark", F.lit("useful")).alias("mark"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.latest_vectors(load(spark, sf_dir, "pathbased_model"), "label", "vector", "loaded_at", 64)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_pairs(vectors.most_similar(_vectors(spark, sf_dir), 5), 0.865).select("label_a", "label_b")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.most_similar(_vectors(spark, sf_dir), 5)


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.called_items(load(spark, sf_dir, "eh_context"), load(spark, sf_dir, "eh_response"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cooccurrence.Cooccurrence(_called(spark, sf_dir), "handler", "item", min_count=5, min_share=0.003).discoveries()
    case = "n_ab >= 5 and 1000 * n_ab >= 3 * n and n_ab * n >= 3 * n_a * n_b"
    return found.where("log_p <= ln(0.1)").where(case).select("item_a", "item_b")


def p3_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cooccurrence.Cooccurrence(_called(spark, sf_dir), "handler", "item").discoveries()
    return found.select("item_a", "item_b", "n_ab", "n_a", "n_b", "lift", "expected", "log_p", "q_value")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(load(spark, sf_dir, "documents"), "doc_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = clusters.cluster(_vectors(spark, sf_dir), 0.865)
    return clusters.groups_of(members, 3).select(F.col("cluster").alias("cluster_label"), "label")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups = clusters.cluster(_vectors(spark, sf_dir), 0.865)
    return groups.select(F.col("cluster").alias("cluster_label"), "size", F.round("mean_similarity", 4).alias("mean_similarity"), F.array_join("typical", " ").alias("typical"))


QUERIES = {
    "p1_found": p1_found,
    "p1_terms": p1_terms,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p3_found": p3_found,
    "p3_surprise": p3_surprise,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_budget_mix": p7_budget_mix,
    "p7_budget_shares": p7_budget_shares,
    "p7_entropy_shares": p7_entropy_shares,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}

_WALKS = f"""walks as (
  select walk_id, tokens, row_number() over () as w from pathbased_walks
  qualify row_number() over (partition by walk_id, case when walk_id is null then concat_ws('|', loaded_at::varchar, walked_at::varchar, tokens::varchar) end
    order by loaded_at desc nulls last, walked_at desc nulls last, tokens desc nulls last) = 1),
labels as (select w, {clean_name_sql("t")} as label from (select w, unnest(tokens) as t from walks)),
named as (select * from labels where label is not null),
freq as (select label, count(*)::bigint as n_occurrences, count(distinct w)::bigint as n_walks from named group by label),
marked as (select *, case when n_occurrences < 5 then 'rare'
  when n_walks > 0.25 * (select count(distinct w) from named) then 'common' end as mark from freq)"""

_VECTORS = """latest as (
  select label, vector from pathbased_model where label is not null
  qualify row_number() over (partition by label order by loaded_at desc nulls last, vector desc nulls last) = 1),
fit as (select label, vector::double[] as v from latest
  where len(vector) = 64 and list_count(vector) = 64 and not isnan(list_sum(vector))
    and not isinf(list_max(vector)) and not isinf(list_min(vector)) and (list_max(vector) <> 0 or list_min(vector) <> 0)),
sims as (select a.label as a, b.label as b, list_cosine_similarity(a.v, b.v) as s from fit a join fit b on a.label <> b.label)"""

SQL: dict[str, str] = {
    "p5_found": f"""with {_VECTORS},
near as (select a, b from sims where s >= 0.865 union all select label, label from fit),
named as (select a as label, min(b) as cluster_label, count(*) as n from near group by a)
select cluster_label, label from named where n >= 3""",
    "p2_found": f"""with {_VECTORS},
top as (select a, b, s from sims qualify row_number() over (partition by a order by s desc, b) <= 5)
select distinct least(a, b) as label_a, greatest(a, b) as label_b from top where s >= 0.865""",
    "p1_found": f"with {_WALKS} select label, mark from marked where mark is not null",
    "p1_terms": f"with {_WALKS} select label, n_occurrences, n_walks, coalesce(mark, 'useful') as mark from marked",
    "p3_found": f"""with held as (
  select distinct handler, {clean_name_sql("item")} as item
  from (select handler, item, type from eh_context union all select handler, item, type from eh_response)
  where type = 'CALL' and handler is not null),
named as (select * from held where item is not null),
total as (select count(distinct handler) as n from named),
freq as (select item, count(*) as k from named group by item),
often as (select n.* from named n join freq f on f.item = n.item, total where f.k >= 5 and 1000 * f.k >= 3 * total.n),
pairs as (select a.item as item_a, b.item as item_b, count(*) as n_ab
  from often a join often b on a.handler = b.handler and a.item < b.item group by 1, 2)
select item_a, item_b from pairs join freq fa on fa.item = item_a join freq fb on fb.item = item_b, total
where n_ab >= 5 and 1000 * n_ab >= 3 * n and n_ab * n >= 3 * fa.k * fb.k""",
}
