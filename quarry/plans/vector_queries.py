"""Queries over embeddings: similarity, clustering, topics and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import embedding as E
from quarry.session import load


def vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.format_string("v%07d", "vec_id").alias("word"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("name"))


def pair_similarity(spark, sf_dir):
    v = vectors(spark, sf_dir)
    n = F.substr("word", F.lit(2)).cast("bigint")
    pairs = v.select(F.col("word").alias("a"), F.format_string("v%07d", n + 1).alias("b"))
    return E.pair_similarity(pairs, v, F.lit(0.0)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def most_similar_words(spark, sf_dir):
    """The words of every vec_id divisible by 50."""
    v = vectors(spark, sf_dir)
    asked = v.select("word").where(F.substr("word", F.lit(2)).cast("bigint") % 50 == 0)
    return E.most_similar(v, asked, 10).select("word", "other", F.round("similarity", 6).alias("similarity"), "rank")


def similarity_histogram(spark, sf_dir):
    """All ordered pairs of different words."""
    return E.similarity_histogram_all(vectors(spark, sf_dir), 0.05).select(F.round("bin", 2).alias("bin"), "n")


def analogies(spark, sf_dir):
    """A question for every vec_id divisible by 50."""
    v = vectors(spark, sf_dir)
    w = lambda i: F.format_string("v%07d", F.col("id") + i)
    n = F.substr("word", F.lit(2)).cast("bigint")
    q = v.select(n.alias("id")).where("id % 50 = 0").select(w(0).alias("a"), w(5).alias("b"), w(10).alias("c"), w(15).alias("d"))
    return E.analogies(v, q, v.select(F.col("word").alias("name"), F.col("name").alias("cluster_id"))).select("a", "b", "c", "d", "predicted", "correct")


def near_vector_pairs(spark, sf_dir):
    return E.near_pairs(vectors(spark, sf_dir), 1.1)


def dbscan(spark, sf_dir):
    return E.dbscan(vectors(spark, sf_dir), 1.15, 3)


def kmeans(spark, sf_dir):
    return E.kmeans(vectors(spark, sf_dir), 10, 1).select("word", "cluster_id")


def kmeans_cosine(spark, sf_dir):
    return E.kmeans(vectors(spark, sf_dir), 10, 1, "cosine", 25).select("word", "cluster_id")


def bisecting_clusters(spark, sf_dir):
    return E.bisecting(vectors(spark, sf_dir), 10, 1).select("word", "cluster_id")


def random_clusters(spark, sf_dir):
    return E.random_clusters(vectors(spark, sf_dir), 10, 1).select("word", "cluster_id")


def silhouette(spark, sf_dir):
    s = E.silhouette(E.kmeans(vectors(spark, sf_dir), 10, 1))
    return spark.createDataFrame([(s,)], "silhouette double")


def classification_f1(spark, sf_dir):
    return E.classification_sweep(vectors(spark, sf_dir), "name", "vector", [x / 10 for x in range(1, 10)])


def label_map(spark, sf_dir):
    return E.project(vectors(spark, sf_dir)).select("word", "x", "y")


def word2vec(spark, sf_dir):
    return E.train_word2vec(load(spark, sf_dir, "pathbased_walks"), 16, 1, 5, 1).select("word", "vector")


def walk_topics(spark, sf_dir):
    return E.topics(load(spark, sf_dir, "pathbased_walks"), 4, 5, 1, 5)


QUERIES = {f.__name__: f for f in (pair_similarity, most_similar_words, similarity_histogram, analogies, near_vector_pairs, dbscan, kmeans, kmeans_cosine, bisecting_clusters, random_clusters, silhouette, classification_f1, label_map, word2vec, walk_topics)}

_V = "v as (select printf('v%07d', vec_id) as word, vec_id, embedding::double[] as x from embeddings), s as (select a.word, a.vec_id, v.word as other, list_cosine_similarity(a.x, v.x) as s from v a join v on a.word <> v.word)"

SQL = {
    "pair_similarity": f"with {_V} select a.word as a, printf('v%07d', a.vec_id + 1) as b, round(coalesce(list_cosine_similarity(a.x, b.x), 0), 6) as similarity from v a left join v b on b.vec_id = a.vec_id + 1",
    "most_similar_words": f"with {_V}, r as (select *, row_number() over (partition by word order by s desc, other) as rank from s where vec_id % 50 = 0) select word, other, round(s, 6) as similarity, rank::int as rank from r where rank <= 10",
    "similarity_histogram": f"with {_V} select round(floor(round(s, 9) / 0.05) * 0.05, 2) as bin, count(*)::bigint as n from s group by 1",
    "analogies": """with v as (select printf('v%07d', vec_id) as word, vec_id as id, label::varchar as name, list_transform(embedding::double[], lambda e: e / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u from embeddings),
q as (select a.word as a, b.word as b, c.word as c, d.word as d, d.name as dn, list_transform(list_zip(b.u, a.u, c.u), lambda z: z[1] - z[2] + z[3]) as goal from v a join v b on b.id = a.id + 5 join v c on c.id = a.id + 10 join (select id, word, name from v) d on d.id = a.id + 15 where a.id % 50 = 0),
s as (select a, b, c, d, dn, word, name, row_number() over (partition by a, b, c, d order by list_cosine_similarity(goal, u) desc, word desc) as r from q join v on word not in (a, b, c))
select a, b, c, d, word as predicted, coalesce(word = d or name = dn, false) as correct from s where r = 1""",
    "dbscan": f"""with recursive {_V}, near as (select a.word as a, b.word as b from v a join v b on a.word <> b.word where 2 - 2 * list_cosine_similarity(a.x, b.x) <= 1.15 * 1.15),
core as (select word from v where (select count(*) from near where a = word) + 1 >= 3), ce as (select a, b from near where a in (select word from core) and b in (select word from core)),
cc as (select word as node, word as low from core union select b, low from cc join ce on a = node), cl as (select node, min(low) as low from cc group by node),
edge as (select a, min(low) as low from near join cl on b = node group by a)
select word, coalesce(cl.low, edge.low, '') as cluster_id from v left join cl on cl.node = word left join edge on edge.a = word""",
    "near_vector_pairs": f"with {_V} select a.word as a, b.word as b from v a join v b on a.word < b.word where 2 - 2 * list_cosine_similarity(a.x, b.x) <= 1.1 * 1.1",
}
