"""Embeddings, topics, classification and clustering of labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, CountVectorizer, Normalizer, StringIndexer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.components import connected_components
from quarry.operators.evaluate import macro_micro_f1
from quarry.session import cut


def train_word2vec(walks: DataFrame, size: int = 100, window: int = 1, min_count: int = 5, seed: int = 0, iterations: int = 1, partitions: int = 1) -> DataFrame:
    """(word, vector) by skip-gram with hierarchical softmax over ``tokens``.

    The published pipeline may use negative sampling; ranks are comparable, not numbers.
    """
    rows = walks.select(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("tokens"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, maxIter=iterations, numPartitions=partitions, inputCol="tokens", outputCol="v").fit(rows)
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; null if a vector is all zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, missing: Column | None = None) -> DataFrame:
    """(a, b, similarity) of pairs of words; ``missing`` where a vector is unknown."""
    side = lambda s: vectors.select(F.col("word").alias(s), F.col("vector").alias(f"v{s}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    s = cosine(F.col("va"), F.col("vb"))
    return both.select(*pairs.columns, (F.coalesce(s, missing) if missing is not None else s).alias("similarity"))


MOST_ASKED = 10_000


def blocks(rows: DataFrame, *keys: str) -> list[DataFrame]:
    """``rows`` in blocks of about ``MOST_ASKED`` / 2, to be sent to all executors one after the other."""
    rows = cut(rows)
    n = max(1, -(-rows.count() * 2 // MOST_ASKED))
    return [F.broadcast(rows.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i)) for i in range(n)]


def most_similar(vectors: DataFrame, words: DataFrame, k: int = 10) -> DataFrame:
    """(word, other, similarity, rank): for the given words their ``k`` most similar ones.

    The words asked for are sent to the vocabulary in blocks; it is read once
    for each block and never shuffled whole.
    """
    asked = vectors.join(words.select("word").distinct(), "word", "left_semi").select("word", F.col("vector").alias("q"))
    order = Window.partitionBy("word").orderBy(F.desc("similarity"), "other")
    out = []
    for some in blocks(asked, "word"):
        s = vectors.select(F.col("word").alias("other"), "vector").join(some, F.col("word") != F.col("other"))
        out.append(s.select("word", "other", cosine(F.col("q"), F.col("vector")).alias("similarity")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return reduce(DataFrame.unionByName, out)


def analogies(vectors: DataFrame, questions: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(a, b, c, d, predicted, correct) for a : b :: c : ?; the inputs are no answer.

    ``correct`` if the prediction is d, or shares a cluster with it.
    """
    v = lambda s: vectors.select(F.col("word").alias(s), F.transform("vector", lambda x: x / F.sqrt(dot(F.col("vector"), F.col("vector")))).alias(f"v{s}"))
    q = questions.join(v("a"), "a").join(v("b"), "b").join(v("c"), "c")
    q = q.withColumn("goal", F.zip_with(F.zip_with("vb", "va", lambda x, y: x - y), "vc", lambda x, y: x + y)).select("a", "b", "c", "d", "goal")
    other = (F.col("word") != F.col("a")) & (F.col("word") != F.col("b")) & (F.col("word") != F.col("c"))
    s = reduce(DataFrame.unionByName, [vectors.select("word", "vector").join(some, other) for some in blocks(q, "a", "b", "c", "d")])
    best = s.select("a", "b", "c", "d", "word", cosine(F.col("goal"), F.col("vector")).alias("s")).groupBy("a", "b", "c", "d").agg(F.max_by("word", F.struct("s", "word")).alias("predicted"))
    same = F.col("predicted") == F.col("d")
    if clusters is not None:
        side = lambda n: clusters.select(F.col("name").alias(n), F.col("cluster_id").alias(f"c_{n}"))
        best = best.join(side("predicted"), "predicted", "left").join(side("d"), "d", "left")
        same = same | F.coalesce(F.col("c_predicted") == F.col("c_d"), F.lit(False))
    return best.select("a", "b", "c", "d", "predicted", same.alias("correct"))


def _features(vectors: DataFrame, column: str = "vector") -> DataFrame:
    return vectors.withColumn("_raw", array_to_vector(F.col(column).cast("array<double>")))


def kmeans(vectors: DataFrame, k: int, seed: int = 0, metric: str = "euclidean", repeats: int = 1) -> DataFrame:
    """``vectors`` with cluster_id on unit vectors; of several seeds the one with the least cost."""
    data = Normalizer(inputCol="_raw", outputCol="_unit").transform(_features(vectors)).cache()
    best = None
    for r in range(repeats):
        model = KMeans(k=k, seed=seed + r, featuresCol="_unit", predictionCol="cluster_id", distanceMeasure=metric).fit(data)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    out = best[1].transform(data).drop("_raw", "_unit")
    data.unpersist()
    return out


def bisecting(vectors: DataFrame, k: int, seed: int = 0, metric: str = "cosine") -> DataFrame:
    """``vectors`` with cluster_id of a divisive hierarchy: what scales of average-linkage clustering."""
    data = Normalizer(inputCol="_raw", outputCol="_unit").transform(_features(vectors))
    return BisectingKMeans(k=k, seed=seed, featuresCol="_unit", predictionCol="cluster_id", distanceMeasure=metric).fit(data).transform(data).drop("_raw", "_unit")


def silhouette(clustered: DataFrame, column: str = "vector", metric: str = "squaredEuclidean") -> float:
    data = Normalizer(inputCol="_raw", outputCol="_unit").transform(_features(clustered, column))
    return ClusteringEvaluator(predictionCol="cluster_id", featuresCol="_unit", distanceMeasure=metric).evaluate(data)


def random_clusters(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``vectors`` with a cluster_id from 0 to k - 1 by a hash of the word."""
    return vectors.withColumn("cluster_id", F.pmod(F.xxhash64("word", F.lit(seed)), F.lit(k)).cast("int"))


def near_pairs(vectors: DataFrame, eps: float, seed: int = 0) -> DataFrame:
    """(a, b): words whose unit vectors are within ``eps``, a < b; exact.

    Words are put in cells by their distance to a few pivots: by the triangle
    inequality partners lie in the same or an adjoining ring of every pivot,
    so only neighbouring cells of the first two pivots are joined.
    """
    norm = F.sqrt(dot(F.col("vector"), F.col("vector")))
    unit = cut(vectors.where(norm > 0).select("word", F.transform("vector", lambda x: x.cast("double") / norm).alias("u")))
    pivots = [r["u"] for r in unit.orderBy(F.xxhash64("word", F.lit(seed))).limit(2).collect()]
    if len(pivots) < 2:
        return unit.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    ring = lambda p: F.floor(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(F.col("u"), F.array(*[F.lit(float(v)) for v in p])))) / eps).cast("int")
    cells = unit.withColumn("r0", ring(pivots[0])).withColumn("r1", ring(pivots[1]))
    reach = cells.select(F.col("word").alias("b"), F.col("u").alias("v"), F.explode(F.sequence(F.col("r0") - 1, F.col("r0") + 1)).alias("r0"), "r1").select("b", "v", "r0", F.explode(F.sequence(F.col("r1") - 1, F.col("r1") + 1)).alias("r1"))
    near = cells.join(reach, ["r0", "r1"]).where((F.col("word") < F.col("b")) & (2 - 2 * dot(F.col("u"), F.col("v")) <= eps * eps))
    return near.select(F.col("word").alias("a"), "b")


def dbscan(vectors: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(word, cluster_id): the least core word of the cluster; noise is one cluster named ''.

    A core point has ``min_samples`` points within ``eps``, itself included;
    border points join the least neighbouring cluster.
    """
    pairs = cut(near_pairs(vectors, eps))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = cut(vectors.select("word").join(both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n")), "word", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("word"))
    inner = both.join(core.select(F.col("word").alias("a")), "a", "left_semi").join(core.select(F.col("word").alias("b")), "b", "left_semi")
    alone = core.select(F.col("word").alias("a"), F.col("word").alias("b"))
    parts = connected_components(inner.unionByName(alone), "a", "b").select(F.col("node").alias("word"), F.col("component").alias("cluster_id"))
    edge = both.join(parts.select(F.col("word").alias("b"), "cluster_id"), "b").groupBy(F.col("a").alias("word")).agg(F.min("cluster_id").alias("edge"))
    return vectors.select("word").join(parts, "word", "left").join(edge, "word", "left").select("word", F.coalesce("cluster_id", "edge", F.lit("")).alias("cluster_id"))


def topics(walks: DataFrame, k: int, top: int = 10, seed: int = 0, iterations: int = 20) -> DataFrame:
    """(topic, term, weight): the heaviest terms of the topics over ``tokens``."""
    rows = walks.select(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("tokens")).where(F.size("tokens") > 0)
    vocabulary = rows.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t")).first()[0]
    counts = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=max(vocabulary, 1)).fit(rows)
    model = LDA(k=k, maxIter=iterations, seed=seed).fit(counts.transform(rows))
    d = model.describeTopics(top).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t"))
    d = d.select("topic", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight"))
    table = rows.sparkSession.createDataFrame(list(enumerate(counts.vocabulary)), "i int, term string")
    return d.join(table, "i").select("topic", "term", "weight")


def classify(rows: DataFrame, label: str, vector: str, train: float = 0.5, seed: int = 0) -> DataFrame:
    """The held-out rows with label and predicted (strings) by logistic regression."""
    data = rows.select(F.col(label).cast("string").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")).where("label is not null")
    fit, test = data.randomSplit([train, 1 - train], seed)
    index = StringIndexer(inputCol="label", outputCol="_y", handleInvalid="keep")
    model = Pipeline(stages=[index, LogisticRegression(labelCol="_y", maxIter=30)]).fit(fit)
    names = F.array(*[F.lit(v) for v in model.stages[0].labels])
    return model.transform(test).select("label", F.coalesce(F.get(names, F.col("prediction").cast("int")), F.lit("")).alias("predicted"))


def classification_sweep(rows: DataFrame, label: str, vector: str, fractions: list[float], seed: int = 0) -> DataFrame:
    """(train, micro, macro) for each share of training rows."""
    out = None
    for t in fractions:
        s = macro_micro_f1(classify(rows, label, vector, t, seed), "label", "predicted").withColumn("train", F.lit(t))
        out = s if out is None else out.unionByName(s)
    return out.select("train", "micro", "macro")


def project(vectors: DataFrame) -> DataFrame:
    """``vectors`` with x and y: two principal components, for a map of the labels."""
    data = _features(vectors)
    xy = vector_to_array(F.col("_xy"))
    return PCA(k=2, inputCol="_raw", outputCol="_xy").fit(data).transform(data).withColumn("x", F.get(xy, F.lit(0))).withColumn("y", F.get(xy, F.lit(1))).drop("_raw", "_xy")


BLOCK_ROWS = 1_000


def similarity_histogram_all(vectors: DataFrame, width: float = 0.05) -> DataFrame:
    """(bin, n): similarities of all ordered pairs of different words, by products of blocks of ``BLOCK_ROWS`` vectors.

    All-zero vectors have no similarity.  Words are distinct; each pair of blocks is one row of a task.
    """
    rows = vectors.select("word", F.transform("vector", lambda x: x.cast("double")).alias("v")).where(F.exists("v", lambda x: x != 0))
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    packs = cut(rows.groupBy(F.pmod(F.xxhash64("word"), F.lit(n)).alias("block")).agg(F.collect_list("v").alias("m")))
    side = lambda s: packs.select(F.col("block").alias(f"b{s}"), F.col("m").alias(f"m{s}"))

    def run(batches):
        for batch in batches:
            bins = {}
            for i, j, a, b in zip(batch["bx"], batch["by"], batch["mx"], batch["my"]):
                x, y = (np.stack(list(m)) for m in (a, b))
                x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
                s = (x @ y.T)[np.triu_indices(len(x), 1)] if i == j else (x @ y.T).ravel()
                k, c = np.unique(np.floor(np.round(s, 9) / width).astype(np.int64), return_counts=True)
                for at, count in zip(k.tolist(), c.tolist()):
                    bins[at] = bins.get(at, 0) + 2 * count
            yield pd.DataFrame({"k": list(bins), "n": list(bins.values())}).astype("int64")

    pairs = side("x").join(side("y"), F.col("bx") <= F.col("by")).repartition("bx", "by")
    return pairs.mapInPandas(run, "k bigint, n bigint").groupBy((F.col("k") * F.lit(width)).alias("bin")).agg(F.sum("n").alias("n"))


def pair_score(a: Column, b: Column) -> Column:
    """Sigmoid of the dot product of two vectors."""
    return 1 / (1 + F.exp(-dot(a, b)))
