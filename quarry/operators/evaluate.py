"""Scores of clusters and rankings against a gold standard.

``classes``: name, class_id.  ``clusters``: name, cluster_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut


def precision(a: Column, b: Column) -> Column:
    """Share of a's members that are in b; recall is the same with a and b exchanged."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def common_members(classes: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both restricted to the names they share; classes of one member are dropped first."""
    big = classes.groupBy("class_id").agg(F.count_distinct("name").alias("n")).where("n > 1")
    classes = classes.select("name", "class_id").distinct().join(big.select("class_id"), "class_id", "left_semi")
    return classes.join(clusters.select("name").distinct(), "name", "left_semi"), clusters.select("name", "cluster_id").distinct().join(classes.select("name").distinct(), "name", "left_semi")


def overlaps(classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(class_id, cluster_id, n, class_size, cluster_size, precision, recall, f) of all that share a name."""
    a = classes.groupBy("class_id").agg(F.count_distinct("name").alias("class_size"))
    b = clusters.groupBy("cluster_id").agg(F.count_distinct("name").alias("cluster_size"))
    both = classes.select("name", "class_id").distinct().join(clusters.select("name", "cluster_id").distinct(), "name").groupBy("class_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    out = both.join(a, "class_id").join(b, "cluster_id").withColumn("precision", F.col("n") / F.col("cluster_size")).withColumn("recall", F.col("n") / F.col("class_size"))
    return out.withColumn("f", f_score(F.col("precision"), F.col("recall")))


def weighted_scores(classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(f_score, avg_precision, avg_recall).

    The F-score weights each class's best F by its size; average precision
    weights the best precision by the size of its cluster, average recall the
    best recall by the class size.  Ties go to the smaller cluster.
    """
    o = overlaps(classes, clusters)
    sizes = classes.groupBy("class_id").agg(F.count_distinct("name").alias("class_size"))
    best = o.groupBy("class_id").agg(F.max("f").alias("f"), F.max("recall").alias("r"), F.max(F.struct("precision", (-F.col("cluster_size")).alias("s"), "cluster_id")).alias("p"))
    rows = sizes.join(best, "class_id", "left").select("class_size", F.coalesce("f", F.lit(0.0)).alias("f"), F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("p.precision", F.lit(0.0)).alias("p"), F.coalesce(-F.col("p.s"), F.lit(0)).alias("w"))
    return rows.agg(F.try_divide(F.sum(F.col("class_size") * F.col("f")), F.sum("class_size")).alias("f_score"), F.try_divide(F.sum(F.col("w") * F.col("p")), F.sum("w")).alias("avg_precision"), F.try_divide(F.sum(F.col("class_size") * F.col("r")), F.sum("class_size")).alias("avg_recall"))


def cluster_f1(classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """``weighted_scores`` over the common members."""
    return weighted_scores(*common_members(classes, clusters))


def purity_report(classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(class_id, cluster_id, precision, recall, f, missing, extra): each class with its best cluster.

    Classes of one member are left out; among equal F the greatest cluster
    wins.  missing and extra list the names on one side only.
    """
    big = classes.groupBy("class_id").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    members = big.select("class_id", F.explode("names").alias("name"))
    best = overlaps(members, clusters).groupBy("class_id").agg(F.max(F.struct("f", "cluster_id", "precision", "recall")).alias("b")).select("class_id", "b.*")
    held = clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_set("name")).alias("in_cluster"))
    none = F.array().cast("array<string>")
    out = big.join(best, "class_id", "left").join(held, "cluster_id", "left")
    inside = F.coalesce("in_cluster", none)
    return out.select("class_id", "cluster_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f")], F.array_except("names", inside).alias("missing"), F.array_except(inside, F.col("names")).alias("extra"))


def purity(classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(purity): share of the clustered gold names that belong to the largest class of their cluster."""
    n = classes.select("name", "class_id").distinct().join(clusters.select("name", "cluster_id").distinct(), "name").groupBy("cluster_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("cluster_id").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return best.agg(F.try_divide(F.sum("top"), F.sum("all")).alias("purity"))


def ranked(pairs: DataFrame, score: str, flag: str, ties: list[str]) -> DataFrame:
    """``pairs`` with rank in descending score, and n_true, n_false so far, without one window over all.

    Ranks come from range partitions; the running counts add the counts of
    earlier partitions.
    """
    from quarry.operators.skew import global_rank

    order = pairs.withColumn("_s", -F.col(score))
    r = global_rank(order, ["_s", *ties], "rank")
    hits = r.groupBy("_pid").agg(F.sum(F.col(flag).cast("int")).alias("k"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    hits = hits.select("_pid", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_pid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(F.broadcast(hits), "_pid").withColumn("n_true", F.col("_before") + F.sum(F.col(flag).cast("int")).over(inner))
    return out.withColumn("n_false", F.col("rank") - F.col("n_true")).drop("_pid", "_s", "_before")


def roc_points(pairs: DataFrame, score: str, flag: str, ties: list[str]) -> DataFrame:
    """``ranked`` with tpr and fpr."""
    r = ranked(pairs, score, flag, ties)
    total = pairs.agg(F.sum(F.col(flag).cast("int")).alias("t"), F.sum((~F.col(flag)).cast("int")).alias("f"))
    return r.join(F.broadcast(total)).withColumn("tpr", F.try_divide("n_true", "t")).withColumn("fpr", F.try_divide("n_false", "f")).drop("t", "f")


def roc_auc(pairs: DataFrame, score: str, flag: str, ties: list[str]) -> DataFrame:
    """(auc, auc_compat): the area under the step curve, and the score (p + 1 - (1 - p) T / F) / 2.

    p is the precision at rank T, the number of true pairs; F counts the false
    ones.  Equal scores are ordered by ``ties``.
    """
    r = ranked(pairs, score, flag, ties)
    total = pairs.agg(F.sum(F.col(flag).cast("int")).alias("t"), F.sum((~F.col(flag)).cast("int")).alias("f"))
    area = r.where(~F.col(flag)).agg(F.sum("n_true").alias("area"))
    at = r.join(F.broadcast(total)).where("rank = t").select(F.try_divide("n_true", "t").alias("p"))
    p = F.col("p")
    return area.join(total).join(at, how="left").select(F.try_divide("area", F.col("t") * F.col("f")).alias("auc"), ((p + 1 - (1 - p) * F.try_divide("t", "f")) / 2).alias("auc_compat"))  # single rows


def average_precision(results: DataFrame, order: str, flag: str) -> DataFrame:
    """(ap): precision at the hits, summed and divided by the number of results."""
    r = ranked(results.withColumn("_o", -F.col(order)), "_o", flag, [order])
    return r.agg(F.try_divide(F.sum(F.when(F.col(flag), F.col("n_true") / F.col("rank")).otherwise(0.0)), F.count(F.lit(1))).alias("ap"))


def confusion(true_pairs: DataFrame, false_pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(tp, fn, fp, tn, missing): pairs in one cluster or not, and distinct names without a cluster."""
    rows = true_pairs.select("a", "b", F.lit(True).alias("related")).unionByName(false_pairs.select("a", "b", F.lit(False).alias("related")))
    side = lambda s: clusters.select(F.col("name").alias(s), F.col("cluster_id").alias(f"c{s}"))
    both = rows.join(side("a"), "a", "left").join(side("b"), "b", "left")
    same = F.col("ca").isNotNull() & F.col("cb").isNotNull() & (F.col("ca") == F.col("cb"))
    known = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    lost = F.when(F.col("ca").isNull(), F.col("a")).when(F.col("cb").isNull(), F.col("b"))
    return both.agg(
        F.count_if(known & same & F.col("related")).alias("tp"),
        F.count_if(known & ~same & F.col("related")).alias("fn"),
        F.count_if(known & same & ~F.col("related")).alias("fp"),
        F.count_if(known & ~same & ~F.col("related")).alias("tn"),
        F.count_distinct(lost).alias("missing"),
    )


def confusion_by_classes(true_pairs: DataFrame, apart: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """``confusion`` with the false pairs given as pairs of classes (ca <= cb, once each) and their members.

    The pairs of names are counted and never formed: those within one cluster
    are products of the classes' members there.  ``members``: name, class_id,
    each name once; cut both before.  ``clusters`` holds a name once.
    """
    side = lambda s: clusters.select(F.col("name").alias(s), F.col("cluster_id").alias(f"c{s}"))
    true = cut(true_pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left"))
    named = cut(members.join(clusters.select("name", "cluster_id"), "name", "left"))
    size = cut(named.groupBy("class_id").agg(F.count("cluster_id").alias("n"), F.max("name").alias("last")))
    part = cut(named.where("cluster_id is not null").groupBy("class_id", "cluster_id").agg(F.count(F.lit(1)).alias("n")))
    of = lambda t, s: t.select(*[F.col(c).alias({"class_id": f"c{s}", "cluster_id": "cluster_id"}.get(c, f"{c}_{s}")) for c in t.columns])
    pairs = F.coalesce(F.sum(F.expr("if(ca = cb, n_a * (n_a - 1) div 2, n_a * n_b)")), F.lit(0))
    sized = cut(apart.join(of(size, "a"), "ca").join(of(size, "b"), "cb"))
    # a name without a cluster is lost if a partner has one or is greater
    met = sized.select(F.col("ca").alias("class_id"), (F.col("n_b") > 0).alias("known"), F.col("last_b").alias("last")).unionByName(sized.select(F.col("cb").alias("class_id"), (F.col("n_a") > 0).alias("known"), F.col("last_a").alias("last")))
    met = met.groupBy("class_id").agg(F.max("known").alias("known"), F.max("last").alias("last"))
    lost = named.where("cluster_id is null").join(met, "class_id").where("known or last > name").select("name")
    lost = lost.unionByName(true.select(F.when(F.col("ca").isNull(), F.col("a")).when(F.col("cb").isNull(), F.col("b")).alias("name"))).agg(F.count_distinct("name").alias("missing"))
    same = apart.join(of(part, "a"), "ca").join(of(part, "b"), ["cb", "cluster_id"]).agg(pairs.alias("fp"))
    counted = true.agg(F.count_if(F.col("ca") == F.col("cb")).alias("tp"), F.count_if(F.col("ca") != F.col("cb")).alias("fn"))
    rows = counted.crossJoin(same).crossJoin(sized.agg(pairs.alias("every"))).crossJoin(lost)  # single rows
    return rows.select("tp", "fn", "fp", (F.col("every") - F.col("fp")).alias("tn"), "missing")


def confusion_scores(c: DataFrame) -> DataFrame:
    """``confusion`` with precision, recall and f1."""
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f_score(F.col("precision"), F.col("recall")))


def first_rank(results: DataFrame, key: str, position: str) -> DataFrame:
    """(key, rank): 1-based rank of each key's first place in the order of ``position``."""
    from quarry.operators.skew import global_rank

    first = results.groupBy(key).agg(F.min(position).alias("_p"))
    return global_rank(first, ["_p", key], "rank").select(key, "rank")


def macro_micro_f1(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """(micro, macro): F1 over all rows, and the mean of the classes' F1."""
    t = rows.groupBy(F.col(label).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(predicted)).alias("tp"))
    p = rows.groupBy(F.col(predicted).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    both = t.join(p, "k", "full_outer").fillna(0)
    f = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n") + F.col("m")), F.lit(0.0))
    return both.agg(F.try_divide(F.sum("tp"), F.sum("n")).alias("micro"), F.avg(f).alias("macro"))
