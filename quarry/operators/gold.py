"""Gold sets of related functions from names, paths and reviewed relations.

``functions``: name, path.  ``relations``: must (boolean), a and b (arrays of
names), prov (where the line stands).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.components import connected_components
from quarry.operators.graph import witness
from quarry.operators.skew import lookup_join
from quarry.session import cut

NAMES_A_LIST = 256
LISTS_A_PART = 16


def name_splits(name: Column) -> Column:
    """(prefix, suffix) of a name at every underscore; both longer than one character."""
    parts = F.split(name, "_")
    cuts = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(cuts, lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "_").alias("prefix"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "_").alias("suffix")))
    return F.filter(pairs, lambda p: (F.length(p["prefix"]) > 1) & (F.length(p["suffix"]) > 1))


def split_at_keyword(name: Column, keyword: str) -> Column:
    """(prefix, suffix) of a name after the underscore part ``keyword``; null if it has none."""
    parts = F.split(name, "_")
    at = F.array_position(parts, keyword).cast("int")
    return F.when(at > 0, F.struct(F.array_join(F.slice(parts, F.lit(1), F.greatest(at, F.lit(1))), "_").alias("prefix"), F.array_join(F.slice(parts, at + 1, F.size(parts)), "_").alias("suffix")))


def exploded_splits(functions: DataFrame) -> DataFrame:
    """(name, path, prefix, suffix), one row for each split of each distinct function."""
    return functions.select("name", "path").distinct().select("name", "path", F.explode(name_splits(F.col("name"))).alias("s")).select("name", "path", "s.prefix", "s.suffix")


def groups_by(functions: DataFrame, side: str = "suffix") -> DataFrame:
    """(side, name, path): the functions of every shared prefix or suffix, one row each."""
    return exploded_splits(functions).select(side, "name", "path").distinct()


def common_keywords(functions: DataFrame, top: int = 3, least: int = 10, compat: bool = False) -> DataFrame:
    """(prefix, path): of each path the ``top`` most frequent prefixes with ``least`` uses or more.

    Ties go to the smaller prefix.  With ``compat`` the first split of each
    path (the least name's first) is not counted.
    """
    rows = exploded_splits(functions)
    if compat:
        first = Window.partitionBy("path").orderBy("name", F.length("prefix"))
        rows = rows.withColumn("r", F.row_number().over(first)).where("r > 1")
    counts = rows.groupBy("path", "prefix").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("path").orderBy(F.desc("n"), "prefix")
    return counts.withColumn("r", F.row_number().over(best)).where((F.col("r") <= top) & (F.col("n") >= least)).select("prefix", "path", "n")


def filter_by_keyword(groups: DataFrame, include: DataFrame, exclude: DataFrame | None = None, least: int = 5) -> DataFrame:
    """Members of suffix groups whose prefix is an included keyword of their own path.

    ``include`` and ``exclude`` have prefix (and path for include); excluded
    prefixes win; groups below ``least`` members are dropped.
    """
    rows = groups.withColumn("prefix", F.expr("split_part(name, concat('_', suffix), 1)"))
    rows = rows.join(include.select("prefix", "path").distinct(), ["prefix", "path"], "left_semi")
    if exclude is not None:
        rows = rows.join(exclude.select("prefix").distinct(), "prefix", "left_anti")
    big = rows.groupBy("suffix").agg(F.count_distinct("name").alias("n")).where(F.col("n") >= least)
    return rows.join(big.select("suffix"), "suffix", "left_semi").select("suffix", "name", "path")


def split_by_directory(groups: DataFrame) -> DataFrame:
    """(suffix, dir, name, path): groups divided by first directory; those of one member are dropped."""
    rows = groups.withColumn("dir", F.get(F.split("path", "/"), F.lit(0)))
    big = rows.groupBy("suffix", "dir").agg(F.count_distinct("name").alias("n")).where("n > 1")
    return rows.join(big.select("suffix", "dir"), ["suffix", "dir"], "left_semi").select("suffix", "dir", "name", "path")


def overlap(groups: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """(n_gold, n_both): distinct gold names, and those also in ``bootstrap`` (name)."""
    gold = groups.select("name").distinct()
    both = gold.join(bootstrap.select("name").distinct().withColumn("hit", F.lit(1)), "name", "left")
    return both.agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("n_both"))


def gold_names(functions: DataFrame, keywords: DataFrame | None = None, exclude: DataFrame | None = None, least: int = 5) -> DataFrame:
    """The whole way from functions to suffix groups by directory."""
    include = keywords if keywords is not None else common_keywords(functions)
    return split_by_directory(filter_by_keyword(groups_by(functions, "suffix"), include, exclude, least))


def underscore_pairs(functions: DataFrame, double: bool = True, single: bool = False) -> DataFrame:
    """(name, wrapper): foo with __foo, and with ``single`` bar with _bar."""
    names = functions.select("name").distinct()
    out = None
    for on, mark, more in ((double, "__", None), (single, "_", "__")):
        if not on:
            continue
        w = names.select(F.col("name").alias("wrapper")).where(F.startswith("wrapper", F.lit(mark)))
        if more:
            w = w.where(~F.startswith("wrapper", F.lit(more)))
        w = w.withColumn("name", F.substr("wrapper", F.lit(len(mark) + 1))).where("name <> ''").join(names, "name", "left_semi").select("name", "wrapper")
        out = w if out is None else out.unionByName(w)
    return out if out is not None else names.limit(0).select("name", F.col("name").alias("wrapper"))


def must_edges(relations: DataFrame, must: bool = True) -> DataFrame:
    """(a, b, prov): a chain of edges linking both sides for must, all cross pairs for must-not.

    Must relations need only connect their names, so the first name of the
    first set is linked to all others.
    """
    rows = relations.where(F.col("must") == must)
    if must:
        return rows.select(F.get("a", F.lit(0)).alias("a"), F.explode(F.array_union("a", "b")).alias("b"), "prov")
    return rows.select(F.explode("a").alias("a"), "b", "prov").select("a", F.explode("b").alias("b"), "prov")


def equivalence_classes(relations: DataFrame) -> DataFrame:
    """(name, class_id): connected components of the must relations; the id is the least name."""
    return connected_components(must_edges(relations), "a", "b").select(F.col("node").alias("name"), F.col("component").alias("class_id"))


def contradictions(relations: DataFrame) -> DataFrame:
    """(a, b, prov): must-not pairs that the must relations put in one class."""
    c = equivalence_classes(relations)
    pairs = must_edges(relations, False)
    one = pairs.join(c.select(F.col("name").alias("a"), F.col("class_id").alias("ca")), "a").join(c.select(F.col("name").alias("b"), F.col("class_id").alias("cb")), "b")
    return one.where("ca = cb").select("a", "b", "prov").distinct()


def contradiction_path(relations: DataFrame, a: str, b: str) -> DataFrame:
    """(step, node): a shortest chain of must relations from a to b."""
    e = must_edges(relations).select(F.col("a").alias("source"), F.col("b").alias("target"))
    return witness(e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))), a, b)


def pair_counts(relations: DataFrame) -> DataFrame:
    """(must, n): products of the set sizes, summed."""
    return relations.groupBy("must").agg(F.sum((F.size("a") * F.size("b")).cast("bigint")).alias("n"))


def related_pair_count(classes: DataFrame) -> DataFrame:
    """(n): pairs within classes."""
    n = classes.groupBy("class_id").agg(F.count_distinct("name").cast("bigint").alias("k"))
    return n.agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("n"))


def related_pairs(classes: DataFrame) -> DataFrame:
    """(a, b) of every pair within a class, a < b: the evaluation asks for each of them."""
    x = classes.select("class_id", F.col("name").alias("a")).distinct()
    y = classes.select("class_id", F.col("name").alias("b")).distinct()
    return x.join(y, "class_id").where("a < b").select("a", "b")


def unrelated_classes(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes that must not meet, members) of the must-not relations.

    The pairs (ca, cb) have ca <= cb and stand once each; the members (name,
    class_id) hold every name, one without a must relation in a class of its
    own.  Both are cut.
    """
    c = cut(equivalence_classes(relations))
    pairs = cut(must_edges(relations, False).select("a", "b").where("a is not null and b is not null").distinct())
    key = lambda s: c.select(F.col("name").alias(s), F.col("class_id").alias(f"c{s}"))
    keyed = pairs.join(key("a"), "a", "left").join(key("b"), "b", "left").select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    keyed = cut(keyed.select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct())
    alone = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().join(c, "name", "left_anti")
    return keyed, cut(c.unionByName(alone.select("name", F.col("name").alias("class_id"))))


def unrelated_pairs(relations: DataFrame) -> DataFrame:
    """(a, b): must-not pairs expanded through the classes of both names, a < b, once each.

    Every name has one class, so different pairs of classes give different
    pairs of names and none has to be shuffled.  Members meet in lists of about
    ``NAMES_A_LIST``, of one class, and the pairs are formed in place: of two
    classes the smaller one's lists are sent, once to each part of about
    ``LISTS_A_PART`` lists of the larger one, which stays where it is.
    """
    keyed, known = unrelated_classes(relations)
    size = cut(known.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / NAMES_A_LIST).alias("lists")))
    held = lookup_join(known, size, "class_id").groupBy("class_id", "lists", F.pmod(F.xxhash64("name"), F.col("lists")).alias("no"))
    held = cut(held.agg(F.collect_list("name").alias("names")))
    parts = lambda lists: F.ceil(lists / LISTS_A_PART)
    tasks = int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own is not made less for lists of few bytes
    sized = lambda s: size.select(F.col("class_id").alias(f"c{s}"), F.struct("n", "lists", "class_id").alias(s))
    both = keyed.join(sized("a"), "ca").join(sized("b"), "cb").select(F.least("a", "b").alias("less"), F.greatest("a", "b").alias("more"))
    asked = both.select(F.col("less.class_id").alias("goes"), F.col("more.class_id").alias("stays"), F.explode(F.sequence(F.lit(0), parts(F.col("more.lists")) - 1)).alias("part"))
    sent = asked.join(held.select(F.col("class_id").alias("goes"), F.col("names").alias("as")), "goes")
    stay = held.select(F.col("class_id").alias("stays"), F.pmod("no", parts(F.col("lists"))).alias("part"), F.col("names").alias("bs"))
    apart = lambda t: t.repartition(tasks, "stays", "part")
    lists = apart(sent).join(apart(stay).hint("shuffle_hash"), ["stays", "part"])  # what is sent is not sorted
    wide = lists.select("goes", "stays", "bs", F.explode("as").alias("a")).select("goes", "stays", "a", F.explode("bs").alias("b")).where("goes <> stays or a < b")
    return wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def unrelated_estimate(relations: DataFrame) -> DataFrame:
    """(n): the sum of products of the must-not sets, plus one."""
    return relations.where(~F.col("must")).agg((F.coalesce(F.sum((F.size("a") * F.size("b")).cast("bigint")), F.lit(0)) + 1).alias("n"))


def sampled_unrelated_pairs(classes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(a, b): up to ``n`` distinct pairs of names of different classes, drawn by a hash.

    Names get ranks; draw i joins two hashed ranks, so no product of the
    classes is formed.
    """
    from quarry.operators.skew import global_rank

    ranked = global_rank(classes.select("name", "class_id").distinct(), ["name"], "no")
    total = ranked.count()
    draws = classes.sparkSession.range(0, 3 * n).select(F.col("id"), *[(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(max(total, 1))) + 1).alias(k) for k in ("x", "y")])
    side = lambda k, s: ranked.select(F.col("no").alias(k), F.col("name").alias(s), F.col("class_id").alias(f"c{s}"))
    pairs = draws.join(side("x", "a"), "x").join(side("y", "b"), "y").where("ca <> cb")
    pairs = pairs.groupBy(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("g")).agg(F.min("id").alias("id"))
    return pairs.orderBy("id").limit(n).select(F.col("l").alias("a"), F.col("g").alias("b"))
