"""Labelled call-and-return graphs over an edge table.

``edges``: source, target, label (call, ret, may_ret or empty), label_id
(array of int), location, and optionally seq, the order of arrival.  Node ids
are ``function.counter``.  ``labels``: id, label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.skew import global_rank
from quarry.session import cut

EMPTY_IDS = "array<int>"


def function_of(node: Column | str) -> Column:
    return F.substring_index(node, ".", 1)


def kind(label: Column | str) -> Column:
    """call, ret, may_ret or internal."""
    c = F.coalesce(F.col(label) if isinstance(label, str) else label, F.lit(""))
    return F.when(c.isin("call", "ret", "may_ret"), c).otherwise(F.lit("internal"))


def edge_label(may_ret: Column, call: Column, ret: Column) -> Column:
    """The label of an edge from its flags: may_ret before call before ret."""
    return F.when(may_ret, "may_ret").when(call, "call").when(ret, "ret").otherwise("")


def drop_source_node(edges: DataFrame, node: str = "main.0") -> DataFrame:
    """Edges that do not touch the artificial source node."""
    return edges.where((F.col("source") != node) & (F.col("target") != node))


def keep_labels(labels: DataFrame, remove: list[str]) -> DataFrame:
    """The label dictionary without labels that start with one of the prefixes."""
    keep = F.lit(True)
    for p in remove:
        keep = keep & ~F.startswith("label", F.lit(p))
    return labels.where(keep)


def nodes(edges: DataFrame) -> DataFrame:
    """Every node once, with its function."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("fn", function_of("node"))


def return_nodes(edges: DataFrame) -> DataFrame:
    """(node, return_node): the target of the last ``ret`` edge."""
    order = F.struct(*(["seq"] if "seq" in edges.columns else []), "target")
    return edges.where(kind("label") == "ret").groupBy(F.col("source").alias("node")).agg(F.max_by("target", order).alias("return_node"))


def may_return(edges: DataFrame) -> DataFrame:
    """(node, may_ret): the targets of ``may_ret`` edges."""
    return edges.where(kind("label") == "may_ret").groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("may_ret"))


def bypass_edges(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) of the by-passes: call site to return node, labelled with the callee.

    New labels are numbered from the greatest id on, in the order of the names.
    """
    calls = edges.where(kind("label") == "call").select("source", function_of("target").alias("callee"))
    return_of = return_nodes(edges)
    names = calls.join(return_of, F.col("source") == F.col("node"), "left_semi").select("callee").distinct()
    top = labels.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    new = global_rank(names, ["callee"]).join(F.broadcast(top)).select((F.col("top") + F.col("rank")).cast("int").alias("id"), F.col("callee").alias("label"))  # top is one row
    out = calls.join(return_of, F.col("source") == F.col("node")).join(new, F.col("callee") == F.col("label"))
    return out.select("source", F.col("return_node").alias("target"), F.array("id").alias("label_id")).distinct(), new


def pushdown(edges: DataFrame, labels: DataFrame, remove: list[str] | None = None, interprocedural: bool = True) -> tuple[DataFrame, DataFrame]:
    """(arcs, labels): the arcs (source, target, label_id, push) a walk can follow.

    Internal edges keep their surviving label ids; a call edge has no label
    and pushes its return node; each call site also has a labelled by-pass to
    its return node.
    """
    edges = drop_source_node(edges)
    labels = keep_labels(labels, remove or [])
    inner = edges.where(kind("label") == "internal").select("source", "target", F.coalesce("label_id", F.array().cast(EMPTY_IDS)).alias("ids")).distinct()
    each = inner.select("source", "target", "ids", F.posexplode_outer("ids").alias("pos", "id")).join(labels.select("id", F.lit(True).alias("live")), "id", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("pos", "id"))))
    internal = each.groupBy("source", "target", "ids").agg(F.transform(kept, lambda s: s["id"]).alias("label_id")).select("source", "target", "label_id", F.lit(None).cast("string").alias("push"))
    around, new = bypass_edges(edges, labels)
    calls = edges.where(kind("label") == "call").join(return_nodes(edges), F.col("source") == F.col("node"), "left")
    calls = calls.select("source", "target", F.array().cast(EMPTY_IDS).alias("label_id"), F.col("return_node").alias("push"))
    if not interprocedural:
        calls = calls.limit(0)
    arcs = internal.unionByName(calls).unionByName(around.withColumn("push", F.lit(None).cast("string")))
    return arcs, labels.select("id", "label").unionByName(new)


def label_rows(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, target, label_id): where each label is found, one row each: target node and the arc's whole label list."""
    return arcs.select("target", "label_id", F.explode("label_id").alias("id")).join(labels, "id").select("label", "target", "label_id").distinct()


def graph_counts(arcs: DataFrame) -> DataFrame:
    """(n_nodes, n_arcs, n_labels)."""
    n = arcs.select(F.explode(F.array("source", "target")).alias("node")).agg(F.count_distinct("node").alias("n_nodes"))
    m = arcs.agg(F.count(F.lit(1)).alias("n_arcs"))
    k = arcs.select(F.explode("label_id").alias("id")).agg(F.count_distinct("id").alias("n_labels"))
    return n.crossJoin(m).crossJoin(k)  # single rows


def degree_histogram(edges: DataFrame, column: str = "source") -> DataFrame:
    """(degree, n): how many nodes have so many edges on this side."""
    return edges.groupBy(column).agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def log_histogram(values: DataFrame, column: str, bins: int, top: float) -> DataFrame:
    """(bin, n) in logarithmic bins from 1 to ``top``; larger values fall in bin ``bins`` + 1."""
    b = F.width_bucket(F.log10(F.greatest(F.col(column).cast("double"), F.lit(1.0))), F.lit(0.0), F.log10(F.lit(float(top))), F.lit(bins))
    return values.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def call_sites(edges: DataFrame) -> DataFrame:
    """(callee, n): distinct call sites of each function."""
    return edges.where(kind("label") == "call").groupBy(function_of("target").alias("callee")).agg(F.count_distinct("source").alias("n"))


def distances(edges: DataFrame, starts: DataFrame, most: int | None = None, backward: bool = False) -> DataFrame:
    """(start, node, distance): shortest distances from each start, by frontier joins.

    ``starts`` has the column node.  Each round joins the frontier with the
    edges and drops what is known; its lineage is cut.
    """
    a, b = ("target", "source") if backward else ("source", "target")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node is not null and next is not null").distinct()
    step = cut(step)
    seen = cut(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("distance", F.lit(0)))
    frontier, d = seen, 0
    while most is None or d < most:
        d += 1
        new = frontier.select("start", "node").join(step, "node").select("start", F.col("next").alias("node")).distinct()
        new = cut(new.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(d)))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def reachable(edges: DataFrame, starts: DataFrame, backward: bool = False) -> DataFrame:
    """(node): everything reachable from any start, the starts included."""
    a, b = ("target", "source") if backward else ("source", "target")
    step = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node is not null and next is not null").distinct())
    seen = frontier = cut(starts.select("node").distinct())
    while True:
        new = cut(frontier.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new), new


def between(edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """(node): nodes on some way from a start to an end."""
    return reachable(edges, start).join(reachable(edges, end, True), "node", "left_semi")


def witness(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(step, node): one shortest way from start to end, of equal ones that with the least nodes; no rows if there is none."""
    spark = edges.sparkSession
    d = distances(edges, spark.createDataFrame([(start,)], "node string"))
    back = d.where(F.col("node") == end).select("node", "distance")
    path = back
    step = edges.select(F.col("source").alias("prev"), F.col("target").alias("node")).distinct()
    while not (head := back.first()) is None and head["distance"] > 0:
        up = back.join(step, "node").select(F.col("prev").alias("node"), (F.col("distance") - 1).alias("distance"))
        back = cut(up.join(d.select("node", "distance"), ["node", "distance"], "left_semi").orderBy("node").limit(1))
        path = path.unionByName(back)
    return path.select(F.col("distance").alias("step"), "node")


def dot_lines(edges: DataFrame) -> DataFrame:
    """(value): the edges as lines of a graph drawing."""
    return edges.select(F.format_string('"%s" -> "%s" [label="%s"];', "source", "target", F.coalesce("label", F.lit(""))).alias("value"))


def may_return_edges(edges: DataFrame) -> DataFrame:
    """(source, target): from each function's exits to the return sites of its callers.

    Exits are nodes without a successor inside their function.
    """
    calls = edges.where(kind("label") == "call").select(F.col("source").alias("site"), function_of("target").alias("callee"))
    sites = calls.join(return_nodes(edges), F.col("site") == F.col("node")).select("callee", F.col("return_node").alias("target"))
    inner = edges.where(kind("label").isin("internal", "ret")).select(F.col("source").alias("node"))
    exits = nodes(edges).join(inner, "node", "left_anti")
    return exits.join(sites, F.col("fn") == F.col("callee")).select(F.col("node").alias("source"), "target").distinct()


def within_folder(calls: DataFrame, source_file: str, target_file: str, indirect: str) -> DataFrame:
    """Indirect calls stay only within the first path component, or where either is ``include``."""
    a, b = F.get(F.split(source_file, "/"), F.lit(0)), F.get(F.split(target_file, "/"), F.lit(0))
    return calls.where(~F.col(indirect) | (a == b) | (a == "include") | (b == "include"))


def wrappers(calls: DataFrame) -> DataFrame:
    """(fn): functions of exactly one block and one call; ``calls`` has fn, block and callee (null: none)."""
    n = calls.groupBy("fn").agg(F.count_distinct("block").alias("blocks"), F.count("callee").alias("calls"))
    return n.where("blocks = 1 and calls = 1").select("fn")


def flat_sentences(calls: DataFrame) -> DataFrame:
    """(fn, callees): the functions called by each function in the order of ``pos``."""
    return calls.groupBy("fn").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "callee"))), lambda s: s["callee"]).alias("callees"))


def bootstrap_groups(fields: DataFrame) -> DataFrame:
    """(field, functions): functions stored in one field, groups of two or more, local fields (``#``) left out."""
    return fields.where(~F.contains("field", F.lit("#"))).groupBy("field").agg(F.array_sort(F.collect_set("fn")).alias("functions")).where(F.size("functions") >= 2)
