"""Biased random walks with a call stack, as joins of the walkers with the arc table.

Each step joins every walker with the bucket of ways that it drew, so neither
the graph nor the walks nor the neighbours of a node must fit anywhere.  All draws are hashes of (seed, walk, step): a lost
task repeats the same walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.graph import kind, label_rows, return_nodes
from quarry.operators.skew import global_rank, lookup_join
from quarry.session import cut

CUT_EVERY, BUCKET = 8, 256
CALL, BACK, ANY, MAY = "call", "back", "any", "may"
ENTER, EXIT = "F2V_ENTERFN", "F2V_EXITFN"


def _draw(n: Column, *salt: Column) -> Column:
    """A reproducible number from 1 to n."""
    return (F.pmod(F.xxhash64(*salt), F.greatest(n, F.lit(1))) + 1).cast("int")


def way_table(arcs: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes): what leads on from each node, in buckets, and what a walker must know of a node.

    nodes: (node, about); about has the node, its return node and the numbers
    of ways into calls, to the return node, of any kind elsewhere, and of
    possible returns.  ways: (node, kind, bucket, list) with at most ``BUCKET``
    ways; each has what is known of its target and of the return node, and the
    parallel arcs with their words.  So one join a step is enough, and no row
    grows with the degree of a node.
    """
    named = cut(arcs.withColumn("_a", F.monotonically_increasing_id()))
    words = named.select("_a", F.posexplode_outer("label_id").alias("pos", "id")).join(labels, "id", "left")
    words = words.groupBy("_a").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("pos", "label")))), lambda s: s["label"]).alias("words"))
    each = named.join(words, "_a").groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("words", F.col("push").isNotNull().alias("pushes")))).alias("arcs"))
    back = cut(return_nodes(edges))
    each = each.select(F.col("source").alias("node"), "target", "arcs").join(back, "node", "left")
    each = each.withColumn("kind", F.when(F.col("return_node").isNull(), ANY).when(F.col("target") == F.col("return_node"), BACK).otherwise(CALL)).drop("return_node")
    may = edges.where(kind("label") == "may_ret").select(F.col("source").alias("node"), "target").distinct()
    may = may.select("node", "target", F.array().cast(each.schema["arcs"].dataType).alias("arcs"), F.lit(MAY).alias("kind"))
    ranked = cut(global_rank(each.unionByName(may), ["node", "kind", "target"]))
    first = cut(ranked.groupBy("node", "kind").agg(F.min("rank").alias("first"), F.count(F.lit(1)).cast("int").alias("n")))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("int").alias(f"n_{k}")
    every = ranked.select(F.explode(F.array("node", "target")).alias("node")).distinct()
    counts = every.join(first.groupBy("node").agg(*[of(k) for k in (CALL, BACK, ANY, MAY)]), "node", "left").join(back, "node", "left")
    nodes = cut(counts.select("node", F.struct("node", F.col("return_node").alias("back"), *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in (CALL, BACK, ANY, MAY)]).alias("about")))
    placed = ranked.join(first, ["node", "kind"]).withColumn("at", F.col("rank") - F.col("first"))
    placed = lookup_join(cut(placed), nodes.select(F.col("node").alias("target"), F.col("about").alias("to")), "target").join(back, "node", "left")
    placed = placed.join(nodes.select(F.col("node").alias("return_node"), F.col("about").alias("after")), "return_node", "left")
    ways = placed.groupBy("node", "kind", F.expr(f"at div {BUCKET}").cast("int").alias("bucket")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "to", "after", "arcs"))), lambda w: F.struct(w["to"].alias("to"), w["after"].alias("after"), w["arcs"].alias("arcs"))).alias("list"))
    return cut(ways), nodes


def random_walks(arcs: DataFrame, edges: DataFrame, labels: DataFrame, *, walks_per_label: int = 1, length: int = 20, bias: float = 1.0, seed: int = 0, interprocedural: bool = True, markers: bool = True) -> DataFrame:
    """(walk_id, start_label, tokens, edges_visited, max_depth), one walk for each label and round.

    A walk starts at a random occurrence of its label and emits that arc's
    labels; at a call site it enters the call with probability
    min(0.5, 1 / bias^depth); at a function's end it pops the stack, or with an
    empty stack goes to a random possible return.  Walks of one label or less
    are left out.  Walkers carry their place and stack only; the tokens of
    ``CUT_EVERY`` steps are written together and put in order at the end.
    """
    ways, nodes = way_table(arcs, edges, labels)
    found = cut(global_rank(label_rows(arcs, labels), ["label", "target", "label_id"]))
    first = cut(found.groupBy("label").agg(F.min("rank").alias("first"), F.count(F.lit(1)).cast("int").alias("n")))
    start = first.select("label", "first", "n", F.explode(F.sequence(F.lit(1), F.lit(walks_per_label))).alias("round"))
    start = start.select("label", F.xxhash64("label", "round", F.lit(seed)).alias("walk_id"), (F.col("first") + _draw(F.col("n"), F.lit(seed), F.col("label"), F.col("round")) - 1).alias("rank"))
    start = cut(start.join(found.select("rank", F.col("target").alias("node"), "label_id"), "rank"))
    words = start.select("walk_id", F.posexplode("label_id").alias("pos", "id")).join(labels.select("id", F.col("label").alias("word")), "id")
    said = [words.groupBy("walk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("tokens")).withColumn("step", F.lit(0))]
    none = F.array().cast("array<string>")
    about = nodes.schema["about"].dataType
    state = lookup_join(start.select("walk_id", F.col("label").alias("start_label"), "node"), nodes, "node").drop("node").withColumnRenamed("about", "at")
    state = cut(state.withColumns({"stack": F.array().cast(T.ArrayType(about)), "calls": F.lit(0), "max_depth": F.lit(0), "edges_visited": F.lit(1), "tokens": none}))
    for step in range(1, length):
        salt = lambda k: (F.lit(seed), F.col("walk_id"), F.lit(step), F.lit(k))  # noqa: E731,B023
        chance = F.least(F.lit(0.5), F.pow(F.lit(float(bias)), -F.col("calls").cast("double")))
        entering = F.pmod(F.xxhash64(*salt("coin")), F.lit(1 << 20)) / float(1 << 20) < chance
        want = F.when(F.col("at.back").isNull(), ANY).when(entering, CALL).otherwise(BACK)
        count = F.when(F.col("kind") == ANY, F.col(f"at.n_{ANY}")).when(F.col("kind") == CALL, F.col(f"at.n_{CALL}")).otherwise(F.col(f"at.n_{BACK}"))
        here = F.col("at").isNotNull()
        s = state.withColumn("kind", want).withColumn("n", count)
        ended = here & (F.col("n") == 0)
        pops = ended & F.lit(interprocedural) & (F.size("stack") > 0)
        jumps = ended & F.lit(interprocedural) & (F.size("stack") == 0) & (F.col(f"at.n_{MAY}") > 0)
        s = s.withColumns({"pops": F.coalesce(pops, F.lit(False)), "jumps": F.coalesce(jumps, F.lit(False)), "ended": F.coalesce(ended, F.lit(False)), "moved": F.coalesce(here & (F.col("n") > 0), F.lit(False))})
        s = s.withColumn("kind", F.when(F.col("moved"), F.col("kind")).when(F.col("jumps"), MAY)).withColumn("i", _draw(F.when(F.col("jumps"), F.col(f"at.n_{MAY}")).otherwise(F.col("n")), *salt("way")) - 1)
        s = s.withColumn("node", F.when(F.col("kind").isNotNull(), F.col("at.node"))).withColumn("bucket", F.expr(f"i div {BUCKET}").cast("int"))
        s = s.join(ways, ["node", "kind", "bucket"], "left").withColumn("way", F.try_element_at("list", (F.col("i") % BUCKET + 1).cast("int")))
        s = s.withColumn("arc", F.when(F.col("moved"), F.try_element_at("way.arcs", _draw(F.size("way.arcs"), *salt("arc")))))
        pushes = F.coalesce(F.col("arc.pushes"), F.lit(False))
        calls = F.col("calls") + F.when(pushes, 1).when(F.col("pops"), -1).otherwise(0)
        heard = F.concat(F.coalesce("arc.words", none), F.when(pushes & F.lit(markers), F.array(F.lit(ENTER))).when(F.col("ended") & F.lit(markers), F.array(F.lit(EXIT))).otherwise(none))
        state = s.select(
            "walk_id",
            "start_label",
            F.when(F.col("kind").isNotNull(), F.col("way.to")).when(F.col("pops"), F.try_element_at("stack", F.lit(-1))).alias("at"),
            F.when(pushes, F.array_append("stack", F.col("way.after"))).when(F.col("pops"), F.slice("stack", 1, F.greatest(F.size("stack") - 1, F.lit(0)))).otherwise(F.col("stack")).alias("stack"),
            calls.alias("calls"),
            F.greatest("max_depth", calls).alias("max_depth"),
            (F.col("edges_visited") + F.when(F.col("moved") | F.col("pops") | F.col("jumps"), 1).otherwise(0)).alias("edges_visited"),
            F.concat("tokens", heard).alias("tokens"),
        )
        if step % CUT_EVERY == 0 or step == length - 1:
            state = cut(state)
            said.append(state.select("walk_id", "tokens", F.lit(step).alias("step")))
            state = state.withColumn("tokens", none)
            if state.where("at is not null").isEmpty():  # every walk has ended
                break
    spoken = reduce(DataFrame.unionByName, said).groupBy("walk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    return state.drop("tokens").join(spoken, "walk_id").where(F.size("tokens") > 1).select("walk_id", "start_label", "tokens", "edges_visited", "max_depth")


def flat_walks(arcs: DataFrame, labels: DataFrame, rounds: int = 100, seed: int = 0) -> DataFrame:
    """(fn, round, tokens): per function its nodes in string order, one label of a random way each."""
    words = arcs.where(F.size("label_id") > 0).select(F.substring_index("source", ".", 1).alias("fn"), "source", F.get("label_id", F.lit(0)).alias("id")).join(labels, "id")
    node = words.groupBy("fn", "source").agg(F.array_sort(F.collect_set("label")).alias("words"))
    fn = node.groupBy("fn").agg(F.array_sort(F.collect_list(F.struct("source", "words"))).alias("nodes"))
    each = fn.select("fn", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), "nodes")
    return each.select("fn", "round", F.transform("nodes", lambda n: F.element_at(n["words"], _draw(F.size(n["words"]), F.lit(seed), F.col("fn"), F.col("round"), n["source"]))).alias("tokens"))


def label_histogram(walks: DataFrame) -> DataFrame:
    """(label, n): occurrences of each label in all walks."""
    return walks.select(F.explode("tokens").alias("label")).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def length_histogram(walks: DataFrame) -> DataFrame:
    """(length, n) of the walks; a null walk has length 0."""
    return walks.groupBy(F.coalesce(F.array_size("tokens"), F.lit(0)).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def depth_histogram(walks: DataFrame) -> DataFrame:
    """(max_depth, n): how deep the walks' stacks grew."""
    return walks.groupBy("max_depth").agg(F.count(F.lit(1)).alias("n"))
