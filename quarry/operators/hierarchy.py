"""Parent-child links to full hierarchies by leaf peeling.

Each round removes all leaves of the remaining forest and, so that a chain of
length L takes O(log L) rounds and not L, an independent set of the nodes with
a single child.  A removed node keeps the ancestor it hung from and the ids
between.  What never becomes a leaf is a loop; it shrinks to one node that is
its own parent.  Subtree sizes and heights are sent to the parents of the removed
leaves; the nodes of a chain get theirs when the node below them is removed.
The reverse peel order, a forest no deeper than the number of
rounds, then assigns roots, depths and paths by pointer doubling.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.skew import lookup_join
from quarry.session import cut

CYCLE, BELOW = "cycle", "below cycle"


def latest_links(df: DataFrame, parent: str, child: str, loaded_at: str | None) -> DataFrame:
    """One parent for each child: (node, parent).

    The link loaded last counts, a null time is the earliest, among equal
    times the greatest parent wins.  Rows with a null on either side set no link.
    """
    links = df.where(F.col(parent).isNotNull() & F.col(child).isNotNull())
    order = F.struct(*([F.col(loaded_at).alias("t")] if loaded_at else []), F.col(parent).alias("p"))
    return links.groupBy(F.col(child).alias("node")).agg(F.max(order).alias("o")).select("node", F.col("o.p").alias("parent"))


@dataclass
class Peeled:
    """Every node at its removal: what it hung from and the nodes between, with what had been sent up to each until then."""

    rows: DataFrame
    rounds: int
    kind: str


def _peel(rows: DataFrame, r: int) -> DataFrame:
    """One round: ``gone`` is set to ``r`` for the removed rows, ``leaf`` for those that are leaves.

    The leaves of the round before have sent (nodes inside, height) to their
    parents; equal parents are added up before the shuffle.
    """
    live = rows.where("gone is null")
    linked = F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))
    kids = live.where(linked).select(F.col("parent").alias("node"), F.lit(1).alias("live"), F.col("node").alias("kid"), F.lit(0).cast("bigint").alias("sent"), F.lit(0).cast("bigint").alias("sent_h"))
    notes = rows.where((F.col("gone") == r - 1) & F.col("leaf") & linked)
    up = F.aggregate("seg", F.struct((F.col("acc") + 1).alias("n"), (F.col("h") + 1).alias("h")), lambda a, s: F.struct((a["n"] + s["acc"] + 1).alias("n"), (F.greatest(a["h"], s["h"]) + 1).alias("h")))
    notes = notes.select(F.col("parent").alias("node"), F.lit(0).alias("live"), F.lit(None).cast(dict(rows.dtypes)["node"]).alias("kid"), up.alias("u")).select("node", "live", "kid", F.col("u.n").alias("sent"), F.col("u.h").alias("sent_h"))
    heard = kids.unionByName(notes).groupBy("node").agg(F.sum("live").alias("n_kids"), F.max("kid").alias("kid"), F.sum("sent").alias("sent"), F.max("sent_h").alias("sent_h"))
    seen = live.join(heard, "node", "left").select(
        "node", "parent", "seg", (F.col("acc") + F.coalesce("sent", F.lit(0))).alias("acc"), F.greatest("h", F.coalesce("sent_h", F.lit(0))).alias("h"), F.coalesce("n_kids", F.lit(0)).alias("n_kids"), "kid"
    )
    coin = lambda c: F.xxhash64(F.col(c), F.lit(r))
    splice = F.coalesce(linked & (F.col("n_kids") == 1) & (coin("node") > coin("parent")) & (coin("node") > coin("kid")), F.lit(False))
    out = seen.where(splice)
    # the single child of a spliced node moves up; its key is unique on both sides
    between = F.concat(F.array(F.struct("node", "acc", "h")), "seg")
    moved = out.select(F.col("kid").alias("node"), F.lit(True).alias("moves"), F.col("parent").alias("s_parent"), between.alias("s_seg"))
    rest = seen.where(~splice).join(moved, "node", "left")
    leaf = F.col("n_kids") == 0
    rest = rest.select(
        "node",
        F.when(F.col("moves"), F.col("s_parent")).otherwise(F.col("parent")).alias("parent"),
        F.when(F.col("moves"), F.concat("seg", "s_seg")).otherwise(F.col("seg")).alias("seg"),
        "acc",
        "h",
        F.when(leaf, F.lit(r)).alias("gone"),
        leaf.alias("leaf"),
    )
    spliced = out.select("node", "parent", "seg", "acc", "h", F.lit(r).alias("gone"), F.lit(False).alias("leaf"))
    return rest.unionByName(spliced)


def peel(df: DataFrame, parent: str, child: str, loaded_at: str | None = None) -> Peeled:
    """Remove all leaves, and nodes of chains, round by round."""
    ids = df.select(F.explode(F.array(F.col(parent), F.col(child))).alias("node")).where("node is not null").distinct()
    state = ids.join(latest_links(df, parent, child, loaded_at), "node", "left")
    kind = dict(ids.dtypes)["node"]
    state = state.withColumn("seg", F.array().cast(f"array<struct<node:{kind},acc:bigint,h:bigint>>"))
    zero = F.lit(0).cast("bigint")
    rows = cut(state.withColumns({"acc": zero, "h": zero, "gone": F.lit(None).cast("int"), "leaf": F.lit(False)}))
    removed, r = [], 0
    while True:
        done = cut(_peel(rows, r))
        removed.append(done.where(F.col("gone") == r))
        rows = done.where(F.col("gone").isNull() | F.col("leaf"))
        r += 1
        if rows.where("gone is null").isEmpty():
            break
    every = removed[0]
    for x in removed[1:]:
        every = every.unionByName(x)
    return Peeled(every, r, kind)


def hierarchy(df: DataFrame, parent: str, child: str, loaded_at: str | None = None) -> DataFrame:
    """(node, root, depth, path_ids, on_cycle, in_cycle) for every id in either column.

    In a tree, ``path_ids`` runs from the root to the node and depth is 0 at
    the root.  Nodes on a loop have ``on_cycle``; those and all below have
    ``in_cycle``, the loop's smallest id as root, depth -1 and no path.
    Of several links of a child the one loaded last counts (see
    ``latest_links``).  A row with a null on one side names a node without a
    link; an empty table gives no rows; repeated rows and further columns
    change nothing.  The ids of one path, or of one loop, share a row.
    """
    return paths(peel(df, parent, child, loaded_at))


def paths(peeled: Peeled) -> DataFrame:
    """``hierarchy`` from the peeled rows, in the reverse order of their removal."""
    kind, rounds = peeled.kind, peeled.rounds
    rows = peeled.rows.select("node", "parent", F.transform("seg", lambda s: s["node"]).alias("seg"))
    loop = F.coalesce(F.col("parent") == F.col("node"), F.lit(False))
    top = F.col("parent").isNull() | loop
    loops = rows.where(loop).select(F.array_append("seg", F.col("node")).alias("ids"))
    members = loops.select(F.explode("ids").alias("node"), F.lit(True).alias("on_cycle"))
    tree = cut(
        rows.select(
            "node",
            F.when(~top, F.col("parent")).alias("anc"),
            F.when(~top, F.col("seg")).otherwise(F.array().cast(f"array<{kind}>")).alias("seg"),
            F.when(loop, F.array_min(F.array_append("seg", F.col("node")))).when(top, F.col("node")).alias("root"),
            F.when(top, loop).alias("in_cycle"),
        )
    )
    for _ in range(math.ceil(math.log2(max(rounds, 2))) + 1):
        if tree.where("root is null").isEmpty():
            break
        found = tree.where("root is not null")
        up = tree.select(F.col("node").alias("anc"), F.col("anc").alias("u_anc"), F.col("seg").alias("u_seg"), F.col("root").alias("u_root"), F.col("in_cycle").alias("u_in"))
        step = lookup_join(tree.where("root is null"), up, "anc").select(
            "node",
            F.coalesce("u_anc", "anc").alias("anc"),
            F.when(F.col("u_anc").isNull(), F.col("seg")).otherwise(F.concat("seg", F.array("anc"), "u_seg")).alias("seg"),
            F.col("u_root").alias("root"),
            F.col("u_in").alias("in_cycle"),
        )
        tree = cut(found.unionByName(step).repartition("node"))
    path = F.concat(F.when(F.col("anc").isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array("anc")), F.reverse("seg"), F.array("node"))
    return tree.join(members, "node", "left").select(
        "node",
        "root",
        F.when(F.col("in_cycle"), F.lit(-1)).otherwise(F.size(path) - 1).cast("bigint").alias("depth"),
        F.when(~F.col("in_cycle"), path).alias("path_ids"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
        "in_cycle",
    )


def path_text(h: DataFrame) -> DataFrame:
    """``hierarchy`` with ``path``: the ids joined by ``/``, ``cycle`` or ``below cycle``."""
    text = F.when(F.col("on_cycle"), F.lit(CYCLE)).when(F.col("in_cycle"), F.lit(BELOW)).otherwise(F.array_join(F.col("path_ids").cast("array<string>"), "/"))
    return h.withColumn("path", text)


def descendants(h: DataFrame) -> DataFrame:
    """(ancestor, descendant, hops): one row for each node inside another, trees only.

    A list of all nodes inside a very wide tree may not fit in one row, so the
    lists are rows.
    """
    each = h.where(F.size("path_ids") > 1).select("node", F.posexplode(F.slice("path_ids", 1, F.size("path_ids") - 1)).alias("pos", "ancestor"), "depth")
    return each.select("ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("pos")).cast("bigint").alias("hops"))


def subtree_sizes(peeled: Peeled, h: DataFrame) -> DataFrame:
    """(node, n_inside, max_hops): how many nodes lie inside each node of the trees, and how deep.

    Both were sent up while peeling: a leaf holds its own, and a node taken out
    of a chain gets those of the nodes below it in the chain.  No list of
    descendants is formed.
    """
    last = peeled.rows.where("leaf").select("node", "seg", "acc", "h")
    each = last.select(F.col("node").alias("leaf"), F.col("acc").alias("leaf_acc"), F.col("h").alias("leaf_h"), F.posexplode("seg").alias("i", "s"))
    below = Window.partitionBy("leaf").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("leaf_acc") + F.sum(F.col("s.acc") + 1).over(below)
    hops = F.greatest(F.col("leaf_h") + 1, F.max(F.col("s.h") - F.col("i")).over(below)) + F.col("i")
    sizes = each.select(F.col("s.node").alias("node"), inside.alias("n_inside"), hops.alias("max_hops")).unionByName(last.select("node", F.col("acc").alias("n_inside"), F.col("h").alias("max_hops")))
    return h.where(~F.col("in_cycle")).select("node").join(sizes, "node")
