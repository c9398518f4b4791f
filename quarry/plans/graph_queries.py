"""Queries over the call graph that the handlers' stacks describe, and over the walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import clean_name, trim_blanks
from quarry.operators import graph as G
from quarry.operators import walks as W
from quarry.operators.components import connected_components
from quarry.operators.skew import global_rank
from quarry.session import load


def stack_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) of the stacks ``outer.site>inner.site``.

    A site calls the next function's entry and returns to ``function.r<site>``;
    an entry leads to its sites, labelled with the function's name; the inner
    site may return to the outer return node.
    """
    stacks = load(spark, sf_dir, "eh_handler").where("stack is not null").select("stack").distinct()
    hop = stacks.select("stack", F.posexplode(F.split("stack", ">")).alias("pos", "site")).select("stack", "pos", trim_blanks("site").alias("site")).where("site like '%.%'")
    nxt = hop.select("stack", (F.col("pos") - 1).alias("pos"), F.col("site").alias("inner"))
    fn = lambda c: F.substring_index(c, ".", 1)
    back = F.concat(fn(F.col("site")), F.lit(".r"), F.substring_index("site", ".", -1))
    inner = hop.select(F.concat(fn(F.col("site")), F.lit(".0")).alias("source"), F.col("site").alias("target"), F.lit("").alias("label"), fn(F.col("site")).alias("word")).distinct()
    pairs = hop.join(nxt, ["stack", "pos"])
    calls = pairs.select(F.col("site").alias("source"), F.concat(fn(F.col("inner")), F.lit(".0")).alias("target"), F.lit("call").alias("label")).distinct()
    rets = pairs.select(F.col("site").alias("source"), back.alias("target"), F.lit("ret").alias("label")).distinct()
    mays = pairs.select(F.col("inner").alias("source"), back.alias("target"), F.lit("may_ret").alias("label")).distinct()
    words = inner.select("word").distinct()
    labels = global_rank(words, ["word"]).select((F.col("rank") - 1).cast("int").alias("id"), F.col("word").alias("label"))
    coded = inner.join(labels.select("id", F.col("label").alias("word")), "word").select("source", "target", "label", F.array("id").alias("label_id"))
    rest = calls.unionByName(rets).unionByName(mays).withColumn("label_id", F.array().cast("array<int>"))
    return coded.unionByName(rest), labels


def edge_kinds(spark, sf_dir):
    edges, _ = stack_edges(spark, sf_dir)
    return edges.groupBy(G.kind("label").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def return_nodes(spark, sf_dir):
    return G.return_nodes(stack_edges(spark, sf_dir)[0])


def may_return_lists(spark, sf_dir):
    return G.may_return(stack_edges(spark, sf_dir)[0]).select("node", F.array_join("may_ret", " ").alias("may_ret"))


def bypass_edges(spark, sf_dir):
    edges, labels = stack_edges(spark, sf_dir)
    arcs, new = G.bypass_edges(edges, labels)
    return arcs.select("source", "target", F.get("label_id", F.lit(0)).alias("id")).join(new, "id").select("source", "target", "label")


def pushdown_counts(spark, sf_dir):
    arcs, _ = G.pushdown(*stack_edges(spark, sf_dir))
    return G.graph_counts(arcs)


def pushdown_arcs(spark, sf_dir):
    arcs, _ = G.pushdown(*stack_edges(spark, sf_dir))
    return arcs.select("source", "target", "push", F.size("label_id").alias("n_labels"))


def label_occurrences(spark, sf_dir):
    arcs, labels = G.pushdown(*stack_edges(spark, sf_dir))
    return G.label_rows(arcs, labels).select("label", "target", F.size("label_id").alias("n_labels"))


def degree_hist(spark, sf_dir):
    return G.degree_histogram(stack_edges(spark, sf_dir)[0])


def degree_log_hist(spark, sf_dir):
    d = stack_edges(spark, sf_dir)[0].groupBy("source").agg(F.count(F.lit(1)).alias("d"))
    return G.log_histogram(d, "d", 10, 100.0)


def call_sites(spark, sf_dir):
    return G.call_sites(stack_edges(spark, sf_dir)[0])


def _calls(spark, sf_dir):
    edges, _ = stack_edges(spark, sf_dir)
    return edges.where("label = 'call'").select(G.function_of("source").alias("source"), G.function_of("target").alias("target")).distinct()


def _roots(spark, sf_dir):
    """The functions that none calls."""
    calls = _calls(spark, sf_dir)
    return calls.select(F.col("source").alias("node")).distinct().join(calls.select(F.col("target").alias("node")), "node", "left_anti")


def reachable_functions(spark, sf_dir):
    return G.reachable(_calls(spark, sf_dir), _roots(spark, sf_dir))


def call_distances(spark, sf_dir):
    return G.distances(_calls(spark, sf_dir), _roots(spark, sf_dir)).withColumn("distance", F.col("distance").cast("int"))


def functions_between(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    end = calls.select(F.col("target").alias("node")).distinct().join(calls.select(F.col("source").alias("node")), "node", "left_anti")
    return G.between(calls, _roots(spark, sf_dir), end)


def call_components(spark, sf_dir):
    return connected_components(_calls(spark, sf_dir), "source", "target")


def may_return_edges(spark, sf_dir):
    edges, _ = stack_edges(spark, sf_dir)
    return G.may_return_edges(edges.where("label <> 'may_ret'"))


def dot_lines(spark, sf_dir):
    return G.dot_lines(stack_edges(spark, sf_dir)[0])


def wrapper_functions(spark, sf_dir):
    edges, _ = stack_edges(spark, sf_dir)
    return G.wrappers(edges.where("label = 'call'").select(G.function_of("source").alias("fn"), F.col("source").alias("block"), F.col("target").alias("callee")))


def flat_sentences(spark, sf_dir):
    edges, _ = stack_edges(spark, sf_dir)
    calls = edges.where("label = 'call'").select(G.function_of("source").alias("fn"), F.struct("source", "target").alias("pos"), G.function_of("target").alias("callee"))
    return G.flat_sentences(calls).select("fn", F.array_join("callees", " ").alias("callees"))


def random_walks(spark, sf_dir):
    edges, labels = stack_edges(spark, sf_dir)
    arcs, labels = G.pushdown(edges, labels)
    return W.random_walks(arcs, edges, labels, walks_per_label=100, length=100, bias=1.5, seed=1).select("walk_id", "start_label", F.array_join("tokens", " ").alias("tokens"), "edges_visited", "max_depth")


def flat_walks(spark, sf_dir):
    arcs, labels = G.pushdown(*stack_edges(spark, sf_dir))
    return W.flat_walks(arcs, labels, 100).select("fn", "round", F.array_join("tokens", " ").alias("tokens"))


def walk_label_hist(spark, sf_dir):
    return W.label_histogram(load(spark, sf_dir, "pathbased_walks"))


def walk_length_hist(spark, sf_dir):
    return W.length_histogram(load(spark, sf_dir, "pathbased_walks"))


def walk_depth_hist(spark, sf_dir):
    return W.depth_histogram(load(spark, sf_dir, "pathbased_walks"))


def bootstrap_groups(spark, sf_dir):
    rows = load(spark, sf_dir, "eh_handler").select(F.get(F.split("predicate_loc", ":"), F.lit(0)).alias("field"), clean_name("parent_function").alias("fn")).where("field <> '' and fn is not null")
    return G.bootstrap_groups(rows).select("field", F.array_join("functions", " ").alias("functions"))


QUERIES = {f.__name__: f for f in (edge_kinds, return_nodes, may_return_lists, bypass_edges, pushdown_counts, pushdown_arcs, label_occurrences, degree_hist, degree_log_hist, call_sites, reachable_functions, call_distances, functions_between, call_components, may_return_edges, dot_lines, wrapper_functions, flat_sentences, random_walks, flat_walks, walk_label_hist, walk_length_hist, walk_depth_hist, bootstrap_groups)}

_E = """stacks as (select distinct stack from eh_handler where stack is not null),
raw as (select stack, unnest(string_split(stack, '>')) as s, generate_subscripts(string_split(stack, '>'), 1) - 1 as pos from stacks),
hop as (select stack, pos, trim(s, ' \t') as site from raw where trim(s, ' \t') like '%.%'),
named as (select stack, pos, site, split_part(site, '.', 1) as fn, split_part(site, '.', 1) || '.r' || split_part(site, '.', -1) as back from hop),
pairs as (select a.site, a.fn, a.back, b.site as inner_site, b.fn as inner_fn from named a join named b on a.stack = b.stack and a.pos + 1 = b.pos),
edges as (select distinct fn || '.0' as source, site as target, '' as label from named
  union all select distinct site, inner_fn || '.0', 'call' from pairs
  union all select distinct site, back, 'ret' from pairs
  union all select distinct inner_site, back, 'may_ret' from pairs),
rets as (select source as node, max(target) as return_node from edges where label = 'ret' group by 1),
calls as (select distinct split_part(source, '.', 1) as source, split_part(target, '.', 1) as target from edges where label = 'call'),
arcs as (select source, target, null as push, 1 as n_labels, split_part(source, '.', 1) as word from edges where label = ''
  union all select source, target, return_node, 0, null from edges left join rets on node = source where label = 'call'
  union all select distinct source, return_node, null, 1, split_part(target, '.', 1) from edges join rets on node = source where label = 'call')"""
_ROOTS = "roots as (select distinct source as node from calls where source not in (select target from calls))"

SQL = {
    "edge_kinds": f"with {_E} select case label when '' then 'internal' else label end as kind, count(*)::bigint as n from edges group by 1",
    "return_nodes": f"with {_E} select node, return_node from rets",
    "may_return_lists": f"with {_E} select source as node, string_agg(distinct target, ' ' order by target) as may_ret from edges where label = 'may_ret' group by 1",
    "bypass_edges": f"with {_E} select distinct source, return_node as target, split_part(target, '.', 1) as label from edges join rets on node = source where label = 'call'",
    "pushdown_counts": f"with {_E} select (select count(distinct n) from (select source as n from arcs union select target from arcs)) as n_nodes, (select count(*) from arcs) as n_arcs, (select count(distinct case when a = 'x' then word end) + count(distinct case when a = 'y' then word end) from (select 'x' as a, word from arcs where push is null and target not like '%.r%' and n_labels = 1 union all select 'y', word from arcs where target like '%.r%' and n_labels = 1)) as n_labels",
    "pushdown_arcs": f"with {_E} select source, target, push, n_labels from arcs",
    "label_occurrences": f"with {_E} select distinct word as label, target, n_labels::int as n_labels from arcs where n_labels = 1",
    "degree_log_hist": f"with {_E}, d as (select source, count(*) as d from edges group by 1) select least(floor(log10(d) / 2 * 10) + 1, 11)::bigint as bin, count(*)::bigint as n from d group by 1",
    "degree_hist": f"with {_E}, d as (select source, count(*) as degree from edges group by 1) select degree, count(*)::bigint as n from d group by 1",
    "call_sites": f"with {_E} select split_part(target, '.', 1) as callee, count(distinct source)::bigint as n from edges where label = 'call' group by 1",
    "reachable_functions": f"with recursive {_E}, {_ROOTS}, r as (select node from roots union select target from r join calls on source = node) select node from r",
    "call_distances": f"with recursive {_E}, {_ROOTS}, r as (select node as start, node, 0 as distance from roots union select start, target, distance + 1 from r join calls on source = node where distance < 40) select start, node, min(distance)::int as distance from r group by 1, 2",
    "functions_between": f"with recursive {_E}, {_ROOTS}, ends as (select distinct target as node from calls where target not in (select source from calls)), f as (select node from roots union select target from f join calls on source = node), b as (select node from ends union select source from b join calls on target = node) select node from f where node in (select node from b)",
    "call_components": f"with recursive {_E}, both_ways as (select source as a, target as b from calls union select target, source from calls), r as (select a as node, a as low from both_ways union select b, low from r join both_ways on a = node) select node, min(low) as component from r group by 1",
    "may_return_edges": f"with {_E}, e as (select * from edges where label <> 'may_ret'), n as (select source as node from e union select target from e), x as (select node, split_part(node, '.', 1) as fn from n where node not in (select source from e where label in ('', 'ret'))) select distinct x.node as source, return_node as target from x join e on label = 'call' and split_part(e.target, '.', 1) = fn join rets on rets.node = e.source",
    "dot_lines": f"with {_E} select '\"' || source || '\" -> \"' || target || '\" [label=\"' || label || '\"];' as value from edges",
    "wrapper_functions": f"with {_E} select split_part(source, '.', 1) as fn from edges where label = 'call' group by 1 having count(distinct source) = 1 and count(*) = 1",
    "flat_sentences": f"with {_E} select split_part(source, '.', 1) as fn, string_agg(split_part(target, '.', 1), ' ' order by source, target) as callees from edges where label = 'call' group by 1",
    "walk_label_hist": "select label, count(*)::bigint as n from (select unnest(tokens) as label from pathbased_walks) where label is not null group by 1",
    "walk_length_hist": "select coalesce(len(tokens), 0)::int as length, count(*)::bigint as n from pathbased_walks group by 1",
    "walk_depth_hist": "select max_depth, count(*)::bigint as n from pathbased_walks group by 1",
    "bootstrap_groups": "with r as (select distinct split_part(predicate_loc, ':', 1) as field, nullif(trim(split_part(trim(parent_function, ' \t'), '.', 1), ' \t'), '') as fn from eh_handler) select field, string_agg(fn, ' ' order by fn) as functions from r where field <> '' and fn is not null and field not like '%#%' group by 1 having count(*) >= 2",
}
