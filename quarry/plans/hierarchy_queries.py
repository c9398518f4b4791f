"""Queries over nested error handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.hierarchy import descendants, hierarchy, path_text, paths, peel, subtree_sizes
from quarry.session import load


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(load(spark, sf_dir, "eh_nesting"), "parent_handler", "child_handler", "loaded_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_text(_tree(spark, sf_dir)).select(F.col("node").alias("handler"), F.col("root").alias("root_handler"), "depth", "path")


def p4_subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    peeled = peel(load(spark, sf_dir, "eh_nesting"), "parent_handler", "child_handler", "loaded_at")
    return subtree_sizes(peeled, paths(peeled)).withColumnRenamed("node", "handler")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_tree(spark, sf_dir)).select(F.col("ancestor").alias("handler"), F.col("descendant").alias("inside"), "hops")


QUERIES = {"p4_found": p4_found, "p4_subtree_sizes": p4_subtree_sizes, "p4_descendants": p4_descendants}

_LINKS = """ids as (
  select parent_handler as h from eh_nesting where parent_handler is not null
  union select child_handler from eh_nesting where child_handler is not null),
links as (
  select child_handler as c, parent_handler as p from eh_nesting
  where parent_handler is not null and child_handler is not null
  qualify row_number() over (partition by child_handler order by loaded_at desc nulls last, parent_handler desc) = 1),
tree as (
  select h as node, h as root, 0::bigint as depth, h::varchar as path from ids where h not in (select c from links)
  union all
  select l.c, t.root, t.depth + 1, t.path || '/' || l.c::varchar from tree t join links l on l.p = t.node)"""

SQL = {
    "p4_found": f"""with recursive {_LINKS},
rest as (select h from ids where h not in (select node from tree)),
up as (
  select h as node, h as at from rest
  union
  select u.node, l.p from up u join links l on l.c = u.at),
loops as (
  select distinct l.c as node from links l join up u on u.node = l.p and u.at = l.c join rest r on r.h = l.c),
cyc as (select u.node, min(u.at) as root from up u join loops k on k.node = u.at group by u.node)
select node as handler, root as root_handler, depth, path from tree
union all
select node, root, -1::bigint, case when node in (select node from loops) then 'cycle' else 'below cycle' end from cyc""",
    "p4_descendants": f"""with recursive {_LINKS},
ups as (
  select t.node as d, l.p as a, 1::bigint as hops from tree t join links l on l.c = t.node
  union all
  select u.d, l.p, u.hops + 1 from ups u join links l on l.c = u.a)
select a as handler, d as inside, hops from ups""",
    "p4_subtree_sizes": f"""with recursive {_LINKS},
ups as (
  select t.node as d, l.p as a, 1::bigint as hops from tree t join links l on l.c = t.node
  union all
  select u.d, l.p, u.hops + 1 from ups u join links l on l.c = u.a)
select t.node as handler, count(u.d)::bigint as n_inside, coalesce(max(u.hops), 0)::bigint as max_hops
from tree t left join ups u on u.a = t.node group by t.node""",
}
