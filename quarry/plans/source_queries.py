"""Queries that run readers and writers over lines made from the tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quarry.functions.names import clean_name, clean_name_sql, trim_blanks
from quarry.operators import embedding as E
from quarry.operators import itemsets as I
from quarry.operators import paths as P
from quarry.operators import specs as S
from quarry.plans.gold_queries import clusters, relations
from quarry.plans.graph_queries import stack_edges
from quarry.plans.mining_queries import DEEP, _rules, baskets
from quarry.plans.spec_queries import handlers, rules
from quarry.plans.vector_queries import vectors
from quarry.sources import domain as D
from quarry.sources import records as R
from quarry.session import cut, load


def edge_lines(spark, sf_dir):
    return D.edge_lines(stack_edges(spark, sf_dir)[0].withColumn("location", F.lit("")))


def walk_round_trip(spark, sf_dir):
    walks = load(spark, sf_dir, "pathbased_walks").select(F.filter(F.transform("tokens", clean_name), lambda t: t.isNotNull()).alias("tokens"))
    back = D.read_walks(spark, D.walk_lines(walks), ["F2V_INST_"])
    return back.groupBy(F.size("tokens").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def vector_round_trip(spark, sf_dir):
    v = vectors(spark, sf_dir)
    back = D.read_vectors(spark, D.vector_lines(v))
    return back.select("word", F.round(E.dot(F.col("vector"), F.col("vector")), 5).alias("norm2"))


def cluster_round_trip(spark, sf_dir):
    back = D.read_clusters(spark, D.cluster_lines(clusters(spark, sf_dir)))
    return back.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("clusters"))


def relation_round_trip(spark, sf_dir):
    back = D.read_relations(spark, D.relation_lines(relations(spark, sf_dir)))
    return back.select("must", F.array_join("a", " ").alias("a"), F.array_join("b", " ").alias("b"))


def transaction_round_trip(spark, sf_dir):
    out = R.write_transactions(baskets(spark, sf_dir).withColumn("wgt", F.lit(2)), weight=True)
    back = R.read_transactions(spark, out, weight=True, comment="")
    return back.groupBy(F.array_join("items", " ").alias("items")).agg(F.sum("wgt").alias("wgt"))


def set_lines(spark, sf_dir):
    return R.write_sets(I.mine(baskets(spark, sf_dir), support=DEEP), " (%a)")


def rule_lines(spark, sf_dir):
    return R.write_rules(_rules(spark, sf_dir), " (%a, %b)")


def spectrum_lines(spark, sf_dir):
    return R.write_spectrum(I.spectrum(I.mine(baskets(spark, sf_dir), support=DEEP)))


def spec_table_round_trip(spark, sf_dir):
    h = handlers(spark, sf_dir)
    r = rules(spark, sf_dir, h)
    c = S.confidences(r.withColumn("group_id", F.col("rule_id")), h).select(F.col("group_id").alias("rule_id"), "support", F.col("global_confidence").alias("confidence"))
    back = D.read_specs({k: cut(v) for k, v in D.spec_tables(cut(r.join(c, "rule_id"))).items()})
    return back.select("id", "support", F.round("confidence", 8).alias("confidence"), F.array_join("context", " ").alias("context"), F.array_join("response", " ").alias("response"))


def item_of_instruction(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "view", "store").otherwise(F.col("event_type")).alias("op"), F.col("event_type").alias("name"))
    return P.instruction_items(e.select(F.col("event_id").alias("node"), "op", "name"))


def branch_safety(spark, sf_dir):
    """Every predicate with zero, an error code, a negative number that is none, and a positive one, on either side."""
    predicates = F.array(*[F.lit(x) for x in ("eq", "ne", "slt", "sle", "sgt", "sge", "ult")])
    number = F.col("event_id")
    rows = load(spark, sf_dir, "events").select("event_id", F.get(predicates, (number % 7).cast("int")).alias("predicate"), F.get(F.array(*[F.lit(x) for x in (0, -5, -7, 3)]), (number % 4).cast("int")).alias("constant"), (number % 3 == 0).alias("right"))
    code = F.col("constant") == -5
    s, p = (P.branch_safety(F.col("predicate"), F.col("constant"), code, F.col("right"), positive) for positive in (False, True))
    return rows.select("event_id", s["safe"].alias("safe"), s["unsafe"].alias("unsafe"), p["safe"].alias("positive_safe"), p["unsafe"].alias("positive_unsafe"))


def caller_pairs(spark, sf_dir):
    edges, _ = stack_edges(spark, sf_dir)
    calls = edges.where("label = 'call'").select(F.substring_index("source", ".", 1).alias("fn"), F.substring_index("target", ".", 1).alias("call"))
    return P.caller_pairs(calls)


def context_paths(spark, sf_dir):
    """Every stack as a program of its own: what is called around its innermost call."""
    stacks = load(spark, sf_dir, "eh_handler").where("stack is not null").select("stack").distinct()
    hop = stacks.select("stack", F.posexplode(F.split("stack", ">")).alias("pos", "site")).select(F.xxhash64("stack").cast("string").alias("s"), "pos", trim_blanks("site").alias("site")).where("site like '%.%'")
    hop = cut(hop.select("s", "pos", F.substring_index("site", ".", 1).alias("name")))
    node = lambda what: F.concat_ws("/", "s", "pos", F.lit(what))
    fn = F.concat_ws("/", "s", "pos")
    nxt = hop.select("s", (F.col("pos") - 1).alias("pos"), F.col("name").alias("inner"))
    pairs = hop.join(nxt, ["s", "pos"], "left")
    calls = pairs.where("inner is not null").select(node("site").alias("node"), F.concat_ws("/", "s", F.col("pos") + 1).alias("callee"), node("back").alias("back"))
    steps = hop.select(F.explode(F.array(F.struct(node("in").alias("a"), node("site").alias("b")), F.struct(node("site").alias("a"), node("back").alias("b")))).alias("e")).select(F.col("e.a").alias("source"), F.col("e.b").alias("target"))
    none = F.lit(None).cast("string")
    kinds = [("in", none, True, False), ("site", F.col("inner"), False, False), ("back", none, False, True)]
    nodes = None
    for what, call, entry, leave in kinds:
        rows = pairs.select(node(what).alias("node"), fn.alias("fn"), call.alias("call"), F.lit(entry).alias("entry"), F.lit(leave).alias("exit"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    wanted = pairs.where("inner is not null").select(F.col("inner").alias("name")).distinct()
    return P.path_lines(P.context_paths(cut(steps), cut(nodes), cut(calls), wanted, 100), True)


QUERIES = {f.__name__: f for f in (edge_lines, walk_round_trip, vector_round_trip, cluster_round_trip, relation_round_trip, transaction_round_trip, set_lines, rule_lines, spectrum_lines, spec_table_round_trip, item_of_instruction, branch_safety, caller_pairs, context_paths)}
from quarry.plans.gold_queries import _CLS, _REL  # noqa: E402
from quarry.plans.graph_queries import _E  # noqa: E402
from quarry.plans.mining_queries import _DEEP_SQL, _PICK, _RULES, _TX, _all  # noqa: E402
from quarry.plans.spec_queries import _H  # noqa: E402

SQL = {
    "edge_lines": f"with {_E} select concat_ws(' ', source, target, nullif(label, '')) as value from edges",
    "walk_round_trip": f"with t as (select row_number() over () as i, tokens from pathbased_walks), u as (select i, {clean_name_sql('k')} as k from (select i, unnest(tokens) as k from t)), g as (select i, count(k) as n, count(*) filter (k not like 'F2V\\_INST\\_%' escape '\\') as m from u group by i) select m::int as length, count(*)::bigint as n from g where n > 1 group by 1",
    "vector_round_trip": "select printf('v%07d', vec_id) as word, round(list_dot_product(embedding::double[], embedding::double[]), 5) as norm2 from embeddings",
    "cluster_round_trip": f"with {_CLS}, n as (select cluster_id, count(*)::bigint as n from clusters group by 1) select n, count(*)::bigint as clusters from n group by 1",
    "relation_round_trip": f"with {_REL} select true as must, name as a, wrapper as b from pairs union all select false, x, y from apart",
    "transaction_round_trip": f"with {_TX}, b as (select tid, string_agg(item, ' ' order by item) as items from tx group by tid) select items, (2 * count(*))::bigint as wgt from b group by 1",
    "set_lines": f"with recursive {_all(_DEEP_SQL)} select items || ' (' || supp::varchar || ')' as value from sets",
    "rule_lines": f"with recursive {_RULES} select head || ' <- ' || body || ' (' || s::bigint::varchar || ', ' || bs::bigint::varchar || ')' as value from rules {_PICK}",
    "spectrum_lines": f"with recursive {_all(_DEEP_SQL)} select size::varchar || ' ' || supp::varchar || ' ' || count(*)::varchar as value from sets group by size, supp",
    "spec_table_round_trip": f"with recursive {_H} select row_number() over (order by rule_id) as id, support, round(g, 8) as confidence, c as context, p as response from conf join rules using (rule_id)",
    "item_of_instruction": "select event_id as node, event_type as name, case event_type when 'click' then 'CALL' else 'STORE' end as type from events where event_type in ('click', 'view')",
    "branch_safety": """with e as (select event_id, ['eq', 'ne', 'slt', 'sle', 'sgt', 'sge', 'ult'][event_id % 7 + 1] as p, [0, -5, -7, 3][event_id % 4 + 1] as c, event_id % 3 = 0 as r from events),
table_of(p, c, safe, unsafe) as (values ('eq', 0, 'T', 'F'), ('eq', -5, 'N', 'T'), ('ne', 0, 'F', 'T'), ('ne', -5, 'N', 'N'),
  ('slt', 0, 'F', 'T'), ('slt', -5, 'F', 'T'), ('sle', 0, 'F', 'T'), ('sle', -5, 'F', 'T'), ('sgt', 0, 'T', 'F'), ('sgt', -5, 'T', 'F'), ('sge', 0, 'T', 'F'), ('sge', -5, 'T', 'F'))
select event_id, coalesce(case when signed and not r then unsafe else safe end, 'N') as safe, coalesce(case when signed and not r then safe else unsafe end, 'N') as unsafe,
  coalesce(case when signed and r then unsafe else safe end, 'N') as positive_safe, coalesce(case when signed and r then safe else unsafe end, 'N') as positive_unsafe
from (select *, p in ('slt', 'sle', 'sgt', 'sge') as signed from e) left join table_of using (p, c)""",
    "context_paths": f"with {_E} select distinct 'PATH_BEGIN ' || inner_fn || ' PATH_END' as value from pairs",
    "caller_pairs": f"with {_E} select distinct split_part(target, '.', 1) as call, 'CALLER_' || split_part(source, '.', 1) as caller from edges where label = 'call'",
}
