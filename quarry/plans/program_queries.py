"""Queries over program facts: instructions, fields, branches, visitors, settings and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import paths as P
from quarry.operators import settings
from quarry.operators import specs as S
from quarry.plans.graph_queries import stack_edges
from quarry.plans.spec_queries import _MERGED, _H, handlers, rules, similar
from quarry.session import cut, load
from quarry.sources import domain as D


def instructions(spark, sf_dir):
    """Events as instructions: 50 functions of many blocks, with files, lines and constants."""
    e, n = load(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        n.alias("node"), n.alias("pos"), F.concat(F.lit("f"), F.col("user_id") % 50, F.lit(".x")).alias("fn"), F.col("user_id").alias("block"), F.col("event_type").alias("op"),
        F.when(n % 11 != 0, F.concat(F.lit("d"), F.col("user_id") % 7, F.lit("/"), "event_type", F.lit(".c"))).alias("file"), (n % 1000).cast("int").alias("line"), (n % 9 - 4).cast("int").alias("value"),
    )


def defined_functions(spark, sf_dir):
    return D.defined_functions(instructions(spark, sf_dir))


def source_ranges(spark, sf_dir):
    i = instructions(spark, sf_dir)
    return D.source_ranges(i, i.where("block % 2 = 0").select(F.col("fn").alias("name")))


def block_chain(spark, sf_dir):
    return P.block_chain(instructions(spark, sf_dir))


def function_names(spark, sf_dir):
    return P.function_names(stack_edges(spark, sf_dir)[0])


def error_code_uses(spark, sf_dir):
    """The codes are -4 and -3; every instruction leads to the next of its block."""
    i = instructions(spark, sf_dir).withColumn("location", F.concat_ws(":", "file", F.col("line").cast("string")))
    codes = spark.createDataFrame([(-4,), (-3,)], "value int")
    return P.error_code_uses(i, P.block_chain(i), codes)


def instruction_labels(spark, sf_dir):
    i = instructions(spark, sf_dir)
    error = F.when(F.col("value") == -4, F.lit("EIO"))
    struct = F.when(F.col("value") == 1, P.struct_name(F.concat(F.lit("struct."), "op", F.lit(".12"))))
    return i.select("node", P.instruction_label(F.col("op"), error, struct, F.col("block").cast("string"), F.col("value") == 2).alias("label"))


def indirect_calls(spark, sf_dir):
    """Fields are (op, block modulo 3); purchases store their function, clicks call."""
    i = instructions(spark, sf_dir).select("node", "fn", "op", "block", (F.col("block") % 3).cast("string").alias("index"), F.lit("s").alias("struct"))
    stores = i.where("op = 'purchase'").select("struct", "index", "fn")
    return P.indirect_calls(i.where("op = 'click'").select("node", "struct", "index"), P.points_to(stores))


def branch_listing(spark, sf_dir):
    h = load(spark, sf_dir, "eh_handler").select(F.col("parent_function").alias("fn"), F.substring_index("predicate_loc", ":", 1).alias("file"), "id")
    return P.branches_like(h, "_s", "s").select("id", "fn", "file")


def file_ends(spark, sf_dir):
    """The first and last location of every file."""
    at = load(spark, sf_dir, "eh_handler").select(P.location(F.col("predicate_loc")).alias("at")).where("at.file <> ''")
    return at.groupBy("at.file").agg(F.min("at")["line"].alias("first"), F.max("at")["line"].alias("last"), F.count_distinct("at").alias("n"))


def setting_names(spark, sf_dir):
    """The published grid of settings with the names of its runs."""
    every = settings.grid(length=["100", "300"], numwalks=["100"], interproc=["1"], removecross=["0", "1"], bias=["1.0", "1.5", "2.0"])
    rows = spark.createDataFrame([tuple(c.values()) for c in every], ", ".join(f"{k} string" for k in every[0]))
    return rows.select(settings.run_name({k: F.col(k) for k in ("bias", "removecross", "length", "numwalks", "interproc")}, ("bias",)).alias("name"))


def rules_applying_counted(spark, sf_dir):
    h = handlers(spark, sf_dir)
    return S.applies_counted(rules(spark, sf_dir, h), h)


def visitor_edges(spark, sf_dir):
    """Edges followed when functions with a name of even length are barred and return nodes were seen."""
    e, _ = stack_edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    stacks = nodes.select("node", F.substring_index("node", ".", 1).alias("stack"))
    return P.inner_edges(e.select("source", "target", "label"), stacks, stacks.where(F.length("stack") % 2 == 0), nodes.where("node like '%.r%'"))


def handlers_met(spark, sf_dir):
    """Handlers met on the way: a stack visits the functions it names; handlers are those of the nesting's functions."""
    h = load(spark, sf_dir, "eh_handler").where("stack is not null").select("stack").distinct()
    each = h.select("stack", F.explode(F.split("stack", ">")).alias("node")).select("stack", F.trim("node").alias("node")).where("node <> ''").distinct()
    own = h.select(F.trim(F.substring_index("stack", ">", -1)).alias("node"), "stack")
    return P.nesting_pairs(each, own, h.where(F.length("stack") % 2 == 0))


def error_pairs(spark, sf_dir):
    """Calls of a stack as a path; those with a name of even length take their error branch."""
    h = load(spark, sf_dir, "eh_handler").where("stack is not null").select("stack").distinct()
    name = lambda c: F.trim(F.substring_index(c, ".", 1))
    p = h.select(F.filter(F.transform(F.split("stack", ">"), name), lambda x: x != "").alias("path"))
    p = p.withColumn("taken", F.filter("path", lambda x: F.length(x) % 2 == 0))
    known = cut(p.select(F.explode("path").alias("x")).distinct()).where(F.length("x") % 3 == 0)
    return P.error_pairs(p, [r["x"] for r in known.orderBy("x").collect()])


def result_tables(spark, sf_dir):
    h = handlers(spark, sf_dir)
    r = rules(spark, sf_dir, h)
    ids = D.spec_tables(r.select("rule_id", "context", "response", F.lit(0).alias("support"), F.lit(0.0).alias("confidence")))["Spec"].select("id")
    from quarry.operators.skew import global_rank

    keyed = global_rank(r.select("rule_id"), ["rule_id"], "id").select("rule_id", F.col("id").cast("bigint").alias("id")).join(ids, "id", "left_semi")
    return D.results_table(S.results(r, h), keyed, h)


def merged_spec_table(spark, sf_dir):
    from quarry.operators.skew import global_rank

    r = rules(spark, sf_dir)
    groups = cut(S.merge_rules(r, similar(spark, sf_dir, r), 0.6))
    keyed = global_rank(groups.select("rule_id").distinct(), ["rule_id"], "id").select("rule_id", F.col("id").cast("bigint").alias("id"))
    return D.merged_spec_table(groups.select("group_id", "rule_id"), keyed)


QUERIES = {f.__name__: f for f in (defined_functions, source_ranges, block_chain, function_names, error_code_uses, instruction_labels, indirect_calls, branch_listing, file_ends, setting_names, rules_applying_counted, visitor_edges, handlers_met, error_pairs, result_tables, merged_spec_table)}

from quarry.plans.graph_queries import _E  # noqa: E402

_I = """ins as (select event_id as node, 'f' || user_id % 50 || '.x' as fn, user_id as block, event_type as op,
  case when event_id % 11 <> 0 then 'd' || user_id % 7 || '/' || event_type || '.c' end as file, (event_id % 1000)::int as line, (event_id % 9 - 4)::int as value from events),
chain as (select node as source, lead(node) over (partition by fn, block order by node) as target from ins)"""

SQL = {
    "defined_functions": f"with {_I} select split_part(fn, '.', 1) as name, arg_min(file, node) as path from ins where file is not null group by 1",
    "source_ranges": f"with {_I} select fn, min(line) as first, max(line) as last from ins where fn in (select fn from ins where block % 2 = 0) group by fn",
    "block_chain": f"with {_I} select source, target from chain where target is not null",
    "function_names": f"with {_E} select split_part(source, '.', 1) as fn from edges union select split_part(target, '.', 1) from edges",
    "error_code_uses": f"with {_I} select distinct concat_ws(':', file, line) as location from ins where node in (select source from chain where target in (select node from ins where value in (-4, -3)))",
    "instruction_labels": f"with {_I} select node, case when value = 2 then 'F2V_CONDBR' when value = -4 then 'F2V_ERR_EIO' when value = 1 then 'F2V_GEP_' || op || '_' || block else 'F2V_INST_' || op end as label from ins",
    "indirect_calls": f"with {_I} select node, callee from (select node, block % 3 as k from ins where op = 'click') join (select distinct block % 3 as k, fn as callee from ins where op = 'purchase') using (k)",
    "branch_listing": "select id, parent_function as fn, split_part(predicate_loc, ':', 1) as file from eh_handler where parent_function like '%\\_s%' escape '\\' and split_part(predicate_loc, ':', 1) like '%s%'",
    "file_ends": "with l as (select split_part(predicate_loc, ':', 1) as file, coalesce(try_cast(split_part(predicate_loc, ':', -1) as int), 0) as line from eh_handler where predicate_loc is not null) select file, min(line) as first, max(line) as last, count(distinct line)::bigint as n from l where file <> '' group by file",
    "setting_names": "select 'bias' || b || '_removecross' || c || '_length' || l || '_numwalks100_interproc1' as name from (values ('1-0'), ('1-5'), ('2-0')) x(b), (values (0), (1)) y(c), (values (100), (300)) z(l)",
    "rules_applying_counted": f"with recursive {_H} select rule_id, hc.loc from rules join hc on list_has_all(hc.names, cl) where not list_has_all(hc.names, pl) or list_has_any(cl, pl)",
    "visitor_edges": f"with {_E} select source, target, label from edges where label not in ('call', 'may_ret') and length(split_part(target, '.', 1)) % 2 <> 0 and target not like '%.r%'",
    "handlers_met": "with h as (select distinct stack from eh_handler where stack is not null), v as (select distinct stack, trim(n, ' ') as node from (select stack, unnest(string_split(stack, '>')) as n from h) where trim(n, ' ') <> ''), own as (select trim(split_part(stack, '>', -1), ' ') as node, stack as child from h) select distinct stack as parent, child from v join own using (node) where child <> stack and length(child) % 2 = 0",
    "error_pairs": """with h as (select distinct stack from eh_handler where stack is not null),
p as (select list_filter(list_transform(string_split(stack, '>'), lambda x: trim(split_part(x, '.', 1), ' ')), lambda x: x <> '') as path from h),
s as (select path, unnest(range(1, len(path) + 1)) as i from p), spot as (select path, i, path[i] as call from s where length(path[i]) % 3 = 0)
select distinct case when length(call) % 2 = 0 then 'ERR_' else 'NO_ERR_' end || call as first,
  unnest(list_append(path[i + 1:], case when len(list_filter(path, lambda x: length(x) % 2 = 0)) > 0 then 'RETURN_ERR' else 'RETURN_NO_ERR' end)) as second from spot""",
    "result_tables": f"with recursive {_H}, ids as (select rule_id, row_number() over (order by rule_id) as spec from rules) select spec, han.id as handler, violation from res join ids using (rule_id) join han using (loc)",
    "merged_spec_table": f"with recursive {_H}, {_MERGED}, ids as (select group_id, row_number() over (order by rule_id) as id from classes) select min(id) over (partition by group_id) as spec, id as supporting from ids",
}
