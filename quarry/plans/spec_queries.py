"""Queries that mine specifications from the handler tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import specs as S
from quarry.session import cut, load

LEAST = 5


def handlers(spark, sf_dir):
    return cut(S.load_handlers(*[load(spark, sf_dir, t) for t in ("eh_handler", "eh_context", "eh_response")]))


def rules(spark, sf_dir, h=None):
    return cut(S.mine_rules(h if h is not None else handlers(spark, sf_dir), _least(spark, sf_dir)))


def _least(spark, sf_dir):
    """0.5 percent of the handlers, 5 at least."""
    return max(LEAST, load(spark, sf_dir, "eh_handler").count() // 200)


def similar(spark, sf_dir, r):
    """(x, y, sim): names of the rules ``r`` with the same last part count as synonyms of 0.9.

    Merging asks for no other names, and the pairs of all labels are as many
    as the square of the table.
    """
    named = r.select(F.explode(F.concat("context", "response")).alias("x")).distinct()
    n = load(spark, sf_dir, "pathbased_model").select(F.col("label").alias("x")).where("x is not null").distinct().join(named, "x", "left_semi")
    n = cut(n.withColumn("k", F.substring_index("x", "_", -1)))
    return n.join(n.select(F.col("x").alias("y"), "k"), "k").where("x <> y").select("x", "y", F.lit(0.9).alias("sim"))


def handler_sides(spark, sf_dir):
    return handlers(spark, sf_dir).select("id", "loc", "fn", F.array_join("context", " ").alias("context"), F.array_join("response", " ").alias("response"))


def handler_sentences(spark, sf_dir):
    return S.sentences(handlers(spark, sf_dir)).select("tid", F.array_join("items", " ").alias("items"))


def mined_rules(spark, sf_dir):
    return rules(spark, sf_dir).select("rule_id", "mined")


def rule_supporting_handlers(spark, sf_dir):
    h = handlers(spark, sf_dir)
    return S.supporting(rules(spark, sf_dir, h), h)


def rule_results(spark, sf_dir):
    h = handlers(spark, sf_dir)
    return S.results(rules(spark, sf_dir, h), h)


def rule_missing_items(spark, sf_dir):
    h = handlers(spark, sf_dir)
    return S.missing_items(rules(spark, sf_dir, h), h).select("rule_id", "loc", F.array_join("missing", " ").alias("missing"))


def rule_confidences(spark, sf_dir):
    h = handlers(spark, sf_dir)
    c = S.confidences(rules(spark, sf_dir, h).withColumn("group_id", F.col("rule_id")), h)
    return c.select(F.col("group_id").alias("rule_id"), "support", "applicable", F.round("global_confidence", 8).alias("global_confidence"), F.round("local_confidence", 8).alias("local_confidence"))


def rule_implementations(spark, sf_dir):
    h = handlers(spark, sf_dir)
    return S.cross_implementation(rules(spark, sf_dir, h).withColumn("group_id", F.col("rule_id")), h).withColumnRenamed("group_id", "rule_id")


def merge_rule_classes(spark, sf_dir):
    r = rules(spark, sf_dir)
    return S.merge_rules(r, similar(spark, sf_dir, r), 0.6).select("group_id", "rule_id")


def ranked_specs(spark, sf_dir):
    h = handlers(spark, sf_dir)
    r = rules(spark, sf_dir, h)
    return S.ranked_specs(r, h, S.merge_rules(r, similar(spark, sf_dir, r), 0.6))


def spec_best_per_response(spark, sf_dir):
    h = handlers(spark, sf_dir)
    r = rules(spark, sf_dir, h)
    c = S.confidences(r.withColumn("group_id", F.col("rule_id")), h).select(F.col("group_id").alias("rule_id"), F.col("support").alias("merged_support"), "local_confidence")
    return S.best_per_response(r.join(c, "rule_id"), 0.3).select("rule_id", "merged_support", F.round("local_confidence", 8).alias("local_confidence"))


def specs_without_listed(spark, sf_dir):
    h = handlers(spark, sf_dir)
    often = h.select(F.explode("context").alias("name")).groupBy("name").count().orderBy(F.desc("count"), "name").limit(5)
    return S.drop_listed(rules(spark, sf_dir, h), [r["name"] for r in often.collect()]).select("rule_id")


def specs_not_subsumed(spark, sf_dir):
    return S.drop_subsumed(rules(spark, sf_dir)).select("rule_id")


def handlers_with_classes(spark, sf_dir):
    k = load(spark, sf_dir, "pathbased_model").select(F.col("label").alias("name")).where("name is not null").distinct().withColumn("class_id", F.substring_index("name", "_", -1))
    return S.replace_names(handlers(spark, sf_dir), k).select("loc", F.array_join("context", " ").alias("context"), F.array_join("response", " ").alias("response"))


def handler_transactions(spark, sf_dir):
    return S.transactions(handlers(spark, sf_dir)).select("tid", F.array_join("items", " ").alias("items"))


def handlers_holding(spark, sf_dir):
    h = handlers(spark, sf_dir)
    top = h.select(F.explode("context").alias("name")).groupBy("name").count().orderBy(F.desc("count"), "name").first()
    return S.holding(h, top["name"] if top else "").select("id", "loc")


def spec_similarity(spark, sf_dir):
    r = rules(spark, sf_dir)
    near = similar(spark, sf_dir, r)
    return S.spec_similarity(cut(S.merge_rules(r, near, 0.6)), near).withColumn("similarity", F.round("similarity", 8))


def compare_thresholds(spark, sf_dir):
    h = handlers(spark, sf_dir)
    r = rules(spark, sf_dir, h)
    plain = S.ranked_specs(r, h)
    return S.compare_runs(plain, S.ranked_specs(r, h, S.merge_rules(r, similar(spark, sf_dir, r), 0.6)))


QUERIES = {f.__name__: f for f in (handler_sides, handler_sentences, mined_rules, rule_supporting_handlers, rule_results, rule_missing_items, rule_confidences, rule_implementations, merge_rule_classes, ranked_specs, spec_best_per_response, specs_without_listed, specs_not_subsumed, handlers_with_classes, handler_transactions, handlers_holding, spec_similarity, compare_thresholds)}
_N = "nullif(trim(split_part(trim({}, ' \t'), '.', 1), ' \t'), '')"
_H = f"""last as (select id, loaded_at, predicate_loc as loc, parent_function as f from eh_handler where id is not null
  qualify row_number() over (partition by id order by loaded_at desc nulls last, predicate_loc desc nulls last, parent_function desc nulls last) = 1),
han as (select id, loc, {_N.format("f")} as fn from last where loc like '%_:_%'
  qualify row_number() over (partition by loc order by loaded_at desc nulls last, id desc) = 1),
ctx as (select distinct handler as id, {_N.format("item")} as name, tactic from eh_context where type = 'CALL' and tactic in ('PRE', 'POST', 'FN') and handler is not null),
c as (select id, name from ctx x where tactic = 'PRE' and name is not null and not exists (select 1 from ctx y where y.id = x.id and y.name = x.name and y.tactic = 'FN')),
r as (select distinct handler as id, {_N.format("item")} as name from eh_response where type = 'CALL' and tactic in ('PRE', 'POST', 'FN') and handler is not null),
cc as (select h.loc, h.id, c.name from han h join c on c.id = h.id), rr as (select h.loc, h.id, r.name from han h join r on r.id = h.id where r.name is not null),
tx as (select loc, id, 'PRE|' || name as item from cc union all select loc, id, 'POST|' || name from rr),
both_sides as (select loc from cc intersect select loc from rr), t as (select * from tx where loc in (select loc from both_sides)),
lim as (select greatest(5, count(*) // 200) as least from eh_handler),
fi as (select item, count(*)::bigint as n, list(loc order by loc) as locs from t, lim group by item having count(*) >= max(least)),
grown as (
  select [item] as l, item as last, n, locs from fi
  union all
  select list_append(l, item), item, len(x)::bigint, x from (
    select g.l, fi.item, list_intersect(g.locs, fi.locs) as x, least from grown g join fi on fi.item > g.last, lim) where len(x) >= least),
up as (select distinct list_filter(l, lambda x: x <> h) as part, n from (select l, n, unnest(l) as h from grown)),
rule as (select list_transform(list_filter(l, lambda x: starts_with(x, 'PRE|')), lambda x: substr(x, 5)) as cl, list_transform(list_filter(l, lambda x: starts_with(x, 'POST|')), lambda x: substr(x, 6)) as pl, n
  from grown g where not exists (select 1 from up where up.part = g.l and up.n = g.n)),
rules as (select array_to_string(cl, ' ') || ' -> ' || array_to_string(pl, ' ') as rule_id, array_to_string(cl, ' ') as c, array_to_string(pl, ' ') as p, cl, pl, n as mined from rule where len(cl) > 0 and len(pl) > 0),
hc as (select loc, list(name) as names from cc group by loc), hr as (select loc, list(name) as names from rr group by loc),
res as (select rule_id, hc.loc, case when list_has_all(coalesce(hr.names, []), pl) then 0 else 1 end as violation, list_filter(pl, lambda x: not list_contains(coalesce(hr.names, []), x)) as missing
  from rules join hc on list_has_all(hc.names, cl) left join hr on hr.loc = hc.loc),
conf as (select rule_id, count(*) filter (violation = 0)::bigint as support, count(*)::bigint as applicable,
  (count(*) filter (violation = 0) / count(*)) as g,
  coalesce(count(*) filter (violation = 0) / nullif(count(*) filter ((rule_id, split_part(loc, ':', 1)) in (select (rule_id, split_part(loc, ':', 1)) from res where violation = 0)), 0), 0) as l from res group by rule_id)"""

#: Classes of merged rules: produced rules of one pair belong together, and single rules with two pairs of synonyms.
_MERGED = """m as (select distinct label as x, split_part(label, '_', -1) as k from pathbased_model where label is not null),
syn as (select a.x as i, b.x as j from m a join m b on a.k = b.k and a.x <> b.x),
pr as (select a.rule_id as ia, b.rule_id as ib, a.cl as ca, b.cl as cb, a.pl as pa, b.pl as pb from rules a join rules b on a.rule_id < b.rule_id),
made as (
  select ia, ib, 'c' as side, array_to_string(list_sort(list_intersect(ca, cb)), ' ') || ' -> ' || unnest([i, j]) as id from pr join syn on list_contains(pa, i) and list_contains(pb, j)
    where list_has_any(ca, cb) and not list_has_any(pa, pb)
  union
  select ia, ib, 'r', unnest([i, j]) || ' -> ' || array_to_string(list_sort(list_intersect(pa, pb)), ' ') from pr join syn on list_contains(ca, i) and list_contains(cb, j)
    where list_has_any(pa, pb) and not list_has_any(ca, cb)),
crossed as (select ia, ib, ca[1] as c1, cb[1] as c2, pa[1] as p1, pb[1] as p2 from pr
  where len(ca) = 1 and len(cb) = 1 and len(pa) = 1 and len(pb) = 1 and (ca[1], cb[1]) in (select (i, j) from syn) and (pa[1], pb[1]) in (select (i, j) from syn)),
edge as (
  select min(id) over (partition by ia, ib, side) as a, id as b from made
  union select ia, ib from crossed union select ia, c1 || ' -> ' || p2 from crossed union select ia, c2 || ' -> ' || p1 from crossed),
link as (select a, b from edge where a <> b union select b, a from edge where a <> b),
reach as (select a as node, a as seen from link union select r.node, k.b from reach r join link k on k.a = r.seen),
classes as (select min(seen) as group_id, node as rule_id from reach group by node)"""

_RANKED = """grp as (select group_id, rule_id, string_split(split_part(rule_id, ' -> ', 1), ' ') as cl, string_split(split_part(rule_id, ' -> ', 2), ' ') as pl from classes),
gapp as (select distinct group_id, hc.loc from grp join hc on list_has_all(hc.names, cl)),
gyes as (select distinct group_id, hc.loc from grp join hc on list_has_all(hc.names, cl) join hr on hr.loc = hc.loc and list_has_all(hr.names, pl)),
gnum as (select group_id, (select count(*) from gyes y where y.group_id = g.group_id)::bigint as yes, (select count(*) from gapp a where a.group_id = g.group_id) as app,
  (select count(*) from gapp a where a.group_id = g.group_id and split_part(a.loc, ':', 1) in (select split_part(y.loc, ':', 1) from gyes y where y.group_id = g.group_id)) as near from (select distinct group_id from classes) g),
ranked as (
  select rule_id, 'mined' as kind, support, mined as merged_support, g as global_confidence, g as local_confidence from rules join conf using (rule_id)
  union all
  select rule_id, 'merged', support, yes, yes / nullif(app, 0), coalesce(yes / nullif(near, 0), 0) from classes join rules using (rule_id) join conf using (rule_id) join gnum using (group_id))"""

SQL = {
    "handler_sides": f"with recursive {_H} select h.id, h.loc, h.fn, coalesce((select string_agg(name, ' ' order by name) from cc where cc.loc = h.loc), '') as context, coalesce((select string_agg(name, ' ' order by name) from rr where rr.loc = h.loc), '') as response from han h",
    "handler_sentences": f"with recursive {_H} select id as tid, string_agg(item, ' ' order by item) as items from t group by id",
    "mined_rules": f"with recursive {_H} select rule_id, mined from rules",
    "rule_supporting_handlers": f"with recursive {_H} select rule_id, loc from res where violation = 0",
    "rule_results": f"with recursive {_H} select rule_id, loc, violation from res",
    "rule_missing_items": f"with recursive {_H} select rule_id, loc, array_to_string(missing, ' ') as missing from res where violation = 1",
    "rule_confidences": f"with recursive {_H} select rule_id, support, applicable, round(g, 8) as global_confidence, round(l, 8) as local_confidence from conf",
    "rule_implementations": f"with recursive {_H} select rule_id, count(distinct split_part(split_part(loc, ':', 1), '/', 2)) > 1 as crosses from res where violation = 0 group by rule_id",
    "spec_best_per_response": f"with recursive {_H}, b as (select rule_id, support as merged_support, l, row_number() over (partition by p order by l desc, support desc, rule_id) as i from conf join rules using (rule_id)) select rule_id, merged_support, round(l, 8) as local_confidence from b where i = 1 and l > 0.3",
    "ranked_specs": f"with recursive {_H}, {_MERGED}, {_RANKED} select * from ranked",
    "compare_thresholds": f"""with recursive {_H}, {_MERGED}, {_RANKED}, best as (select rule_id, max(merged_support) as m, max(merged_support) filter (kind = 'mined') as own from ranked group by 1)
select rule_id, row_number() over (order by own desc, rule_id) as rank_a, row_number() over (order by m desc, rule_id) as rank_b from best""",
    "spec_similarity": f"""with recursive {_H}, {_MERGED}, part as (select group_id, rule_id, 'c' as side, unnest(string_split(split_part(rule_id, ' -> ', 1), ' ')) as name from classes union select group_id, rule_id, 'r', unnest(string_split(split_part(rule_id, ' -> ', 2), ' ')) from classes),
names as (select distinct group_id, side, name from part)
select group_id, case when exists (select 1 from names x join names y on x.side = y.side and x.group_id = y.group_id join syn on i = x.name and j = y.name where x.group_id = c.group_id) then 0.9::double else 1.0::double end as similarity from (select distinct group_id from classes) c""",
    "merge_rule_classes": f"with recursive {_H}, {_MERGED} select group_id, rule_id from classes",
    "specs_without_listed": f"with recursive {_H}, often as (select list(name) as names from (select name from cc group by 1 order by count(*) desc, name limit 5)) select rule_id from rules, often where not list_has_all(names, cl) and not list_has_all(names, pl)",
    "specs_not_subsumed": f"with recursive {_H} select rule_id from rules a where not exists (select 1 from rules b where b.rule_id <> a.rule_id and ((list_has_all(a.cl, b.cl) and (len(b.cl) < len(a.cl) or b.rule_id < a.rule_id)) or (list_has_all(a.pl, b.pl) and (len(b.pl) < len(a.pl) or b.rule_id < a.rule_id))))",
    "handlers_with_classes": f"with recursive {_H}, m as (select distinct label as name, split_part(label, '_', -1) as k from pathbased_model where label is not null), k as (select k, 'CLASS_' || (row_number() over (order by k) - 1)::varchar as code from (select distinct k from m)), d as (select name, code from m join k using (k)), x as (select distinct loc, coalesce(code, cc.name) as n from cc left join d on d.name = cc.name), y as (select distinct loc, coalesce(code, rr.name) as n from rr left join d on d.name = rr.name) select h.loc, coalesce((select string_agg(n, ' ' order by n) from x where x.loc = h.loc), '') as context, coalesce((select string_agg(n, ' ' order by n) from y where y.loc = h.loc), '') as response from han h",
    "handler_transactions": f"with recursive {_H}, u as (select id, name from cc union select id, name from rr) select h.id as tid, coalesce((select string_agg(name, ' ' order by name) from u where u.id = h.id), '') as items from han h",
    "handlers_holding": f"with recursive {_H}, top as (select name from cc group by 1 order by count(*) desc, name limit 1), u as (select loc from cc where name in (select name from top) union select loc from rr where name in (select name from top)) select id, loc from han where loc in (select loc from u)",
}
