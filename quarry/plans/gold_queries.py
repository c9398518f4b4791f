"""Queries over function names, gold classes and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.names import clean_name
from quarry.operators import evaluate as V
from quarry.operators import gold as G
from quarry.session import load


def functions(spark, sf_dir):
    """(name, path) of the handlers' parent functions."""
    return load(spark, sf_dir, "eh_handler").select(clean_name("parent_function").alias("name"), F.get(F.split("predicate_loc", ":"), F.lit(0)).alias("path")).where("name is not null and path <> ''").distinct()


def _model(spark, sf_dir):
    return load(spark, sf_dir, "pathbased_model").select(F.col("label").alias("name")).where("name is not null").distinct()


def classes(spark, sf_dir):
    """Names by their last part: the gold classes of the tests."""
    return _model(spark, sf_dir).withColumn("class_id", F.substring_index("name", "_", -1))


def clusters(spark, sf_dir):
    """Names by their last two parts, every third of them only by the last: a clustering close to the classes."""
    last = F.substring_index("name", "_", -1)
    return _model(spark, sf_dir).withColumn("cluster_id", F.when(F.length("name") % 3 == 0, last).otherwise(F.substring_index("name", "_", -2)))


def relations(spark, sf_dir):
    """Reviewed relations: labels with the same last two parts belong together, the first and last function of a file do not."""
    f = functions(spark, sf_dir)
    m = _model(spark, sf_dir).withColumn("k", F.substring_index("name", "_", -2))
    pairs = m.groupBy("k").agg(F.min("name").alias("name")).join(m.withColumnRenamed("name", "wrapper"), "k").where("name <> wrapper")
    must = pairs.select(F.lit(True).alias("must"), F.array("name").alias("a"), F.array("wrapper").alias("b"), F.col("k").alias("prov"))
    firsts = f.groupBy("path").agg(F.min("name").alias("x"), F.max("name").alias("y")).where("x <> y")
    apart = firsts.select(F.lit(False).alias("must"), F.array("x").alias("a"), F.array("y").alias("b"), F.col("path").alias("prov"))
    return must.unionByName(apart)


def name_splits(spark, sf_dir):
    return G.exploded_splits(functions(spark, sf_dir))


def suffix_groups(spark, sf_dir):
    return G.groups_by(functions(spark, sf_dir), "suffix").groupBy("suffix").agg(F.count_distinct("name").alias("n")).where("n > 1")


def prefix_groups(spark, sf_dir):
    return G.groups_by(functions(spark, sf_dir), "prefix").groupBy("prefix").agg(F.count_distinct("name").alias("n"))


def top_prefixes(spark, sf_dir):
    f = functions(spark, sf_dir).withColumn("path", F.get(F.split("path", "/"), F.lit(0)))
    return G.common_keywords(f, 3, 1)


def gold_names(spark, sf_dir):
    f = functions(spark, sf_dir)
    return G.gold_names(f, G.exploded_splits(f).select("prefix", "path").distinct(), None, 3).select("suffix", "dir", "name", "path")


def gold_overlap(spark, sf_dir):
    f = functions(spark, sf_dir)
    return G.overlap(G.groups_by(f, "suffix"), _model(spark, sf_dir))


def underscore_pairs(spark, sf_dir):
    """With wrappers of some functions put in: ``__`` before names whose length 3 divides, ``_`` where 5 does."""
    f = functions(spark, sf_dir)
    put = lambda n, mark: f.where(F.length("name") % n == 0).withColumn("name", F.concat(F.lit(mark), "name"))
    return G.underscore_pairs(f.unionByName(put(3, "__")).unionByName(put(5, "_")), True, True)


def keyword_split(spark, sf_dir):
    rows = functions(spark, sf_dir).select("name").distinct().withColumn("s", G.split_at_keyword(F.col("name"), "probe")).where("s is not null")
    return rows.select("name", "s.prefix", "s.suffix")


def equivalence_classes(spark, sf_dir):
    return G.equivalence_classes(relations(spark, sf_dir))


def contradictions(spark, sf_dir):
    """With must-not relations put in between names that belong together: those whose length 3 divides."""
    r = relations(spark, sf_dir)
    put = r.where("must").where(F.length(F.get("b", F.lit(0))) % 3 == 0)
    return G.contradictions(r.unionByName(put.withColumn("must", F.lit(False))))


def relation_pair_counts(spark, sf_dir):
    return G.pair_counts(relations(spark, sf_dir))


def related_pair_count(spark, sf_dir):
    return G.related_pair_count(classes(spark, sf_dir))


def unrelated_pairs(spark, sf_dir):
    return G.unrelated_pairs(relations(spark, sf_dir))


def unrelated_estimate(spark, sf_dir):
    return G.unrelated_estimate(relations(spark, sf_dir))


def sampled_unrelated_pairs(spark, sf_dir):
    return G.sampled_unrelated_pairs(classes(spark, sf_dir), 200, 3)


def cluster_fscore(spark, sf_dir):
    s = V.cluster_f1(classes(spark, sf_dir), clusters(spark, sf_dir))
    return s.select(*[F.round(c, 8).alias(c) for c in s.columns])


def purity(spark, sf_dir):
    return V.purity(classes(spark, sf_dir), clusters(spark, sf_dir)).select(F.round("purity", 8).alias("purity"))


def purity_report(spark, sf_dir):
    r = V.purity_report(classes(spark, sf_dir), clusters(spark, sf_dir))
    return r.select("class_id", "cluster_id", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"), F.round("f", 8).alias("f"), F.size("missing").alias("n_missing"), F.size("extra").alias("n_extra"))


def _scored(spark, sf_dir):
    """Order rows as ranked pairs: price as score, urgent ones as true."""
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").alias("hit"))


def roc_points(spark, sf_dir):
    r = V.roc_points(_scored(spark, sf_dir), "o_totalprice", "hit", ["o_orderkey"])
    return r.select("o_orderkey", F.col("rank").cast("bigint").alias("rank"), F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


def roc_auc(spark, sf_dir):
    return V.roc_auc(_scored(spark, sf_dir), "o_totalprice", "hit", ["o_orderkey"]).select(F.round("auc", 8).alias("auc"), F.round("auc_compat", 8).alias("auc_compat"))


def average_precision(spark, sf_dir):
    return V.average_precision(_scored(spark, sf_dir), "o_orderkey", "hit").select(F.round("ap", 8).alias("ap"))


def pairwise_confusion(spark, sf_dir):
    rel = relations(spark, sf_dir)
    must = G.must_edges(rel).select("a", "b").where("a <> b").distinct()
    return V.confusion_scores(V.confusion_by_classes(must, *G.unrelated_classes(rel), clusters(spark, sf_dir))).select("tp", "fn", "fp", "tn", "missing", F.round("f1", 8).alias("f1"))


def first_rank(spark, sf_dir):
    return V.first_rank(load(spark, sf_dir, "events"), "user_id", "event_id").withColumn("rank", F.col("rank").cast("bigint"))


def label_f1(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").withColumn("guess", F.when(F.col("o_totalprice") > 250000, "F").otherwise("O"))
    return V.macro_micro_f1(rows, "o_orderstatus", "guess").select(F.round("micro", 8).alias("micro"), F.round("macro", 8).alias("macro"))


QUERIES = {f.__name__: f for f in (name_splits, suffix_groups, prefix_groups, top_prefixes, gold_names, gold_overlap, underscore_pairs, keyword_split, equivalence_classes, contradictions, relation_pair_counts, related_pair_count, unrelated_pairs, unrelated_estimate, sampled_unrelated_pairs, cluster_fscore, purity, purity_report, roc_points, roc_auc, average_precision, pairwise_confusion, first_rank, label_f1)}

_F = """fns as (select distinct nullif(trim(split_part(trim(parent_function, ' \t'), '.', 1), ' \t'), '') as name, split_part(predicate_loc, ':', 1) as path from eh_handler),
functions as (select * from fns where name is not null and path <> ''),
parts as (select name, path, string_split(name, '_') as l from functions),
cuts as (select name, path, l, unnest(range(1, len(l))) as i from parts),
sp as (select name, path, array_to_string(l[1:i], '_') as prefix, array_to_string(l[i + 1:], '_') as suffix from cuts),
splits as (select * from sp where length(prefix) > 1 and length(suffix) > 1)"""
_WRAP = f"""{_F}, names as (select name from functions union select '__' || name from functions where length(name) % 3 = 0 union select '_' || name from functions where length(name) % 5 = 0),
wrap as (select substr(name, 3) as name, name as wrapper from names where name like '\\_\\_%' escape '\\'
  union all select substr(name, 2), name from names where name like '\\_%' escape '\\' and name not like '\\_\\_%' escape '\\'),
pairs as (select w.* from wrap w join names n on n.name = w.name)"""
_REL = f"""{_F}, lab as (select distinct label as n, split_part(label, '_', -2) || '_' || split_part(label, '_', -1) as k from pathbased_model where label is not null),
pairs as (select * from (select min(n) over (partition by k) as name, n as wrapper from lab) where name <> wrapper),
apart as (select path, min(name) as x, max(name) as y from functions group by path having min(name) <> max(name))"""
_CC = """walk as (select name as node, name as low from pairs union select wrapper, wrapper from pairs
  union select case when node = name then wrapper else name end, low from walk join pairs on node = name or node = wrapper),
cls as (select node as name, min(low) as class_id from walk group by node)"""
_CLS = """model as (select distinct label as name from pathbased_model where label is not null),
classes as (select name, split_part(name, '_', -1) as class_id from model),
clusters as (select name, case when length(name) % 3 = 0 or name not like '%\\_%' escape '\\' then split_part(name, '_', -1) else split_part(name, '_', -2) || '_' || split_part(name, '_', -1) end as cluster_id from model)"""
_OV = f"""{_CLS}, big as (select class_id from classes group by 1 having count(*) > 1), c1 as (select * from classes where class_id in (select class_id from big)),
k1 as (select * from clusters where name in (select name from c1)),
cs as (select class_id, count(*) as cn from c1 group by 1), ks as (select cluster_id, count(*) as kn from k1 group by 1),
o as (select class_id, cluster_id, count(*) as n from c1 join k1 using (name) group by 1, 2),
s as (select *, n / kn as p, n / cn as r, 2.0 * n / (kn + cn) as f from o join cs using (class_id) join ks using (cluster_id))"""
_RANK = "t as (select o_orderkey, o_totalprice as s, o_orderpriority = '1-URGENT' as hit from orders), r as (select *, row_number() over w as rank, sum(hit::int) over w as nt from t window w as (order by s desc, o_orderkey rows unbounded preceding)), tot as (select sum(hit::int) as a, sum((not hit)::int) as b from t)"

SQL = {
    "name_splits": f"with {_F} select name, path, prefix, suffix from splits",
    "suffix_groups": f"with {_F} select suffix, count(distinct name)::bigint as n from splits group by 1 having count(distinct name) > 1",
    "prefix_groups": f"with {_F} select prefix, count(distinct name)::bigint as n from splits group by 1",
    "top_prefixes": f"with {_F}, d as (select distinct name, split_part(path, '/', 1) as path from functions), s as (select d.name, d.path, prefix from d join (select distinct name, prefix from splits) using (name)), c as (select path, prefix, count(*)::bigint as n from s group by 1, 2) select prefix, path, n from c where n >= 1 qualify row_number() over (partition by path order by n desc, prefix) <= 3",
    "gold_names": f"with {_F}, g as (select distinct suffix, name, path from splits), b as (select suffix from g group by 1 having count(distinct name) >= 3), h as (select suffix, split_part(path, '/', 1) as dir, name, path from g where suffix in (select suffix from b)) select suffix, dir, name, path from h where (suffix, dir) in (select (suffix, dir) from h group by suffix, dir having count(distinct name) > 1)",
    "gold_overlap": f"with {_F}, g as (select distinct name from splits) select count(*)::bigint as n_gold, count(*) filter (name in (select label from pathbased_model where label is not null))::bigint as n_both from g",
    "underscore_pairs": f"with {_WRAP} select name, wrapper from pairs",
    "keyword_split": f"with {_F}, n as (select distinct name, string_split(name, '_') as l from functions), p as (select name, l, list_position(l, 'probe') as i from n) select name, array_to_string(l[1:i], '_') as prefix, array_to_string(l[i + 1:], '_') as suffix from p where i > 0",
    "equivalence_classes": f"with recursive {_REL}, {_CC} select name, class_id from cls",
    "contradictions": f"with recursive {_REL}, {_CC} select distinct x as a, y as b, path as prov from (from apart union all select split_part(name, '_', -2) || '_' || split_part(name, '_', -1), name, wrapper from pairs where length(wrapper) % 3 = 0) apart(path, x, y) join cls p on p.name = x join cls q on q.name = y where p.class_id = q.class_id",
    "relation_pair_counts": f"with {_REL} select true as must, count(*)::bigint as n from pairs having count(*) > 0 union all select false, count(*)::bigint from apart having count(*) > 0",
    "related_pair_count": f"with {_CLS}, n as (select count(*) as k from classes group by class_id) select sum(k * (k - 1) // 2)::bigint as n from n",
    "unrelated_pairs": f"with recursive {_REL}, {_CC}, side as (select name, class_id from cls union select n, n from (select x as n from apart union select y from apart) where n not in (select name from cls)), k as (select distinct p.class_id as ca, q.class_id as cb from apart join side p on p.name = x join side q on q.name = y) select distinct least(p.name, q.name) as a, greatest(p.name, q.name) as b from k join side p on p.class_id = ca join side q on q.class_id = cb where p.name <> q.name",
    "unrelated_estimate": f"with {_REL} select count(*)::bigint + 1 as n from apart",
    "cluster_fscore": f"with {_OV}, b as (select class_id, cn, max(f) as f, max(r) as r, max(p) as p from s group by 1, 2), w as (select class_id, arg_max(kn, row(p, -kn)) as kn from s group by 1) select round(sum(cn * f) / sum(cn), 8) as f_score, round(sum(kn * p) / sum(kn), 8) as avg_precision, round(sum(cn * r) / sum(cn), 8) as avg_recall from b join w using (class_id)",
    "purity": f"with {_CLS}, n as (select cluster_id, class_id, count(*) as n from classes join clusters using (name) group by 1, 2), b as (select max(n) as t, sum(n) as s from n group by cluster_id) select round(sum(t) / sum(s), 8) as purity from b",
    "purity_report": f"with {_OV.replace('k1 as (select * from clusters where name in (select name from c1))', 'k1 as (select * from clusters)')}, b as (select *, row_number() over (partition by class_id order by f desc, cluster_id desc) as i from s) select class_id, cluster_id, round(p, 8) as precision, round(r, 8) as recall, round(f, 8) as f, (cn - n)::int as n_missing, (kn - n)::int as n_extra from b where i = 1",
    "roc_points": f"with {_RANK} select o_orderkey, rank, round(nt / a, 8) as tpr, round((rank - nt) / b, 8) as fpr from r, tot",
    "roc_auc": f"with {_RANK}, p as (select nt / a as p from r, tot where rank = a) select round((select sum(nt) from r where not hit) / (a * b), 8) as auc, round((p + 1 - (1 - p) * a / b) / 2, 8) as auc_compat from tot, p",
    "average_precision": "with t as (select o_orderpriority = '1-URGENT' as hit, row_number() over (order by o_orderkey) as i, sum((o_orderpriority = '1-URGENT')::int) over (order by o_orderkey rows unbounded preceding) as k from orders) select round(sum(case when hit then k / i else 0 end) / count(*), 8) as ap from t",
    "pairwise_confusion": f"with recursive {_REL}, {_CC}, {_CLS}, side as (select name, class_id from cls union select n, n from (select x as n from apart union select y from apart) where n not in (select name from cls)), k as (select distinct p.class_id as ca, q.class_id as cb from apart join side p on p.name = x join side q on q.name = y), un as (select distinct least(p.name, q.name) as a, greatest(p.name, q.name) as b, false as rel from k join side p on p.class_id = ca join side q on q.class_id = cb where p.name <> q.name), allp as (select * from un union all select distinct name, wrapper, true from pairs), j as (select allp.*, p.cluster_id as ca, q.cluster_id as cb from allp left join clusters p on p.name = a left join clusters q on q.name = b), c as (select count(*) filter (ca = cb and rel)::bigint as tp, count(*) filter (ca <> cb and rel)::bigint as fn, count(*) filter (ca = cb and not rel)::bigint as fp, count(*) filter (ca <> cb and not rel)::bigint as tn, count(distinct case when ca is null then a when cb is null then b end)::bigint as missing from j) select tp, fn, fp, tn, missing, round(case when 2 * tp + fp + fn = 0 then 0 else 2.0 * tp / (2 * tp + fp + fn) end, 8) as f1 from c",
    "first_rank": "with f as (select user_id, min(event_id) as p from events group by 1) select user_id, row_number() over (order by p, user_id) as rank from f",
    "label_f1": "with r as (select o_orderstatus as l, case when o_totalprice > 250000 then 'F' else 'O' end as g from orders), k as (select l as k from r union select g from r), m as (select k, (select count(*) from r where l = k) as n, (select count(*) from r where g = k) as m, (select count(*) from r where l = k and g = k) as tp from k) select round(sum(tp) / sum(n), 8) as micro, round(avg(2 * tp / (n + m)), 8) as macro from m",
}
