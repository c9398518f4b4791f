"""Itemset and rule queries over baskets of part brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import measures as M
from quarry.operators import itemsets as I
from quarry.operators import rules as R
from quarry.operators import transactions as T
from quarry.session import load

LEAST = 0.8  # percent of the baskets
DEEP = 0.16
BORDER = {1: 100.0, 2: 300.0, 3: 30.0}


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, items): the brands of each order."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return T.from_pairs(line.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand")


def weighted_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``baskets`` with the summed quantity as weight."""
    w = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tid")).agg(F.sum("l_quantity").cast("bigint").alias("wgt"))
    return baskets(spark, sf_dir).join(w, "tid")


def _text(sets: DataFrame, *more: str) -> DataFrame:
    return sets.select(F.array_join("items", " ").alias("items"), "size", F.col("supp").cast("bigint").alias("supp"), *more)


def _sets(spark: SparkSession, sf_dir: str, target: str, **options) -> DataFrame:
    return _text(I.mine(baskets(spark, sf_dir), target=target, **({"support": DEEP} | options)))


def item_support(spark, sf_dir):
    return T.item_frequencies(baskets(spark, sf_dir)).select("item", F.col("frq").alias("support"), F.col("xfq").alias("extended"))


def basket_dedup_weighted(spark, sf_dir):
    return T.collapse(weighted_baskets(spark, sf_dir)).select(F.array_join("items", " ").alias("items"), "wgt")


def item_recode(spark, sf_dir):
    return T.recode(baskets(spark, sf_dir), 1).select("item", "frq", "code")


def baskets_from_columns(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return T.from_columns(part, "p_partkey", ["p_brand", "p_type", "p_size"]).select(F.col("tid").alias("p_partkey"), F.array_join("items", " ").alias("items"))


def baskets_from_flags(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 25).cast("string").alias("large"), (F.col("p_retailprice") > 1000).cast("string").alias("dear"))
    return T.from_flags(part, "p_partkey", ["large", "dear"], "true").select(F.col("tid").alias("p_partkey"), F.array_join("items", " ").alias("items"))


def basket_selection(spark, sf_dir):
    keep = [f"Brand#{i}" for i in range(1, 6)]
    return T.by_size(T.select_items(baskets(spark, sf_dir), keep), 2).select("tid", F.array_join("items", " ").alias("items"))


def table_derived_check(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.array(F.concat(F.lit("b="), "p_brand"), F.concat(F.lit("t="), "p_type")).alias("items"))
    one = lambda what, tx: T.is_table_like(tx).withColumn("table", F.lit(what))
    return one("part", rows).unionByName(one("baskets", baskets(spark, sf_dir).select("items")))


def exact_basket_count(spark, sf_dir):
    return T.occurrences_of(baskets(spark, sf_dir), ["Brand#1", "Brand#2"])


def idempotent_weights(spark, sf_dir):
    return T.idempotent_weights(baskets(spark, sf_dir)).select(F.array_join("items", " ").alias("items"), "wgt")


def subsequence_match(spark, sf_dir):
    seq = F.array(F.lit("Brand#1"), F.lit("Brand#3"))
    b = baskets(spark, sf_dir)
    return b.select("tid", T.is_subsequence(seq, F.col("items")).alias("inside"), T.substring_at(seq, F.col("items")).alias("offset")).where("inside")


def frequent_sets(spark, sf_dir):
    return _sets(spark, sf_dir, "s")


def closed_sets(spark, sf_dir):
    return _sets(spark, sf_dir, "c")


def maximal_sets(spark, sf_dir):
    return _sets(spark, sf_dir, "m")


def generator_sets(spark, sf_dir):
    return _sets(spark, sf_dir, "g")


def weighted_sets(spark, sf_dir):
    """Sets of at most two items: the bound on the size is the feature."""
    return _text(I.mine(weighted_baskets(spark, sf_dir), support=LEAST, largest_size=2))


def border_sets(spark, sf_dir):
    return _sets(spark, sf_dir, "s", border=BORDER)


def bounded_sets(spark, sf_dir):
    return _sets(spark, sf_dir, "s", most_support=2.0, least_size=2)


def pattern_spectrum(spark, sf_dir):
    return I.spectrum(I.mine(baskets(spark, sf_dir), support=DEEP)).select("size", F.col("supp").cast("bigint").alias("supp"), "n")


def set_size_stats(spark, sf_dir):
    return I.size_statistics(I.mine(baskets(spark, sf_dir), support=DEEP)).select(F.coalesce("size", F.lit(0)).alias("size"), "n")


def set_tids(spark, sf_dir):
    b = baskets(spark, sf_dir)
    keep = I.mine(b, support=DEEP)
    return I.supporting_tids(keep, b).select(F.array_join("items", " ").alias("items"), "tid")


def expected_spectrum(spark, sf_dir):
    return I.expected_spectrum(baskets(spark, sf_dir), [2, 3], [0, 10, 20, 300])


def _rules(spark, sf_dir, **options):
    return R.mine_rules(baskets(spark, sf_dir), LEAST, 12.0, **options)


def _rule_text(rules, *more):
    return rules.select(F.array_join("body", " ").alias("body"), "head", F.col("supp").cast("bigint").alias("supp"), *more)


def rules_confidence_lift(spark, sf_dir):
    return _rule_text(_rules(spark, sf_dir), F.round("confidence", 8).alias("confidence"), F.round("lift", 8).alias("lift"))


def rules_empty_body(spark, sf_dir):
    return _rule_text(R.mine_rules(baskets(spark, sf_dir), LEAST, 15.0, empty_body=True), F.round("confidence", 8).alias("confidence"))


def rules_appearance(spark, sf_dir):
    where = {"": "both", "Brand#1": "body", "Brand#2": "head", "Brand#3": "none"}
    return _rule_text(_rules(spark, sf_dir, appear=where))


_ARITHMETIC = "ocdlaqverkjznyi"


def rule_measures(spark, sf_dir):
    return _rule_text(R.evaluate(_rules(spark, sf_dir), _ARITHMETIC), *[F.round(f"m_{c}", 8).alias(f"m_{c}") for c in _ARITHMETIC if c != "o"])


def rule_pvalues(spark, sf_dir):
    return _rule_text(R.evaluate(_rules(spark, sf_dir), "ptgfhms"), *[f"m_{c}" for c in "ptgfhms"])


def rule_filter(spark, sf_dir):
    return _rule_text(R.select_rules(_rules(spark, sf_dir), "l", 1.02))


def set_log_quotient(spark, sf_dir):
    b = baskets(spark, sf_dir)
    return _text(R.set_log_quotient(I.mine(b, support=LEAST), float(b.count())).withColumn("value", F.round("value", 8)), "value")


def set_rule_measure(spark, sf_dir):
    b = baskets(spark, sf_dir)
    return _text(R.evaluate_sets(I.mine(b, support=LEAST), float(b.count()), "c", "max").withColumn("value", F.round("value", 8)), "value")


def set_evaluation_pruning(spark, sf_dir):
    b = baskets(spark, sf_dir)
    return _text(R.prune_sets(I.mine(b, support=DEEP), float(b.count()), "l", 1.02, 1))


def surrogate_shuffle(spark, sf_dir):
    out = T.surrogate_shuffle(load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey", ["p_brand", "p_type"], 7)
    before = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("was"), F.col("p_type").alias("was_type"))
    both = out.join(before, "p_partkey")
    return both.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("p_brand") != F.col("was")).alias("moved"))


def surrogate_swap(spark, sf_dir):
    b = baskets(spark, sf_dir)
    out = T.surrogate_swap(b, 2, 3)
    rows = lambda t: t.select("tid", F.explode("items").alias("item"))
    new = rows(out).join(rows(b), ["tid", "item"], "left_anti").groupBy("item").agg(F.count(F.lit(1)).alias("new"))
    sizes = rows(out).groupBy("tid").agg(F.count(F.lit(1)).alias("k")).join(rows(b).groupBy("tid").agg(F.count(F.lit(1)).alias("was")), "tid", "full_outer")
    same = sizes.agg(F.bool_and(F.coalesce(F.col("k") == F.col("was"), F.lit(False))).alias("same_sizes"))
    return T.item_frequencies(out).join(new, "item", "left").crossJoin(same).select("item", "frq", (F.coalesce("new", F.lit(0)) > 0).alias("moved"), "same_sizes")  # same is one row


def surrogate_frequencies(spark, sf_dir):
    b = baskets(spark, sf_dir)
    out = T.surrogate_frequencies(b, 5).select("tid", F.explode("items").alias("item"))
    both = out.join(b.select("tid", F.explode("items").alias("item"), F.lit(1).alias("was")), ["tid", "item"], "left")
    return both.groupBy("item").agg(F.count(F.lit(1)).alias("frq"), (F.count("was") < F.count(F.lit(1))).alias("moved"))


def basket_pairs_flagship(spark, sf_dir):
    """The strongest rules of two brands: support, confidence and lift."""
    rules = R.mine_rules(baskets(spark, sf_dir), LEAST, 1.0, 2)
    top = rules.orderBy(F.desc("lift"), F.array_join("body", " "), "head").limit(20)
    return _rule_text(top, F.round("confidence", 8).alias("confidence"), F.round("lift", 8).alias("lift"))


QUERIES = {f.__name__: f for f in (basket_pairs_flagship, item_support, basket_dedup_weighted, item_recode, baskets_from_columns, baskets_from_flags, basket_selection, table_derived_check, exact_basket_count, idempotent_weights, subsequence_match, frequent_sets, closed_sets, maximal_sets, generator_sets, weighted_sets, border_sets, bounded_sets, pattern_spectrum, set_size_stats, set_tids, expected_spectrum, rules_confidence_lift, rules_empty_body, rules_appearance, rule_measures, rule_pvalues, rule_filter, set_log_quotient, set_rule_measure, set_evaluation_pruning, surrogate_shuffle, surrogate_swap, surrogate_frequencies)}
_TX = """tx as (select distinct l_orderkey as tid, p_brand as item from lineitem join part on l_partkey = p_partkey),
total as (select count(distinct tid)::double as n from tx),
sizes as (select tid, count(*) as k from tx group by tid)"""
_LEAST_SQL = f"ceil(0.01 * {LEAST} * n - 1e-9)"
_DEEP_SQL = f"ceil(0.01 * {DEEP} * n - 1e-9)"


def _all(least: str) -> str:
    """All sets that reach ``least``: each with the list of its baskets, extended by the greater items."""
    return f"""{_TX}, lim as (select {least} as least from total),
f1 as (select item as a, count(*)::bigint as supp, list(tid order by tid) as tids from tx group by item),
grown as (
  select [a] as l, a as last, supp, tids from f1, lim where supp >= least
  union all
  select list_append(l, a), a, len(t)::bigint, t from (
    select g.l, f1.a, list_intersect(g.tids, f1.tids) as t, least from grown g join f1 on f1.a > g.last, lim where f1.supp >= least) where len(t) >= least),
sets as (select array_to_string(l, ' ') as items, l, len(l)::int as size, supp from grown),
below as (select items, size, supp, h, list_filter(l, lambda x: x <> h) as part from (select *, unnest(l) as h from sets))"""


def _rules_sql(confidence: float) -> str:
    """``_all`` with all rules from the sets that rules of a confidence can have."""
    return f"""{_all(f"greatest(1, ceil({_LEAST_SQL} * {confidence} - 1e-9))")},
rules as (select array_to_string(b.part, ' ') as body, b.part as body_l, b.h as head, b.supp::double as s, p.supp::double as bs, f1.supp::double as hs, n, {_LEAST_SQL} as body_least
  from below b join sets p on p.l = b.part join f1 on f1.a = b.h, total)"""


_RULES = _rules_sql(0.12)
_PICK = "where bs >= body_least and s >= bs * 0.12 * (1 - 1e-12)"
_TWO = f"""{_TX}, lim as (select {_LEAST_SQL} as least from total),
f1 as (select item as a, count(*)::bigint as supp from tx group by item),
f2 as (select x.item as a, y.item as b, count(*)::bigint as supp from tx x join tx y on x.tid = y.tid and x.item <> y.item group by 1, 2),
rules as (select x.a as body, x.b as head, x.supp::double as s, p.supp::double as bs, h.supp::double as hs, n from f2 x join f1 p on p.a = x.a join f1 h on h.a = x.b, total)"""

SQL = {
    "basket_pairs_flagship": f"with {_TWO} select body, head, s::bigint as supp, round(s / bs, 8) as confidence, round(s * n / (bs * hs), 8) as lift from rules where bs >= (select least from lim) and s >= greatest(1, ceil((select least from lim) * 0.01 - 1e-9)) and s >= bs * 0.01 order by s * n / (bs * hs) desc, body, head limit 20",
    "item_support": f"with {_TX} select item, count(*)::bigint as support, sum(k)::bigint as extended from tx join sizes using (tid) group by item",
    "basket_dedup_weighted": f"with {_TX}, w as (select l_orderkey as tid, sum(l_quantity)::bigint as wgt from lineitem group by 1), b as (select tid, string_agg(item, ' ' order by item) as items from tx group by tid) select items, sum(wgt)::bigint as wgt from b join w using (tid) group by items having sum(wgt) <> 0",
    "item_recode": f"with {_TX}, f as (select item, count(*)::bigint as frq from tx group by item) select item, frq, row_number() over (order by frq, item) - 1 as code from f",
    "baskets_from_columns": "select p_partkey, string_agg(i, ' ' order by i) as items from (select p_partkey, unnest(['p_brand=' || p_brand, 'p_type=' || p_type, 'p_size=' || p_size::varchar]) as i from part) group by p_partkey",
    "baskets_from_flags": "select p_partkey, concat_ws(' ', case when p_retailprice > 1000 then 'dear' end, case when p_size > 25 then 'large' end) as items from part",
    "basket_selection": f"with {_TX} select tid, string_agg(item, ' ' order by item) as items from tx where item in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') group by tid having count(*) >= 2",
    "table_derived_check": f"with {_TX}, placed as (select 'baskets' as t, tid::varchar as id, item, row_number() over (partition by tid order by item) as pos from tx union all select 'part', p_partkey::varchar, 'b=' || p_brand, 1 from part union all select 'part', p_partkey::varchar, 't=' || p_type, 2 from part), k as (select t, id, count(*) as k from placed group by 1, 2), i as (select t, item, count(distinct pos) as n from placed group by 1, 2) select t as \"table\", (select count(distinct k) <= 1 from k where k.t = d.t) as same_size, (select max(n) <= 1 from i where i.t = d.t) as fixed_positions from (values ('part'), ('baskets')) d(t)",
    "exact_basket_count": f"with {_TX}, b as (select tid, string_agg(item, ' ' order by item) as items from tx group by tid) select count(*)::bigint as wgt from b where items = 'Brand#1 Brand#2'",
    "subsequence_match": f"with {_TX}, b as (select tid, list(item order by item) as l from tx group by tid) select tid, true as inside, (case when list_position(l, 'Brand#3') = list_position(l, 'Brand#1') + 1 then list_position(l, 'Brand#1') - 1 else -1 end)::int as \"offset\" from b where list_position(l, 'Brand#1') is not null and list_position(l, 'Brand#3') is not null",
    "frequent_sets": f"with recursive {_all(_DEEP_SQL)} select items, size, supp from sets",
    "closed_sets": f"with recursive {_all(_DEEP_SQL)} select items, size, supp from sets s where not exists (select 1 from below b where b.part = s.l and b.supp = s.supp)",
    "maximal_sets": f"with recursive {_all(_DEEP_SQL)} select items, size, supp from sets s where not exists (select 1 from below b where b.part = s.l)",
    "generator_sets": f"with recursive {_all(_DEEP_SQL)} select items, size, supp from sets s where (size > 1 or supp < (select n from total)) and not exists (select 1 from below b join sets t on t.l = b.part where b.items = s.items and t.supp = s.supp)",
    "weighted_sets": f"with {_TX}, w as (select l_orderkey as tid, sum(l_quantity)::bigint as wgt from lineitem group by 1), t as (select sum(wgt)::double as n from w where tid in (select tid from tx)), s as (select item as items, 1 as size, sum(wgt)::bigint as supp from tx join w using (tid) group by 1 union all select x.item || ' ' || y.item, 2, sum(wgt)::bigint from tx x join tx y on x.tid = y.tid and x.item < y.item join w on w.tid = x.tid group by 1) select items, size, supp from s, t where supp >= {_LEAST_SQL.replace('n -', 't.n -')}",
    "border_sets": f"with recursive {_all(_DEEP_SQL)} select items, size, supp from sets where supp >= case size when 1 then 100 when 2 then 300 else 30 end",
    "bounded_sets": f"with recursive {_all(_DEEP_SQL)} select items, size, supp from sets, total where size >= 2 and supp <= ceil(0.02 * n - 1e-9)",
    "pattern_spectrum": f"with recursive {_all(_DEEP_SQL)} select size, supp, count(*)::bigint as n from sets group by size, supp",
    "set_size_stats": f"with recursive {_all(_DEEP_SQL)} select coalesce(size, 0) as size, count(*)::bigint as n from sets group by rollup (size)",
    "set_tids": f"with recursive {_all(_DEEP_SQL)} select array_to_string(l, ' ') as items, unnest(tids) as tid from grown",
    "rules_confidence_lift": f"with recursive {_RULES} select body, head, s::bigint as supp, round(s / bs, 8) as confidence, round(s * n / (bs * hs), 8) as lift from rules {_PICK}",
    "rules_empty_body": f"with recursive {_rules_sql(0.15)} select '' as body, a as head, supp, round(supp / n, 8) as confidence from f1, total, lim where supp >= n * 0.15 and supp >= least union all select body, head, s::bigint, round(s / bs, 8) from rules where bs >= body_least and s >= bs * 0.15 * (1 - 1e-12)",
    "rules_appearance": f"with recursive {_RULES} select body, head, s::bigint as supp from rules {_PICK} and not list_has_any(body_l, ['Brand#2', 'Brand#3']) and head not in ('Brand#1', 'Brand#3')",
    "rule_measures": f"""with recursive {_RULES},
m as (select *, s / bs as c, hs / n as p, s * n / (bs * hs) as l, bs * (n - hs) / ((bs - s) * n) as v, s * (n - bs) / (bs * (hs - s)) as k, hs * bs - s * n as t, hs * (n - hs) * bs * (n - bs) as q from rules {_PICK})
select body, head, s::bigint as supp, round(c, 8) as m_c, round(abs(c - p), 8) as m_d, round(l, 8) as m_l, round(abs(l - 1), 8) as m_a, round(1 - least(l, 1 / l), 8) as m_q,
  round(v, 8) as m_v, round(abs(v - 1), 8) as m_e, round(1 - least(v, 1 / v), 8) as m_r, round(k, 8) as m_k, round(log2(k), 8) as m_j,
  round(case when c >= p then (c - p) / (1 - p) else (c - p) / p end, 8) as m_z, round(t * t / q, 8) as m_n, round((abs(t) - 0.5 * n) * (abs(t) - 0.5 * n) / q, 8) as m_y,
  round(s / n * log2(s * n / (bs * hs)) + (bs - s) / n * log2((bs - s) * n / (bs * (n - hs))) + (hs - s) / n * log2((hs - s) * n / ((n - bs) * hs)) + (n - bs - hs + s) / n * log2((n - bs - hs + s) * n / ((n - bs) * (n - hs))), 8) as m_i from m""",
    "rule_filter": f"with recursive {_RULES} select body, head, s::bigint as supp from rules {_PICK} and s * n / (bs * hs) >= 1.02",
    "set_evaluation_pruning": f"with recursive {_all(_DEEP_SQL)}, score as (select b.items, avg(b.supp::double * n / (p.supp::double * f1.supp)) as v from below b join sets p on p.l = b.part join f1 on f1.a = b.h, total group by 1), passed as (select s.l, s.items, s.size, s.supp from sets s join score using (items) where v >= 1.02), kept as (select l, items, size, supp, 1 as round from sets where size = 1 union all select p.l, p.items, p.size, p.supp, k.round + 1 from (select distinct round from kept) k join passed p on p.size = k.round + 1 where (select count(*) from below b where b.items = p.items) = (select count(*) from below b join kept q on q.l = b.part where b.items = p.items)) select items, size, supp from kept",
    "expected_spectrum": f"with {_TX}, m as (select count(distinct item) as m from tx), z as (select unnest([2, 3]) as size), c as (select unnest([0.0, 10.0, 20.0, 300.0]) as supp), slots as (select size, sum(case size when 2 then k * (k - 1) / 2 else k * (k - 1) * (k - 2) / 6 end) as w from sizes, z group by size), every as (select size, case size when 2 then m * (m - 1) / 2 else m * (m - 1) * (m - 2) / 6 end as e from m, z) select size, supp, floor(e * exp(supp * ln(w / e) - w / e - lgamma(supp + 1)) + 0.5) as expected from slots join every using (size), c",
    "idempotent_weights": f"""with recursive {_TX}, code as (select item, row_number() over (order by item) - 1 as c from (select distinct item from tx)),
b as (select items, mask, count(*)::bigint as w from (select tid, string_agg(item, ' ' order by item) as items, sum(1::bigint << c)::bigint as mask from tx join code using (item) group by tid) group by 1, 2),
step as (
  select (select max(bit_count(mask)) from b)::bigint as z, items, mask, w from b
  union all
  select t.z - 1, t.items, t.mask, t.w - coalesce(lost, 0)::bigint from step t left join (
    select s.mask, sum(h.w) as lost from step s join step h on bit_count(h.mask) = h.z and bit_count(s.mask) < h.z and (s.mask & h.mask) = s.mask group by s.mask) x on x.mask = t.mask
  where t.z > 1)
select items, w as wgt from step where z = 1""",
    "surrogate_frequencies": f"with {_TX} select item, count(*)::bigint as frq, true as moved from tx group by item",
    "set_log_quotient": f"with recursive {_all(_LEAST_SQL)} select items, size, supp, round(case when size = 1 then 0 else log2(supp / n) - (select sum(log2(f1.supp / n)) from f1 where list_contains(l, a)) end, 8) as value from sets, total",
    "set_rule_measure": f"with recursive {_all(_LEAST_SQL)}, best as (select b.items, max(b.supp / p.supp) as value from below b join sets p on p.l = b.part group by 1) select items, size, supp, round(coalesce(value, 0.0), 8) as value from sets left join best using (items)",
    "surrogate_shuffle": "select p_brand, count(*)::bigint as n, true as moved from part group by p_brand",
    "surrogate_swap": f"with {_TX} select item, count(*)::bigint as frq, true as moved, true as same_sizes from tx group by item",
}
