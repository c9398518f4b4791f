"""Association rules with one item in the head, and measures of sets over their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.measures import MEASURES, log_quotient, measure, passes
from quarry.operators.itemsets import frequent, rule_supports, subsets_one_smaller
from quarry.operators.transactions import collapse
from quarry.session import cut

#: fixed values: spellings of where an item may appear in a rule
APPEARANCES = {
    "none": "n", "neither": "n", "ignore": "n", "n": "n", "-": "n",
    "body": "b", "in": "b", "inp": "b", "input": "b", "b": "b", "i": "b", "a": "b", "antecedent": "b", "ante": "b",
    "head": "h", "out": "h", "output": "h", "h": "h", "o": "h", "c": "h", "cons": "h", "consequent": "h",
    "both": "x", "inout": "x", "io": "x", "in&out": "x", "x": "x", "bh": "x", "ac": "x", "a&c": "x", "canda": "x", "i&o": "x", "c&a": "x", "b&h": "x", "h&b": "x",
}


def appearance(text: str) -> str:
    """n, b, h or x from a spelling or its unique beginning."""
    text = text.strip().lower()
    if text in APPEARANCES:
        return APPEARANCES[text]
    hits = {v for k, v in APPEARANCES.items() if len(text) > 1 and k.startswith(text)}
    if len(hits) != 1:
        raise ValueError(f"unknown appearance {text!r}")
    return hits.pop()


def rules_of(sets: DataFrame, total: float, least_body: float, confidence: float, empty_body: bool = False, appear: dict[str, str] | None = None) -> DataFrame:
    """(body, head, supp, body_supp, head_supp, total, confidence, lift) of the rules in ``sets``.

    A rule needs the body's support ``least_body`` and a confidence in percent.
    ``appear`` maps items (and '' for all others) to where they may stand.
    """
    at = F.col("supp").cast("double")
    rules = subsets_one_smaller(sets).select(F.col("items").alias("body"), "head", at.alias("supp"))
    bodies = sets.select(F.col("items").alias("body"), at.alias("body_supp"))
    heads = sets.where("size = 1").select(F.get("items", F.lit(0)).alias("head"), at.alias("head_supp"))
    long = rules.where(F.size("body") > 0).join(bodies, "body")
    if empty_body:
        long = long.unionByName(rules.where(F.size("body") == 0).withColumn("body_supp", F.lit(float(total))))
    out = long.join(heads, "head").withColumn("total", F.lit(float(total)))
    args = (F.col("supp"), F.col("body_supp"), F.col("head_supp"), F.col("total"))
    out = out.withColumn("confidence", measure("c", *args)).withColumn("lift", measure("l", *args))
    if appear:
        rest = appearance(appear.get("", "both"))
        codes = {k: appearance(v) for k, v in appear.items() if k}
        only = lambda want: F.array(*[F.lit(k) for k, v in codes.items() if v in want]) if any(v in want for v in codes.values()) else F.array().cast("array<string>")
        named = F.array(*[F.lit(k) for k in codes]) if codes else F.array().cast("array<string>")
        ok_head = F.array_contains(only("hx"), F.col("head")) | (~F.array_contains(named, F.col("head")) & F.lit(rest in "hx"))
        ok_body = F.forall("body", lambda x: F.array_contains(only("bx"), x) | (~F.array_contains(named, x) & F.lit(rest in "bx")))
        out = out.where(ok_head & ok_body)
    return out.where((F.col("body_supp") >= least_body) & (F.col("supp") >= F.col("body_supp") * (confidence / 100) * (1 - 1e-12))).select("body", "head", "supp", "body_supp", "head_supp", "total", "confidence", "lift")


def mine_rules(tx: DataFrame, support: float = 10.0, confidence: float = 80.0, largest: int = 0, **options) -> DataFrame:
    """Rules straight from transactions; see ``rules_of``."""
    base = cut(collapse(tx))
    total = base.agg(F.coalesce(F.sum("wgt"), F.lit(0)).cast("double")).first()[0] or 0.0
    least, body = rule_supports(support, confidence, total)
    return rules_of(frequent(base, least, largest, collapsed=True), total, body, confidence, **options)


def evaluate(rules: DataFrame, codes: str) -> DataFrame:
    """``rules`` with one column ``m_<code>`` for each measure code."""
    args = (F.col("supp"), F.col("body_supp"), F.col("head_supp"), F.col("total"))
    return rules.withColumns({f"m_{c}": measure(c, *args).cast("double") for c in codes})


def select_rules(rules: DataFrame, code: str, threshold: float) -> DataFrame:
    """The rules at least as good as a threshold."""
    args = (F.col("supp"), F.col("body_supp"), F.col("head_supp"), F.col("total"))
    return rules.withColumn("value", measure(code, *args)).where(passes(code, F.col("value"), threshold))


def evaluate_sets(sets: DataFrame, total: float, code: str, how: str = "avg", invalidate: bool = False) -> DataFrame:
    """``sets`` with ``value``: a rule measure over all rules of one head item (min, max, avg, or first).

    ``first`` takes the greatest item as head.  Sets of one item get the worst value.
    """
    worst = 0.0 if MEASURES[code][1] else 1.0
    single = sets.select(F.col("items").alias("body"), F.col("supp").alias("body_supp"))
    heads = sets.where("size = 1").select(F.get("items", F.lit(0)).alias("head"), F.col("supp").alias("head_supp"))
    rules = subsets_one_smaller(sets.where("size > 1")).select(F.col("items").alias("body"), "head", "supp").join(single, "body").join(heads, "head")
    rules = rules.withColumn("value", measure(code, F.col("supp"), F.col("body_supp"), F.col("head_supp"), F.lit(float(total)), invalidate)).withColumn("items", F.array_sort(F.array_append("body", F.col("head"))))
    agg = {"min": F.min("value"), "max": F.max("value"), "avg": F.avg("value"), "first": F.max_by("value", "head")}[how]
    return sets.join(rules.groupBy("items").agg(agg.alias("value")), "items", "left").withColumn("value", F.coalesce("value", F.lit(worst)))


def prune_sets(sets: DataFrame, total: float, code: str, threshold: float, strength: int = 0) -> DataFrame:
    """Sets whose value passes; with ``strength`` the subsets one smaller must pass too.

    0 tests the set alone, below 0 some subset must have passed, above 0 all;
    this repeats from small to large sizes.
    """
    scored = evaluate_sets(sets, total, code).withColumn("ok", passes(code, F.col("value"), threshold) | (F.col("size") <= 1))
    if strength == 0:
        return scored.where("ok").drop("ok")
    sizes = sorted(r[0] for r in scored.select("size").distinct().collect())
    kept = scored.where("size <= 1")
    for size in sizes:
        if size <= 1:
            continue
        now = scored.where((F.col("size") == size) & F.col("ok"))
        below = subsets_one_smaller(now).withColumn("whole", F.array_sort(F.array_append("items", F.col("head")))).select("whole", "items")
        hits = below.join(kept.select("items"), "items", "left_semi").groupBy(F.col("whole").alias("items")).agg(F.count(F.lit(1)).alias("k"))
        now = now.join(hits, "items").where(F.col("k") >= (1 if strength < 0 else size)).drop("k")
        kept = kept.unionByName(now)
    return kept.drop("ok")


def set_log_quotient(sets: DataFrame, total: float) -> DataFrame:
    """``sets`` with frq (the items' frequencies) and the itemset measures derived from them.

    value is log2 of the support quotient; value_per_item divides by the size,
    supp_times_size and supp_per_item relate weight and size.
    """
    heads = sets.where("size = 1").select(F.get("items", F.lit(0)).alias("item"), F.col("supp").alias("f"))
    rows = sets.select("items", F.explode("items").alias("item")).join(heads, "item").groupBy("items").agg(F.array_sort(F.collect_list("f")).alias("frq"))
    out = sets.join(rows, "items").withColumn("value", log_quotient(F.col("supp"), F.lit(float(total)), F.col("frq")))
    return out.withColumns({"value_per_item": F.col("value") / F.col("size"), "supp_times_size": F.col("supp") * F.col("size"), "supp_per_item": F.col("supp") / F.col("size")})
