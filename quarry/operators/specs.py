"""Specifications of error handlers: what to do in which context.

``handlers``: id, loc, fn, context and response (sorted arrays of names).
``rules``: rule_id, context, response (sorted arrays).  Handlers are told
apart by ``loc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import clean_name
from quarry.operators.components import connected_components
from quarry.operators.itemsets import closed, frequent
from quarry.operators.transactions import items_of
from quarry.operators.skew import global_rank
from quarry.session import cut

TYPES, TACTICS = ("CALL",), ("PRE", "POST", "FN")
NAMES = "array<string>"


def file_of(loc: Column) -> Column:
    return F.get(F.split(loc, ":"), F.lit(0))


def implementation_of(loc: Column) -> Column:
    """The second path component."""
    return F.get(F.split(file_of(loc), "/"), F.lit(1))


def items(table: DataFrame) -> DataFrame:
    """(handler, name, tactic) of valid rows: a handler, a name, type CALL and tactic PRE, POST or FN; once each."""
    rows = table.where(F.col("handler").isNotNull() & F.col("type").isin(*TYPES) & F.col("tactic").isin(*TACTICS))
    return rows.select("handler", clean_name("item").alias("name"), "tactic").where("name is not null").distinct()


def clean_context(context: DataFrame) -> DataFrame:
    """(handler, name): PRE items whose name does not stand in the handler with tactic FN."""
    i = items(context)
    fn = i.where("tactic = 'FN'").select("handler", "name")
    return i.where("tactic = 'PRE'").join(fn, ["handler", "name"], "left_anti").select("handler", "name")


def load_handlers(handler: DataFrame, context: DataFrame, response: DataFrame) -> DataFrame:
    """(id, loc, fn, context, response) of the handlers with a known location.

    Of several rows of an id, and of several ids at one location, the one
    loaded last counts (ties: the greater).
    """
    last = handler.where("id is not null").groupBy("id").agg(F.max(F.struct("loaded_at", "predicate_loc", "parent_function")).alias("h")).select("id", "h.*").where("predicate_loc like '%_:_%'")
    last = last.groupBy("predicate_loc").agg(F.max(F.struct("loaded_at", "id", "parent_function")).alias("h")).select(F.col("h.id").alias("id"), F.col("predicate_loc").alias("loc"), clean_name("h.parent_function").alias("fn"))
    wide = lambda t, name: t.select("handler", "name").distinct().groupBy(F.col("handler").alias("id")).agg(F.array_sort(F.collect_list("name")).alias(name))
    out = last.join(wide(clean_context(context), "context"), "id", "left").join(wide(items(response), "response"), "id", "left")
    return out.select("id", "loc", "fn", *[F.coalesce(c, F.array().cast(NAMES)).alias(c) for c in ("context", "response")])


def sentences(handlers: DataFrame, loc_like: str | None = None) -> DataFrame:
    """(tid, items): tagged tokens ``PRE|name`` and ``POST|name`` of handlers with both sides."""
    rows = handlers.where((F.size("context") > 0) & (F.size("response") > 0))
    if loc_like is not None:
        rows = rows.where(F.col("loc").rlike(f"^(?:{loc_like})"))
    tag = lambda t, c: F.transform(c, lambda x: F.concat(F.lit(f"{t}|"), x))
    return rows.select(F.col("id").alias("tid"), items_of(F.concat(tag("PRE", "context"), tag("POST", "response"))).alias("items"))


def mine_rules(handlers: DataFrame, least: float, largest: int = 0, loc_like: str | None = None) -> DataFrame:
    """(rule_id, context, response, mined): closed sets of tagged tokens with both sides; the id is their text."""
    sets = closed(frequent(sentences(handlers, loc_like), least, largest + 1 if largest else 0))
    if largest:
        sets = sets.where(F.col("size") <= largest)
    part = lambda t: F.transform(F.filter("items", lambda x: F.startswith(x, F.lit(f"{t}|"))), lambda x: F.substr(x, F.lit(len(t) + 2)))
    rules = sets.select(part("PRE").alias("context"), part("POST").alias("response"), F.col("supp").cast("bigint").alias("mined"))
    return with_id(rules.where((F.size("context") > 0) & (F.size("response") > 0)))


def with_id(rules: DataFrame) -> DataFrame:
    """``rules`` with the key ``rule_id``: context and response as text."""
    return rules.withColumn("rule_id", F.concat(F.array_join("context", " "), F.lit(" -> "), F.array_join("response", " ")))


def _containing(rules: DataFrame, handlers: DataFrame, side: str) -> DataFrame:
    """(rule_id, loc): handlers whose side holds all the rule's names of that side.

    Only handlers with the rule's rarest name are tested, so a frequent name
    does not blow up the join.
    """
    held = handlers.select("loc", F.explode(side).alias("name"))
    often = held.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    want = rules.select("rule_id", F.col(side).alias("want"), F.explode(side).alias("name")).join(often, "name", "left")
    key = want.groupBy("rule_id", "want").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "name")).alias("k")).select("rule_id", "want", F.col("k.name").alias("name"))
    full = handlers.select("loc", F.col(side).alias("have"), F.explode(side).alias("name"))
    return key.join(full, "name").where(F.size(F.array_except("want", "have")) == 0).select("rule_id", "loc").distinct()


def applicable(rules: DataFrame, handlers: DataFrame) -> DataFrame:
    """(rule_id, loc): handlers whose context holds the rule's."""
    return _containing(rules, handlers, "context")


def supporting(rules: DataFrame, handlers: DataFrame) -> DataFrame:
    """(rule_id, loc): applicable handlers whose response holds the rule's."""
    a = applicable(rules, handlers).join(rules.select("rule_id", F.col("response").alias("want")), "rule_id")
    return a.join(handlers.select("loc", "response"), "loc").where(F.size(F.array_except("want", "response")) == 0).select("rule_id", "loc")


def results(rules: DataFrame, handlers: DataFrame) -> DataFrame:
    """(rule_id, loc, violation): applicable handlers, 0 if they support the rule and 1 if not."""
    s = supporting(rules, handlers).withColumn("ok", F.lit(1))
    return applicable(rules, handlers).join(s, ["rule_id", "loc"], "left").select("rule_id", "loc", F.when(F.col("ok") == 1, 0).otherwise(1).alias("violation"))


def applies_counted(rules: DataFrame, handlers: DataFrame) -> DataFrame:
    """(rule_id, loc): applicable handlers whose context counts some name of the rule less often than both its sides together."""
    a = applicable(rules, handlers).join(rules.select("rule_id", F.concat("context", "response").alias("names")), "rule_id").join(handlers.select("loc", F.col("context").alias("have")), "loc")
    times = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    return a.where(F.exists("names", lambda x: times(F.col("names"), x) > times(F.col("have"), x))).select("rule_id", "loc")


def missing_items(rules: DataFrame, handlers: DataFrame) -> DataFrame:
    """(rule_id, loc, missing): what a violating handler does not do."""
    bad = results(rules, handlers).where("violation = 1").join(rules.select("rule_id", F.col("response").alias("want")), "rule_id")
    return bad.join(handlers.select("loc", "response"), "loc").select("rule_id", "loc", F.array_except("want", "response").alias("missing"))


def confidences(groups: DataFrame, handlers: DataFrame) -> DataFrame:
    """(group_id, support, applicable, global_confidence, local_confidence) of groups of rules.

    ``groups``: group_id and the columns of ``rules``.  Support and
    applicability count distinct handlers over all rules of a group.  The local
    confidence counts only handlers in files with a supporting one.
    """
    handlers = cut(handlers)
    ids = groups.select("group_id", "rule_id").distinct()
    rules = cut(groups.select("rule_id", "context", "response").distinct())
    yes = cut(supporting(rules, handlers).join(ids, "rule_id").select("group_id", "loc").distinct())
    may = cut(applicable(rules, handlers).join(ids, "rule_id").select("group_id", "loc").distinct())
    files = yes.select("group_id", file_of(F.col("loc")).alias("file")).distinct()
    near = may.withColumn("file", file_of(F.col("loc"))).join(files, ["group_id", "file"], "left_semi")
    count = lambda t, name: t.groupBy("group_id").agg(F.count(F.lit(1)).alias(name))
    out = ids.select("group_id").distinct().join(count(yes, "support"), "group_id", "left").join(count(may, "applicable"), "group_id", "left").join(count(near, "near"), "group_id", "left").fillna(0)
    return out.select("group_id", "support", "applicable", F.try_divide("support", "applicable").alias("global_confidence"), F.coalesce(F.try_divide("support", "near"), F.lit(0.0)).alias("local_confidence"))


def cross_implementation(groups: DataFrame, handlers: DataFrame) -> DataFrame:
    """(group_id, crosses): whether the supporting handlers lie in more than one implementation."""
    yes = supporting(groups.select("rule_id", "context", "response").distinct(), handlers).join(groups.select("group_id", "rule_id").distinct(), "rule_id")
    return yes.groupBy("group_id").agg((F.count_distinct(implementation_of(F.col("loc"))) > 1).alias("crosses"))


def synonym_sets(a: DataFrame, similar: DataFrame, least: float) -> DataFrame:
    """(pair_id, names): the sets that can stand for two sides at once.

    ``a``: pair_id, left, right (arrays).  A common name gives the
    intersection; names i, j with similarity ``least`` or more give the
    intersection with i, and with j.  ``similar``: x, y, sim, both ways.
    """
    core = F.array_intersect("left", "right")
    same = a.where(F.size(core) > 0).select("pair_id", F.array_sort(core).alias("names"))
    x = a.select("pair_id", core.alias("core"), "right", F.explode("left").alias("x")).join(similar.where(F.col("sim") >= least), "x").where(F.array_contains("right", F.col("y")) & (F.col("x") != F.col("y")))
    add = lambda c: x.select("pair_id", F.array_sort(F.array_union("core", F.array(c))).alias("names"))
    return same.unionByName(add("x")).unionByName(add("y")).distinct()


def merge_edges(rules: DataFrame, similar: DataFrame, least: float, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges between rule ids, all rules named in them) by synonym merging.

    Two rules that share a name on exactly one side produce rules of the
    shared names and each synonym of the other side; the produced ones are
    linked with each other.  Two rules whose sides all have one name, with both
    pairs more similar than ``least``, are linked with each other and with the
    crossed rules.  ``compat`` builds rules from the shared
    context where the responses meet, as the published procedure does.
    """
    r = rules.select("rule_id", "context", "response").distinct()
    one = lambda s: r.select(F.col("rule_id").alias(f"id_{s}"), F.col("context").alias(f"c_{s}"), F.col("response").alias(f"r_{s}"))

    near = similar.where(F.col("sim") >= least).select("x", "y").distinct()
    edges, made = None, None
    for side, o in (("context", "response"), ("response", "context")):
        c, p = side[0], o[0]
        # the rules meet at a shared name and a pair of synonyms at once, so a frequent name alone makes no pairs
        left = one("a").withColumn("k", F.explode(f"{c}_a")).withColumn("x", F.explode(f"{p}_a")).join(near, "x")
        right = one("b").withColumn("k", F.explode(f"{c}_b")).withColumn("y", F.explode(f"{p}_b"))
        pairs = left.join(right, ["k", "y"]).where((F.col("id_a") < F.col("id_b")) & (F.size(F.array_intersect(f"{p}_a", f"{p}_b")) == 0))
        shared = F.array_sort(F.array_intersect(f"{c}_a", f"{c}_b"))
        new = pairs.select(F.concat_ws(" | ", "id_a", "id_b").alias("pair_id"), shared.alias("shared"), F.explode(F.array("x", "y")).alias("name")).distinct()
        names = F.array("name")
        if side == "response" and compat:
            new = new.select("pair_id", F.array().cast(NAMES).alias("context"), names.alias("response"))
        elif side == "context":
            new = new.select("pair_id", F.col("shared").alias("context"), names.alias("response"))
        else:
            new = new.select("pair_id", names.alias("context"), F.col("shared").alias("response"))
        new = with_id(new)
        # the produced rules of a pair belong together; a single one has no partner
        e = new.select(F.min("rule_id").over(Window.partitionBy("pair_id")).alias("id_a"), F.col("rule_id").alias("id_b")).where("id_a <> id_b")
        edges = e if edges is None else edges.unionByName(e)
        made = new.select("rule_id", "context", "response") if made is None else made.unionByName(new.select("rule_id", "context", "response"))
    single = r.where((F.size("context") == 1) & (F.size("response") == 1)).select("rule_id", F.get("context", F.lit(0)).alias("c"), F.get("response", F.lit(0)).alias("p"))
    left = single.select(F.col("rule_id").alias("id_a"), F.col("c").alias("x"), F.col("p").alias("p_a"))
    right = single.select(F.col("rule_id").alias("id_b"), F.col("c").alias("y"), F.col("p").alias("p_b"))
    strict = similar.where(F.col("sim") > least).select("x", "y")
    apart = left.join(strict, "x").join(right, "y").where("id_a < id_b and x <> y and p_a <> p_b").join(strict.select(F.col("x").alias("p_a"), F.col("y").alias("p_b")), ["p_a", "p_b"], "left_semi")
    cross = apart.select("id_a", "id_b", F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("p_b").alias("p")), F.struct(F.col("y").alias("c"), F.col("p_a").alias("p")))).alias("n"))
    cross = with_id(cross.select("id_a", "id_b", F.array("n.c").alias("context"), F.array("n.p").alias("response")))
    edges = edges.unionByName(cross.select("id_a", F.explode(F.array("id_b", "rule_id")).alias("id_b")))
    made = made.unionByName(cross.select("rule_id", "context", "response"))
    named = r.join(edges.select(F.explode(F.array("id_a", "id_b")).alias("rule_id")).distinct(), "rule_id", "left_semi")
    return edges, named.unionByName(made).dropDuplicates(["rule_id"])


def merge_rules(rules: DataFrame, similar: DataFrame, least: float, compat: bool = False) -> DataFrame:
    """(group_id, rule_id, context, response): classes of rules merged by synonyms; others do not appear."""
    edges, every = merge_edges(rules, similar, least, compat)
    edges = cut(edges)
    parts = connected_components(edges, "id_a", "id_b")
    return every.join(parts.select(F.col("node").alias("rule_id"), F.col("component").alias("group_id")), "rule_id").select("group_id", "rule_id", "context", "response")


def ranked_specs(rules: DataFrame, handlers: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(rule_id, kind, support, merged_support, global_confidence, local_confidence), best merged support first.

    Every mined rule is listed with its own support; a rule in a merged class
    also with the class's support and confidences.
    """
    rules = cut(rules)
    own = confidences(rules.withColumn("group_id", F.col("rule_id")), handlers)
    plain = rules.select("rule_id", "mined").join(own.withColumnRenamed("group_id", "rule_id"), "rule_id").select("rule_id", F.lit("mined").alias("kind"), "support", F.col("mined").alias("merged_support"), "global_confidence", F.col("global_confidence").alias("local_confidence"))
    if merged is not None:
        merged = cut(merged)
        c = confidences(merged, handlers)
        more = merged.select("group_id", "rule_id").join(rules.select("rule_id"), "rule_id", "left_semi").join(c, "group_id").join(own.select(F.col("group_id").alias("rule_id"), F.col("support").alias("own")), "rule_id")
        plain = plain.unionByName(more.select("rule_id", F.lit("merged").alias("kind"), F.col("own").alias("support"), F.col("support").alias("merged_support"), "global_confidence", "local_confidence"))
    return plain.orderBy(F.desc("merged_support"), "rule_id", "kind")


def drop_listed(rules: DataFrame, names: list[str]) -> DataFrame:
    """Rules without a side that consists only of listed names."""
    listed = F.array(*[F.lit(x) for x in names]) if names else F.array().cast(NAMES)
    return rules.where((F.size(F.array_except("context", listed)) > 0) & (F.size(F.array_except("response", listed)) > 0))


def best_per_response(specs: DataFrame, least: float = 0.5) -> DataFrame:
    """Of each response the spec with the highest local confidence (ties: merged support, then id), above ``least``."""
    order = Window.partitionBy("response").orderBy(F.desc("local_confidence"), F.desc("merged_support"), "rule_id")
    return specs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).where(F.col("local_confidence") > least).drop("_r")


def drop_subsumed(rules: DataFrame) -> DataFrame:
    """Rules without another whose context, or whose response, is a subset of theirs.

    Of rules with equal sides all but the least id are dropped.
    """
    bad = None
    for side in ("context", "response"):
        small = rules.select(F.col("rule_id").alias("other"), F.col(side).alias("small"), F.array_min(side).alias("name"))
        mine = rules.select("rule_id", F.col(side).alias("mine"), F.explode(side).alias("name"))
        hit = mine.join(small, "name").where((F.col("rule_id") != F.col("other")) & (F.size(F.array_except("small", "mine")) == 0) & ((F.size("small") < F.size("mine")) | (F.col("other") < F.col("rule_id")))).select("rule_id")
        bad = hit if bad is None else bad.unionByName(hit)
    return rules.join(bad.distinct(), "rule_id", "left_anti")


def _class_ranks(classes: DataFrame) -> DataFrame:
    """(class_id, no): 0-based ranks of the classes."""
    return global_rank(classes.select("class_id").distinct(), ["class_id"]).select("class_id", (F.col("rank") - 1).alias("no"))


def replace_names(handlers: DataFrame, classes: DataFrame, prefix: str = "CLASS_") -> DataFrame:
    """Handlers with names replaced by ``prefix`` and the rank of their class; others stay.

    ``classes``: name, class_id.  The ranks follow the class ids.
    """
    rank = _class_ranks(classes)
    code = classes.join(rank, "class_id").select("name", F.concat(F.lit(prefix), "no").alias("code"))
    out = handlers
    for side in ("context", "response"):
        each = handlers.select("loc", F.explode(side).alias("name")).join(code, "name", "left").select("loc", F.coalesce("code", "name").alias("name"))
        new = each.groupBy("loc").agg(F.array_sort(F.collect_set("name")).alias(side))
        out = out.drop(side).join(new, "loc", "left").withColumn(side, F.coalesce(side, F.array().cast(NAMES)))
    return out.select(*handlers.columns)


def merged_items(classes: DataFrame, prefix: str = "CLASS_") -> DataFrame:
    """(merged, unmerged): the dictionary of ``replace_names``."""
    rank = _class_ranks(classes)
    return classes.join(rank, "class_id").select(F.concat(F.lit(prefix), "no").alias("merged"), F.col("name").alias("unmerged"))


def holding(handlers: DataFrame, name: str) -> DataFrame:
    """Handlers with the name on either side."""
    return handlers.where(F.array_contains("context", name) | F.array_contains("response", name))


def transactions(handlers: DataFrame) -> DataFrame:
    """(tid, items): context and response as one transaction."""
    return handlers.select(F.col("id").alias("tid"), items_of(F.concat("context", "response")).alias("items"))


def spec_similarity(groups: DataFrame, similar: DataFrame) -> DataFrame:
    """(group_id, similarity): mean similarity of the different names at one side of a group's rules; 1 if none is known."""
    names = groups.select("group_id", F.explode(F.concat(F.transform("context", lambda x: F.concat(F.lit("c|"), x)), F.transform("response", lambda x: F.concat(F.lit("r|"), x)))).alias("t")).distinct()
    names = names.select("group_id", F.substring_index("t", "|", 1).alias("side"), F.expr("substr(t, 3)").alias("name"))
    pairs = names.withColumnRenamed("name", "x").join(similar, "x").join(names.withColumnRenamed("name", "y"), ["group_id", "side", "y"]).where("x < y")
    return groups.select("group_id").distinct().join(pairs.groupBy("group_id").agg(F.avg("sim").alias("similarity")), "group_id", "left").select("group_id", F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def judgements(log: DataFrame) -> DataFrame:
    """(context, response, judgement): the last of each pair; ``log`` has seq, judgement (T, F or ?), context, response."""
    return log.where(F.col("judgement").isin("T", "F", "?")).groupBy("context", "response").agg(F.max_by("judgement", "seq").alias("judgement"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rule_id, rank_a, rank_b): ranks of every rule in two ranked runs; null where it is not listed."""
    from quarry.operators.evaluate import first_rank

    rank = lambda t, name: first_rank(t.withColumn("_p", -F.col("merged_support")), "rule_id", "_p").withColumnRenamed("rank", name)
    return rank(a, "rank_a").join(rank(b, "rank_b"), "rule_id", "full_outer")
