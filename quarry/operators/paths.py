"""Context paths around interesting calls.

``steps``: source, target (within a function).  ``nodes``: node, fn, call
(name called there, null for none), entry and exit (booleans).  ``calls``:
node, callee, back (where the call returns).  Paths never visit a node twice,
so a loop is passed at most once; a path of more than ``most`` calls stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import between, function_of, kind, reachable
from quarry.session import cut

NAMES = "array<string>"


def append(path: Column, call: Column) -> Column:
    """The path with one more call; a null call changes nothing."""
    return F.when(call.isNull(), path).otherwise(F.array_append(path, call))


def without(path: Column, call: str) -> Column:
    return F.array_remove(path, call)


def rewind(path: Column, n: int) -> Column:
    """The path without its last n calls."""
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - n, F.lit(0)))


def path_key(path: Column) -> Column:
    """Text that tells call sequences apart."""
    return F.array_join(path, " ")


def prefix_compatible(a: Column, b: Column) -> Column:
    """Whether the shorter function sequence is the beginning of the longer."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)


def hide_calls(path: Column, functions: Column) -> Column:
    """The path without calls to the functions that are being left."""
    return F.filter(path, lambda c: ~F.array_contains(functions, c))


def call_sites_of(nodes: DataFrame, interesting: DataFrame) -> DataFrame:
    """(node, fn, call): sites that call an interesting name."""
    return nodes.join(interesting.select(F.col("name").alias("call")).distinct(), "call", "left_semi").select("node", "fn", "call").distinct()


def caller_pairs(nodes: DataFrame) -> DataFrame:
    """(call, caller): names with ``CALLER_`` and the function they are called in."""
    return nodes.where("call is not null").select("call", F.concat(F.lit("CALLER_"), "fn").alias("caller")).distinct()


def return_sites(calls: DataFrame, of: DataFrame) -> DataFrame:
    """(node, back): return sites of the callers of each node's function."""
    return of.select("node", "fn").join(calls.select(F.col("callee").alias("fn"), "back"), "fn").select("node", "back").distinct()


def _extend(start: DataFrame, steps: DataFrame, nodes: DataFrame, calls: DataFrame, most: int, forward: bool) -> DataFrame:
    """(site, path, fns) of all simple paths from the sites to the end of the outermost caller reached.

    ``path`` holds the calls in order of the walk, ``fns`` the functions left.
    """
    a, b = ("source", "target") if forward else ("target", "source")
    step = steps.select(F.col(a).alias("node"), F.col(b).alias("next"))
    node = nodes.select(F.col("node").alias("next"), F.col("call").alias("met"))
    ends = nodes.where(F.col("exit" if forward else "entry")).select("node", F.col("fn").alias("leaving"))
    if forward:
        out = ends.join(calls.select(F.col("callee").alias("leaving"), F.col("back").alias("up")), "leaving", "left")
    else:
        out = ends.join(calls.select(F.col("callee").alias("leaving"), F.col("node").alias("up")), "leaving", "left")
    front = cut(start.select(F.col("node").alias("site"), "node", F.array("node").alias("seen"), F.array().cast(NAMES).alias("path"), F.array().cast(NAMES).alias("fns")))
    done = None
    while True:  # a way visits no node twice, so all of them end
        inside = front.join(step, "node").where(~F.array_contains("seen", F.col("next"))).join(node, "next")
        inside = inside.select("site", F.col("next").alias("node"), F.array_append("seen", F.col("next")).alias("seen"), append(F.col("path"), F.col("met")).alias("path"), "fns")
        leaving = front.join(out, "node").select("site", F.col("up").alias("node"), "seen", "path", F.array_append("fns", F.col("leaving")).alias("fns"))
        top = leaving.where("node is null").select("site", "path", "fns")
        up = leaving.where("node is not null").where(~F.array_contains("seen", F.col("node"))).withColumn("seen", F.array_append("seen", F.col("node")))
        if forward:
            met = nodes.select("node", F.col("call").alias("met"))
            up = up.join(met, "node").select("site", "node", "seen", append(F.col("path"), F.col("met")).alias("path"), "fns")
        grown = inside.unionByName(up.select("site", "node", "seen", "path", "fns"))
        full = grown.where(F.size("path") >= most).select("site", "path", "fns")
        ended = cut(top.unionByName(full).distinct())
        done = ended if done is None else done.unionByName(ended)
        front = cut(grown.where(F.size("path") < most))
        if front.isEmpty():
            break
    return done.distinct()


def context_paths(steps: DataFrame, nodes: DataFrame, calls: DataFrame, interesting: DataFrame, most: int = 100) -> DataFrame:
    """(site, path): calls before an interesting call, the call, and the calls after it, once for each sequence.

    Ways before and after are matched only if they leave the same functions,
    the shorter sequence of them being the beginning of the longer.
    """
    sites = call_sites_of(nodes, interesting)
    after = _extend(sites, steps, nodes, calls, most, True)
    before = _extend(sites, steps, nodes, calls, most, False)
    pairs = before.select("site", F.reverse("path").alias("head"), F.col("fns").alias("fb")).join(after.select("site", F.col("path").alias("tail"), F.col("fns").alias("fa")), "site").where(prefix_compatible(F.col("fa"), F.col("fb")))
    named = pairs.join(sites.select(F.col("node").alias("site"), "call"), "site")
    return named.select("site", F.concat(hide_calls(F.col("head"), F.col("fb")), F.array("call"), hide_calls(F.col("tail"), F.col("fa"))).alias("path")).distinct()


def path_lines(paths: DataFrame, mark: bool = False) -> DataFrame:
    """(value): distinct paths as lines, with ``mark`` between PATH_BEGIN and PATH_END."""
    text = F.array_join("path", " ")
    return paths.select((F.concat(F.lit("PATH_BEGIN "), text, F.lit(" PATH_END")) if mark else text).alias("value")).distinct()


def error_pairs(paths: DataFrame, handlers: list[str]) -> DataFrame:
    """(first, second): for each call with an error branch on a path, its outcome with every later call and the end.

    ``paths`` has path and taken, the calls whose error branch the path takes;
    the outcome is ERR_ or NO_ERR_ and the name, the end RETURN_ERR or
    RETURN_NO_ERR.
    """
    known = F.array(*[F.lit(h) for h in handlers]) if handlers else F.array().cast(NAMES)
    at = paths.select("path", "taken", F.posexplode("path").alias("i", "call")).where(F.array_contains(known, F.col("call")))
    hit = F.array_contains("taken", F.col("call"))
    state = F.concat(F.when(hit, "ERR_").otherwise("NO_ERR_"), "call")
    later = F.slice("path", F.col("i") + 2, F.greatest(F.size("path") - F.col("i") - 1, F.lit(0)))
    end = F.array(F.when(F.size("taken") > 0, F.lit("RETURN_ERR")).otherwise(F.lit("RETURN_NO_ERR")))
    return at.select(state.alias("first"), F.explode(F.concat(later, end)).alias("second")).distinct()


def trace_items(edges: DataFrame, entry: DataFrame, handler: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, tactic): PRE items on ways from the entry to the handler, POST items reachable from it and not met before."""
    pre = between(edges, entry, handler)
    post = reachable(edges, handler).join(pre, "node", "left_anti")
    named = nodes.where("call is not null").select("node", F.col("call").alias("name"))
    return named.join(pre, "node", "left_semi").select("name", F.lit("PRE").alias("tactic")).unionByName(named.join(post, "node", "left_semi").select("name", F.lit("POST").alias("tactic"))).distinct()


def instruction_items(instructions: DataFrame) -> DataFrame:
    """(node, name, type): CALL, STORE and LOAD items; generated temporaries (names with ``tmp``) are left out for the latter two."""
    kept = F.col("op").isin("call", "store", "load") & ((F.col("op") == "call") | ~F.contains("name", F.lit("tmp")))
    return instructions.where(kept & F.col("name").isNotNull()).select("node", "name", F.upper("op").alias("type"))


def instruction_label(op: Column, error: Column, struct: Column, index: Column, conditional: Column) -> Column:
    """The label of an instruction: condition, error code, field access, or its kind."""
    return F.when(conditional, F.lit("F2V_CONDBR")).when(error.isNotNull(), F.concat(F.lit("F2V_ERR_"), error)).when(struct.isNotNull(), F.concat(F.lit("F2V_GEP_"), struct, F.lit("_"), index)).otherwise(F.concat(F.lit("F2V_INST_"), op))


def error_code_uses(instructions: DataFrame, edges: DataFrame, codes: DataFrame) -> DataFrame:
    """(location): where the blocks that lead to an error code are decided: locations of the predecessors."""
    hit = instructions.where(F.col("value").isNotNull()).join(codes.select("value").distinct(), "value", "left_semi").select(F.col("node").alias("target"))
    before = edges.join(hit, "target", "left_semi").select(F.col("source").alias("node")).distinct()
    return before.join(instructions.select("node", "location"), "node").where("location is not null").select("location").distinct()


def branch_safety(predicate: Column, constant: Column, is_code: Column, right_constant: Column | None = None, positive: bool = False) -> Column:
    """Which branch of a comparison with a constant is without error: struct(safe, unsafe) of T, F or N (neither).

    Only comparisons with zero or an error code are error tests.  Being less
    than either is the error, on the side where the constant stands on the
    right; with ``right_constant`` false the branches of the signed predicates
    swap, and with error codes of ``positive`` sign once more.  Equality tells
    the error branch for a code and both for zero; inequality tells nothing for
    a code.  Other predicates tell nothing.
    """
    out = lambda s, u: F.struct(F.lit(s).alias("safe"), F.lit(u).alias("unsafe"))
    zero = constant == 0
    right = F.lit(True) if right_constant is None else right_constant
    below = predicate.isin("slt", "sle")
    first = (below == right) != F.lit(positive)  # the error is where the comparison holds
    tests = F.coalesce(zero | is_code, F.lit(False))
    return (
        F.when(tests & (below | predicate.isin("sgt", "sge")), F.when(first, out("F", "T")).otherwise(out("T", "F")))
        .when(tests & (predicate == "eq"), F.when(zero, out("T", "F")).otherwise(out("N", "T")))
        .when(tests & (predicate == "ne"), F.when(zero, out("F", "T")).otherwise(out("N", "N")))
        .otherwise(out("N", "N"))
    )


def branches_like(branches: DataFrame, name: str, file: str) -> DataFrame:
    """The conditional branches of functions with ``name`` in their name, in files with ``file`` in theirs."""
    return branches.where(F.contains("fn", F.lit(name)) & F.contains("file", F.lit(file)))


def location(c: Column) -> Column:
    """``file:line`` as a struct, ordered by file and then by line; 0 where there is no line."""
    line = F.coalesce(F.substring_index(c, ":", -1).try_cast("int"), F.lit(0))
    return F.when(c.isNotNull(), F.struct(F.substring_index(c, ":", 1).alias("file"), line.alias("line")))


def inner_edges(edges: DataFrame, stacks: DataFrame, stop: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The edges that an action visitor follows: no calls, no possible returns, not into a ``stop`` stack or a ``seen`` node.

    ``stacks``: node, stack; ``stop``: stack; ``seen``: node.
    """
    kept = edges.where(~kind("label").isin("call", "may_ret"))
    if stop is not None:
        barred = stacks.join(stop.select("stack").distinct(), "stack", "left_semi").select(F.col("node").alias("target"))
        kept = kept.join(barred, "target", "left_anti")
    if seen is not None:
        kept = kept.join(seen.select(F.col("node").alias("target")), "target", "left_anti")
    return kept.select(*edges.columns)


def nesting_pairs(visited: DataFrame, stacks: DataFrame, handlers: DataFrame) -> DataFrame:
    """(parent, child): a handler's stack with each other handler's that it meets; ``visited`` has stack and node."""
    met = visited.join(stacks.select("node", F.col("stack").alias("child")), "node").where(F.col("child") != F.col("stack"))
    return met.join(handlers.select(F.col("stack").alias("child")).distinct(), "child", "left_semi").select(F.col("stack").alias("parent"), "child").distinct()


def points_to(stores: DataFrame) -> DataFrame:
    """(struct, index, functions): functions stored in each field."""
    return stores.groupBy("struct", "index").agg(F.array_sort(F.collect_set("fn")).alias("functions"))


def indirect_calls(sites: DataFrame, pointed: DataFrame) -> DataFrame:
    """(node, callee): indirect sites (node, struct, index) with every function their field may hold."""
    return sites.join(pointed, ["struct", "index"]).select("node", F.explode("functions").alias("callee"))


def struct_name(c: Column) -> Column:
    """A struct's name without its kind and numeric suffix."""
    return F.regexp_extract(c, r"^(?:struct\.|union\.|class\.)?([^.]*)", 1)


def block_chain(instructions: DataFrame) -> DataFrame:
    """(source, target): consecutive instructions of each block in the order of ``pos``."""
    from pyspark.sql import Window

    nxt = F.lead("node").over(Window.partitionBy("fn", "block").orderBy("pos"))
    return instructions.select(F.col("node").alias("source"), nxt.alias("target")).where("target is not null")


def function_names(edges: DataFrame) -> DataFrame:
    """(fn): functions with a node in the graph."""
    return edges.select(F.explode(F.array(function_of("source"), function_of("target"))).alias("fn")).distinct()
