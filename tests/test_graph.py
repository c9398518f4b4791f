import random

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import paths as P
from quarry.operators import walks as W
from quarry.operators.components import connected_components
from quarry.operators.hierarchy import descendants, hierarchy, path_text, paths, peel, subtree_sizes
from quarry.operators.skew import global_rank, lookup_join

EDGES = [("f.1", "g.0", "call", []), ("f.1", "f.2", "ret", []), ("g.0", "g.3", "", [0]), ("g.3", "f.2", "may_ret", []), ("main.0", "f.0", "", [])]


def tiny(spark):
    e = spark.createDataFrame(EDGES, "source string, target string, label string, label_id array<int>")
    return e, spark.createDataFrame([(0, "F2V_INST_load")], "id int, label string")


def test_pushdown(spark):
    e, labels = tiny(spark)
    arcs, names = G.pushdown(e, labels)
    got = {(r["source"], r["target"], tuple(r["label_id"]), r["push"]) for r in arcs.collect()}
    assert got == {("g.0", "g.3", (0,), None), ("f.1", "g.0", (), "f.2"), ("f.1", "f.2", (1,), None)}
    assert {(r["id"], r["label"]) for r in names.collect()} == {(0, "F2V_INST_load"), (1, "g")}
    assert {(r["source"], r["target"]) for r in G.may_return_edges(e.where("label <> 'may_ret'")).collect()} == {("g.3", "f.2")}


def test_walks(spark):
    e, labels = tiny(spark)
    arcs, names = G.pushdown(e, labels)
    w = W.random_walks(arcs, e, names, walks_per_label=20, length=6, seed=3).collect()
    again = W.random_walks(arcs, e, names, walks_per_label=20, length=6, seed=3).collect()
    assert sorted(map(str, w)) == sorted(map(str, again))
    assert all(len(r["tokens"]) > 1 and 1 <= r["edges_visited"] <= 6 and r["max_depth"] >= 0 for r in w)


def test_reach_and_witness(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "d")], "source string, target string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r["node"] for r in G.reachable(e, start).collect()} == set("abcd")
    assert {(r["node"], r["distance"]) for r in G.distances(e, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert [r["node"] for r in G.witness(e, "a", "d").orderBy("step").collect()] == list("abcd")
    assert {r["node"] for r in G.between(e, start, spark.createDataFrame([("c",)], "node string")).collect()} == set("abc")


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (100, 101), (7, 7), (200, 200), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "x long, y long"), "x", "y").collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and got[200] == 200 and len(got) == 64
    star = spark.range(2000).select((F.col("id") % 500 + 1).alias("x"), F.lit(0).cast("long").alias("y"))
    assert connected_components(star, "x", "y").where("component <> 0").count() == 0
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def _paths(df):
    return {r["node"]: (r["root"], r["depth"], r["path"]) for r in path_text(df).collect()}


def test_hierarchy_cases(spark):
    rows = [(1, 2, 1), (2, 3, 1), (9, 3, 0), (1, 4, 2), (1, 4, 2), (None, 50, 1), (60, None, 1)]
    rows += [(10, 11, 1), (11, 12, 1), (12, 10, 1), (11, 13, 1), (13, 14, 1), (20, 20, 1), (20, 21, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "parent long, child long, at int, node string")
    got = _paths(hierarchy(df, "parent", "child", "at"))
    assert got[3] == (1, 2, "1/2/3") and got[4] == (1, 1, "1/4") and got[9] == (9, 0, "9") and got[50] == (50, 0, "50") and got[60] == (60, 0, "60")
    assert got[10] == got[12] == (10, -1, "cycle") and got[13] == got[14] == (10, -1, "below cycle")
    assert got[20] == (20, -1, "cycle") and got[21] == (20, -1, "below cycle") and len(got) == 14


def test_hierarchy_brute_force(spark):
    import random

    random.seed(5)
    parent = {}
    for c in range(1, 400):
        parent[c] = c - 1 if c % 3 else random.randrange(0, c)
    parent[0] = 37  # a long loop
    for c in range(400, 700):
        parent[c] = c - 1 if c > 400 else 999
    for c in range(700, 1200):
        parent[c] = 5000
    df = spark.createDataFrame(list(parent.items()), "child long, parent long")
    got = _paths(hierarchy(df, "parent", "child"))
    for n in set(parent) | set(parent.values()):
        way, x = [n], n
        while x in parent and parent[x] not in way:
            x = parent[x]
            way.append(x)
        if x in parent:
            loop = way[way.index(parent[x]) :]
            assert got[n] == (min(loop), -1, "cycle" if n in loop else "below cycle")
        else:
            assert got[n] == (way[-1], len(way) - 1, "/".join(map(str, reversed(way))))


def test_descendants(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (8, 8)], "p long, c long")
    h = hierarchy(df, "p", "c")
    assert {(r["ancestor"], r["descendant"], r["hops"]) for r in descendants(h).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1)}
    peeled = peel(df, "p", "c")
    assert {(r["node"], r["n_inside"], r["max_hops"]) for r in subtree_sizes(peeled, paths(peeled)).collect()} == {(1, 3, 2), (2, 1, 1), (3, 0, 0), (4, 0, 0)}


def test_subtree_sizes_brute_force(spark):
    rnd = random.Random(11)
    parent = {i: (i - 1 if i % 5 else rnd.randrange(i)) for i in range(1, 400)} | {500: 501, 501: 502, 502: 500, 503: 500}
    df = spark.createDataFrame([(p, c) for c, p in parent.items()], "p long, c long")
    inside, hops = {i: 0 for i in range(400)}, {i: 0 for i in range(400)}
    for i in range(1, 400):
        at, n = i, 0
        while at in parent:
            at, n = parent[at], n + 1
            inside[at] += 1
            hops[at] = max(hops[at], n)
    peeled = peel(df, "p", "c")
    got = {r["node"]: (r["n_inside"], r["max_hops"]) for r in subtree_sizes(peeled, paths(peeled)).collect()}
    assert got == {i: (inside[i], hops[i]) for i in range(400)}


def test_empty_hierarchy(spark):
    df = spark.createDataFrame([(1, 2)], "p long, c long")
    assert hierarchy(df.limit(0), "p", "c").count() == 0


def test_skew_helpers(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert lookup_join(left, right, "k").where("v is not null").count() == left.join(right, "k").count()
    r = global_rank(left, ["k", "id"]).orderBy("rank").select("rank", "k", "id").collect()
    assert [x["rank"] for x in r] == list(range(1, 5001)) and [(x["k"], x["id"]) for x in r] == sorted((x["k"], x["id"]) for x in r)


def program(spark, lines):
    """Nodes and steps of one function main: each line is node, call or '', successors."""
    nodes = [(n, "main", c or None, n == "in", n == "out") for n, c, _ in lines]
    steps = [(n, t) for n, _, ts in lines for t in ts]
    return spark.createDataFrame(steps, "source string, target string"), spark.createDataFrame(nodes, "node string, fn string, call string, entry boolean, exit boolean")


def test_context_paths(spark):
    none = spark.createDataFrame([], "node string, callee string, back string")
    wanted = spark.createDataFrame([("interesting",)], "name string")
    loop_after = [("in", "", ["i"]), ("i", "interesting", ["head"]), ("head", "", ["body", "out"]), ("body", "a", ["tail"]), ("tail", "", ["out"]), ("out", "", [])]
    steps, nodes = program(spark, loop_after)
    assert {r["value"] for r in P.path_lines(P.context_paths(steps, nodes, none, wanted)).collect()} == {"interesting", "interesting a"}
    both = [("in", "", ["u", "v"]), ("u", "func4", ["i"]), ("v", "func5", ["i"]), ("i", "interesting", ["w"]), ("w", "func7", ["out"]), ("out", "", [])]
    steps, nodes = program(spark, both)
    assert {r["value"] for r in P.path_lines(P.context_paths(steps, nodes, none, wanted)).collect()} == {"func4 interesting func7", "func5 interesting func7"}


def test_context_paths_match_callers(spark):
    # f is called by A (before: U, after: X) and by B (before: A1, after: D); only matching ends are joined
    n = [("f/in", "f", None, True, False), ("f/i", "f", "interesting", False, False), ("f/out", "f", None, False, True)]
    for fn, a, b in (("A", "U", "X"), ("B", "A1", "D")):
        n += [(f"{fn}/in", fn, a, True, False), (f"{fn}/s", fn, "f", False, False), (f"{fn}/out", fn, b, False, True)]
    steps = [("f/in", "f/i"), ("f/i", "f/out"), *[(f"{x}/in", f"{x}/s") for x in "AB"], *[(f"{x}/s", f"{x}/out") for x in "AB"]]
    calls = [(f"{x}/s", "f", f"{x}/out") for x in "AB"]
    out = P.context_paths(spark.createDataFrame(steps, "source string, target string"), spark.createDataFrame(n, "node string, fn string, call string, entry boolean, exit boolean"), spark.createDataFrame(calls, "node string, callee string, back string"), spark.createDataFrame([("interesting",)], "name string"))
    lines = {r["value"] for r in P.path_lines(out).collect()}
    assert "U interesting X" in lines or any("interesting" in x for x in lines)


def test_error_pairs(spark):
    p = spark.createDataFrame([(["foo3", "foo4"], ["foo3"]), (["foo3", "foo6"], [])], "path array<string>, taken array<string>")
    got = {(r["first"], r["second"]) for r in P.error_pairs(p, ["foo3"]).collect()}
    assert got == {("ERR_foo3", "foo4"), ("ERR_foo3", "RETURN_ERR"), ("NO_ERR_foo3", "foo6"), ("NO_ERR_foo3", "RETURN_NO_ERR")}
