from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import embedding as E
from quarry.operators import evaluate as V
from quarry.operators import gold as G
from quarry.operators import specs as S
from quarry.plans import spec_queries as Q
from quarry.plans import vector_queries as W
from quarry.sources import domain as D

SMALL = "/root/testdata/sf0.01"


def test_names_and_groups(spark):
    f = spark.createDataFrame([("ext4_free_block", "fs/a.c"), ("xfs_free_block", "fs/b.c"), ("__foo", "x/a.c"), ("foo", "x/a.c"), ("_bar", "y"), ("bar", "y"), ("a_b", "z")], "name string, path string")
    s = {(r["name"], r["prefix"], r["suffix"]) for r in G.exploded_splits(f).collect()}
    assert ("ext4_free_block", "ext4", "free_block") in s and ("ext4_free_block", "ext4_free", "block") in s and not any(x[0] == "a_b" for x in s)
    assert {(r["name"], r["wrapper"]) for r in G.underscore_pairs(f, True, True).collect()} == {("foo", "__foo"), ("bar", "_bar")}
    one = f.where("name like '%free%'").select(G.split_at_keyword(F.col("name"), "free").alias("s")).first()["s"]
    assert (one["prefix"], one["suffix"]) == ("ext4_free", "block")
    assert G.gold_names(f, G.exploded_splits(f).select("prefix", "path").distinct(), None, 2).count() >= 2


def relations(spark):
    lines = ["# note", "", "T {a b} {c}", "T {c}{d}", "F {x}{a}", "T {q r}", "F {b}{d}"]
    return D.read_relations(spark, spark.createDataFrame([(x,) for x in lines], "value string"))


def test_classes_and_contradictions(spark):
    r = relations(spark)
    assert {(x["name"], x["class_id"]) for x in G.equivalence_classes(r).collect()} == {*[(n, "a") for n in "abcd"], ("q", "q"), ("r", "q")}
    assert {(x["a"], x["b"]) for x in G.contradictions(r).collect()} == {("b", "d")}
    assert [x["node"] for x in G.contradiction_path(r, "b", "d").orderBy("step").collect()] == ["b", "a", "c", "d"]
    assert {(x["a"], x["b"]) for x in G.unrelated_pairs(r.where("must or a[0] = 'x'")).collect()} == {(n, "x") for n in "abcd"}
    with pytest.raises(Exception, match="malformed"):
        D.read_relations(spark, spark.createDataFrame([("T a b",)], "value string")).collect()
    c = G.equivalence_classes(r)
    assert G.related_pair_count(c).first()["n"] == 7 and G.related_pairs(c).count() == 7
    s = G.sampled_unrelated_pairs(c, 5, 1).collect()
    assert len({(x["a"], x["b"]) for x in s}) == len(s) > 0


def test_scores(spark):
    classes = spark.createDataFrame([(n, k) for k, v in {1: "abc", 2: "de"}.items() for n in v], "name string, class_id int")
    clusters = spark.createDataFrame([(n, k) for k, v in {1: "ab", 2: "cde"}.items() for n in v], "name string, cluster_id int")
    s = V.weighted_scores(classes, clusters).first()
    assert s["f_score"] == pytest.approx(0.8)
    assert V.purity(classes, clusters).first()["purity"] == pytest.approx(0.8)
    rep = {r["class_id"]: (r["cluster_id"], r["missing"], r["extra"]) for r in V.purity_report(classes, clusters).collect()}
    assert rep == {1: (1, ["c"], []), 2: (2, [], ["c"])}
    flags = spark.createDataFrame([(i, bool(f)) for i, f in enumerate([1, 0, 1, 0])], "pos int, hit boolean")
    assert V.average_precision(flags, "pos", "hit").first()["ap"] == pytest.approx((1 + 2 / 3) / 4)
    pairs = flags.withColumn("score", -F.col("pos"))
    auc = V.roc_auc(pairs, "score", "hit", ["pos"]).first()
    assert auc["auc"] == pytest.approx(0.75) and auc["auc_compat"] == pytest.approx(0.5 * (0.5 + 1 - 0.5))


def test_rule_merging(spark):
    sim = [("B", "D"), ("D", "B"), ("C", "E"), ("E", "C")]
    similar = spark.createDataFrame([(x, y, 0.9) for x, y in sim] + [("B", "C", 0.4), ("C", "B", 0.4)], "x string, y string, sim double")
    sets = spark.createDataFrame([("p", list("ABC"), list("ADE"))], "pair_id string, left array<string>, right array<string>")
    got = {"".join(r["names"]) for r in S.synonym_sets(sets, similar, 0.8).collect()}
    assert got == {"A", "AB", "AD", "AC", "AE"}
    rule = lambda *rs: S.with_id(spark.createDataFrame([(list(c), list(r)) for c, r in rs], "context array<string>, response array<string>"))
    assert S.merge_rules(rule("AB", "AC"), similar, 0.8).count() == 0
    one = S.merge_rules(rule("AB", "AD"), similar, 0.8)
    assert {r["rule_id"] for r in one.collect()} == {"A -> B", "A -> D"} and one.select("group_id").distinct().count() == 1
    four = S.merge_rules(rule("BC", "DE"), similar, 0.8)
    assert {r["rule_id"] for r in four.collect()} == {"B -> C", "D -> E", "B -> E", "D -> C"} and four.select("group_id").distinct().count() == 1


def test_specs(spark):
    h = spark.createDataFrame([(1, "m/ext4/a.c:1", ["p", "q"], ["r"]), (2, "m/ext4/a.c:2", ["p"], []), (3, "m/xfs/b.c:3", ["p"], ["r", "s"]), (4, "m/xfs/c.c:4", ["p"], ["z"])], "id long, loc string, context array<string>, response array<string>").withColumn("fn", F.lit("f"))
    rules = S.with_id(spark.createDataFrame([(["p"], ["r"])], "context array<string>, response array<string>"))
    assert {(r["loc"][-1], r["violation"]) for r in S.results(rules, h).collect()} == {("1", 0), ("2", 1), ("3", 0), ("4", 1)}
    c = S.confidences(rules.withColumn("group_id", F.col("rule_id")), h).first()
    assert (c["support"], c["applicable"], c["global_confidence"]) == (2, 4, 0.5) and c["local_confidence"] == pytest.approx(2 / 3)
    assert S.cross_implementation(rules.withColumn("group_id", F.col("rule_id")), h).first()["crosses"]
    assert {tuple(r["missing"]) for r in S.missing_items(rules, h).collect()} == {("r",)}
    assert S.drop_listed(rules, ["p"]).count() == 0 and S.drop_listed(rules, ["q"]).count() == 1
    k = spark.createDataFrame([("p", "k1"), ("q", "k1")], "name string, class_id string")
    assert {tuple(r["context"]) for r in S.replace_names(h, k).collect()} == {("CLASS_0",)}
    back = D.read_specs(D.spec_tables(rules.withColumn("support", F.lit(2)).withColumn("confidence", F.lit(0.5)))).first()
    assert (back["context"], back["response"], back["support"]) == (["p"], ["r"], 2)


def test_whole_spec_queries_keep_rules_of_any_size(spark):
    least, held = Q._least(spark, SMALL), [frozenset(r["items"]) for r in S.sentences(Q.handlers(spark, SMALL)).collect()]
    where = {}
    for i, t in enumerate(held):
        for x in t:
            where.setdefault(x, set()).add(i)
    closed, todo = {}, [((), set(range(len(held))), sorted(x for x in where if len(where[x]) >= least))]
    while todo:
        _, ids, rest = todo.pop()
        for k, x in enumerate(rest):
            both = ids & where[x]
            if len(both) >= least:
                closed[frozenset.intersection(*[held[i] for i in both])] = len(both)
                todo.append(((), both, rest[k + 1 :]))
    want = sorted(n for c, n in closed.items() if len({x.split("|")[0] for x in c}) == 2)
    got = Q.QUERIES["mined_rules"](spark, SMALL).collect()
    assert sorted(r["mined"] for r in got) == want


def test_whole_similarities(spark):
    v = W.vectors(spark, SMALL).orderBy("word").collect()
    x = np.array([r["vector"] for r in v], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    off = s[~np.eye(len(x), dtype=bool)]
    got = W.similarity_histogram(spark, SMALL).collect()
    want = Counter(np.round(np.floor(np.round(off, 9) / 0.05) * 0.05, 2).tolist())
    assert {r["bin"]: r["n"] for r in got} == want and sum(r["n"] for r in got) == len(x) * (len(x) - 1)
    asked = [i for i, r in enumerate(v) if int(r["word"][1:]) % 50 == 0]
    top = {(r["word"], r["rank"]): r["similarity"] for r in W.most_similar_words(spark, SMALL).collect()}
    assert len(top) == 10 * len(asked)
    for i in asked:
        best = np.sort(np.delete(s[i], i))[::-1][:10]
        assert [top[v[i]["word"], k + 1] for k in range(10)] == pytest.approx(list(best), abs=2e-6)


def test_readers(spark):
    text = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert [r["tokens"] for r in D.read_walks(spark, text("a F2V_x b"), ["F2V_"]).collect()] == [["a", "b"]]
    v = D.read_vectors(spark, text("2 3", "w 1 2 3", "u 0 0.5 1")).collect()
    assert {r["word"]: r["vector"] for r in v} == {"w": [1, 2, 3], "u": [0, 0.5, 1]}
    assert {(r["name"], r["label"]) for r in D.read_class_labels(spark, text("f x", "g y", "f z").coalesce(1)).collect()} == {("f", "x"), ("g", "y")}
    h = D.read_hints(spark, text("a/b.c:12 branch", "bad")).first()
    assert (h["file"], h["line"], h["how"]) == ("a/b.c", 12, "branch")
    assert D.read_error_codes(spark, text("EIO 5")).first() == ("TENTATIVE_EIO", 5)
    j = D.read_judgements(spark, text("T a b", "F a b").coalesce(1)).first()
    assert j["judgement"] == "F"
    assert D.has_table(spark, "no_such_table") is False


def test_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.99, 0.05]), ("c", [0.97, 0.1]), ("d", [-1.0, 0.1]), ("z", [0.0, 0.0])]
    v = spark.createDataFrame(rows, "word string, vector array<float>")
    top = E.most_similar(v.where("word <> 'z'"), v.where("word = 'a'"), 2).orderBy("rank").collect()
    assert [r["other"] for r in top] == ["b", "c"]
    got = {r["word"]: r["cluster_id"] for r in E.dbscan(v, 0.2, 2).collect()}
    assert got["a"] == got["b"] == got["c"] == "a" and got["d"] == ""
    q = spark.createDataFrame([("a", "b", "d", "c")], "a string, b string, c string, d string")
    assert E.analogies(v.where("word <> 'z'"), q).count() == 1


def test_synonyms_of_rule_names_only(spark, tmp_path):
    from quarry.plans.spec_queries import similar

    names = ["a_free", "b_free", "c_put", "x_free"]
    spark.createDataFrame([(n,) for n in [*names, *(f"n{i}_free" for i in range(3000))]], "label string").write.parquet(str(tmp_path / "pathbased_model.parquet"))
    rules = S.with_id(spark.createDataFrame([(["a_free"], ["b_free", "c_put"]), (["unknown_free"], ["a_free"])], "context array<string>, response array<string>"))
    got = sorted(map(tuple, similar(spark, str(tmp_path), rules).collect()))
    assert got == [("a_free", "b_free", 0.9), ("b_free", "a_free", 0.9)]  # not the 9 million pairs of all labels


def test_unrelated_pairs_move_no_pairs(spark):
    rows = [(True, [f"{c}0"], [f"{c}{i}" for i in range(700)]) for c in "abc"] + [(False, ["a1"], ["b2"]), (False, ["b3"], ["a4"]), (False, ["c1"], ["c2", "z"])]
    r = spark.createDataFrame([(*x, "p") for x in rows], "must boolean, a array<string>, b array<string>, prov string")
    pairs = G.unrelated_pairs(r)
    assert "HashAggregate" not in pairs._jdf.queryExecution().executedPlan().toString()  # distinct shuffled each pair
    got = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a", "b").alias("d"), F.count_if(F.col("a") >= F.col("b")).alias("bad")).first()
    assert got["n"] == got["d"] == 700 * 700 + 700 * 699 // 2 + 700 and got["bad"] == 0


def test_unrelated_pairs_send_the_smaller_class(spark):
    large, small = [f"big{i:04}_of_a_large_class" for i in range(5000)], [f"n{i:03}" for i in range(400)]
    must = [(True, large[:1], large), (True, small[2:3], small[2:5])]
    # "a..." is before, "z..." behind the large class: either side of a pair may be the larger one
    apart = [(False, [large[7]], [*small, *(f"{c}{i:03}" for c in "az" for i in range(200))]), (False, [small[2]], [small[3], "a000"])]
    r = spark.createDataFrame([(*x, "p") for x in must + apart], "must boolean, a array<string>, b array<string>, prov string")
    sc, old = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def sent():
        sc.listenerBus().waitUntilEmpty()
        executors = sc.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = G.unrelated_pairs(r)
        before = sent()
        got = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") >= F.col("b")).alias("bad")).first()
        assert got["n"] == 5000 * 800 + 3 + 3 and got["bad"] == 0  # and the class of three with itself and with "a000"
        assert sent() - before < 2_000_000  # not the large class to each of its 798 partners
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_confusion_by_classes(spark):
    rows = [(True, ["a"], ["a", "b", "c", "d"]), (True, ["e"], ["e", "f", "g"]), (True, ["s"], ["t"]), (False, ["a"], ["e"]), (False, ["f"], ["b"]), (False, ["s"], ["t"]), (False, ["c"], ["d"]), (False, ["x"], ["y"]), (False, ["u"], ["a"])]
    r = spark.createDataFrame([(*x, "p") for x in rows], "must boolean, a array<string>, b array<string>, prov string")
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("e", 1), ("f", 2), ("u", 3)], "name string, cluster_id int")
    must = G.must_edges(r).select("a", "b").where("a <> b").distinct()
    counted = V.confusion_by_classes(must, *G.unrelated_classes(r), clusters)
    assert counted.collect() == V.confusion(must, G.unrelated_pairs(r), clusters).collect()
    none = r.where("must")
    assert V.confusion_by_classes(must, *G.unrelated_classes(none), clusters).collect() == V.confusion(must, G.unrelated_pairs(none), clusters).collect()
