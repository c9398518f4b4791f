import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import special
from quarry.operators import embedding as E
from quarry.operators import itemsets as I
from quarry.operators import pairs, settings
from quarry.operators import paths as P
from quarry.operators import specs as S
from quarry.operators import transactions as T


def test_pair_sums_of_long_baskets():
    rnd = random.Random(5)
    baskets = {b: sorted(rnd.sample(range(40), rnd.choice([0, 1, 2, 9, 30]))) for b in range(200)}
    want = Counter()
    rows = []
    for b, codes in baskets.items():
        want.update({p: b % 3 + 1 for p in combinations(codes, 2)})
        for s in range(-(-len(codes) // 4)):
            rows += [(b, s, c, float(b % 3 + 1)) for c in codes]
    columns = list(zip(*rows))
    t = pa.table({"basket": columns[0], "slice": pa.array(columns[1], pa.int32()), "code": columns[2], "wgt": columns[3]})
    got = Counter()
    for out in pairs.pair_sums(40, long=4, most=50)(iter(t.to_batches(max_chunksize=37))):
        for a, b, n in zip(*(out.column(i).to_pylist() for i in range(3))):
            got[a, b] += n
    assert got == want
    assert list(pairs.pair_sums(40)(iter([]))) == []


def test_mining_with_more_candidates_than_one_pass(spark, monkeypatch):
    monkeypatch.setattr(I, "CANDIDATES_AT_ONCE", 3)
    rnd = random.Random(2)
    held = [sorted({f"i{int(rnd.paretovariate(1)) % 9}" for _ in range(rnd.randrange(0, 7))}) for _ in range(150)]
    tx = spark.createDataFrame([(i, h) for i, h in enumerate(held)], "tid long, items array<string>")
    want = Counter(c for h in held for k in range(1, len(h) + 1) for c in combinations(h, k))
    got = {tuple(r["items"]): r["supp"] for r in I.frequent(tx, 4).collect()}
    assert got == {k: n for k, n in want.items() if n >= 4} and max(map(len, got)) > 2
    assert I.frequent(tx.limit(0), 1).count() == 0
    tids = {(tuple(r["items"]), r["tid"]) for r in I.supporting_tids(I.frequent(tx, 4), tx).collect()}
    assert tids == {(s, i) for s in got for i, h in enumerate(held) if set(s) <= set(h)}


def test_branch_safety(spark):
    rows = [("eq", 0, False), ("eq", -5, True), ("ne", 0, False), ("ne", -5, True), ("slt", -5, True), ("sge", 0, False), ("slt", -7, False), ("ult", 0, False), ("eq", None, None)]
    df = spark.createDataFrame(rows, "p string, c int, code boolean")
    at = lambda **k: [tuple(r["s"]) for r in df.select(P.branch_safety(F.col("p"), F.col("c"), F.col("code"), **k).alias("s")).collect()]
    same = [("T", "F"), ("N", "T"), ("F", "T"), ("N", "N")]
    rest = [("N", "N")] * 3
    assert at() == [*same, ("F", "T"), ("T", "F"), *rest]
    assert at(right_constant=F.lit(False)) == at(positive=True) == [*same, ("T", "F"), ("F", "T"), *rest]


def test_merging_links_produced_rules_only(spark):
    rules = S.with_id(spark.createDataFrame([(["a"], ["p"]), (["a"], ["q"]), (["b"], ["r"])], "context array<string>, response array<string>"))
    similar = spark.createDataFrame([("p", "q", 0.9), ("q", "p", 0.9)], "x string, y string, sim double")
    groups = {}
    for r in S.merge_rules(rules, similar, 0.6).collect():
        groups.setdefault(r["group_id"], set()).add(r["rule_id"])
    assert groups == {"a -> p": {"a -> p", "a -> q"}}
    shared = S.with_id(spark.createDataFrame([(["a", "x"], ["p"]), (["a", "y"], ["q"])], "context array<string>, response array<string>"))
    merged = {r["rule_id"] for r in S.merge_rules(shared, similar, 0.6).collect()}
    assert merged == {"a -> p", "a -> q"}  # not the rules they came from
    assert S.merge_rules(rules, similar.limit(0), 0.6).count() == 0


def test_counted_application(spark):
    rules = S.with_id(spark.createDataFrame([(["a"], ["p"]), (["a"], ["a"]), (["z"], ["p"])], "context array<string>, response array<string>"))
    h = spark.createDataFrame([("f:1", ["a"], []), ("f:2", ["a", "p"], ["p"])], "loc string, context array<string>, response array<string>")
    assert {tuple(r) for r in S.applies_counted(rules, h).collect()} == {("a -> p", "f:1"), ("a -> a", "f:1"), ("a -> a", "f:2")}


def test_locations_and_settings(spark):
    df = spark.createDataFrame([("b.c:9",), ("b.c:10",), ("a.c:100",), ("x",), (None,)], "l string")
    got = [tuple(r["at"]) for r in df.select(P.location(F.col("l")).alias("at")).where("at is not null").orderBy("at").collect()]
    assert got == [("a.c", 100), ("b.c", 9), ("b.c", 10), ("x", 0)]
    grid = settings.grid(a=[1, 2], b=["x"], c=["1.5", "2.0"])
    assert len(grid) == 4 and grid[1] == {"a": 1, "b": "x", "c": "2.0"}
    name = spark.range(1).select(settings.run_name({"bias": F.lit("1.5"), "length": F.lit(100)}, ("bias",)).alias("n")).first()["n"]
    assert name == "bias1-5_length100"


def test_exact_tests_of_large_margins():
    rnd = random.Random(1)
    import math

    for _ in range(30):
        n = rnd.randrange(8, 60)
        b, h = rnd.randrange(1, n), rnd.randrange(1, n)
        low, high = max(0, b + h - n), min(b, h)
        s = rnd.randrange(low, high + 1)
        p = {k: math.comb(b, k) * math.comb(n - b, h - k) / math.comb(n, h) for k in range(low, high + 1)}
        assert special.fisher_support(s, b, h, n) == pytest.approx(sum(v for k, v in p.items() if k >= s))
        assert special.fisher_probability(s, b, h, n) == pytest.approx(sum(v for v in p.values() if v <= p[s] * (1 + 1e-8)))
        assert special.fisher_chi2(s, b, h, n) == pytest.approx(sum(v for k, v in p.items() if abs(k - b * h / n) >= abs(s - b * h / n) - 1e-9))
    assert 0.4 < special.fisher_support(10**8 // 4, 10**8, 10**9 // 4, 10**9) < 0.6


def test_surrogates_keep_frequencies_and_move_items(spark):
    rnd = random.Random(3)
    held = [sorted({f"i{int(rnd.paretovariate(0.8)) % 12}" for _ in range(rnd.randrange(1, 8))}) for _ in range(120)]
    tx = spark.createDataFrame([(i, h) for i, h in enumerate(held)], "tid long, items array<string>")
    out = {r["tid"]: r["items"] for r in T.surrogate_frequencies(tx, 4).collect()}
    assert Counter(i for h in out.values() for i in h) == Counter(i for h in held for i in h)
    assert all(out.get(i) != h for i, h in enumerate(held[:3])) or out[5] != held[5]
    assert all(len(set(h)) == len(h) for h in out.values())


def test_blocks_cover_all_rows(spark, monkeypatch):
    monkeypatch.setattr(E, "MOST_ASKED", 10)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    v = spark.createDataFrame([(f"w{i:02d}", [float(a) for a in r]) for i, r in enumerate(x)], "word string, vector array<double>")
    got = {(r["word"], r["rank"]): r["other"] for r in E.most_similar(v, v, 3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert got == {(f"w{i:02d}", k + 1): f"w{j:02d}" for i in range(60) for k, j in enumerate(np.argsort(-s[i])[:3])}


def test_nesting_and_inner_edges(spark):
    edges = spark.createDataFrame([("a", "b", ""), ("a", "c", "call"), ("b", "d", "may_ret"), ("b", "e", "")], "source string, target string, label string")
    stacks = spark.createDataFrame([("a", "s"), ("b", "s"), ("e", "t")], "node string, stack string")
    follow = lambda **k: {(r["source"], r["target"]) for r in P.inner_edges(edges, stacks, **k).collect()}
    assert follow() == {("a", "b"), ("b", "e")}
    assert follow(stop=stacks.where("stack = 't'")) == {("a", "b")}
    assert follow(seen=stacks.where("node = 'b'").select("node")) == {("b", "e")}
    visited = spark.createDataFrame([("s", "b"), ("s", "e")], "stack string, node string")
    assert [tuple(r) for r in P.nesting_pairs(visited, stacks, stacks).collect()] == [("s", "t")]
