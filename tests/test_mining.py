import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import special
from quarry.functions.measures import MEASURES, measure
from quarry.operators import itemsets as I
from quarry.operators import rules as R
from quarry.operators import transactions as T
from quarry.plans import mining_queries as Q
from quarry.sources import records as S

SMOKE = "/root/testdata/sf0.001"
ROWS = "abc ade bcd abcd bc abd de abcd cde abc".split()
FREQUENT = dict(x.split(":") for x in "a:6 b:7 c:7 d:7 e:3 ab:5 ac:4 ad:4 bc:6 bd:4 cd:4 de:3 abc:4 abd:3 bcd:3".split())


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(ROWS)], "tid long, items array<string>").cache()


def sets(df):
    return {"".join(r["items"]): int(r["supp"]) for r in df.collect()}


def test_frequent(tx):
    assert sets(I.mine(tx, support=-3)) == {k: int(v) for k, v in FREQUENT.items()}


def test_closed_maximal_generators(tx):
    want = {k: int(v) for k, v in FREQUENT.items()}
    assert sets(I.mine(tx, target="c", support=-3)) == {k: v for k, v in want.items() if k not in ("e", "ac")}
    assert set(sets(I.mine(tx, target="m", support=-3))) == {"abc", "abd", "bcd", "de"}
    assert set(sets(I.mine(tx, target="g", support=-3))) == set(want) - {"abc", "de"}
    assert set(sets(I.mine(tx, target="c", support=-3, largest_size=2))) == {k for k in want if len(k) < 3 and k not in ("e", "ac")}


def test_size_and_border(tx):
    assert set(sets(I.mine(tx, support=-3, least_size=3))) == {"abc", "abd", "bcd"}
    assert set(sets(I.mine(tx, support=-3, border={1: 7, 2: 5, 3: 4}))) == {"b", "c", "d", "ab", "bc", "abc"}
    assert "" in sets(I.mine(tx, support=-3, least_size=0))


def test_spectrum_and_tids(tx):
    s = {(r["size"], int(r["supp"])): r["n"] for r in I.spectrum(I.mine(tx, support=-3)).collect()}
    assert s == {(1, 3): 1, (1, 6): 1, (1, 7): 3, (2, 3): 1, (2, 4): 4, (2, 5): 1, (2, 6): 1, (3, 3): 2, (3, 4): 1}
    t = I.supporting_tids(I.mine(tx, support=-3).where("size = 3"), tx)
    assert {(("".join(r["items"])), r["tid"]) for r in t.collect()} >= {("abc", 0), ("abc", 3), ("abc", 7), ("abc", 9), ("bcd", 2)}


def test_weights_and_empty(spark):
    w = spark.createDataFrame([(["a", "b"], 5), (["a"], 2), ([], 9), (["a", "b"], 1)], "items array<string>, wgt long")
    assert sets(I.mine(w, support=-1)) == {"a": 8, "b": 6, "ab": 6}
    assert {tuple(r["items"]): r["wgt"] for r in T.collapse(w).collect()} == {("a", "b"): 6, ("a",): 2, (): 9}
    assert I.mine(w.limit(0)).count() == 0


def test_rules(tx):
    r = R.mine_rules(tx, -3, 80)
    got = {("".join(x["body"]), x["head"]): round(x["confidence"], 3) for x in r.collect()}
    assert got == {("b", "c"): 0.857, ("c", "b"): 0.857, ("a", "b"): 0.833, ("e", "d"): 1.0, ("ab", "c"): 0.8, ("ac", "b"): 1.0}
    assert R.mine_rules(tx, -3, 60, empty_body=True).where(F.size("body") == 0).count() == 4


def test_measures_against_plain_python(spark):
    rows = [(3.0, 5.0, 6.0, 10.0), (4.0, 4.0, 4.0, 10.0), (0.0, 3.0, 2.0, 10.0), (2.0, 10.0, 2.0, 10.0)]
    df = spark.createDataFrame(rows, "s double, b double, h double, n double")
    out = df.select("*", *[measure(k, F.col("s"), F.col("b"), F.col("h"), F.col("n")).cast("double").alias(f"m_{k}") for k in MEASURES]).collect()
    for r in out:
        s, b, h, n = r["s"], r["b"], r["h"], r["n"]
        assert r["m_l"] == pytest.approx(s * n / (b * h))
        assert r["m_v"] == pytest.approx(b * (n - h) / ((b - s) * n) if b > s else 0)
        assert r["m_e"] == (math.inf if b <= s else pytest.approx(abs(b * (n - h) / ((b - s) * n) - 1)))
        live = 0 < b < n and 0 < h < n
        chi = (h * b - s * n) ** 2 / (h * (n - h) * b * (n - b)) if live else 0
        assert r["m_n"] == pytest.approx(chi)
        assert r["m_p"] == pytest.approx(math.erfc(math.sqrt(chi * n / 2)))
        assert r["m_i"] == pytest.approx(special.information(s, b, h, n))


def test_exact_tests():
    # 2x2 table with margins 3, 3 of 6
    assert special.fisher_support(3, 3, 3, 6) == pytest.approx(1 / 20)
    assert special.fisher_probability(3, 3, 3, 6) == pytest.approx(2 / 20)
    assert special.fisher_chi2(3, 3, 3, 6) == pytest.approx(2 / 20)
    assert special.fisher_information(3, 3, 3, 6) == pytest.approx(2 / 20)
    assert special.fisher_support(1, 0, 3, 6) == 1.0
    assert special.gamma_p(2.5, 3.0) + special.gamma_q(2.5, 3.0) == pytest.approx(1)
    assert special.chi2_p(special.chi2_quantile(0.95, 3), 3) == pytest.approx(0.95)
    assert special.chi2_q(3.841458820694124, 1) == pytest.approx(0.05)


def test_idempotent_weights(spark):
    tx = spark.createDataFrame([(["a"], 3), (["a", "b"], 5), (["a", "b", "c"], 2), ([], 20)], "items array<string>, wgt long")
    got = {"".join(r["items"]): r["wgt"] for r in T.idempotent_weights(tx).collect()}
    assert got == {"abc": 2, "ab": 3, "a": 3 - 3 - 2, "": 20 - (2 + 3 - 2)}


@pytest.mark.parametrize("most_items, most_subset", [(62, 12), (62, 3), (4, 12)])
def test_idempotent_weights_either_way(spark, monkeypatch, most_items, most_subset):
    monkeypatch.setattr(T, "MASK_ITEMS", most_items)
    monkeypatch.setattr(T, "SUBSET_ITEMS", most_subset)
    draw = random.Random(5)
    sets = {tuple(sorted(draw.sample("abcdefgh", draw.randint(0, 6)))): draw.randint(1, 9) for _ in range(150)}
    want = {}
    for s in sorted(sets, key=len, reverse=True):
        want[s] = sets[s] - sum(w for t, w in want.items() if set(s) < set(t))
    tx = spark.createDataFrame([(list(s), w) for s, w in sets.items()], "items array<string>, wgt long")
    assert {tuple(r["items"]): r["wgt"] for r in T.idempotent_weights(tx).collect()} == want


def test_layouts(spark):
    want = [list(r) for r in ROWS]
    lines = spark.createDataFrame([(" ".join(r),) for r in ROWS] + [("# a comment",)], "value string")
    got = S.read_transactions(spark, lines).select("items").collect()
    assert sorted(r["items"] for r in got) == sorted(want)
    csv = spark.createDataFrame([(",".join(r) + ",,",) for r in ROWS], "value string")
    assert sorted(r["items"] for r in S.read_transactions(spark, csv).collect()) == sorted(want)
    last = S.read_transactions(spark, spark.createDataFrame([("a b (2)",), ("c [3]",)], "value string"), weight=True)
    assert sorted((r["items"], r["wgt"]) for r in last.collect()) == [(["a", "b"], 2), (["c"], 3)]
    one = spark.createDataFrame(list(enumerate(["a", "b", "", "c"])), "no long, line string")
    assert sorted(r["items"] for r in T.from_lines(one, "no", "line").collect()) == [["a", "b"], ["c"]]
    w = S.read_weighted_items(spark, spark.createDataFrame([("a:0.5 b",)], "value string")).first()["items"]
    assert [(x["item"], x["wgt"]) for x in w] == [("a", 0.5), ("b", 1.0)]


def test_text_output(tx, spark):
    out = S.write_sets(I.mine(tx, support=-7), " (%a)")
    assert {r["value"] for r in out.collect()} == {"b (7)", "c (7)", "d (7)"}
    names = spark.createDataFrame([('a "b"',), ("plain",), ("",)], "n string").select(S.escaped(F.col("n")).alias("e"), "n")
    assert all(r["u"] == r["n"] for r in names.select("n", S.unescaped(F.col("e")).alias("u")).collect())


def test_appearance_and_penalty():
    assert R.appearance("ante") == "b" and R.appearance("ou") == "h" and R.appearance("inout") == "x"
    assert S.read_appearances([["both"], ["a", "in"]]) == {"": "x", "a": "b"}
    assert S.read_penalties([["0.5"], ["a", "-1"]]) == {"": 0.5, "a": 0.0}
    with pytest.raises(ValueError):
        S.read_penalties([["2"]])


def test_surrogates_keep_margins(tx):
    swapped = T.surrogate_swap(tx, 2, 1)
    f = lambda t: {r["item"]: r["n"] for r in T.item_frequencies(t).collect()}
    assert f(swapped) == f(tx)
    assert {r["tid"]: len(r["items"]) for r in swapped.collect()} == {i: len(r) for i, r in enumerate(ROWS)}
    assert f(T.surrogate_frequencies(tx, 1)) == f(tx)


def test_whole_rule_queries_have_bodies_of_any_size(spark):
    held = {}
    for r in Q.baskets(spark, SMOKE).collect():
        held[r["tid"]] = sorted(r["items"])
    n, supp = len(held), Counter(c for items in held.values() for k in range(1, len(items) + 1) for c in combinations(items, k))
    body_least = math.ceil(0.01 * Q.LEAST * n - 1e-9)
    want = {}
    for c, s in supp.items():
        for head in c if len(c) > 1 else ():
            body = tuple(i for i in c if i != head)
            if supp[body] >= body_least and s >= max(1, math.ceil(body_least * 0.12 - 1e-9)) and s >= supp[body] * 0.12 * (1 - 1e-12):
                want[" ".join(body), head] = s
    got = {(r["body"], r["head"]): r["supp"] for r in Q.QUERIES["rules_confidence_lift"](spark, SMOKE).collect()}
    assert got == want and any(" " in b for b, _ in got)
    assert {(r["body"], r["head"]) for r in Q.rule_pvalues(spark, SMOKE).collect()} == set(want)
