"""Frequent, closed, maximal and generator itemsets.

Mining is level-wise.  Pairs are added up as they occur, so their number is
bounded by the data and not by the square of the items.  From three items on
each task turns blocks of transactions into item columns, forms the
intersection of a prefix once and multiplies the weights with the columns of
all its extensions.  Only supports are shuffled, whatever the number of
transactions; levels and candidates stay in the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.pairs import pair_sums
from quarry.operators.skew import global_rank, lookup_join
from quarry.operators.transactions import collapse, item_frequencies
from quarry.session import cut

CANDIDATES_AT_ONCE = 500_000
BLOCK, CELLS = 8192, 64_000_000
SET_SCHEMA = "items array<string>, size int, supp double"


def absolute_support(s: float, total: float) -> float:
    """``s`` percent of the total weight, or an absolute support if negative."""
    return math.ceil(0.01 * s * total * (1 - 1e-12)) if s >= 0 else -s


def rule_supports(s: float, confidence: float, total: float, rule_support: bool = False) -> tuple[float, float]:
    """(least support of a set, least support of a body) for rules of a confidence in percent."""
    body = math.ceil(absolute_support(s, total))
    least = body if rule_support else math.ceil(body * confidence / 100 * (1 - 1e-12))
    return max(1, least), body


def _pairs(coded: DataFrame, n_codes: int) -> DataFrame:
    """(codes, supp) of the pairs of codes that stand together."""
    run = pair_sums(max(n_codes, 1))
    rows = coded.withColumn("basket", F.monotonically_increasing_id()).select("basket", F.explode("codes").alias("code"), "wgt")
    rows = rows.select("basket", F.lit(0).alias("slice"), F.col("code").cast("bigint").alias("code"), "wgt")  # the rows of a list stay together and in order
    sums = rows.mapInArrow(run, "code_a bigint, code_b bigint, total double").groupBy("code_a", "code_b").agg(F.sum("total").alias("supp"))
    return sums.select(F.array(F.col("code_a").cast("int"), F.col("code_b").cast("int")).alias("codes"), "supp")


def _candidates(level: DataFrame, size: int) -> DataFrame:
    """(codes): sets of ``size`` codes whose subsets are all in ``level``, the sets one smaller."""
    prefix = lambda n: level.select(F.slice("codes", 1, size - 2).alias("p"), F.get("codes", F.lit(size - 2)).alias(n))
    joined = prefix("a").join(prefix("b"), "p").where("a < b").select(F.concat("p", F.array("a", "b")).alias("codes"))
    part = F.transform(F.sequence(F.lit(1), F.lit(size - 2)), lambda j: F.filter("codes", lambda x, i: i + 1 != j))
    parts = joined.select("codes", F.explode(part).alias("part"))
    known = level.select(F.col("codes").alias("part"))
    return parts.join(known, "part", "left_semi").groupBy("codes").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size - 2).select("codes")


def frequent(tx: DataFrame, least: float, largest: int = 0, items: list[str] | None = None, collapsed: bool = False) -> DataFrame:
    """(items, size, supp) of all sets of at least one item with summed weight ``least`` or more.

    ``largest`` bounds the size (0: none), ``items`` selects items.  Weights
    come from ``wgt`` (1 if absent); equal transactions are collapsed first
    unless they are ``collapsed`` and cut already.  Empty transactions hold no
    set; an empty table has none.  Neither items nor candidates nor results
    pass through the driver, but for ``CANDIDATES_AT_ONCE`` candidates at a time.
    """
    base = tx if collapsed else cut(collapse(tx))
    freq = item_frequencies(base).where(F.col("frq") >= least)
    if items is not None:
        freq = freq.where(F.col("item").isin(list(items)))
    first = cut(global_rank(freq.select("item", F.col("frq").cast("double").alias("frq")), ["frq", "item"]).select("item", (F.col("rank") - 1).cast("int").alias("code"), "frq"))
    n_codes = first.count()
    levels = [first.select(F.array("code").alias("codes"), F.col("frq").alias("supp"))]
    if n_codes > 1 and largest != 1:
        rows = cut(base.withColumn("_t", F.monotonically_increasing_id()).select("_t", F.col("wgt").cast("double").alias("wgt"), F.explode("items").alias("item")))
        rows = lookup_join(rows, first.select("item", "code"), "item").where("code is not null")
        lists = rows.groupBy("_t").agg(F.first("wgt").alias("wgt"), F.array_sort(F.collect_list("code")).alias("codes")).where(F.size("codes") > 1)
        coded = cut(lists.groupBy("codes").agg(F.sum("wgt").alias("wgt")))
        level, size = cut(_pairs(coded, n_codes).where(F.col("supp") >= least)), 2
        while not level.isEmpty():
            levels.append(level)
            if largest and size >= largest:
                break
            size += 1
            level = _count(coded, cut(_candidates(level, size)), least)
            if level is None:
                break
    sets = levels[0]
    for x in levels[1:]:
        sets = sets.unionByName(x)
    named = sets.select("codes", "supp", F.explode("codes").alias("code")).join(first.select("code", "item"), "code")
    named = named.groupBy("codes").agg(F.first("supp").alias("supp"), F.array_sort(F.collect_list("item")).alias("items"))
    return cut(named.select("items", F.size("items").alias("size"), "supp"))


def _count(coded: DataFrame, cand: DataFrame, least: float) -> DataFrame | None:
    """(codes, supp) of the candidates that reach ``least``, one pass for each ``CANDIDATES_AT_ONCE`` of them."""
    n = cand.count()
    if not n:
        return None
    chunks = -(-n // CANDIDATES_AT_ONCE)
    found = None
    for k in range(chunks):
        some = sorted(tuple(r[0]) for r in cand.where(F.pmod(F.xxhash64("codes"), F.lit(chunks)) == k).select("codes").collect())
        if not some:
            continue
        got = cut(_count_some(coded, some).where(F.col("supp") >= least))
        found = got if found is None else found.unionByName(got)
    return found


def _count_some(coded: DataFrame, cand: list[tuple[int, ...]]) -> DataFrame:
    """(codes, supp) of sorted candidates by intersecting columns of blocks of transactions."""
    groups = []
    at = 0
    for prefix, some in groupby(cand, key=lambda c: c[:-1]):
        ends = [c[-1] for c in some]
        groups.append((list(prefix), np.array(ends), at))
        at += len(ends)
    shared = coded.sparkSession.sparkContext.broadcast((groups, cand))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, cand = shared.value
        total = np.zeros(len(cand))
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                lists, w = whole.column(0).slice(k, BLOCK), whole.column(1).slice(k, BLOCK).to_numpy()
                codes, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                step = max(1, CELLS // max(len(codes), 1))
                for lo in range(0, len(lists), step):  # a bounded matrix of the block's own codes; the last row is empty
                    inside = (owner >= lo) & (owner < lo + step)
                    n = min(step, len(lists) - lo)
                    m = np.zeros((len(codes) + 1, n), bool)
                    m[place[inside], owner[inside] - lo] = True
                    row = {int(c): i for i, c in enumerate(codes)}
                    for prefix, ends, start in groups:
                        if any(c not in row for c in prefix):
                            continue
                        hit = np.flatnonzero(m[[row[c] for c in prefix]].all(0))
                        if len(hit):
                            total[start : start + len(ends)] += m[np.ix_([row.get(int(e), len(codes)) for e in ends], hit)] @ w[lo + hit]
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([cand[i] for i in hit], pa.list_(pa.int32())), pa.array(total[hit])], names=["codes", "supp"])

    return coded.select("codes", "wgt").mapInArrow(run, "codes array<int>, supp double").groupBy("codes").agg(F.sum("supp").alias("supp"))


def subsets_one_smaller(sets: DataFrame) -> DataFrame:
    """(items, supp, head): for each set and item the set without it."""
    return sets.select(F.explode("items").alias("head"), "items", "supp").select(F.array_remove("items", F.col("head")).alias("items"), "supp", "head")


def closed(sets: DataFrame) -> DataFrame:
    """Sets without a proper superset of equal support; ``sets`` must reach one size further than wanted."""
    above = subsets_one_smaller(sets).select("items", "supp").distinct()
    return sets.join(above, ["items", "supp"], "left_anti")


def maximal(sets: DataFrame) -> DataFrame:
    """Sets without a frequent proper superset."""
    return sets.join(subsets_one_smaller(sets).select("items").distinct(), "items", "left_anti")


def generators(sets: DataFrame, total: float) -> DataFrame:
    """Sets without a proper subset of equal support; single items in all transactions are none."""
    below = sets.select("items", F.col("supp").alias("sub_supp"))
    equal = subsets_one_smaller(sets.where("size > 1")).withColumn("whole", F.array_sort(F.array_append("items", F.col("head")))).join(below, "items").where("supp = sub_supp").select(F.col("whole").alias("items")).distinct()
    return sets.where((F.col("size") > 1) | (F.col("supp") < total)).join(equal, "items", "left_anti")


TARGETS = {"s": "all", "a": "all", "f": "all", "c": "closed", "m": "maximal", "g": "generators"}


def mine(tx: DataFrame, *, target: str = "s", support: float = 10.0, most_support: float | None = None, least_size: int = 1, largest_size: int = 0, items: list[str] | None = None, border: dict[int, float] | None = None) -> DataFrame:
    """(items, size, supp, rel_supp) for a target: all sets, closed, maximal or generators.

    ``support`` is in percent of the total weight, absolute if negative;
    ``border`` maps a size to its own least support.  Size and upper support
    bounds apply after the target's test.  The empty set is reported with
    ``least_size`` 0.
    """
    base = cut(collapse(tx))
    total = base.agg(F.coalesce(F.sum("wgt"), F.lit(0)).cast("double").alias("w")).first()["w"] or 0.0
    least = max(absolute_support(support, total), 1e-9)
    kind = TARGETS[target]
    reach = largest_size + 1 if largest_size and kind in ("closed", "maximal") else largest_size
    sets = frequent(base, least, reach, items, collapsed=True)
    if kind == "closed":
        sets = closed(sets)
    elif kind == "maximal":
        sets = maximal(sets)
    elif kind == "generators":
        sets = generators(sets, total)
    if least_size == 0 and kind in ("all", "generators"):
        sets = sets.unionByName(tx.sparkSession.createDataFrame([([], 0, float(total))], SET_SCHEMA))
    sets = sets.where(F.col("size") >= least_size)
    if largest_size:
        sets = sets.where(F.col("size") <= largest_size)
    if most_support is not None:
        sets = sets.where(F.col("supp") <= absolute_support(most_support, total))
    if border:
        limit = F.coalesce(*[F.when(F.col("size") == k, F.lit(float(v))) for k, v in border.items()], F.lit(0.0))
        sets = sets.where(F.col("supp") >= limit)
    return sets.withColumn("rel_supp", F.try_divide("supp", F.lit(total)))


def spectrum(sets: DataFrame) -> DataFrame:
    """(size, supp, n): the pattern spectrum."""
    return sets.groupBy("size", "supp").agg(F.count(F.lit(1)).alias("n"))


def add_spectra(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of two spectra."""
    return a.unionByName(b).groupBy("size", "supp").agg(F.sum("n").alias("n"))


def size_statistics(sets: DataFrame) -> DataFrame:
    """(size, n): the number of sets of each size and, with a null size, of all."""
    return sets.rollup("size").agg(F.count(F.lit(1)).alias("n"))


def supporting_tids(sets: DataFrame, tx: DataFrame) -> DataFrame:
    """(items, tid): the transactions that contain each set, one row each.

    Only transactions with the set's rarest item are tested.
    """
    rare = item_frequencies(tx.select("items")).select("item", "n")
    key = sets.select("items", F.explode("items").alias("item")).join(rare, "item").groupBy("items").agg(F.min(F.struct("n", "item")).alias("k"))
    held = tx.select("tid", F.col("items").alias("held"), F.explode("items").alias("item"))
    return key.select("items", F.col("k.item").alias("item")).join(held, "item").where(F.forall("items", lambda x: F.array_contains("held", x))).select("items", "tid")


def expected_spectrum(tx: DataFrame, sizes: list[int], supports: list[int], equivalent: float = 1.0) -> DataFrame:
    """(size, supp, expected): sets expected by chance with equal item probabilities.

    For size z the slots are the sum of C(transaction size, z), the rate is
    slots / C(n, z) and the count C(n, z) times the Poisson probability,
    rounded half up.
    """
    n = item_frequencies(tx).count()
    histogram = {r[0]: r[1] for r in tx.groupBy(F.size("items")).count().collect()}
    rows = []
    for z in sizes:
        slots, every = sum(math.comb(k, z) * c for k, c in histogram.items()), math.comb(n, z)
        rate = slots / every if every else 0.0
        for c in supports:
            p = math.exp(c * math.log(rate) - rate - math.lgamma(c + 1)) if rate > 0 else float(c == 0)
            rows.append((z, float(c), float(math.floor(every * p * equivalent + 0.5))))
    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("supp", T.DoubleType()), T.StructField("expected", T.DoubleType())])
    return tx.sparkSession.createDataFrame(rows, schema)
