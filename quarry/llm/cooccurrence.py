"""Items that appear together: exact pair counts and their surprise.

Counting: items get codes in the order of their frequency; each task turns its
baskets into pair codes, a bounded number at a time, and adds equal ones up, so
only sums are shuffled, never the pairs of a basket.  The pairs of a basket of
more than ``LONG`` items are divided among several tasks.  Neither the items
nor any count passes through the driver.

Null model: the bipartite configuration model fitted to all item frequencies
and all basket sizes, p(item, basket) = x y / (1 + x y).  The fit runs over the
two histograms; small values have a class each, large ones geometric classes,
so both are bounded by the range of the values.  The x of an item is
interpolated between the classes around its frequency.  The number of common baskets is Poisson-binomial;
its upper tail comes from a saddlepoint formula on the histogram of basket
sizes.  Pairs with equal counts share one test; Benjamini-Hochberg over the
distinct ones, each with the number of its pairs, gives false-discovery rates.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import clean_name
from quarry.operators.pairs import LONG, PAIRS_IN_MEMORY, pair_sums
from quarry.operators.skew import global_rank, lookup_join
from quarry.session import cut

EXACT_FREQUENCY, FREQUENCY_CLASSES = 1024, 256  # a class each up to here, then so many for each doubling
EXACT_SIZE, SIZE_CLASSES = 256, 64
FIT_ROUNDS, FIT_ERROR = 2000, 1e-9
TESTS_AT_ONCE = 2000


def value_class(c: Column, exact: int, per_doubling: int) -> Column:
    """The class of a positive count: itself up to ``exact``, then geometric."""
    return F.when(c <= exact, c).otherwise(exact + F.ceil(F.log2(c / F.lit(float(exact))) * per_doubling)).cast("int")


def fit_null(degrees: np.ndarray, n_items: np.ndarray, sizes: np.ndarray, n_baskets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x for each item frequency, y for each basket size) of the bipartite configuration model.

    Arguments: item frequencies with their number of items, basket sizes with
    their number of baskets.  A fit that has not settled gives a warning.
    """
    k, d = degrees.astype(float), sizes.astype(float)
    total = math.sqrt(float((k * n_items).sum()))
    x, y = k / total, d / total
    moved = 0.0
    for _ in range(FIT_ROUNDS):
        x2 = k / np.maximum((n_baskets * y / (1 + np.outer(x, y))).sum(1), 1e-300)
        y2 = d / np.maximum((n_items[:, None] * x2[:, None] / (1 + np.outer(x2, y))).sum(0), 1e-300)
        x2, y2 = np.clip(x2, 1e-12, 1e12), np.clip(y2, 1e-12, 1e12)
        moved = max(np.abs(x2 / x - 1).max(), np.abs(y2 / y - 1).max())
        x, y = x2, y2
        if moved < FIT_ERROR:
            return x, y
    warnings.warn(f"the null model moved by {moved:.1e} in its last round", stacklevel=2)
    return x, y


def chances(degrees: np.ndarray, classes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """p(item, basket) for items of these frequencies in baskets of each class; ln x is interpolated in ln frequency between the classes."""
    at = np.exp(np.interp(np.log(degrees), np.log(classes), np.log(x)))[:, None] * y
    return at / (1 + at)


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _log_normal_tail(w: np.ndarray) -> np.ndarray:
    """ln P(Z >= w) of a standard normal, w >= 0: the complementary error function, and Mills' continued fraction far out."""
    near = np.log(_erfc(np.minimum(w, 5.0) / math.sqrt(2)).astype(float) / 2)
    f = w.copy()
    for j in range(40, 0, -1):
        f = w + j / np.maximum(f, 1e-9)
    far = -0.5 * w * w - 0.5 * math.log(2 * math.pi) - np.log(np.maximum(f, 1e-300))
    return np.where(w < 5, near, far)


def log_tail(count: np.ndarray, p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """ln P(X >= count) for X a sum of Bernoulli trials, ``times[j]`` of them with ``p[i, j]``.

    Lugannani-Rice with the lattice correction; relative error about a percent
    where the tail is not tiny, far less than that of a normal or Poisson tail.
    """
    count = count.astype(float)
    p = np.clip(p, 0.0, 1 - 1e-12)
    mean = (p * times).sum(1)
    most = np.where(p > 0, times, 0).sum(1)
    out = np.zeros(len(count))
    over = count > most  # impossible
    full = (count == most) & ~over
    out[over] = -np.inf
    out[full] = (np.log(np.maximum(p[full], 1e-300)) * times * (p[full] > 0)).sum(1)
    live = ~over & ~full & (count > 0)
    if not live.any():
        return out
    c, q, m = count[live], p[live], mean[live]
    odds = q / (1 - q)
    s = np.log(np.maximum(c, 0.5) / np.maximum(m, 1e-300))
    low, high = np.full(len(c), -60.0), np.full(len(c), 60.0)
    rows = np.arange(len(c))
    for _ in range(80):  # safeguarded Newton for K'(s) = count
        e = odds[rows] * np.exp(s[rows])[:, None]
        tilted = e / (1 + e)
        k1 = tilted @ times
        k2 = np.maximum((tilted * (1 - tilted)) @ times, 1e-300)
        low[rows] = np.where(k1 < c[rows], s[rows], low[rows])
        high[rows] = np.where(k1 >= c[rows], s[rows], high[rows])
        step = s[rows] - (k1 - c[rows]) / k2
        new = np.where((step > low[rows]) & (step < high[rows]), step, (low[rows] + high[rows]) / 2)
        moving = np.abs(new - s[rows]) > 1e-10 * (1 + np.abs(new))
        s[rows] = new
        rows = rows[moving]
        if not len(rows):
            break
    e = odds * np.exp(s)[:, None]
    tilted = e / (1 + e)
    k2 = (tilted * (1 - tilted) * times).sum(1)
    k0 = (np.log1p(q * np.expm1(s)[:, None]) * times).sum(1)
    rate = np.maximum(s * c - k0, 0)
    w = np.sign(s) * np.sqrt(2 * rate)
    u = -np.expm1(-s) * np.sqrt(np.maximum(k2, 1e-300))
    upper = s > 1e-3
    result = np.zeros(len(c))
    if upper.any():
        lw = _log_normal_tail(w[upper])
        phi = -0.5 * w[upper] ** 2 - 0.5 * math.log(2 * math.pi)
        ratio = np.exp(phi - lw) * (1 / u[upper] - 1 / w[upper])
        result[upper] = lw + np.log(np.maximum(1 + ratio, 1e-12))
    if (~upper).any():  # at or below the mean: normal with continuity correction
        var = np.maximum((q * (1 - q) * times).sum(1)[~upper], 1e-300)
        z = (c[~upper] - 0.5 - m[~upper]) / np.sqrt(var)
        tail = np.exp(_log_normal_tail(np.abs(z)))
        result[~upper] = np.log(np.maximum(np.where(z >= 0, tail, 1 - tail), 1e-300))
    out[live] = np.minimum(result, 0.0)
    return out


class Cooccurrence:
    """Pair counts over distinct (basket, item) rows; the steps share what is counted once."""

    def __init__(self, rows: DataFrame, basket: str, item: str, min_count: int = 1, min_share: float = 0.0):
        """Null baskets and null items are left out, repeated rows count once."""
        given = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null")
        self.pairs = cut(given.distinct())
        sizes = cut(self.pairs.groupBy("basket").agg(F.count(F.lit(1)).alias("size")))
        self.long = sizes.where(F.col("size") > LONG)
        by_class = sizes.groupBy(value_class(F.col("size"), EXACT_SIZE, SIZE_CLASSES).alias("c")).agg(F.avg("size").alias("value"), F.count(F.lit(1)).alias("n"))
        self.sizes = by_class.orderBy("c").toPandas()  # a row for each class
        self.n = int(self.sizes["n"].sum())
        self.least = max(min_count, math.ceil(min_share * self.n - 1e-9))
        frequency = self.pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
        ranked = global_rank(frequency.withColumn("_less", -F.col("n_item")), ["_less", "item"])
        self.items = cut(ranked.select("item", (F.col("rank") - 1).alias("code"), "n_item"))
        by_class = self.items.groupBy(value_class(F.col("n_item"), EXACT_FREQUENCY, FREQUENCY_CLASSES).alias("c")).agg(F.avg("n_item").alias("value"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_item") >= self.least, 1)).alias("kept"))
        self.degrees = by_class.orderBy("c").toPandas()  # a row for each class
        self.n_kept = int(self.degrees["kept"].sum())

    def counts(self) -> DataFrame:
        """(item_a, item_b, n_ab, n_a, n_b) of all pairs of items with the least count that occur together, item_a < item_b."""
        kept = self.items.where(F.col("n_item") >= self.least)
        coded = lookup_join(self.pairs, kept.select("item", "code"), "item").where("code is not null").select("basket", "code")
        parts = self.long.select("basket", F.ceil(F.col("size") / LONG).cast("int").alias("parts"))
        sliced = coded.join(parts, "basket", "left").select("basket", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("slice"), "code")
        placed = sliced.repartition("basket", "slice").sortWithinPartitions("basket", "slice", "code")
        counted = placed.withColumn("wgt", F.lit(1.0)).mapInArrow(pair_sums(max(self.n_kept, 1), LONG, PAIRS_IN_MEMORY), "code_a bigint, code_b bigint, total double").groupBy("code_a", "code_b").agg(F.sum("total").cast("bigint").alias("n_ab"))
        side = lambda s: kept.select(F.col("code").alias(f"code_{s}"), F.col("item").alias(f"i_{s}"), F.col("n_item").alias(f"k_{s}"))
        named = counted.join(side("a"), "code_a").join(side("b"), "code_b")
        ordered = F.col("i_a") < F.col("i_b")
        pick = lambda x, y, name: F.when(ordered, F.col(x)).otherwise(F.col(y)).alias(name)
        return named.select(pick("i_a", "i_b", "item_a"), pick("i_b", "i_a", "item_b"), "n_ab", pick("k_a", "k_b", "n_a"), pick("k_b", "k_a", "n_b"))

    def tests(self, counted: DataFrame) -> DataFrame:
        """(n_low, n_high, n_ab, n_pairs, expected, log_p): one row for each distinct test."""
        d, times = self.sizes["value"].to_numpy(float), self.sizes["n"].to_numpy(float)
        classes = self.degrees["value"].to_numpy(float)
        x, y = fit_null(classes, self.degrees["n"].to_numpy(float), d, times) if self.n else (classes, d)

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), TESTS_AT_ONCE):
                    g = f.iloc[at : at + TESTS_AT_ONCE]
                    k, where = np.unique(g[["n_low", "n_high"]].to_numpy().ravel(), return_inverse=True)
                    p = chances(k, classes, x, y)[where.reshape(-1, 2)]
                    p = p[:, 0] * p[:, 1]
                    yield g.assign(expected=(p * times).sum(1), log_p=log_tail(g["n_ab"].to_numpy(), p, times))

        distinct = counted.groupBy(F.least("n_a", "n_b").alias("n_low"), F.greatest("n_a", "n_b").alias("n_high"), "n_ab").agg(F.count(F.lit(1)).alias("n_pairs"))
        parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return distinct.repartition(parts, "n_low", "n_high", "n_ab").mapInPandas(score, "n_low bigint, n_high bigint, n_ab bigint, n_pairs bigint, expected double, log_p double")

    def discoveries(self) -> DataFrame:
        """``counts`` with n, lift (n_ab n / n_a n_b), expected (under the null), log_p and q_value.

        log_p is the natural log of the p-value, q_value the false-discovery
        rate at which the pair is reported.  The family is all pairs of items
        with the least count; those never together have p-value 1.
        """
        counted = cut(self.counts())
        family = float(max(self.n_kept * (self.n_kept - 1) // 2, 1))
        parts = cut(self.tests(counted).repartitionByRange("log_p").withColumn("_pid", F.spark_partition_id()))
        sizes = parts.groupBy("_pid").agg(F.sum("n_pairs").alias("s"))  # one row for each partition
        before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        within = Window.partitionBy("_pid").orderBy("log_p").rangeBetween(Window.unboundedPreceding, 0)
        ranked = parts.join(F.broadcast(sizes.select("_pid", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_before"))), "_pid")
        rank = F.col("_before") + F.sum("n_pairs").over(within)
        ranked = ranked.withColumn("_raw", F.least(F.lit(0.0), F.col("log_p") + math.log(family) - F.log(rank)))
        lowest = ranked.groupBy("_pid").agg(F.min("_raw").alias("m"))
        later = Window.orderBy("_pid").rowsBetween(1, Window.unboundedFollowing)
        after = F.broadcast(lowest.select("_pid", F.coalesce(F.min("m").over(later), F.lit(0.0)).alias("_after")))
        rest = Window.partitionBy("_pid").orderBy(F.desc("log_p")).rangeBetween(Window.unboundedPreceding, 0)  # a running minimum
        tests = ranked.join(after, "_pid").withColumn("q_value", F.exp(F.least(F.min("_raw").over(rest), F.col("_after"))))
        keyed = counted.withColumn("n_low", F.least("n_a", "n_b")).withColumn("n_high", F.greatest("n_a", "n_b"))
        joined = keyed.join(tests.select("n_low", "n_high", "n_ab", "expected", "log_p", "q_value"), ["n_low", "n_high", "n_ab"])
        lift = F.col("n_ab") * F.lit(self.n) / (F.col("n_a") * F.col("n_b"))
        return joined.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(self.n).cast("bigint").alias("n"), lift.alias("lift"), "expected", "log_p", "q_value")


def called_items(context: DataFrame, response: DataFrame) -> DataFrame:
    """(handler, item) of the rows of type CALL in both tables, items as names; null and blank ones left out."""
    both = context.select("handler", "item", "type").unionByName(response.select("handler", "item", "type"))
    return both.where("type = 'CALL' and handler is not null").select("handler", clean_name("item").alias("item")).where("item is not null")
