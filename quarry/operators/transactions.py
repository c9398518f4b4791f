"""Transactions: building, weighting, collapsing, recoding and randomising.

A transaction table has ``items`` (sorted distinct strings) and, where given,
``wgt`` (a number) and ``tid``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.pairs import SUMS_IN_MEMORY, merge_sums


def items_of(values: Column) -> Column:
    """Sorted distinct items of a list; nulls and empty strings are dropped, a null list is empty."""
    full = F.coalesce(values, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(full, lambda x: x.isNotNull() & (x != ""))))


def from_pairs(pairs: DataFrame, tid: str, item: str) -> DataFrame:
    """(tid, items) from one row for each item of a transaction; repeated rows count once."""
    rows = pairs.select(F.col(tid).alias("tid"), F.col(item).cast("string").alias("item")).where("tid is not null and item is not null").distinct()
    return rows.groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("items"))


def from_flags(table: DataFrame, key: str, columns: list[str], true: str = "T") -> DataFrame:
    """(tid, items) from a flag matrix: the names of the columns that hold ``true``."""
    marks = F.array(*[F.when(F.col(c).cast("string") == true, F.lit(c)) for c in columns])
    return table.select(F.col(key).alias("tid"), items_of(marks).alias("items"))


def from_columns(table: DataFrame, key: str, columns: list[str], named: bool = True) -> DataFrame:
    """(tid, items) with an item ``column=value`` (or ``Xi=value`` by position) for each non-null column."""
    cells = F.array(*[F.concat(F.lit(f"{c}=" if named else f"X{i}="), F.col(c).cast("string")) for i, c in enumerate(columns, 1)])
    return table.select(F.col(key).alias("tid"), items_of(cells).alias("items"))


def from_lines(lines: DataFrame, order: str, value: str, group: str | None = None) -> DataFrame:
    """(tid, items) from one item per line, a blank line ending the record.

    The order is within ``group`` (a file), which keeps the running count of
    blanks from being one window over everything.
    """
    by = Window.partitionBy(*([group] if group else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim(F.coalesce(value, F.lit(""))) == ""
    run = lines.withColumn("tid", F.sum(F.when(blank, 1).otherwise(0)).over(by)).where(~blank)
    keys = [group, "tid"] if group else ["tid"]
    return run.groupBy(*keys).agg(items_of(F.collect_list(F.trim(value))).alias("items"))


def select_items(tx: DataFrame, keep: list[str]) -> DataFrame:
    """Transactions with only the listed items."""
    return tx.withColumn("items", F.array_intersect("items", F.array(*[F.lit(x) for x in sorted(set(keep))]) if keep else F.array().cast("array<string>")))


def weighted(tx: DataFrame) -> DataFrame:
    """The table with a weight: 1 where none is given."""
    return tx if "wgt" in tx.columns else tx.withColumn("wgt", F.lit(1).cast("bigint"))


def collapse(tx: DataFrame, keep_zero: bool = False) -> DataFrame:
    """(items, wgt): equal transactions as one with the summed weight; sums of 0 are dropped."""
    out = weighted(tx).groupBy("items").agg(F.sum("wgt").alias("wgt"))
    return out if keep_zero else out.where("wgt <> 0")


def item_frequencies(tx: DataFrame) -> DataFrame:
    """(item, frq, xfq, n): weight, weight times transaction size, and number of transactions of each item."""
    rows = weighted(tx).select(F.explode("items").alias("item"), "wgt", F.size("items").alias("size"))
    return rows.groupBy("item").agg(F.sum("wgt").alias("frq"), F.sum(F.col("wgt") * F.col("size")).alias("xfq"), F.count(F.lit(1)).alias("n"))


def recode(tx: DataFrame, least: float = 0, most: float | None = None, by: str = "frq", ascending: bool = True) -> DataFrame:
    """(item, frq, xfq, n, code): items within the frequency bounds with a dense code in the order of ``by``.

    Ties go to the smaller item.  The codes are ranks over range partitions.
    """
    from quarry.operators.skew import global_rank

    freq = item_frequencies(tx).where(F.col("frq") >= least)
    if most is not None:
        freq = freq.where(F.col("frq") <= most)
    ranked = global_rank(freq.withColumn("_key", F.col(by) if ascending else -F.col(by)), ["_key", "item"])
    return ranked.select(*freq.columns, (F.col("rank") - 1).cast("bigint").alias("code"))


def by_size(tx: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Transactions with a number of items within the bounds."""
    size = F.size("items")
    return tx.where((size >= least) & (size <= most if most is not None else F.lit(True)))


def trim_sequence(seq: Column, allowed: Column) -> Column:
    """A sequence without the items at both ends that are not in ``allowed``; null if none is."""
    hits = F.filter(F.transform(seq, lambda x, i: F.when(F.array_contains(allowed, x), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.slice(seq, F.array_min(hits), F.array_max(hits) - F.array_min(hits) + 1))


def is_table_like(tx: DataFrame) -> DataFrame:
    """(same_size, fixed_positions): all transactions equally long, and every item always in one position."""
    size = tx.agg((F.count_distinct(F.size("items")) <= 1).alias("same_size"))
    place = tx.select(F.posexplode("items").alias("pos", "item")).groupBy("item").agg((F.min("pos") == F.max("pos")).alias("one"))
    return size.crossJoin(place.agg(F.coalesce(F.bool_and("one"), F.lit(True)).alias("fixed_positions")))  # two single rows


def occurrences_of(tx: DataFrame, items: list[str]) -> DataFrame:
    """(wgt): summed weight of the transactions that are exactly ``items``."""
    want = F.array(*[F.lit(x) for x in sorted(set(items))]) if items else F.array().cast("array<string>")
    return weighted(tx).where(F.col("items") == want).agg(F.coalesce(F.sum("wgt"), F.lit(0)).alias("wgt"))


def contains(outer: Column, inner: Column) -> Column:
    """Whether the list ``outer`` holds every item of ``inner``."""
    return F.size(F.array_except(inner, outer)) == 0


def is_subsequence(seq: Column, of: Column) -> Column:
    """Whether the items of ``seq`` occur in ``of`` in this order, gaps allowed."""
    done = F.aggregate(of, F.lit(0), lambda at, x: F.when(F.coalesce(F.get(seq, at) == x, F.lit(False)), at + 1).otherwise(at))
    return done == F.size(seq)


def substring_at(seq: Column, of: Column) -> Column:
    """0-based start of the first gapless occurrence of ``seq`` in ``of``; -1 if there is none."""
    last = F.size(of) - F.size(seq)
    starts = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
    hit = F.filter(starts, lambda i: F.slice(of, i + 1, F.size(seq)) == seq)
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(-1))


MASK_ITEMS, SUBSET_ITEMS = 62, 12
CELLS_AT_ONCE = 2_000_000


def _subset_sums(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (mask, wgt), masks of ``size`` bits, to the weights of their proper subsets but the empty one, added up."""
    chosen = np.array([[j >> i & 1 for j in range(1, (1 << size) - 1)] for i in range(size)], np.int64)
    step = max(1, CELLS_AT_ONCE >> size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            key, total = merge_sums(held)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], names=["mask", "wgt"])

        for b in batches:
            for at in range(0, b.num_rows, step):
                left, w = (b.column(c).slice(at, step).to_numpy().copy() for c in (0, 1))
                bits = np.empty((len(left), size), np.int64)
                for i in range(size):
                    bits[:, i] = left & -left
                    left -= bits[:, i]
                held.append(merge_sums([((bits @ chosen).ravel(), np.repeat(w, chosen.shape[1]))]))
                if sum(len(h[0]) for h in held) > SUMS_IN_MEMORY:
                    held[:] = [merge_sums(held)]
                    if len(held[0][0]) > SUMS_IN_MEMORY // 2:
                        yield rows()
                        held.clear()
        if held:
            yield rows()

    return run


def idempotent_weights(tx: DataFrame, item_least: int = 2) -> DataFrame:
    """(items, wgt): weight of each distinct transaction less that of its larger supersets.

    From the largest size down, w(s) loses the adjusted w of every distinct
    proper superset; the loop runs over the distinct sizes.  With at most
    ``MASK_ITEMS`` items a set of up to ``SUBSET_ITEMS`` lists its subsets as
    masks, which each task adds up.  Otherwise a set meets the larger ones that
    hold its two rarest items (its one item, if it has but one), and
    containment is tested there.  The empty transaction keeps its weight less
    all others.
    """
    from quarry.session import cut

    base = cut(collapse(tx))
    rare = cut(item_frequencies(base).select("item", "n"))
    state = base.withColumn("size", F.size("items"))
    sizes = sorted((r[0] for r in state.select("size").distinct().collect()), reverse=True)
    names = [r["item"] for r in rare.select("item").limit(MASK_ITEMS + 1).collect()]
    listed = SUBSET_ITEMS if len(names) <= MASK_ITEMS and dict(base.dtypes)["wgt"] in ("int", "bigint", "double") else 0
    if listed and names:
        bit = F.create_map(*[F.lit(x) for n, name in enumerate(sorted(names)) for x in (name, 1 << n)])
        state = state.withColumn("mask", F.aggregate("items", F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.element_at(bit, x).cast("bigint"))))
    if sizes and sizes[0] > listed:
        two = base.select("items", F.explode("items").alias("item")).join(rare, "item").groupBy("items").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "item"))), 1, 2).alias("r"))
        key = two.select("items", F.array_min(F.col("r.item")).alias("a"), F.array_max(F.col("r.item")).alias("b"))
        state = state.join(key, "items", "left")
    state = cut(state)
    for size in sizes:
        if size < 2:
            break
        if size <= listed:
            big = state.where(F.col("size") == size).select("mask", "wgt")
            lost = big.mapInArrow(_subset_sums(size), big.schema).groupBy("mask").agg(F.sum("wgt").alias("lost"))
            met = ["mask"]
        else:
            pairs = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 1, F.size("items") - i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
            larger = state.where(F.col("size") == size).select(F.col("items").alias("big"), F.col("wgt").alias("big_wgt"), F.explode(pairs).alias("p")).select("big", "big_wgt", "p.a", "p.b")
            hit = state.where(F.col("size") < size).select("items", "a", "b").join(larger, ["a", "b"]).where(F.forall("items", lambda x: F.array_contains("big", x)))
            lost = hit.groupBy("items").agg(F.sum("big_wgt").alias("lost"))
            met = ["items"]
        columns = state.columns
        state = cut(state.join(lost, met, "left").withColumn("wgt", F.col("wgt") - F.coalesce("lost", F.lit(0))).select(*columns))
    rest = state.where("size > 0").agg(F.coalesce(F.sum("wgt"), F.lit(0)).alias("lost"))
    empty = state.where("size = 0").crossJoin(F.broadcast(rest)).select("items", (F.col("wgt") - F.col("lost")).alias("wgt"))  # single rows
    return state.where("size > 0").select("items", "wgt").unionByName(empty)


STRIDES = 64


def surrogate_frequencies(tx: DataFrame, seed: int = 0) -> DataFrame:
    """(tid, items): every item kept with its frequency, its transactions drawn anew.

    Transactions are numbered in a random order, by ranks of a hash.  The
    occurrences of an item are numbered too and go through that order from a
    random start in one of ``STRIDES`` random strides prime to the number of
    transactions, so no two of them meet.
    """
    from quarry.operators.skew import global_rank, lookup_join
    from quarry.session import cut

    ids = tx.select("tid").distinct().withColumn("_h", F.xxhash64("tid", F.lit(seed)))
    numbered = cut(global_rank(ids, ["_h", "tid"], "_no").select("tid", (F.col("_no") - 1).alias("_no")))
    n = max(numbered.count(), 1)
    draw = random.Random(seed)
    strides: list[int] = []
    while len(strides) < STRIDES:
        x = draw.randrange(1, n + 1)
        if math.gcd(x, n) == 1:
            strides.append(x)
    rows = cut(global_rank(tx.select("tid", F.explode("items").alias("item")).distinct(), ["item", "tid"], "_r").select("item", "_r"))
    first = cut(rows.groupBy("item").agg(F.min("_r").alias("_first")))
    each = lookup_join(rows, first, "item")
    start = F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(n))
    stride = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in strides]), (F.pmod(F.xxhash64("item", F.lit(seed + 1)), F.lit(STRIDES)) + 1).cast("int"))
    drawn = each.select("item", F.pmod(start + F.pmod((F.col("_r") - F.col("_first")).cast("decimal(38,0)") * stride, F.lit(n)).cast("bigint"), F.lit(n)).alias("_no"))
    return from_pairs(drawn.join(numbered, "_no"), "tid", "item")


def surrogate_shuffle(table: DataFrame, key: str, columns: list[str], seed: int = 0) -> DataFrame:
    """The table with each column permuted on its own, by ranks of seeded hashes."""
    from quarry.operators.skew import global_rank

    ranked = lambda c, s: global_rank(table.select(key, *([c] if c else [])).withColumn("_h", F.xxhash64(key, F.lit(s))), ["_h", key], "_no")
    out = ranked(None, seed).select(key, "_no")
    for i, c in enumerate(columns, 1):
        out = out.join(ranked(c, seed + i).select("_no", c), "_no")
    return out.drop("_no")


def surrogate_swap(tx: DataFrame, rounds: int = 3, seed: int = 0) -> DataFrame:
    """(tid, items) after random swaps that keep both transaction sizes and item frequencies.

    In each round a seeded hash pairs the (tid, item) rows within buckets; a
    pair swaps its items unless a transaction would hold one twice.
    """
    from quarry.session import cut

    rows = cut(tx.select("tid", F.explode("items").alias("item")))
    for r in range(rounds):
        h = rows.withColumn("_h", F.xxhash64("tid", "item", F.lit(seed + r)))
        bucket = Window.partitionBy(F.pmod("_h", F.lit(1 << 12))).orderBy("_h")
        h = h.withColumn("_b", F.pmod("_h", F.lit(1 << 12))).withColumn("_i", F.row_number().over(bucket))
        h = h.withColumn("_pair", F.floor((F.col("_i") - 1) / 2))
        pairs = h.groupBy("_b", "_pair").agg(F.min(F.struct("_i", "tid", "item")).alias("a"), F.max(F.struct("_i", "tid", "item")).alias("z"), F.count(F.lit(1)).alias("n"))
        swap = pairs.where("n = 2 and a.tid <> z.tid and a.item <> z.item").select(F.explode(F.array(
            F.struct(F.col("a.tid").alias("tid"), F.col("a.item").alias("old"), F.col("z.item").alias("item"), F.col("_b"), F.col("_pair")),
            F.struct(F.col("z.tid").alias("tid"), F.col("z.item").alias("old"), F.col("a.item").alias("item"), F.col("_b"), F.col("_pair")))).alias("s")).select("s.*")
        held = rows.select("tid", "item")
        clash = swap.join(held, ["tid", "item"], "left_semi").select("_b", "_pair").unionByName(
            swap.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("tid", "item"))).where("c > 1").select("_b", "_pair"))
        good = swap.join(clash.distinct(), ["_b", "_pair"], "left_anti")
        kept = rows.join(good.select("tid", F.col("old").alias("item")), ["tid", "item"], "left_anti")
        rows = cut(kept.unionByName(good.select("tid", "item")))
    return from_pairs(rows, "tid", "item")
