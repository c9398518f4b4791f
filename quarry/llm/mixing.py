"""Mixing sources to target weights.

Method: temperature mixing.  With target weights w and natural token shares t
the weights are p(x) ~ w^(1-x) * t^x; without targets w is uniform, which is
the usual tempering of the token shares.  The exponent x is bisected: to the
least one that keeps every source within its repetition limit at a given
budget, or to a target entropy.  The weights are then realised as budgeted
block permutations: in every pass over a source its records are permuted by a
hash, blocks of the permutation get their token offset from the block totals,
and the last pass stops at the source's budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import trim_blanks
from quarry.llm.tokens import count_tokens
from quarry.session import cut

MOST_SOURCES = 10_000
ROWS_A_BLOCK = 20_000
BISECTIONS = 200


@dataclass
class Plan:
    """What each source gets: share, tokens, and the exponent used."""

    exponent: float
    shares: dict[str, float]
    tokens: dict[str, int]


def tempered(x: float, target: dict[str, float], natural: dict[str, float]) -> dict[str, float]:
    """Normalised w^(1-x) * t^x."""
    logs = {s: (1 - x) * math.log(target[s]) + x * math.log(natural[s]) for s in target}
    top = max(logs.values())
    raw = {s: math.exp(v - top) for s, v in logs.items()}
    total = math.fsum(raw.values())
    return {s: v / total for s, v in raw.items()}


def entropy(p: dict[str, float]) -> float:
    return -math.fsum(v * math.log(v) for v in p.values() if v > 0)


def solve(size: dict[str, int], cap: dict[str, int], target: dict[str, float] | None = None, budget: int | None = None, target_entropy: float | None = None) -> Plan:
    """Shares and token budgets of the sources with ``size`` > 0.

    Without a budget the largest one is taken at which the weights hold as
    they are (exponent 0, or the one with the target entropy).  With a budget
    the exponent grows from there until no source is repeated more than its
    limit; what even the natural shares can't give is cut off.  An entropy that
    no exponent from 0 to 1 has gives the nearer end.
    """
    live = {s: n for s, n in size.items() if n > 0 and cap.get(s, 0) > 0 and (target is None or target.get(s, 0) > 0)}
    if not live:
        return Plan(0.0, {}, {})
    whole = sum(live.values())
    natural = {s: n / whole for s, n in live.items()}
    wanted = {s: (target[s] if target else 1.0) for s in live}
    at = 0.0
    if target_entropy is not None:
        ends = (0.0, 1.0)
        low, high = sorted(ends, key=lambda x: entropy(tempered(x, wanted, natural)))
        for _ in range(BISECTIONS):
            at = (low + high) / 2
            low, high = (at, high) if entropy(tempered(at, wanted, natural)) < target_entropy else (low, at)
    most = lambda p: min(cap[s] * live[s] / p[s] for s in live)
    shares = tempered(at, wanted, natural)
    if budget is None:
        budget = int(most(shares))
    elif most(shares) < budget:
        low, high = at, 1.0
        for _ in range(BISECTIONS):
            at = (low + high) / 2
            low, high = (low, at) if most(tempered(at, wanted, natural)) >= budget else (at, high)
        at = high
        shares = tempered(at, wanted, natural)
    return Plan(at, shares, {s: min(cap[s] * live[s], round(shares[s] * budget)) for s in live})


def source_key(c):
    """Sources compared without blanks and tabs at both ends, in lower case."""
    return F.lower(trim_blanks(c))


def sized(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, path: str | None = None) -> tuple[DataFrame, list]:
    """(rows of listed sources with n_tokens, the target rows).

    Target rows with a null source or weight, or a weight or repeats of 0 or
    less, are not used; of several rows of one source the largest weight counts.
    """
    rows = targets.select(source_key("source").alias("source"), F.col("target_weight").cast("double"), F.col("max_repeats").cast("int")).where("source <> '' and target_weight > 0 and max_repeats > 0").groupBy("source").agg(F.max(F.struct("target_weight", "max_repeats")).alias("t")).select("source", "t.*").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    listed = docs.select(F.col(doc_id).alias("doc_id"), source_key(source).alias("source"), F.col(text).alias("text")).where(F.col("source").isin([r["source"] for r in rows]))
    return cut(count_tokens(listed, ["doc_id", "source"], "text", path=path)), rows


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, budget: int | None = None, budget_share: float | None = None, target_entropy: float | None = None, use_targets: bool = True, seed: int = 0, mix_blocks: int = 1000, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the mix, the report).

    The mix has one row for each use of a record: doc_id, source, epoch (from
    1), n_tokens and mix_block; every mix_block holds about the target shares.
    A source is used at most max_repeats times, its last pass to within half a
    record of its budget.  Records without a listed source are left out, those
    without tokens (null and empty texts) carry no share and are left out too.
    ``budget`` is in tokens, ``budget_share`` in parts of all tokens of the listed sources.
    The report has one row for each listed source: its tokens and target, and
    the tokens, share and repeats reached; sources without tokens have 0, and
    the targets are normalised over the others.  Both are empty for empty
    targets.
    """
    spark = docs.sparkSession
    sizes, rows = sized(docs, doc_id, text, source, targets, path)
    totals = {r["source"]: r for r in sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).collect()}
    tokens = {r["source"]: (totals[r["source"]]["n_tokens"] if r["source"] in totals else 0) for r in rows}
    cap = {r["source"]: r["max_repeats"] for r in rows}
    weight = {r["source"]: r["target_weight"] for r in rows}
    if budget_share is not None:
        budget = round(budget_share * sum(tokens.values()))
    plan = solve(tokens, cap, weight if use_targets else None, budget, target_entropy)
    passes = [(s, int(n), e, n - e * tokens[s], tokens[s]) for s, n in plan.tokens.items() for e in range(-(-n // tokens[s]))]
    epochs = F.broadcast(spark.createDataFrame(passes or [("", 0, 0, 0, 0)], "source string, budget bigint, epoch int, room bigint, whole bigint"))
    n_rows = sum(r["n_docs"] for r in totals.values())
    n_blocks = max(64, -(-n_rows // ROWS_A_BLOCK))
    used = sizes.where("n_tokens > 0").join(epochs, "source")
    order = F.xxhash64("doc_id", "epoch", F.lit(seed))
    used = used.withColumn("_h", order).withColumn("_block", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(n_blocks)))
    blocks = used.groupBy("source", "epoch", "_block").agg(F.sum("n_tokens").alias("n"))
    by_pass = Window.partitionBy("source", "epoch").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("source", "epoch", "_block", F.coalesce(F.sum("n").over(by_pass), F.lit(0)).alias("_offset"))
    in_block = Window.partitionBy("source", "epoch", "_block").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = used.withColumn("_before", F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0))).join(offsets, ["source", "epoch", "_block"])
    before = F.col("_offset") + F.col("_before")
    done = F.try_divide(F.col("epoch") * F.col("whole") + before, F.col("budget"))
    mixed = placed.where(before * 2 + F.col("n_tokens") <= F.col("room") * 2).select(
        "doc_id", "source", (F.col("epoch") + 1).alias("epoch"), "n_tokens", F.least(F.floor(done * mix_blocks), F.lit(mix_blocks - 1)).cast("int").alias("mix_block")
    )
    goal = math.fsum(weight[s] for s in plan.tokens)
    natural = sum(tokens[s] for s in plan.tokens)
    listed = [(s, weight[s], weight[s] / goal if s in plan.tokens else 0.0, int(cap[s]), int(totals[s]["n_docs"]) if s in totals else 0, int(tokens[s]), tokens[s] / natural if s in plan.tokens else 0.0, plan.shares.get(s, 0.0), plan.exponent) for s in weight]
    report = spark.createDataFrame(listed, "source string, target_weight double, target_share double, max_repeats int, n_docs bigint, source_tokens bigint, natural_share double, planned_share double, exponent double")
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("epoch").alias("most_uses"))
    report = report.join(F.broadcast(reached), "source", "left").select(*report.columns, F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    everything = Window.partitionBy()  # at most MOST_SOURCES rows
    report = report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(everything)), F.lit(0.0)))
    return mixed, report.withColumn("repeats", F.coalesce(F.try_divide("mixed_tokens", "source_tokens"), F.lit(0.0)))
