"""Vectors: cleaning, routing through a pivot tree, and the most similar ones of every vector."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.graph_index import BEAM, Graph
from quarry.operators.skew import lookup_join
from quarry.session import cut

MOST_PIVOTS, POINTS_A_PIVOT, SAMPLE_A_PIVOT = 4096, 16, 4
SHARD_POINTS, SLACK = 16_384, 1.5
VISITS, DEEP_VISITS, MARGIN = 12, 2, 0.12
TOGETHER = 0.8
ROWS_AT_ONCE = 4096
COGROUP_ROWS = 65_536
CODES, MOST_LEVELS = 1 << 15, 3  # shards of one cell, and levels below the root


def latest_vectors(df: DataFrame, label: str, vector: str, loaded_at: str, size: int) -> DataFrame:
    """(label, vector) of the row loaded last for each label, if its vector can be compared.

    Null labels and vectors that are null, not ``size`` long, all zero or hold
    a null, NaN or infinity take no part.  A null time is the earliest; among
    equal times the greater vector counts.
    """
    last = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.max(F.struct(F.col(loaded_at).alias("t"), F.col(vector).alias("v"))).alias("r")).select("label", F.col("r.v").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return last.where((F.size("vector") == size) & ~bad & F.exists("vector", lambda v: v != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of a batch as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def lists(x: np.ndarray) -> pa.ListArray:
    """Rows as the lists of a batch."""
    k = x.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(k, 1), dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def close_cells(pivots: np.ndarray) -> list[np.ndarray]:
    """Cells grouped so that pivots with cosine ``TOGETHER`` or more share a group."""
    near = pivots.astype(np.float32)
    left, out = np.ones(len(pivots), bool), []
    for i in range(len(pivots)):
        if not left[i]:
            continue
        left[i] = False
        group, todo = [i], [i]
        while todo:
            hit = np.flatnonzero(left & (near @ near[todo.pop()] >= TOGETHER))
            left[hit] = False
            group += hit.tolist()
            todo += hit.tolist()
        out.append(np.array(group))
    return out


def plan_shards(pivots: np.ndarray, weight: np.ndarray, most: float) -> tuple[np.ndarray, int]:
    """(shard of each cell, number of shards).

    Groups of close cells are halved by 2-means until a part holds at most
    ``most`` points; only a group that is larger itself is divided further.  A
    single cell that is larger is a shard of its own, to be divided by pivots
    of its own.
    """
    shard, n = np.zeros(len(pivots), np.int64), 0
    rng = np.random.default_rng(0)
    todo = [close_cells(pivots)]
    while todo:
        groups = todo.pop()
        cells = np.concatenate(groups)
        if weight[cells].sum() <= most or len(cells) == 1:
            shard[cells], n = n, n + 1
            continue
        if len(groups) == 1:
            groups = [np.array([c]) for c in cells]
        x = np.stack([pivots[g].mean(0) for g in groups])
        centres = x[rng.choice(len(x), 2, replace=False)]
        side = np.arange(len(x)) % 2 == 0
        for _ in range(8):
            lead = x @ centres[0] - x @ centres[1]
            cut_at = 0.0 if (lead > 0).any() and not (lead > 0).all() else np.median(lead)
            now = lead > cut_at
            if now.all() or not now.any():
                break
            side = now
            centres = np.stack([x[side].sum(0), x[~side].sum(0)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        todo += [[g for g, s in zip(groups, side) if s], [g for g, s in zip(groups, side) if not s]]
    return shard, n


@dataclass
class Cell:
    """How the points of one cell are divided: pivots with their shards, or, with ``parts``, by hash."""

    pivots: np.ndarray
    shard: np.ndarray
    weight: np.ndarray  # estimated points of each shard
    parts: int = 0

    def shards(self, x: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts, shards): the distinct shards of the pivots near each row, the nearest one's first.

        A pivot counts if it is among the ``visits`` nearest and within
        ``MARGIN`` of the nearest.
        """
        k = max(1, min(visits, len(self.pivots)))
        sims = x.astype(np.float32) @ self.pivots.T
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(sims, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
        s = np.where(value >= value[:, :1] - MARGIN, self.shard[top], -1)
        keep = s >= 0
        for j in range(1, k):
            keep[:, j] &= ~(s[:, :j] == s[:, j : j + 1]).any(1)
        return keep.sum(1), s[keep]

    def by_hash(self, hashes: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that no pivot tells apart: the own part and those after it, ``visits`` in all."""
        s = (hashes[:, None] + np.arange(min(visits, self.parts))) % self.parts
        return np.full(len(hashes), s.shape[1]), s.ravel()


def plan_cell(x: np.ndarray, n: float, most: int, n_pivots: int, last: bool = False) -> Cell:
    """The division of a cell of about ``n`` points from a sample of unit vectors in random order."""
    p = max(1, min(n_pivots, int(n) // POINTS_A_PIVOT, len(x)))
    pivots = np.ascontiguousarray(x[:p], np.float32)
    home = np.concatenate([(x[at : at + ROWS_AT_ONCE].astype(np.float32) @ pivots.T).argmax(1) for at in range(0, len(x), ROWS_AT_ONCE)])
    weight = np.bincount(home, minlength=p) * (n / len(x))
    shard, k = plan_shards(pivots.astype(np.float64), weight, most)
    total = np.bincount(shard, weights=weight, minlength=k)
    parts = min(-(-int(n) // most), CODES) if n > most * SLACK and (last or total.max() > 0.9 * n) else 0
    return Cell(pivots, shard, total, parts)


class Router:
    """A tree of pivots whose leaves, the shards, hold about ``SHARD_POINTS`` vectors each, however many there are.

    The root's pivots, at most ``MOST_PIVOTS``, are planned from a hash sample
    in the driver and broadcast.  A shard that is still too large becomes a
    cell with pivots of its own, planned from a sample of the cell in one task
    for each cell and joined to the cell's rows, which are salted; and so on.
    Vectors that pivots can't divide (copies) are divided by hash.
    """

    def __init__(self, points: DataFrame, key: str, vector: str = "vector", seed: int = 0, most: int = SHARD_POINTS, n_pivots: int = MOST_PIVOTS):
        """``points`` is read several times: cut it before."""
        self.n, self.seed, self.most, self.n_pivots = points.count(), seed, most, n_pivots
        self.spark = points.sparkSession
        self.levels: list[DataFrame] = []
        self.n_shards = 1
        wanted = n_pivots * SAMPLE_A_PIVOT
        h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30))
        share = min(1.0, (1.1 * wanted + 256) / max(self.n, 1))
        rows = points.where(h < int(share * (1 << 30)) + 1).orderBy(h, key).limit(wanted).select(vector).collect()
        self.root = plan_cell(unit(np.array([r[0] for r in rows], np.float64)), self.n, most, n_pivots) if rows else None
        if self.root is None:
            return
        self.n_shards, self.dense = len(self.root.weight), True
        self.shared = self.spark.sparkContext.broadcast(self.root)  # at most MOST_PIVOTS pivots
        heavy = [(int(s), float(w)) for s, w in enumerate(self.root.weight) if w > most * SLACK]
        cells = self.spark.createDataFrame(heavy, "cell bigint, weight double") if heavy else None
        while cells is not None:
            cells = self._deepen(points.select(F.col(key).alias("_key"), F.col(vector).alias("vector")), cells)

    def _deepen(self, points: DataFrame, cells: DataFrame) -> DataFrame | None:
        """Plan one more level for ``cells`` (cell, weight); the cells that are still too large."""
        self.dense = False
        home = self.place(points, "_key", 1).withColumnRenamed("shard", "cell")
        rate = F.col("weight") / F.lit(float(self.n_pivots * SAMPLE_A_PIVOT))
        h = F.pmod(F.xxhash64("_key", F.lit(self.seed + 1 + len(self.levels))), F.lit(1 << 30))
        sample = home.join(cells, "cell").where(h * rate < F.lit(1 << 30)).select("cell", "weight", h.alias("h"), "vector")
        most, n_pivots, last = self.most, self.n_pivots, len(self.levels) + 1 == MOST_LEVELS

        def plan(t: pa.Table) -> pa.Table:
            t = t.sort_by("h")
            c = plan_cell(unit(matrix(t.column("vector"))), t.column("weight")[0].as_py(), most, n_pivots, last)
            s = t.column("cell")[0].as_py()
            heavy = np.flatnonzero((c.weight > most * SLACK) & (c.parts == 0))
            return pa.table({
                "cell": pa.array([s], pa.int64()), "pivots": pa.array([b"" if c.parts else c.pivots.tobytes()]), "size": pa.array([c.pivots.shape[1]], pa.int32()),
                "local": pa.array([c.shard.tolist()], pa.list_(pa.int64())), "parts": pa.array([c.parts], pa.int32()), "n_shards": pa.array([max(c.parts, len(c.weight))], pa.int64()),
                "salts": pa.array([-(-int(t.column("weight")[0].as_py() * max(4, c.parts)) // COGROUP_ROWS)], pa.int64()),
                "heavy": pa.array([[{"cell": (s + 1) * CODES + int(k), "weight": float(c.weight[k])} for k in heavy]], pa.list_(pa.struct([("cell", pa.int64()), ("weight", pa.float64())]))),
            })

        table = cut(sample.groupBy("cell").applyInArrow(plan, "cell bigint, pivots binary, size int, local array<bigint>, parts int, n_shards bigint, salts bigint, heavy array<struct<cell:bigint,weight:double>>"))
        self.levels.append(table)
        self.n_shards += int(table.agg(F.sum("n_shards")).first()[0] or 0)
        rest = cut(table.select(F.explode("heavy").alias("h")).select("h.*"))
        return None if rest.isEmpty() else rest

    def place(self, rows: DataFrame, key: str, visits: int = VISITS, whole: bool = False) -> DataFrame:
        """``rows`` (key, vector and any others) once at home and once as a visitor of every other shard they ask.

        With ``whole`` they ask all parts of a cell that is divided by hash.
        Adds ``shard`` (bigint) and ``visitor``.  Vectors need not have unit length.
        """
        shared, kind = self.shared, rows.schema
        fields = [f for f in kind.fields if f.name != "vector"]
        given = rows.select("vector", *[f.name for f in fields])
        routed = T.StructType([*given.schema.fields, T.StructField("shards", T.ArrayType(T.LongType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    b = whole.slice(at, ROWS_AT_ONCE)
                    counts, s = shared.value.shards(unit(matrix(b.column(0))), visits)
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(s.astype(np.int64)))], names=[f.name for f in routed])

        out = given.mapInArrow(run, routed).select(*[f.name for f in fields], "vector", F.posexplode("shards").alias("_pos", "shard")).withColumn("visitor", F.col("_pos") > 0).drop("_pos")
        for depth, table in enumerate(self.levels):
            out = self._descend(out, key, table, depth, visits, whole)
        return out

    def _descend(self, placed: DataFrame, key: str, table: DataFrame, depth: int, visits: int, whole: bool) -> DataFrame:
        """One level down for the rows in the cells of ``table``; rows of a cell are salted."""
        small = table.select(F.col("cell").alias("shard"), "salts")
        seen = placed.join(small, "shard", "left")
        stay = seen.where("salts is null").drop("salts")
        salt = F.pmod(F.xxhash64(F.col(key), F.lit(depth)), F.col("salts"))
        move = seen.where("salts is not null").withColumn("_salt", salt).withColumn("_hash", F.pmod(F.xxhash64(F.col(key), F.lit(-1)), F.lit(1 << 40))).drop("salts")
        cells = table.select(F.col("cell").alias("shard"), "pivots", "size", "local", "parts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"))
        names = placed.columns

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return left.select(names).slice(0, 0)
            r = {k: right.column(k)[0].as_py() for k in ("shard", "pivots", "size", "local", "parts")}
            cell = Cell(np.frombuffer(r["pivots"], np.float32).reshape(-1, r["size"]), np.array(r["local"]), np.zeros(0), r["parts"])
            visitor = left.column("visitor").to_numpy().astype(bool)
            parts = []
            for side, most in ((False, visits), (True, min(visits, DEEP_VISITS))):
                asked = cell.parts if whole else 2 if most > 1 and not side else 1  # of the parts by hash
                step = max(1, ROWS_AT_ONCE // max(asked, 1))
                for at in range(0, int((visitor == side).sum()), step):
                    rows = np.flatnonzero(visitor == side)[at : at + step]
                    b = left.take(pa.array(rows))
                    if cell.parts:
                        counts, s = cell.by_hash(b.column("_hash").to_numpy(), asked)
                    else:
                        counts, s = cell.shards(unit(matrix(b.column("vector"))), most)
                    again = np.repeat(np.arange(len(rows)), counts)
                    first = np.append(True, np.diff(again) > 0) if len(again) else np.zeros(0, bool)
                    t = b.select(names).take(pa.array(again))
                    t = t.set_column(names.index("shard"), "shard", pa.array((r["shard"] + 1) * CODES + s, pa.int64()))
                    parts.append(t.set_column(names.index("visitor"), "visitor", pa.array(side | ~first)))
            return pa.concat_tables(parts)

        grouped = move.groupBy("shard", "_salt").cogroup(cells.groupBy("shard", "_salt"))
        return stay.select(*names).unionByName(grouped.applyInArrow(run, placed.schema))

    def gather(self, placed: DataFrame, *order: str) -> DataFrame:
        """Each shard whole in one partition, sorted by ``shard`` and ``order``."""
        parts = self.n_shards if self.dense else self.n_shards | 1
        return placed.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", *order)


def _spread(rows: np.ndarray, ids: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Answers (row, distinct vector) as (row, member): up to ``most`` members of each vector."""
    counts = np.minimum(np.diff(starts)[ids], most)
    again = np.repeat(np.arange(len(ids)), counts)
    offset = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
    return rows[again], starts[ids[again]] + offset


def _few_copies(points: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(points, rest): of each vector the points with the ``most`` least labels; the others with the last of those as ``lead``.

    ``rest`` is None if no vector has more copies.  ``points`` is cut.
    """
    code = F.xxhash64("vector")
    often = cut(points.groupBy(code.alias("_code")).count().where(F.col("count") > most).select("_code"))
    if often.isEmpty():
        return points, None
    many = cut(points.withColumn("_code", code).join(often, "_code", "left_semi").select("label", "vector"))
    kept = cut(many.withColumn("_no", F.row_number().over(Window.partitionBy("vector").orderBy("label"))).where(F.col("_no") <= most))
    more = cut(many.join(kept.select("label"), "label", "left_anti"))
    lead = cut(kept.where(F.col("_no") == most).select("vector", F.col("label").alias("lead")))
    rest = cut(lookup_join(more, lead, "vector").select("label", "lead"))
    return cut(points.join(rest.select("label"), "label", "left_anti")), rest


def most_similar(points: DataFrame, k: int = 5, beam: int = BEAM, shard_points: int = SHARD_POINTS, n_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(label, neighbour, cosine, rank): the ``k`` most similar other vectors of every vector.

    Vectors are routed to shards through a pivot tree; every shard is indexed
    whole as a robust-pruned graph of its distinct vectors; each vector queries
    its own shard, starting from itself, and those of the pivots near it, and
    the best answers are merged.  Cosines are exact (float64); ties go to the
    smaller label.  Fewer than two points give no rows.

    Of equal vectors those with the k + 1 least labels are indexed: no answer
    names another, and the others' answers are those of the last of them.  In
    cells that no pivot divides (vectors equal but for rounding) every part is
    asked.
    """
    points, rest = _few_copies(cut(points.select("label", F.col("vector").cast("array<float>").alias("vector"))), k + 1)
    router = Router(points, "label", most=shard_points, n_pivots=n_pivots)
    if router.root is None:
        return points.sparkSession.createDataFrame([], "label string, neighbour string, cosine double, rank int")
    placed = router.gather(router.place(points, "label", whole=True), "visitor", "label")
    beam = max(beam, k + 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, held = None, [], []
        graph = labels = exact = starts = None

        def best(asked: pa.Array, q: np.ndarray, row: np.ndarray, ids: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            """The k best members for each row; ``own`` is the row's own position or -1."""
            row, hit = _spread(row, ids, starts, k + 1)
            other = hit != own[row]
            row, hit = row[other], hit[other]
            cosine = np.einsum("ij,ij->i", q[row], exact[hit])
            order = np.lexsort((hit, -cosine, row))  # members stand in the order of their labels within a vector
            row, hit, cosine = row[order], hit[order], cosine[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < k
            return pa.RecordBatch.from_arrays([asked.take(pa.array(row[top])), labels.take(pa.array(hit[top])), pa.array(cosine[top])], names=["label", "neighbour", "cosine"])

        def members() -> Iterator[pa.RecordBatch]:
            """Index what is held and answer for it."""
            nonlocal graph, labels, exact, starts, names, held
            labels, exact = pa.chunked_array(names).combine_chunks(), unit(np.vstack(held))
            names, held = [], []
            small = np.ascontiguousarray(exact, np.float32)
            _, vector = np.unique(small.view(f"V{small.shape[1] * 4}").ravel(), return_inverse=True)
            order = np.argsort(vector, kind="stable")  # equal vectors side by side, by label
            labels, exact = labels.take(pa.array(order)), exact[order]
            starts = np.append(np.flatnonzero(np.diff(vector[order], prepend=-1)), len(order))
            graph = Graph(small[order][starts[:-1]])
            for at in range(0, graph.n, ROWS_AT_ONCE):
                some = np.arange(at, min(at + ROWS_AT_ONCE, graph.n))
                ids, _ = graph.around(some, beam)
                lo, hi = starts[some[0]], starts[some[-1] + 1]
                copies = np.diff(starts)[some]
                each = np.repeat(np.arange(len(some)), copies)
                row, col = np.nonzero(ids[each] >= 0)
                yield best(labels.slice(lo, hi - lo), exact[lo:hi], row, ids[each][row, col], np.arange(lo, hi))

        for whole in batches:
            code = whole.column(0).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code))
            at = 0
            for end in ends:
                b, at = whole.slice(at, end - at), end
                if not b.num_rows:
                    continue
                s = b.column(0)[0].as_py()
                if s != now:
                    if names:
                        yield from members()
                    now, graph = s, None
                visitor = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                split = int((~visitor).sum())
                if split:
                    names.append(b.column(2).slice(0, split))
                    held.append(matrix(b.column(3).slice(0, split)))
                if split < len(visitor):
                    if names:
                        yield from members()
                    if graph is not None:
                        q = unit(matrix(b.column(3).slice(split)))
                        ids, _ = graph.search(q.astype(np.float32), beam)
                        row, col = np.nonzero(ids >= 0)
                        yield best(b.column(2).slice(split), q, row, ids[row, col], np.full(len(q), -1))
        if names:
            yield from members()

    found = placed.select("shard", "visitor", "label", "vector").mapInArrow(run, "label string, neighbour string, cosine double")
    order = Window.partitionBy("label").orderBy(F.desc("cosine"), "neighbour")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if rest is None:
        return found
    found = cut(found)
    given = found.join(rest.select(F.col("lead").alias("label")).distinct(), "label", "left_semi")
    given = cut(given.groupBy(F.col("label").alias("lead")).agg(F.collect_list(F.struct("neighbour", "cosine", "rank")).alias("_given")))
    return found.unionByName(lookup_join(rest, given, "lead").select("label", F.explode("_given").alias("g")).select("label", "g.*"))


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """(label_a, label_b, cosine) of the neighbours with at least this cosine, once each, label_a < label_b."""
    a, b = F.least("label", "neighbour"), F.greatest("label", "neighbour")
    return neighbours.where(F.col("cosine") >= least).groupBy(a.alias("label_a"), b.alias("label_b")).agg(F.max("cosine").alias("cosine"))
