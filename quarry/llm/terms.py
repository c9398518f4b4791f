"""Frequency of every distinct term: a vertical index of compressed bitmaps.

Each task numbers its records densely and turns every 32,768 of them (a chunk)
into one container per term: the sorted 16-bit positions of its records while
there are fewer than 2,048, else the 4,096-byte bitmap of Spark's bitmap
functions; beside it stands the number of occurrences.  The containers are
brought together by term and merged by union chunk by chunk; a term's merged
index is the list of its chunks' containers, which share no record, and its
document frequency the cardinality of that list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import clean_name
from quarry.session import cut

CHUNK = 1 << 15
BITMAP_BYTES = CHUNK // 8
TOKENS_AT_ONCE = 4_000_000
RARE, COMMON = "rare", "common"


def pack(positions: np.ndarray) -> bytes:
    """The container of sorted distinct positions in a chunk."""
    if len(positions) * 2 < BITMAP_BYTES:
        return positions.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    """The sorted positions of a container."""
    if len(container) < BITMAP_BYTES:
        return np.frombuffer(container, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little")).astype("<u2")


def cardinality(container: Column) -> Column:
    """How many records a container holds."""
    return F.when(F.octet_length(container) < BITMAP_BYTES, F.expr("cast(0 as bigint)") + F.octet_length(container) / 2).otherwise(F.bitmap_count(container)).cast("bigint")


def _containers(lists: list[pa.Array], chunk: int) -> pa.RecordBatch:
    """One row for each term of the chunk, and one with a null term for the records that hold any."""
    terms = pa.chunked_array(lists)
    lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
    flat = pa.chunked_array([x.flatten() for x in terms.chunks]).combine_chunks().dictionary_encode()
    record = np.repeat(np.arange(len(lengths)), lengths)
    pairs, times = np.unique(flat.indices.to_numpy().astype(np.int64) * CHUNK + record, return_counts=True)
    code, position = pairs // CHUNK, (pairs % CHUNK).astype(np.uint16)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.append(starts[1:], len(code))
    maps = [pack(position[a:b]) for a, b in zip(starts, ends)]
    occurrences = np.add.reduceat(times, starts) if len(starts) else times
    names = flat.dictionary.take(pa.array(code[starts])).cast(pa.string())
    holding = np.flatnonzero(lengths)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([names, pa.array([None], pa.string())]),
            pa.array(np.full(len(maps) + 1, chunk)),
            pa.array([*maps, pack(holding)], pa.binary()),
            pa.array(np.append(occurrences, lengths.sum()).astype(np.int64)),
        ],
        names=["term", "chunk", "bitmap", "n_occurrences"],
    )


def _index_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    held: list[pa.Array] = []
    records = tokens = 0
    for batch in batches:
        lists, at = batch.column(0), 0
        while at < len(lists):
            part = lists.slice(at, CHUNK - records)
            held.append(part)
            at, records, tokens = at + len(part), records + len(part), tokens + len(part.flatten())
            if records == CHUNK or tokens > TOKENS_AT_ONCE:
                yield _containers(held, chunk)
                held, records, tokens, chunk = [], 0, 0, chunk + 1
    if held:
        yield _containers(held, chunk)


def bitmap_index(records: DataFrame, terms: str) -> DataFrame:
    """(term, chunk, bitmap, n_occurrences) of the string lists in column ``terms``.

    The rows with a null term hold the records with at least one term.  Null
    lists count as empty, null terms nowhere.  Records are numbered within
    their task, so nothing is shuffled.
    """
    lists = F.filter(F.coalesce(F.col(terms), F.array().cast("array<string>")), lambda t: t.isNotNull())
    return records.select(lists.alias("terms")).mapInArrow(_index_partition, "term string, chunk bigint, bitmap binary, n_occurrences bigint")


def _union_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by term and chunk to one row for each term and chunk: their union and the sum of the counters."""

    def united(t: pa.Table) -> pa.RecordBatch:
        terms, chunks, n = t.column("term").combine_chunks(), t.column("chunk").to_numpy(), t.column("n_occurrences").to_numpy()
        same = pc.equal(terms.slice(1), terms.slice(0, len(terms) - 1)).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        null = pc.is_null(terms).to_numpy(zero_copy_only=False)
        same |= null[1:] & null[:-1]
        head = np.flatnonzero(np.append(True, ~(same & (chunks[1:] == chunks[:-1]))))
        length = np.diff(np.append(head, len(terms)))
        maps = t.column("bitmap").combine_chunks().take(pa.array(head))
        if (length > 1).any():
            each = maps.to_pylist()
            for i in np.flatnonzero(length > 1):
                several = t.column("bitmap").slice(int(head[i]), int(length[i])).to_pylist()
                each[i] = pack(np.unique(np.concatenate([unpack(c) for c in several])))
            maps = pa.array(each, pa.binary())
        return pa.RecordBatch.from_arrays([terms.take(pa.array(head)), pa.array(chunks[head]), maps, pa.array(np.add.reduceat(n, head))], names=["term", "chunk", "bitmap", "n_occurrences"])

    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        last = t.slice(t.num_rows - 1).to_pylist()[0]
        end = t.num_rows - 1
        while end and t.column("chunk")[end - 1].as_py() == last["chunk"] and t.column("term")[end - 1].as_py() == last["term"]:
            end -= 1
        if end:
            yield united(t.slice(0, end))
        rest = t.slice(end)
    if rest is not None:
        yield united(rest)


def union_bitmaps(index: DataFrame) -> DataFrame:
    """(term, chunk, bitmap, n_occurrences): the containers of each term and chunk merged by union, all of a term in one partition."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("term", "chunk", "bitmap", "n_occurrences").repartition(parts, "term").sortWithinPartitions("term", "chunk")
    return placed.mapInArrow(_union_partition, "term string, chunk bigint, bitmap binary, n_occurrences bigint")


def term_frequencies(records: DataFrame, terms: str, rare_below: int = 5, common_above: float = 0.25) -> DataFrame:
    """(term, n_occurrences, n_records, share, mark) for every distinct term.

    ``share`` is the part of the records holding any term that hold this one.
    ``mark`` is ``rare`` below ``rare_below`` occurrences, ``common`` above the
    share ``common_above`` and null otherwise; a term that is both is rare.
    Counts are exact.  An empty table gives no rows.
    """
    totals = union_bitmaps(bitmap_index(records, terms)).groupBy("term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum(cardinality(F.col("bitmap"))).alias("n_records"))
    totals = cut(totals)
    everything = totals.where("term is null").select(F.col("n_records").alias("n_all"))  # one row
    share = F.col("n_records") / F.col("n_all")
    mark = F.when(F.col("n_occurrences") < rare_below, RARE).when(F.col("n_records") > F.col("n_all") * F.lit(common_above), COMMON)
    return totals.where("term is not null").join(F.broadcast(everything)).select("term", "n_occurrences", "n_records", share.alias("share"), mark.alias("mark"))


def latest_walks(walks: DataFrame) -> DataFrame:
    """One row for each walk: the one loaded last, a null time being the earliest.

    Among equal times the later walk time and then the greater token list
    wins.  Rows without a walk_id are each a walk of their own, equal ones once.
    """
    alone = F.when(F.col("walk_id").isNull(), F.struct("loaded_at", "walked_at", "tokens"))
    newest = F.max(F.struct("loaded_at", "walked_at", "tokens")).alias("w")
    return walks.groupBy("walk_id", alone.alias("alone")).agg(newest).select("walk_id", "w.tokens")


def walk_labels(walks: DataFrame) -> DataFrame:
    """(walk_id, labels): the latest walks with their labels as names; null and blank tokens are left out."""
    names = F.filter(F.transform("tokens", clean_name), lambda t: t.isNotNull())
    return latest_walks(walks).select("walk_id", names.alias("labels"))
