"""Sums over the pairs of items that stand together, without a row for each pair of a basket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG = 4096
PAIRS_IN_MEMORY, SUMS_IN_MEMORY = 2_000_000, 2_000_000


def merge_sums(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) with equal keys added up."""
    key, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    return key[head], np.add.reduceat(n, head) if len(head) else n


def pair_codes(codes: np.ndarray, length: np.ndarray, slices: np.ndarray, n_codes: int, long: int = LONG, most: int = PAIRS_IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair code, place of its first item) of the pairs within runs of ascending codes, about ``most`` at a time.

    An item pairs with those after it if its block of ``long`` places in the
    run is its ``slices``; so the pairs of a long run may be divided.
    """
    starts = np.cumsum(length) - length
    place = np.arange(len(codes)) - np.repeat(starts, length)
    partners = np.where(place // long == slices, np.repeat(length, length) - 1 - place, 0)
    done = np.cumsum(partners)
    at = 0
    while at < len(codes):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, "right")))
        some = partners[at:end]
        first = np.repeat(np.arange(at, end), some)
        step = np.arange(len(first)) - np.repeat(np.cumsum(some) - some, some)
        yield codes[first] * n_codes + codes[first + 1 + step], first
        at = end


def pair_sums(n_codes: int, long: int = LONG, most: int = PAIRS_IN_MEMORY) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (basket, slice, code, wgt), sorted, to (code_a, code_b, total): the partition's pairs, code_a < code_b, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sums[0] // n_codes), pa.array(sums[0] % n_codes), pa.array(sums[1].astype(float))], names=["code_a", "code_b", "total"])

        def count(t: pa.Table, last: bool) -> tuple[pa.Table | None, list[tuple[np.ndarray, np.ndarray]]]:
            """What is left of an unfinished basket, and the sums of the others."""
            if not t.num_rows:
                return None, []
            change = np.zeros(t.num_rows - 1, bool)
            for c in ("basket", "slice"):
                v = t.column(c).combine_chunks()
                change |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False).astype(bool)
            starts = np.append(0, np.flatnonzero(change) + 1)
            whole = t.num_rows if last else int(starts[-1])
            length = np.diff(np.append(starts[starts < whole], whole))
            codes, slices, wgt = (t.column(c).to_numpy()[:whole] for c in ("code", "slice", "wgt"))
            sums = []
            for key, first in pair_codes(codes, length, slices, n_codes, long, most):
                if len(key):
                    sums.append(merge_sums([(key, wgt[first])]))
            return (None if last else t.slice(whole)), sums

        waiting: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            waiting.append(b)
            size += b.num_rows
            if size < max(100_000, rest.num_rows if rest is not None else 0):
                continue
            t = pa.Table.from_batches(waiting)
            rest, sums = count(pa.concat_tables([rest, t]) if rest is not None else t, False)
            waiting, size = [], 0
            held += sums
            if sum(len(h[0]) for h in held) > SUMS_IN_MEMORY:
                held = [merge_sums(held)]
                if len(held[0][0]) > SUMS_IN_MEMORY // 2:
                    yield rows(held.pop())
        tables = ([rest] if rest is not None else []) + ([pa.Table.from_batches(waiting)] if waiting else [])
        if tables:
            held += count(pa.concat_tables(tables), True)[1]
        if held:
            yield rows(merge_sums(held))

    return run
