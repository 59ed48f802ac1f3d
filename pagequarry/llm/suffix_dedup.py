"""Substring dedup over bytes with Burrows-Wheeler transforms of shards.

The byte paths that can repeat at all (spans.py) are the strings of a small text collection in each hash partition.  A shard is the share that a group of
blocks of documents has in it, equal strings once.  Each shard gets a suffix order and a BWT; the BWTs are merged by refining
their interleave: one pass of the LF mapping extends the sorted prefix by `step` bytes, and the borders between
neighbours that part in that pass give their common prefixes.  After window / step passes the places whose common prefix is a whole window are the intervals
of repeated windows.  No suffix is compared or sorted again for the merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import U64, distinct_spans, list_of, ranges
from pagequarry.llm.spans import Block, Paths, Windows, repeated_windows
from pagequarry.llm.substring_dedup import runs_of

SHARDS = 4


def _ranks(code: np.ndarray) -> tuple[np.ndarray, int]:
    """(rank of each value among the distinct ones, how many there are)."""
    order = np.argsort(code)
    ranked = code[order]
    rank = np.zeros(len(code), U64)
    rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])).astype(U64)[: len(code)]
    return rank, int(rank.max()) + 1 if len(code) else 0


class Collection:
    """Strings as rotations, each closed by `step` end marks; symbols are ranks of `step` bytes at a time."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, step: int):
        padded = sizes + step
        n = int(padded.sum())
        kind = np.int32 if n < (1 << 31) else np.int64
        self.starts = (np.cumsum(padded) - padded).astype(kind)
        self.string = np.repeat(np.arange(len(sizes), dtype=kind), padded)
        # bytes by their rank among those that occur, so that more symbols fit 64 bits; 0 is the end mark
        known = np.zeros(256, bool)
        known[data] = True
        base = int(known.sum()) + 1
        text = np.zeros(n, U64)
        text[ranges(self.starts.astype(np.int64), sizes)] = (np.cumsum(known) * known).astype(U64)[data]
        self.before = np.arange(n, dtype=kind) - kind(step)
        # the first and the last `step` places of a string look round its end
        wrap = (self.starts[:, None] + np.arange(step, dtype=kind)).ravel()
        self.before[wrap] += np.repeat(padded.astype(kind), step)
        last = wrap + np.repeat(sizes.astype(kind), step)
        inside = np.tile(np.arange(step, dtype=kind), len(sizes))
        # symbols joined one by one, ranked whenever the next would not fit
        code, radix = text.copy(), base
        for j in range(1, step):
            if radix > (1 << 64) // base:
                code, radix = _ranks(code)
            ahead = np.empty_like(text)
            ahead[:-j] = text[j:]
            round_ = inside + j >= step
            ahead[last[round_]] = text[np.minimum(self.starts.repeat(step)[round_] + inside[round_] + kind(j - step), n - 1)]
            code = code * U64(base) + ahead
            radix *= base
        rank, self.distinct = _ranks(code)
        self.rank = rank.astype(np.uint16 if self.distinct <= 65536 else np.int64)

    def suffix_order(self, positions: np.ndarray, passes: int) -> np.ndarray:
        """Positions in the order of their first passes * step bytes."""
        for _ in range(passes):
            positions = self.before[positions]
            positions = positions[np.argsort(self.rank[positions], kind="stable")]
        return positions


def merge(orders: list[np.ndarray], symbols: list[np.ndarray], passes: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(positions in merged order, common prefix of each place with the one before it): the interleave of the shards, refined from nothing.

    The interleave says which shard each place belongs to; the shard's own order says which suffix.  A pass reads the merged BWT and moves every
    place by the LF mapping, which is stable; places stay in one interval while they were in one before and have the same symbol.
    A border stays where it is once it is found, and the pass that finds it tells the common prefix there, a multiple of step (passes * step: at least that).
    """
    order, symbol = np.concatenate(orders), np.concatenate(symbols)
    shard = np.repeat(np.arange(len(orders)), [len(o) for o in orders]).astype(np.uint8)
    common = np.full(len(order), passes * step, np.int32)
    common[:1] = 0
    interval = None
    bwt = symbol.copy()
    for done in range(passes):
        if done:
            bwt[np.argsort(shard, kind="stable")] = symbol
        moved = np.argsort(bwt, kind="stable")
        shard, sorted_ = shard[moved], bwt[moved]
        border = sorted_[1:] != sorted_[:-1]
        if interval is not None:
            interval = interval[moved]
            border |= interval[1:] != interval[:-1]
        found = common[1:]
        found[border & (found == passes * step)] = done * step
        if done < passes - 1:
            interval = np.zeros(len(order), np.int32)
            np.cumsum(border, dtype=np.int32, out=interval[1:])
    merged = np.empty_like(order)
    merged[np.argsort(shard, kind="stable")] = order
    return merged, common


def least_codes(data: np.ndarray, count: np.ndarray, code: np.ndarray, shard: np.ndarray, window: int) -> np.ndarray:
    """Smallest code + offset over the equal windows of all strings, for every window of every string (count windows each), from the intervals of the merged transform."""
    sizes = count + window - 1
    for step in [s for s in (10, 5, 2, 1) if window % s == 0]:
        strings = Collection(data, sizes, step)
        if strings.distinct <= 65536:
            break
    passes = window // step
    shard = shard[strings.string]
    orders = [strings.suffix_order(p, passes) for z in range(SHARDS) if len(p := np.flatnonzero(shard == z))]
    position, common = merge(orders, [strings.rank[strings.before[o]] for o in orders], passes, step)
    border = common < window
    heads = np.flatnonzero(border)
    offset = np.arange(len(position)) - strings.starts[strings.string]
    least = np.minimum.reduceat((code[strings.string] + offset)[position], heads)
    out = np.empty(len(position), np.int64)
    out[position] = np.repeat(least, np.diff(np.append(heads, len(position))))
    return out[offset < count[strings.string]]


def resolver(window: int, chunk_tokens: int = 1 << 16):
    def resolve(paths: Paths) -> tuple[np.ndarray, ...]:
        """Resolves the paths of a partition (see spans.repeated_windows): the payload of a path is its bytes."""
        # within a shard equal strings are one, byte for byte, with the least source and the largest doc_id
        ends = np.cumsum(paths.size)
        same = distinct_spans(paths.data, ends - paths.size, ends, paths.path)[0]
        shard = paths.row % SHARDS
        order = np.lexsort((paths.at, paths.low, same * SHARDS + shard, paths.key))
        ranked = (same * SHARDS + shard)[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        answer = np.empty(len(order), np.int64)
        answer[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        paths, shard = paths.pick(order[heads]), shard[order[heads]]
        # keys are independent and stand together: whole keys, some at a time, so that a merge stays in the cache
        new = np.concatenate([[True], paths.key[1:] != paths.key[:-1]])
        chunk = (np.cumsum(paths.size) // chunk_tokens)[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
        at = np.concatenate([[0], np.cumsum(paths.size)])
        source, place = [], []
        for s, e in zip(cuts, cuts[1:], strict=False):
            docs, rank = np.unique(paths.low[s:e], return_inverse=True)
            code = least_codes(paths.data[at[s] : at[e]], paths.count[s:e], (rank.astype(np.int64) << 32) + paths.at[s:e], shard[s:e], window)
            source.append(docs[code >> 32])
            place.append(code & 0xFFFFFFFF)
        source, place = np.concatenate(source), np.concatenate(place)
        starts = np.ones(len(source), bool)
        starts[1:] = (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)
        starts[np.cumsum(paths.count) - paths.count] = True
        return answer, paths.count, source, place, starts

    return resolve


def _cut_bytes(table: pa.Table, block: Block, ids: np.ndarray, removed: np.ndarray) -> pa.Table:
    bounds, n = block.bounds, table.num_rows
    s, e, doc = runs_of(removed, bounds)
    spans = np.bincount(doc, minlength=n)
    lost = np.diff(np.concatenate([[0], np.cumsum(removed)])[bounds])
    ends = np.concatenate([[0], np.cumsum(np.diff(bounds) - lost)])
    kept = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(block.buf[~removed].tobytes())]).cast(pa.binary())
    columns = {"n_bytes": pa.array(np.diff(bounds)), "n_removed": pa.array(lost), "starts": list_of(s, spans), "ends": list_of(e, spans), "kept": kept}
    names = [c for c in table.column_names if c not in ("text", "block")]
    return pa.table([*[table.column(c) for c in names], *columns.values()], names=[*names, *columns])


RESULT = ("text", "block", "n_bytes", "n_removed", "starts", "ends", "kept")


def remove_repeated_bytes(docs: DataFrame, window: int = 50, k: int = 16, seed: int = 0) -> DataFrame:
    """All columns of docs but text, and n_bytes, n_removed, starts and ends (byte positions of the removed runs), kept binary.

    docs: doc_id, text and more; columns that clash with the result's are replaced.  Null texts are empty.  A null doc_id takes no part and is kept
    whole.  Documents with fewer than `window` bytes lose nothing.  Rows that repeat a doc_id do not count as smaller than each other.
    What is kept may cut a character, so it is binary.  Empty input: empty result.  The job stops (spans.Collision) if unlike paths meet in a 64-bit hash;
    `seed` changes those.
    """
    keep = [c for c in docs.columns if c.lower() not in (*RESULT, "doc_id")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text"))
    fields = [f for f in docs.schema.fields if f.name != "text"]
    long = T.LongType()
    schema = T.StructType(
        [*fields, T.StructField("n_bytes", long), T.StructField("n_removed", long), T.StructField("starts", T.ArrayType(long)), T.StructField("ends", T.ArrayType(long)), T.StructField("kept", T.BinaryType())]
    )
    return repeated_windows(docs, Windows(window, k, False, seed), resolver(window), _cut_bytes, schema)
