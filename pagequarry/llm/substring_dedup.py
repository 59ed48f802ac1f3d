"""Substring dedup over words by de Bruijn compaction.

The graph: a window of `window` words is an edge between two nodes, its first and its last window - 1 words.  Edges are dealt by the k-mer of least hash
inside them, so that equal edges meet; joins on those k-mers bring the paths of edges that more than one document walks (spans.py).

In a partition, equal edges become one, with the source coordinates (smallest doc_id, position there) of all its occurrences.  A node with one edge in and one
edge out does not branch: edges in a row over such nodes, whose sources are neighbours too, compact to one run with one source.
The runs come back to the documents that walk them.  Where runs of neighbouring sources follow each other, also across partitions, they are joined to one long passage, and
that is verified at its source coordinates: the words there are the words here.  A document loses every word covered by a window that starts
in a document with a smaller doc_id as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import TOKEN_BASE, U64, list_of, mix, ranges, within
from pagequarry.llm.spans import Block, Paths, Windows, repeated_windows


def compact_graph(paths: Paths) -> tuple[np.ndarray, ...]:
    """Resolves the paths of a partition (see spans.repeated_windows): the payload of a path of n edges is its n + 1 nodes."""
    # equal paths are one, with the least source and the largest doc_id
    order = np.lexsort((paths.at, paths.low, paths.path))
    ranked = paths.path[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    answer = np.empty(len(order), np.int64)
    answer[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    high = np.maximum.reduceat(paths.high[order], heads)
    paths = paths.pick(order[heads])
    count = paths.count
    tail_at = ranges(np.cumsum(paths.size) - paths.size, count)
    tail, head = paths.data[tail_at], paths.data[tail_at + 1]
    # equal edges are one
    edge = mix(tail * U64(TOKEN_BASE) + head)
    doc, at = np.repeat(paths.low, count), np.repeat(paths.at, count) + within(count)
    order = np.lexsort((at, doc, edge))
    ranked = edge[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    heads = np.flatnonzero(first)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first) - 1
    one = order[heads]
    source, place = doc[one], at[one]
    repeated = source < np.maximum.reduceat(np.repeat(high, count)[order], heads)
    # a node that does not branch: one edge in, one edge out
    node = np.unique(np.concatenate([tail[one], head[one]]), return_inverse=True)[1]
    degree_out, degree_in = (np.bincount(x, minlength=int(node.max()) + 1) for x in (node[: len(one)], node[len(one) :]))
    straight = ((degree_out == 1) & (degree_in == 1))[node[len(one) :]]
    left, right = number[:-1], number[1:]
    joined = straight[left] & repeated[left] & repeated[right] & (source[left] == source[right]) & (place[left] + 1 == place[right])
    starts = np.concatenate([[True], ~joined])
    starts[np.cumsum(count) - count] = True
    return answer, count, source[number], place[number], starts


def runs_of(removed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal removed runs within each document, in tokens of the document."""
    if not len(removed):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(len(removed) + 1, bool)
    edge[bounds] = True
    first, last = removed.copy(), removed.copy()
    first[1:] &= ~removed[:-1] | edge[1:-1]
    last[:-1] &= ~removed[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(bounds, s, side="right") - 1
    return s - bounds[doc], e - bounds[doc], doc


def _joined(block: Block, removed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the kept words, joined by one space."""
    keep = np.flatnonzero(~removed)
    owner = np.searchsorted(block.bounds, keep, side="right") - 1
    length = block.ends[keep] - block.starts[keep]
    is_last = np.ones(len(keep), bool)
    is_last[:-1] = owner[1:] != owner[:-1]
    size = length + ~is_last
    out = np.full(int(size.sum()), 0x20, np.uint8)
    out[ranges(np.cumsum(size) - size, length)] = block.buf[ranges(block.starts[keep], length)]
    return out, np.concatenate([[0], np.cumsum(np.bincount(owner, weights=size, minlength=n).astype(np.int64))])


def _laid_out(block: Block, s: np.ndarray, e: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts without the removed runs: each goes with the white space behind it."""
    first, last = s + block.bounds[doc], e + block.bounds[doc]
    # kept stretches: from a document's start or the end of a run, to the next run or the document's end
    stop = np.where(last < block.bounds[doc + 1], np.append(block.starts, 0)[np.minimum(last, len(block.starts))], block.ends[last - 1] if len(last) else last)
    begins = np.concatenate([block.offsets[:-1], stop])
    ends = np.concatenate([block.offsets[1:], block.starts[first]])
    owner = np.concatenate([np.arange(len(block.offsets) - 1), doc])
    begins, ends = begins[np.lexsort((begins, owner))], ends[np.lexsort((ends, owner))]
    raw = block.buf.tobytes()
    kept = b"".join([raw[x:y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)])
    size = np.bincount(np.sort(owner), weights=ends - begins, minlength=len(block.offsets) - 1).astype(np.int64)
    return np.frombuffer(kept, np.uint8), np.concatenate([[0], np.cumsum(size)])


def _cutter(layout: bool):
    def cut(table: pa.Table, block: Block, ids: np.ndarray, removed: np.ndarray) -> pa.Table:
        bounds, n = block.bounds, table.num_rows
        s, e, doc = runs_of(removed, bounds)
        out, ends = _laid_out(block, s, e, doc) if layout else _joined(block, removed, n)
        kept = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())
        lost = np.diff(np.concatenate([[0], np.cumsum(removed)])[bounds])
        spans = np.bincount(doc, minlength=n)
        columns = {"n_words": pa.array(np.diff(bounds)), "n_removed": pa.array(lost), "starts": list_of(s, spans), "ends": list_of(e, spans), "kept": kept}
        names = [c for c in table.column_names if c not in ("text", "block")]
        return pa.table([*[table.column(c) for c in names], *columns.values()], names=[*names, *columns])

    return cut


RESULT = ("text", "block", "n_words", "n_removed", "starts", "ends", "kept")


def remove_repeated_words(docs: DataFrame, window: int = 50, k: int = 12, layout: bool = False, seed: int = 0) -> DataFrame:
    """All columns of docs but text, and n_words, n_removed, starts and ends (word positions of the removed runs), kept string.

    kept: the kept words joined by one space; with `layout`, the text as it was without the removed runs.

    docs: doc_id, text and more; columns that clash with the result's are replaced.  Null and empty texts have no words.  A null doc_id takes no
    part and is kept whole.  Documents with fewer than `window` words lose nothing.  Rows that repeat a doc_id do not count as smaller than
    each other.  Empty input: empty result.  The job stops (spans.Collision) if unlike words or windows meet in a 64-bit hash; `seed` changes those.
    """
    keep = [c for c in docs.columns if c.lower() not in (*RESULT, "doc_id")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text"))
    fields = [f for f in docs.schema.fields if f.name != "text"]
    long = T.LongType()
    schema = T.StructType(
        [*fields, T.StructField("n_words", long), T.StructField("n_removed", long), T.StructField("starts", T.ArrayType(long)), T.StructField("ends", T.ArrayType(long)), T.StructField("kept", T.StringType())]
    )
    return repeated_windows(docs, Windows(window, k, True, seed), compact_graph, _cutter(layout), schema)
