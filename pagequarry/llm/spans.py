"""Repeated windows across documents: the exchange that substring dedup by words and by bytes share.

A *window* is `window` consecutive tokens of one document.  Every window has a key: the smallest hash of the k-grams
inside it.  A maximal run of windows with one key (cut after MOST windows) is a *path*.  Equal windows have equal keys, so a window can
repeat only along paths of one key.

1. Blocks of documents send their keys; a key that two documents have comes back.
2. Blocks send the paths of such keys, each distinct path once, with its source coordinates (smallest doc_id, position there) and its largest
   doc_id.  The caller's `resolve` finds the source of every window of all paths of a partition of keys: by a de Bruijn graph of words, or by merged
   Burrows-Wheeler transforms of bytes.
3. Runs of windows with neighbouring sources come back to the blocks that asked, which cover and cut their texts.
4. The passages that are to be cut, as long as their sources go on, are verified: their bytes are compared by a 128-bit blake2b digest with those at the
   source coordinates, in the block that holds the source.  Hashes of 64 bits only propose; should unlike texts have met, the job stops and
   asks for another `seed`, so a result is never decided by a hash.

Everything travels as packed rows between blocks and hash partitions, so a passage in very many documents
costs one entry for each block.  Whole-document copies (equal SHA-256 of the text) are found first and take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import (
    BYTE_BASE,
    MASK,
    TOKEN_BASE,
    U64,
    alone,
    bounded_batches,
    by_partition,
    deal,
    distinct_spans,
    kgrams,
    mix,
    power_tables,
    ranges,
    release,
    sliding_min,
    text_buffer,
    text_bytes,
    unpack,
    within,
    word_hashes,
)

COPY, KEYS, PATHS = 0, 1, 2
ANSWER = "block int, kind int, part int, id long, a binary, b binary, c binary, d binary, e binary"
EMPTY_ANSWER = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), *[(c, pa.binary()) for c in "abcde"]])
#: windows of a path
MOST = 256


class Collision(ValueError):
    """Unlike texts have one hash under this seed."""

    def __init__(self):
        super().__init__("unlike texts share a hash; run again with another seed")


@dataclass(frozen=True)
class Windows:
    """window tokens in a window, k in a key's gram; words or bytes; the seed of all hashes."""

    window: int
    k: int
    words: bool
    seed: int = 0

    @property
    def grams(self) -> int:
        return self.window - self.k + 1


class Block:
    """Tokens of a block's documents: bounds (n + 1), and the hashes of any stretch."""

    def __init__(self, column: pa.ChunkedArray, spec: Windows):
        self.spec = spec
        self.buf, self.offsets = text_buffer(column)
        if spec.words:
            self.hashes, self.starts, self.ends, self.bounds = word_hashes(self.buf, self.offsets, seed=spec.seed)
        else:
            self.bounds = self.offsets
            self.salt = U64((spec.seed * TOKEN_BASE) & MASK)
            self.values = mix(np.arange(1, 257, dtype=U64) * U64(BYTE_BASE) ^ self.salt)

    def grams(self, lo: int, hi: int) -> np.ndarray:
        """Mixed hash of every k-gram of a stretch of tokens."""
        k = self.spec.k
        if self.spec.words:
            return mix(kgrams(self.hashes[lo:hi], k))
        if k < 8:
            return mix(kgrams(self.values[self.buf[lo:hi]], k))
        # bytes go eight at a time, the last eight perhaps again in part
        n = max(0, hi - lo - k + 1)
        part = np.ascontiguousarray(self.buf[lo:hi])
        out = None
        for at in (*range(0, k - 8, 8), k - 8):
            eight = np.ndarray((n,), "<u8", buffer=part.data, offset=at, strides=(1,)).astype(U64) if n else np.zeros(0, U64)
            out = eight ^ self.salt if out is None else mix(out) * U64(TOKEN_BASE) + eight
        return mix(out)

    def compare_words(self) -> None:
        """Stops if unlike words of the block have one hash."""
        if self.spec.words and len(np.unique(self.hashes)) < len(distinct_spans(self.buf, self.starts, self.ends, self.hashes)[1]):
            raise Collision

    def nodes(self) -> np.ndarray:
        """The (window - 1)-gram at every word: a window is the edge between two of them."""
        return mix(kgrams(self.hashes, self.spec.window - 1))

    def digests(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """blake2b of each stretch of tokens, words joined by one space."""
        if self.spec.words:
            length = self.ends - self.starts
            at = np.cumsum(length + 1) - length - 1
            flat = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
            flat[ranges(at, length)] = self.buf[ranges(self.starts, length)]
            first, last = at[first], at[last - 1] + length[last - 1]
        else:
            flat = self.buf
        raw = memoryview(np.ascontiguousarray(flat))
        return [hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(first.tolist(), last.tolist(), strict=True)]

    def paths(self, active: np.ndarray, tile: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
        """(first token, windows, key, path hash, document index) of all paths of the active documents, by tiles of bounded size.

        A document longer than a tile is cut into overlapping tiles; a path cut there branches, which costs time but no window.
        """
        w, n = self.spec.window, len(self.bounds) - 1
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + tile, side="right")) - 1)
            lo, hi = int(self.bounds[at]), int(self.bounds[to])
            docs = np.flatnonzero(active[at:to]) + at
            if to == at + 1 and hi - lo > tile:
                if len(docs):
                    for a in range(lo, hi - w + 1, tile):
                        yield self._paths(a, min(a + tile + w - 1, hi), np.array([at]), np.array([0]), np.array([min(tile, hi - w + 1 - a)]))
            elif len(docs):
                sizes = np.maximum(self.bounds[docs + 1] - self.bounds[docs] - w + 1, 0)
                if sizes.any():
                    yield self._paths(lo, hi, docs, self.bounds[docs] - lo, sizes)
            at = to

    def _paths(self, lo: int, hi: int, docs: np.ndarray, first: np.ndarray, sizes: np.ndarray):
        spec = self.spec
        grams = self.grams(lo, hi)
        key = sliding_min(grams, spec.grams)
        at = ranges(first, sizes)
        key = key[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
        # two documents may stand side by side: a path ends with its document
        heads = np.cumsum(sizes) - sizes
        new[heads[sizes > 0]] = True
        head = np.flatnonzero(new)
        count = np.diff(np.concatenate([head, [len(at)]]))
        if len(count) and int(count.max()) > MOST:
            pieces = -(-count // MOST)
            step = within(pieces) * MOST
            head = np.repeat(head, pieces) + step
            count = np.minimum(np.repeat(count, pieces) - step, MOST)
        s = at[head]
        # mixed grams, not tokens: no two texts are bound to meet by the way they are made
        e = s + count + spec.grams - 1
        pw, inv = power_tables(TOKEN_BASE, len(grams) + 1)
        total = np.zeros(len(grams) + 1, U64)
        np.cumsum(grams * pw[: len(grams)], dtype=U64, out=total[1:])
        path = mix((total[e] - total[s]) * inv[s] + count.astype(U64) * U64(0xA24BAED4963EE407))
        return s + lo, count, key[head], path, np.repeat(docs, sizes)[head]

    def all_paths(self, active: np.ndarray) -> list[np.ndarray]:
        found = list(self.paths(active))
        if not found:
            return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)]
        return [np.concatenate(x) for x in zip(*found, strict=True)]


def grouped(values: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): entries sorted by value; a group starts at each head."""
    order = np.argsort(values, kind=kind)
    ranked = values[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)


def _active(docs: pa.Table, answers: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(rows by doc_id, doc ids, takes part, is a later copy)."""
    alone("spans")
    release()
    docs = docs.sort_by("doc_id")
    column = docs.column("doc_id")
    ids = column.fill_null(0).to_numpy() if column.null_count else column.to_numpy()
    known = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else np.ones(len(ids), bool)
    copies = answers.filter(pa.array(answers.column("kind").to_numpy() == COPY))
    marks = set(zip(copies.column("id").to_pylist(), copies.column("a").to_pylist(), strict=True))
    later = np.isin(ids, copies.column("id").to_numpy()) & known
    # a doc_id may have other texts as well
    text = docs.column("text")
    for i in np.flatnonzero(later).tolist():
        x = text[i].as_buffer()
        later[i] = x is not None and (int(ids[i]), hashlib.sha256(x).digest()) in marks
    return docs, ids.astype(np.int64), known & ~later, later


def _key_parts(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys & U64(0xFFFFFFFF)) % U64(parts)).astype(np.int64)


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


@dataclass
class Paths:
    """The paths of a partition, block by block: key, hash, source (low, at), largest doc_id, windows, and the flat payload with its size for each path."""

    key: np.ndarray
    path: np.ndarray
    low: np.ndarray
    at: np.ndarray
    high: np.ndarray
    count: np.ndarray
    data: np.ndarray
    size: np.ndarray
    row: np.ndarray

    def pick(self, i: np.ndarray) -> Paths:
        starts = np.cumsum(self.size) - self.size
        return Paths(*[getattr(self, c)[i] for c in ("key", "path", "low", "at", "high", "count")], self.data[ranges(starts[i], self.size[i])], self.size[i], self.row[i])


#: see repeated_windows
Resolve = Callable[[Paths], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def repeated_windows(docs: DataFrame, spec: Windows, resolve: Resolve, cut: Callable, schema: T.StructType, block_bytes: int = 4 << 20, part_keys: int = 1 << 19) -> DataFrame:
    """Runs the exchange over docs (doc_id long, text string, more columns) and cuts each block's documents.

    resolve(paths): (number of the resolved path for each path, windows of each resolved path, doc_id and position of the source of each of their windows, starts of runs).
    cut(table, block, doc ids, removed): rows of `schema` from a mask of removed tokens.
    Documents with a null doc_id take no part and lose nothing.  Rows that repeat a doc_id are one document as to order: neither
    counts as smaller than the other.
    """
    total = text_bytes(bounded_batches(docs))
    # blocks grow with the input up to 64 MB, so that what a partition gets from each stays more than a few entries
    block_bytes = min(max(block_bytes, total >> 16), 64 << 20)
    blocks = max(1, -(-total // block_bytes))
    a_byte = 0.009 if spec.words else 0.06  # distinct keys
    parts = deal(total * a_byte, block_bytes * a_byte, part_keys)
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    copies = later_copies(docs).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(COPY).alias("kind"), F.lit(0).alias("part"), F.col("doc_id").alias("id"), F.col("mark").alias("a"), *[F.lit(None).cast("binary").alias(c) for c in "bcde"]
    )
    by_block = docs.groupBy("block")

    def send_keys(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        docs_table, ids, active, _ = _active(docs_table, answers)
        _, _, key, _, doc = Block(docs_table.column("text"), spec).all_paths(active)
        rows = []
        if len(key):
            order, heads = grouped(key)
            own = ids[doc[order]]
            many = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
            key = key[order[heads]]
            block = docs_table.column("block")[0].as_py()
            rows = [(p, block, (key[i] >> U64(32)).astype(np.uint32).tobytes(), many[i].tobytes()) for p, i in by_partition(_key_parts(key, parts))]
        return _rows(["part", "block", "keys", "many"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()], rows)

    def match_keys(table: pa.Table) -> pa.Table:
        keys, many = unpack(table.column("keys"), np.uint32), unpack(table.column("many"), bool)
        order, heads = grouped(np.concatenate(keys))
        sizes = np.diff(np.concatenate([heads, [len(order)]]))
        hit = np.empty(len(order), bool)
        hit[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(np.concatenate(many)[order], heads), sizes)
        rows, at = [], 0
        for block, part, own in zip(table.column("block").to_pylist(), table.column("part").to_pylist(), keys, strict=True):
            found = own[hit[at : at + len(own)]]
            at += len(own)
            if len(found):
                rows.append((block, KEYS, part, None, found.tobytes(), None, None, None, None))
        return _rows(EMPTY_ANSWER.names, EMPTY_ANSWER.types, rows)

    def send_paths(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        docs_table, ids, active, _ = _active(docs_table, answers)
        block = Block(docs_table.column("text"), spec)
        block.compare_words()
        start, count, key, path, doc = block.all_paths(active)
        kind = answers.column("kind").to_numpy()
        wanted = [
            (U64(p) << U64(32)) | np.frombuffer(a, np.uint32).astype(U64)
            for k, p, a in zip(kind, answers.column("part").to_pylist(), answers.column("a").to_pylist(), strict=True)
            if k == KEYS
        ]
        rows = []
        if wanted and len(key):
            wanted = np.sort(np.concatenate(wanted))
            mine = (_key_parts(key, parts).astype(U64) << U64(32)) | (key >> U64(32))
            at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == mine)
            if len(hit):
                # rows are in the order of doc_id, so the first of equal paths has the source coordinates
                order, heads = grouped(path[hit], "stable")
                own = ids[doc[hit[order]]]
                low, high = own[heads], own[np.append(heads[1:], len(own)) - 1]
                one = hit[order[heads]]
                if not spec.words and len(heads) < len(hit) and len(distinct_spans(block.buf, start[hit], start[hit] + count[hit] + spec.window - 1, path[hit])[1]) > len(heads):
                    raise Collision
                payload, more = (block.nodes(), 1) if spec.words else (block.buf, spec.window - 1)
                number = docs_table.column("block")[0].as_py()
                for p, i in by_partition(_key_parts(key[one], parts)):
                    j = one[i]
                    data = payload[ranges(start[j], count[j] + more)]
                    position = (start[j] - block.bounds[doc[j]]).astype(np.int32)
                    rows.append((p, number, *[x.tobytes() for x in (key[j], path[j], low[i], position, high[i], count[j].astype(np.int32), data)]))
        return _rows(["part", "block", "key", "path", "low", "at", "high", "count", "data"], [pa.int32(), pa.int32(), *[pa.binary()] * 7], rows)

    def match_paths(table: pa.Table) -> pa.Table:
        key, path = (unpack(table.column(c), U64) for c in ("key", "path"))
        lengths = [len(k) for k in key]
        low, high = (np.concatenate(unpack(table.column(c), np.int64)) for c in ("low", "high"))
        position, count = (np.concatenate(unpack(table.column(c), np.int32)).astype(np.int64) for c in ("at", "count"))
        data = np.concatenate(unpack(table.column("data"), U64 if spec.words else np.uint8))
        block = np.array(table.column("block").to_pylist(), np.int64)
        paths = Paths(np.concatenate(key), np.concatenate(path), low, position, high, count, data, count + (1 if spec.words else spec.window - 1), np.repeat(block, lengths))
        # a key of one document repeats nothing
        order, heads = grouped(paths.key)
        members = np.diff(np.append(heads, len(order)))
        useful = np.empty(len(order), bool)
        useful[order] = np.repeat(np.minimum.reduceat(low[order], heads) < np.maximum.reduceat(high[order], heads), members)
        use = np.flatnonzero(useful)
        if not len(use):
            return _rows(EMPTY_ANSWER.names, EMPTY_ANSWER.types, [])
        answer, windows, source, place, starts_run = resolve(paths.pick(use))
        run = np.flatnonzero(starts_run)
        run_size = np.diff(np.append(run, len(source)))
        window_head = np.cumsum(windows) - windows
        runs = np.add.reduceat(starts_run.astype(np.int64), window_head)
        run_head = np.cumsum(runs) - runs
        least = np.minimum.reduceat(source, window_head)
        wanted = np.zeros(len(useful), bool)
        wanted[use] = least[answer] < high[use]
        number = np.zeros(len(useful), np.int64)
        number[use] = answer
        rows, at = [], 0
        for own, n in zip(block.tolist(), lengths, strict=True):
            i = np.flatnonzero(wanted[at : at + n]) + at
            at += n
            if len(i):
                c = number[i]
                r = run[ranges(run_head[c], runs[c])]
                rows.append((own, PATHS, 0, None, *[x.tobytes() for x in (paths.path[i], runs[c].astype(np.int32), run_size[ranges(run_head[c], runs[c])].astype(np.int32), source[r], place[r].astype(np.int32))]))
        return _rows(EMPTY_ANSWER.names, EMPTY_ANSWER.types, rows)

    def sources(docs_table: pa.Table, answers: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, Block, list[tuple[np.ndarray, ...]]]:
        """(rows, doc ids, later copies, their block, its repeated windows: first token, row, and source of each)."""
        docs_table, ids, active, later = _active(docs_table, answers)
        block = Block(docs_table.column("text"), spec)
        got = answers.filter(pa.array(answers.column("kind").to_numpy() == PATHS))
        found = []
        if got.num_rows:
            path, runs, size, source, place = (np.concatenate(unpack(got.column(c), t)) for c, t in zip("abcde", (U64, np.int32, np.int32, np.int64, np.int32), strict=True))
            runs = runs.astype(np.int64)
            heads = np.cumsum(runs) - runs
            order = np.argsort(path)
            ranked = path[order]
            for start, count, _, own, doc in block.paths(active):
                at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)
                hit = np.flatnonzero(ranked[at] == own)
                if not len(hit):
                    continue
                at = order[at[hit]]
                r = ranges(heads[at], runs[at])
                n = size[r].astype(np.int64)
                n_windows = np.add.reduceat(n, np.cumsum(runs[at]) - runs[at])
                if (n_windows != count[hit]).any():
                    raise Collision
                w, row = ranges(start[hit], n_windows), np.repeat(doc[hit], n_windows)
                source_doc, source_at = np.repeat(source[r], n), np.repeat(place[r].astype(np.int64), n) + within(n)
                keep = source_doc < ids[row]
                found.append((w[keep].astype(np.int64), row[keep], source_doc[keep], source_at[keep]))
        return docs_table, ids, later, block, found

    def claim(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        """The passages that will be cut, as long as their sources go on: where the source is, tokens, digest."""
        _, _, _, block, found = sources(docs_table, answers)
        claims = set()
        if found:
            w, row, doc, at = (np.concatenate(x) for x in zip(*found, strict=True))
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1] + 1) | (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(w))) + spec.window - 1
            claims = set(zip(doc[head].tolist(), at[head].tolist(), n.tolist(), block.digests(w[head], w[head] + n), strict=True))
        return _rows(["doc", "at", "n", "digest"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], list(claims))

    def verify(docs_table: pa.Table, claims: pa.Table) -> pa.Table:
        """No rows; stops if the text at some source coordinates is not that of the passage."""
        alone("spans")
        if claims.num_rows:
            docs_table = docs_table.filter(pa.compute.is_in(docs_table.column("doc_id"), claims.column("doc")))
            rows: dict[int, list[int]] = {}
            for i, d in enumerate(docs_table.column("doc_id").to_pylist()):
                rows.setdefault(d, []).append(i)
            block = Block(docs_table.column("text"), spec)
            doc, at, n, digest = (claims.column(c).to_pylist() for c in ("doc", "at", "n", "digest"))
            # a doc_id may have several texts; one of them is the source
            asked = [(c, int(block.bounds[i]) + at[c], n[c]) for c in range(len(doc)) for i in rows.get(doc[c], ()) if at[c] + n[c] <= block.bounds[i + 1] - block.bounds[i]]
            first = np.array([s for _, s, _ in asked], np.int64)
            last = first + np.array([k for _, _, k in asked], np.int64)
            right = {c for (c, _, _), d in zip(asked, block.digests(first, last) if len(asked) else [], strict=True) if d == digest[c]}
            if len(right) < len(doc):
                raise Collision
        return schema_rows.slice(0, 0)

    def cover(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        docs_table, ids, later, block, found = sources(docs_table, answers)
        size = np.diff(block.bounds)
        removed = np.repeat(later & (size >= spec.window), size)
        if found:
            w = np.concatenate([x[0] for x in found])
            edges = np.bincount(w, minlength=len(removed) + 1).astype(np.int32)
            edges -= np.bincount(w + spec.window, minlength=len(removed) + 1).astype(np.int32)
            removed |= np.cumsum(edges[:-1]) > 0
        return cut(docs_table, block, ids, removed)

    import pyarrow.compute  # noqa: F401
    from pyspark.sql.pandas.types import to_arrow_schema

    schema_rows = to_arrow_schema(schema).empty_table()
    one = by_block.cogroup(copies.groupBy("block")).applyInArrow(send_keys, "part int, block int, keys binary, many binary")
    answers = one.groupBy("part").applyInArrow(match_keys, ANSWER).unionByName(copies)
    two = by_block.cogroup(answers.groupBy("block")).applyInArrow(send_paths, "part int, block int, key binary, path binary, low binary, at binary, high binary, count binary, data binary")
    answers = two.groupBy("part").applyInArrow(match_paths, ANSWER).unionByName(copies)
    claims = by_block.cogroup(answers.groupBy("block")).applyInArrow(claim, "doc long, at long, n long, digest binary").distinct()
    claims = claims.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"))
    verified = by_block.cogroup(claims.groupBy("block")).applyInArrow(verify, schema)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(cover, schema).unionByName(verified)


def later_copies(docs: DataFrame) -> DataFrame:
    """doc_id and mark (SHA-256 of the text) of each document whose whole text an earlier document (smaller doc_id) has as well.

    The first of each group is found by partial aggregation; groups of one go before anything is joined, and the rest is
    dealt by key and a salt, so a group with a large share of all rows is no task of its own.
    """
    salts = 64
    marks = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("mark"))
    groups = marks.groupBy("mark").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return marks.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(groups, ["mark", "salt"]).filter("doc_id > least").select("doc_id", "mark").distinct()
