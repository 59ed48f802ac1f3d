"""Helpers shared by the corpus operators: Arrow text access, vectorised hashing, packed shuffles.

Large intermediate results travel as *packed rows*: one Spark row carries the numpy arrays of many
entries as binary columns, keyed by a hash partition.  A reducer then works on a whole partition
with numpy, and the JVM never sees one row for each n-gram.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: odd multipliers: of the rules below, and of the polynomial hashes over tokens
BYTE_BASE = 0x9E3779B97F4A7C15
TOKEN_BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all machines must share.

    Where that is unset, a local session (tests) gets a temporary folder of its own; a cluster gets an error, as its machines share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="pagequarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pagequarry-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, most: int = 12 << 20) -> DataFrame:
    """df; its session passes texts to Python in batches of at most `most` bytes, unless the user has set a size (Spark's own is 64 MB)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if conf.get(key, None) is None:
        conf.set(key, str(most))
    return df


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column (one small aggregate on the driver)."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), vectorised and out of place."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & MASK, U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


_STATE: dict = {}


def worker_state(owner: str, key, make):
    """make() once for each key in this Python worker.  Tables of another owner go first: workers outlive the operators they ran."""
    if owner not in _STATE:
        _STATE.clear()
        release()
    own = _STATE.setdefault(owner, {})
    if key not in own:
        own[key] = make()
    return own[key]


def alone(owner: str) -> None:
    """Drops the tables that other operators left in this worker."""
    if owner not in _STATE:
        _STATE.clear()
        _STATE[owner] = {}
        release()


def release() -> None:
    """Gives freed memory back to the system; large temporaries would otherwise stay with an idle worker."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(powers, inverse powers) of at least n entries, kept for each base."""
    have = _POW.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        have = (powers(base, size), powers(pow(base, -1, 1 << 64), size))
        _POW[base] = have
    return have


#: a random-looking 64-bit value for every byte, by rule
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(BYTE_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: the bytes that end a word: space and 0x09 to 0x0D
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: document i is bytes[offsets[i]:offsets[i+1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all words of a buffer; a word never crosses a document's border."""
    n = len(buf)
    word = ~separator[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: words beyond this many bytes are hashed by blake2b, shorter ones eight bytes at a time
LANES = 64
#: the low n bytes of a 64-bit word
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes.  Every eight bytes go through a nonlinear mixer, so no rule by which a text is made lets unlike words meet (as
    it can with polynomials modulo 2**64).  What must be exact compares bytes behind it: distinct_spans here, whole passages at their source in spans.py.
    """
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    salt = U64((seed * BYTE_BASE) & MASK)
    out = mix((eight[starts] & LOW_BYTES[np.minimum(length, 8)]) + length.astype(U64) * U64(TOKEN_BASE) ^ salt)
    at = np.flatnonzero((length > 8) & (length <= LANES))
    for lane in range(8, LANES, 8):
        if not len(at):
            break
        part = eight[starts[at] + lane] & LOW_BYTES[np.minimum(length[at] - lane, 8)]
        out[at] = mix((out[at] ^ part) * U64(BYTE_BASE) + U64(lane))
        at = at[length[at] > lane + 8]
    for i in np.flatnonzero(length > LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each stretch, first stretch of each number): equal numbers mean equal bytes.

    Stretches are grouped by their hashes, then each is compared byte for byte with the first of its group; a group
    that holds unlike ones is parted by its bytes.
    """
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    heads = order[new]
    head = heads[number]
    length = ends - starts
    unlike = length != length[head]
    todo = np.flatnonzero((np.arange(len(head)) != head) & ~unlike)
    step = 1 << 16
    for a in range(0, len(todo), step):
        i = todo[a : a + step]
        n = length[i]
        same = buf[ranges(starts[i], n)] == buf[ranges(starts[head[i]], n)]
        bad = np.flatnonzero(~same)
        if len(bad):
            unlike[i[np.searchsorted(np.cumsum(n), bad, side="right")]] = True
    if unlike.any():
        more, at = {}, len(heads)
        extra = []
        for i in np.flatnonzero(unlike).tolist():
            word = buf[starts[i] : ends[i]].tobytes()
            if word not in more:
                more[word] = at + len(extra)
                extra.append(i)
            number[i] = more[word]
        heads = np.concatenate([heads, np.array(extra, heads.dtype)])
    return number, heads


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = SEPARATOR, stems: tuple[int, ...] = (), spans: tuple[np.ndarray, np.ndarray] | None = None, seed: int = 0):
    """(hashes, starts, ends, word offsets) of the words of all documents.

    spans: (starts, ends) instead of the words that separators make.  With stems, hashes has a row for the words and one for their first n bytes for each n of stems.
    """
    starts, ends = spans or word_spans(buf, offsets, separator)
    data = LOWER[buf] if lower else buf
    if stems:
        hashes = np.stack([span_hashes(data, starts, np.minimum(ends, starts + n) if n else ends, seed) for n in (0, *stems)])
    else:
        hashes = span_hashes(data, starts, ends, seed)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def kgrams(tokens: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every window of k consecutive tokens (len(tokens) - k + 1 values, unmixed)."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, block, width, base = None, 0, tokens, 1, TOKEN_BASE
    while True:
        if k & width:
            part = block[done : done + n]
            out = part.copy() if out is None else out * U64(base) + part
            done += width
        if done == k:
            return out
        block = block[:-width] * U64(base) + block[width:]
        base = base * base & MASK
        width *= 2


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w consecutive values."""
    block, width = values, 1
    while width * 2 <= w:
        block = np.minimum(block[:-width], block[width:])
        width *= 2
    return block if width == w else np.minimum(block[: len(values) - w + 1], block[w - width : w - width + len(values) - w + 1])


def within(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each length n, concatenated."""
    return ranges(np.zeros(len(lengths), np.int64), lengths)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start .. start+n-1 for each pair, concatenated; 32-bit where that holds them."""
    total = int(lengths.sum())
    small = total == 0 or max(total, int((starts + lengths).max(initial=0))) < (1 << 31)
    kind = np.int32 if small else np.int64
    out = np.arange(total, dtype=kind)
    out += np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(kind), lengths)
    return out


def pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def unpack(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def deal(entries: float, a_block: float, a_part: int) -> int:
    """How many hash partitions `entries` go to, when a block sends a_block of them: about a_part each, but not so many that a block's packed rows hold fewer than 64,
    unless more than 16 million would come to one partition.
    """
    return max(1, math.ceil(max(entries / (16 << 20), min(entries / a_part, a_block / 64))))


def by_partition(part: np.ndarray):
    """(partition, its entries) of the partitions that occur, in order: the work follows the entries, however many partitions there are."""
    order = np.argsort(part.astype(np.uint16) if len(part) and int(part.max()) < 65536 else part, kind="stable")
    ranked = part[order]
    cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(order)] if len(order) else [0]
    for s, e in itertools.pairwise(bounds):
        yield int(ranked[s]), order[s:e]


def list_of(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(values))


def slices(batch: pa.RecordBatch, name: str, most: int = 8 << 20):
    """Cuts a batch into slices of about `most` text bytes, one document at least."""
    _, offsets = text_buffer(batch.column(name))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to
