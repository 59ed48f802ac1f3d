"""Sequence packing by power-of-two decomposition.

A document of n token ids is cut into whole sequences of `max_length` ids and into one piece for each
set bit of what is left, the longest first.  Every piece has a power-of-two length and is a sequence of
its own: sequences of equal length make up a bucket, a batch draws from one bucket, no sequence crosses
a document's border and nothing is padded.

Tokenisation is memoised: white space never lies inside a token of the vocabulary's pre-tokeniser, so a text
is split at spaces and line ends; the distinct words of a slice are found by hashes and byte comparisons, and the ids of each
are looked up once in a bounded table.
One narrow stage without a shuffle; a task's memory is one Arrow batch and that table.
"""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import LOWER, bounded_batches, distinct_spans, ranges, release, slices, text_buffer, word_hashes, word_spans, worker_state

PIECES = "doc_id long, start long, length long, doc_tokens long, bucket int, token_bytes binary"


#: letters below this code point stand for themselves in normal form
SIMPLE_END = "\u0180"


def byte_letters() -> dict[int, str]:
    """The character that byte-level models write for each byte: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


def word_model(spec: dict) -> bool:
    """Whether a word of simple letters can go straight to the merges: lower case, NFC and white space are all that the normaliser sees to."""
    parts = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    before = [x.get("type") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return parts == ["NFC", "Replace", "Lowercase"] and before == ["Split", "ByteLevel"] and spec["model"]["type"] == "BPE"


def without_marks(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans with a full stop or comma at the end of a word, behind an ASCII letter, as a word of its own: the pre-tokeniser parts there too."""
    last = buf[ends - 1]
    cut = np.flatnonzero(((last == 46) | (last == 44)) & (ends - starts > 1))
    before = buf[ends[cut] - 2] | 32
    cut = cut[(before >= 97) & (before <= 122)]
    mark = ends[cut] - 1
    out_ends = ends.copy()
    out_ends[cut] = mark
    return np.insert(starts, cut + 1, mark), np.insert(out_ends, cut + 1, mark + 1)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit bytes."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds(dict):
    """word (bytes) -> its ids as little-endian unsigned 32-bit bytes.

    Two generations of at most `most` words each: when the younger is full it becomes the older, so frequent
    words stay.  A run of letters and the mark behind it are separate tokens to the pre-tokeniser, and ASCII case
    does not matter to it; both share the entry of the bare lower-case word.
    """

    def __init__(self, path: str, most: int = 300_000, longest: int = 48):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.longest, self.older = Tokenizer.from_file(path), most, longest, {}
        spec = json.loads(self.tokenizer.to_str())
        self.simple = word_model(spec)
        #: special tokens are found in the text as it is, whatever stands around them
        self.added = [x["content"].encode() for x in spec.get("added_tokens") or [] if x.get("content")]
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if text.isalpha():
                low = text.lower()
                if low != text and text.isascii():
                    ids = self[low.encode()]
                elif self.simple and max(text) < SIMPLE_END and "\u0130" not in text:
                    # a run of such letters is one word to the pre-tokeniser, its normal form is its lower case
                    ids = packed([t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LETTERS))])
            elif len(word) > 1 and word[-1:] in (b".", b",") and text[:-1].isalpha() and max(text) < SIMPLE_END and "\u0130" not in text:
                # letters beyond these may end in a mark once in normal form, and marks join what follows
                ids = self[word[:-1]] + self[word[-1:]]
            if ids is None:
                ids = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, ids of each document), the end id behind each; every distinct word is looked up once."""
        low = LOWER[buf]
        if any(x.lower() in low.tobytes() for x in self.added):
            low = buf  # special tokens are known by their case
        hashes, starts, ends, bounds = word_hashes(low, offsets, spans=without_marks(buf, *word_spans(buf, offsets)))
        which, heads = distinct_spans(low, starts, ends, hashes)
        raw = low.tobytes()
        found = [self[raw[s:e]] for s, e in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True)]
        found.append(np.array([end_id], "<u4").tobytes())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        which = np.insert(which, bounds[1:], len(found) - 1)
        counts = sizes[which]
        ids = flat[ranges((np.cumsum(sizes) - sizes)[which], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[np.concatenate([[0], bounds[1:] + np.arange(1, len(bounds))])])


def piece_lengths(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, length) of the pieces of n ids each: whole sequences, then the set bits of the rest from the highest."""
    bits = np.arange(most.bit_length() - 2, -1, -1)
    doc, bit = np.nonzero((n % most)[:, None] >> bits & 1)
    doc = np.concatenate([np.repeat(np.arange(len(n)), n // most), doc])
    length = np.concatenate([np.full(int((n // most).sum()), most, np.int64), np.int64(1) << bits[bit]])
    order = np.argsort(doc, kind="stable")
    return doc[order], length[order]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_length: int = 4096) -> DataFrame:
    """Pieces of all documents: PIECES plus sequence_id and offset.

    docs: doc_id, text; other columns are ignored.  Null and empty texts have the end id alone.  Repeated
    rows are packed each time they occur.  A null doc_id is kept.  max_length must be a power of two.
    sequence_id is unique in the result and depends on the input's partitions only.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def cut(batches):
        table = worker_state("packing", tokenizer_path, lambda: WordIds(tokenizer_path))
        for whole in batches:
            for batch in slices(whole, "text", 3 << 20):
                ids, n = table.encode(*text_buffer(batch.column("text")), end_id)
                doc, length = piece_lengths(n, max_length)
                start = np.cumsum(length) - length
                cuts = np.concatenate([start, [len(ids)]]) * 4
                first = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(doc)),
                        pa.array(start - first[doc]),
                        pa.array(length),
                        pa.array(n[doc]),
                        pa.array(np.log2(length).round().astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "bucket", "token_bytes"],
                )
            release()

    pieces = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def with_ids(pieces: DataFrame) -> DataFrame:
    """Adds token_ids array<long> (unsigned) to the pieces."""

    def decode(batches):
        for b in batches:
            flat = np.frombuffer(b"".join(b.column("token_bytes").to_pylist()), "<u4").astype(np.int64)
            lengths = np.asarray(b.column("length").to_pylist(), np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[*b.schema.names, "token_ids"])

    from pyspark.sql import types as T

    return pieces.mapInArrow(decode, T.StructType([*pieces.schema.fields, T.StructField("token_ids", T.ArrayType(T.LongType()))]))
