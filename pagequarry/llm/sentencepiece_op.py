"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once; at each position it follows its output links, and every
piece that ends there relaxes the best score of that position (Viterbi over the unigram lattice).  Characters that
no piece covers become the unknown piece, or byte pieces if the model has them.

The lattice falls apart wherever no piece holds the two characters at a border, so such chunks are solved on their own
and kept in a bounded table: the result is that of the whole text.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import bounded_batches, distinct_spans, list_of, ranges, release, slices, text_buffer, word_hashes, worker_state

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNKNOWN_PENALTY = 10.0
UNKNOWN_SURFACE = " ⁇ "


@dataclass
class PieceModel:
    """Pieces, scores, types and the normaliser's switches; plain data, so that it travels to executors."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool = True
    trim: bool = False
    table: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser and escaped leading white space are read")
        return cls([p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces], spec.add_dummy_prefix, spec.remove_extra_whitespaces)


class Encoder:
    """Encodes with one model; `most` chunks are kept in each of two generations."""

    def __init__(self, model: PieceModel, most: int = 150_000, longest: int = 32):
        import ahocorasick

        self.model, self.most, self.longest = model, most, longest
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        normal = [s for s, t in zip(model.scores, model.types, strict=True) if t == NORMAL] or [0.0]
        self.unknown_score = min(normal) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, t in enumerate(model.types) if t == UNKNOWN), 0)
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}
        self.automaton = ahocorasick.Automaton()
        self.inside: set[str] = set()
        for i, (piece, score, kind) in enumerate(zip(model.pieces, model.scores, model.types, strict=True)):
            if piece and kind in (NORMAL, USER_DEFINED):
                value = score if kind == NORMAL else len(piece) * max(normal) - 0.1
                self.automaton.add_word(piece, (len(piece), value, i))
                self.inside.update(map("".join, zip(piece, piece[1:], strict=False)))
        self.automaton.make_automaton()
        # a border between a word and the space before the next is free if no piece holds a space behind another character
        self.words_part = not any(x[1] == SPACE and x[0] != SPACE for x in self.inside)

    def viterbi(self, text: str) -> bytes:
        """Best segmentation of one stretch of normalised text as packed 32-bit ids; ties go to the earlier start, that is the longer piece."""
        n = len(text)
        best, back, ids = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], at, single = 0.0, 0, False

        def close(to: int) -> None:
            """Ends that have had all their pieces: an uncovered character may be unknown."""
            nonlocal at, single
            while at < to:
                at += 1
                if not single and best[at - 1] + self.unknown_score > best[at]:
                    best[at], back[at], ids[at] = best[at - 1] + self.unknown_score, at - 1, -1
                single = False

        if len(self.automaton):
            for end, (length, score, piece) in self.automaton.iter(text):
                if end > at:
                    close(end)
                start = end + 1 - length
                single = single or length == 1
                if best[start] + score > best[end + 1]:
                    best[end + 1], back[end + 1], ids[end + 1] = best[start] + score, start, piece
        close(n)
        out: list[int] = []
        end = n
        while end:
            start = back[end]
            if ids[end] >= 0:
                out.append(ids[end])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(text[start:end].encode("utf-8")))
            elif not (out and out[-1] == self.unknown_id):  # neighbouring unknown characters are one piece
                out.append(self.unknown_id)
            end = start
        return array("i", reversed(out)).tobytes()

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk with free borders; cut further at free borders inside, if bytes stand for unknown characters."""
        ids = self.recent.get(text)
        if ids is None:
            ids = self.older.get(text)
            if ids is None:
                cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.inside] if self.bytes else []
                if cuts and len(cuts) < len(text) - 1:
                    ids = b"".join(self.chunk(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True))
                else:
                    ids = self.viterbi(text) if not cuts else b"".join(map(self.viterbi, text))
            if len(text) <= self.longest:
                if len(self.recent) >= self.most:
                    self.older, self.recent = self.recent, {}
                self.recent[text] = ids
        return ids

    def normalise(self, text: str) -> str:
        if self.model.trim:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def packed(self, text: str) -> bytes:
        """Ids of any text, packed."""
        text = self.normalise(text)
        if not self.words_part or not self.bytes:
            return self.viterbi(text) if text else b""
        out: list[bytes] = []
        at = 0
        while at < len(text):
            to = at
            while to < len(text) and text[to] == SPACE:
                to += 1
            to = text.find(SPACE, to)
            to = len(text) if to < 0 else to
            out.append(self.chunk(text[at:to]))
            at = to
        return b"".join(out)

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each document); texts whose words stand apart by single spaces go through one table of distinct words."""
        texts = [x or "" for x in column.to_pylist()]
        plain = self.words_part and bool(self.bytes) and self.model.dummy_prefix
        easy = [plain and bool(x) and "  " not in x and x[0] != " " and x[-1] != " " and SPACE not in x for x in texts]
        buf, offsets = text_buffer(pa.array([x if e else "" for x, e in zip(texts, easy, strict=True)], pa.large_string()))
        hashes, starts, ends, bounds = word_hashes(buf, offsets, separator=ONLY_SPACE)
        which, heads = distinct_spans(buf, starts, ends, hashes)
        raw = buf.tobytes()
        found = [self.chunk(SPACE + raw[s:e].decode("utf-8")) for s, e in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True)]
        hard = [i for i, e in enumerate(easy) if not e]
        base = len(found)
        found += [self.packed(texts[i]) for i in hard]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        if hard:
            at = bounds[np.array(hard)]
            which = np.insert(which, at, np.arange(base, base + len(hard)))
            bounds = bounds + np.searchsorted(np.array(hard), np.arange(len(bounds)), side="left")
        counts = sizes[which]
        ids = flat[ranges((np.cumsum(sizes) - sizes)[which], counts)]
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[bounds])


ONLY_SPACE = np.zeros(256, bool)
ONLY_SPACE[0x20] = True


class Decoder:
    """ids -> text, by a gather over the pieces' bytes; control pieces vanish, the dummy space goes, bad UTF-8 becomes U+FFFD."""

    def __init__(self, model: PieceModel):
        surfaces = []
        for p, t in zip(model.pieces, model.types, strict=True):
            surfaces.append(bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else UNKNOWN_SURFACE.encode() if t == UNKNOWN else p.replace(SPACE, " ").encode())
        self.dummy = model.dummy_prefix
        self.sizes = np.fromiter(map(len, surfaces), np.int64, len(surfaces))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(surfaces), np.uint8)

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            raise ValueError("an id is not in the model")
        sizes = self.sizes[ids]
        raw = self.flat[ranges(self.starts[ids], sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
        return [x[1:] if self.dummy and x[:1] == " " else x for x in out]


def worker_encoder(model: PieceModel) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    key = (len(model.pieces), hash(tuple(model.pieces)), hash(tuple(model.scores)), model.dummy_prefix, model.trim)
    return worker_state("sentencepiece", key, lambda: Encoder(model))


def encode_documents(docs: DataFrame, model: PieceModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, text and ids array<int> of every row; null and empty texts: no ids.  A kept column of one of these names is replaced.  Empty input: empty result."""
    from pyspark.sql import types as T

    docs = bounded_batches(docs).select(*[F.col(f"`{c}`") for c in keep if c.lower() not in ("text", "ids")], F.col("text").cast("string").alias("text"))
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = worker_encoder(model)
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                ids, counts = encoder.encode_batch(b.column("text"))
                yield pa.RecordBatch.from_arrays([*b.columns, list_of(ids, counts)], names=[*b.schema.names, "ids"])
        release()

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """encoded plus decoded string, from `ids` alone; null ids: null.  A column of that name is replaced.  Empty input: empty result."""
    from pyspark.sql import types as T

    encoded = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != "decoded"])
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        decoder = Decoder(model)
        for whole in batches:
            counts = np.array([n or 0 for n in pa.compute.list_value_length(whole.column("ids")).to_pylist()], np.int64)
            total = np.concatenate([[0], np.cumsum(counts)])
            at = 0
            while at < whole.num_rows:  # about half a million ids at a time
                to = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 19), side="right")) - 1)
                b = whole.slice(at, to - at)
                column = b.column(b.schema.get_field_index("ids"))
                texts = decoder.decode_batch(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts[at:to])
                known = column.is_valid().to_pylist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t if k else None for t, k in zip(texts, known, strict=True)], pa.string())], names=[*b.schema.names, "decoded"])
                at = to

    import pyarrow.compute  # noqa: F401

    return encoded.mapInArrow(run, schema)
