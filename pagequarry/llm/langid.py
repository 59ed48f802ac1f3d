"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, drawn from its code point, whatever its script.  A letter trigram is the product (binding) of its letters'
vectors, each permuted by its place; a document is the sum (bundle) of its trigrams' vectors; a language's
prototype is the bundle of its training documents.  A document gets the language whose prototype, less the mean of
all prototypes, has the largest cosine with the document's vector less the same mean.

Each worker keeps a table of the trigrams of a to z, made from the seed alone; those with other letters are bound when they are met.
Bundling is linear, so training sends one sum of vectors a language and task; scoring is one narrow stage.
"""

from __future__ import annotations

import itertools
import unicodedata
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import BYTE_BASE, TOKEN_BASE, U64, bounded_batches, materialise, mix, slices, worker_state

#: codes of the gap and of a to z
BASIC = 27
CODE_BITS = 21
UNDETERMINED = "und"


def letter_codes() -> np.ndarray:
    """Code point -> code of its letter: 0 no letter, 1-26 a-z, any other the code point of the lower-case letter."""

    def make() -> np.ndarray:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x33480):
            if unicodedata.category(chr(c))[0] == "L":
                low = ord(chr(c).lower()[0])
                out[c] = low - 96 if 97 <= low <= 122 else low
        return out

    return worker_state("languages", "letters", make)


def letter_vectors(codes: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """int8 (letters, dims): random signs, a letter's from its code and the seed alone."""
    words = np.arange(-(-dims // 64), dtype=U64) * U64(TOKEN_BASE)
    bits = mix(mix(codes.astype(U64)[:, None] * U64(BYTE_BASE) + U64(seed)) + words)
    return np.unpackbits(bits.view(np.uint8), axis=1, count=dims).astype(np.int8) * np.int8(2) - np.int8(1)


def bound(letters: np.ndarray, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Vectors of trigrams whose letters are rows of `letters`, each permuted by its place."""
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


def trigram_table(dims: int, seed: int) -> np.ndarray:
    """int8 (BASIC**3, dims): the bound vectors of the trigrams of a to z and gaps."""

    def make() -> np.ndarray:
        ids = np.arange(BASIC**3)
        return bound(letter_vectors(np.arange(BASIC), dims, seed), ids // BASIC**2, ids // BASIC % BASIC, ids % BASIC)

    return worker_state("languages", (dims, seed), make)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(distinct trigrams, their shares, has a letter): three codes of CODE_BITS bits each; runs of other characters count as one gap, the ends as gaps."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_codes()[points]
    if not codes.any():
        return np.zeros(0, U64), np.zeros(0, np.float32), False
    codes = np.concatenate([[0], codes, [0]]).astype(U64)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[0] = True
    codes = codes[keep]
    ids = np.sort((codes[:-2] << U64(2 * CODE_BITS)) | (codes[1:-1] << U64(CODE_BITS)) | codes[2:])
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[new], (np.diff(np.concatenate([new, [len(ids)]])) / len(ids)).astype(np.float32), True


def bundled(ids: np.ndarray, shares: np.ndarray, dims: int, seed: int, tile: int = 4096) -> np.ndarray:
    """Sum of the trigrams' vectors by their shares."""
    mask = U64((1 << CODE_BITS) - 1)
    places = [(ids >> U64(s)).astype(U64) & mask for s in (2 * CODE_BITS, CODE_BITS, 0)]
    places = [p.astype(np.int64) for p in places]
    basic = np.maximum(np.maximum(*places[:2]), places[2]) < BASIC
    x, y, z = (p[basic] for p in places)
    out = shares[basic] @ trigram_table(dims, seed)[(x * BASIC + y) * BASIC + z].astype(np.float32)
    others = np.flatnonzero(~basic)
    for at in range(0, len(others), tile):
        own = others[at : at + tile]
        letters, rows = np.unique(np.concatenate([p[own] for p in places]), return_inverse=True)
        out += shares[own] @ bound(letter_vectors(letters, dims, seed), *rows.reshape(3, -1)).astype(np.float32)
    return out


def text_trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams of all texts in their order, codes of those beyond a to z, trigrams of each text): as trigrams() has them, but not counted; a text without a letter has none.

    A trigram is a row of trigram_table, or BASIC**3 and more for the codes beyond.
    """
    # a gap before all texts and one behind each
    points = np.frombuffer("\0".join(["", *(x or "" for x in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_codes().take(points).view(np.int32)
    keep = codes != 0
    keep[1:] |= keep[:-1]
    keep[0] = True
    kept = np.flatnonzero(keep)
    codes = codes.take(kept)
    # the gap that a text ends in is also where the next one starts, and the middle of no trigram
    gaps = np.searchsorted(kept, np.cumsum([len(x or "") + 1 for x in texts]), side="right") - 1
    inner = np.ones(max(0, len(codes) - 2), bool)
    inner[gaps[(gaps > 0) & (gaps < len(codes) - 1)] - 1] = False
    first, second, third = codes[:-2], codes[1:-1], codes[2:]
    rows, others = (first * np.int32(BASIC) + second) * np.int32(BASIC) + third, np.zeros(0, U64)
    beyond = codes >= BASIC
    if beyond.any():
        at = np.flatnonzero((beyond[:-2] | beyond[1:-1] | beyond[2:]) & inner)
        x, y, z = (c[at].astype(U64) for c in (first, second, third))
        others, which = np.unique((x << U64(2 * CODE_BITS)) | (y << U64(CODE_BITS)) | z, return_inverse=True)
        rows[at] = BASIC**3 + which
    return rows[inner], others, np.maximum(np.diff(gaps, prepend=0) - 1, 0)


@dataclass(frozen=True)
class LanguageModel:
    """Labels and their prototypes (rows of unit length, less the mean), that mean, and how to make the vectors again."""

    labels: list[str]
    prototypes: np.ndarray
    mean: np.ndarray
    dims: int
    seed: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """(label, cosine from 0 to 1); `und` and 0 for a text without a letter or a model without labels."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(label, cosine, has a letter)."""
        ids, shares, letters = trigrams(text)
        if not letters or not self.labels:
            return UNDETERMINED, 0.0, letters
        vector = bundled(ids, shares, self.dims, self.seed) - self.mean
        norm = float(np.linalg.norm(vector))
        cosines = self.prototypes @ vector / (norm or 1.0)
        best = int(cosines.argmax())
        return self.labels[best], float(min(1.0, max(0.0, cosines[best]))), True

    @cached_property
    def projections(self) -> np.ndarray:
        """(BASIC**3, labels): prototypes times the vectors of the trigrams of a to z."""
        return (trigram_table(self.dims, self.seed).astype(np.float32) @ self.prototypes.T).astype(np.float64)

    def names(self, texts: list[str | None], most: int = 1 << 18) -> list[str]:
        """predict()'s labels of many texts, about `most` characters at once: a text's cosines have its norm in common, so the prototypes' products with its trigrams decide."""
        block = np.cumsum([0, *(len(x or "") for x in texts)])[:-1] // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        return [x for s, e in itertools.pairwise(cuts) for x in self._names(texts[s:e])]

    def _names(self, texts: list[str | None]) -> list[str]:
        rows, others, sizes = text_trigrams(texts)
        if not self.labels or not len(rows):
            return [UNDETERMINED] * len(texts)
        table = [self.projections]
        for at in range(0, len(others), 4096):
            letters, places = np.unique(np.stack([others[at : at + 4096] >> U64(s) & U64((1 << CODE_BITS) - 1) for s in (2 * CODE_BITS, CODE_BITS, 0)]), return_inverse=True)
            table.append(bound(letter_vectors(letters, self.dims, self.seed), *places.reshape(3, -1)).astype(np.float32) @ self.prototypes.T)
        there = np.flatnonzero(sizes)
        products = (np.concatenate(table) if len(others) else self.projections).take(rows, axis=0)
        scores = np.add.reduceat(products, np.cumsum(sizes)[there] - sizes[there], axis=0) / sizes[there, None] - self.prototypes @ self.mean
        out = [UNDETERMINED] * len(texts)
        for i, k in zip(there.tolist(), scores.argmax(axis=1).tolist(), strict=True):
            out[i] = self.labels[k]
        return out


def fit(labelled: DataFrame, max_rows_per_label: int | None = None, max_rows: int | None = None, dims: int = 512, seed: int = 7) -> LanguageModel:
    """Prototypes from text and lang of `labelled` (doc_id, text, lang); null langs and texts without letters are left out.

    Every row is learnt from, unless bounds are given: then about max_rows_per_label rows of each language are used, and about max_rows in all, chosen by a hash of doc_id, and
    where languages are so many that max_rows binds (dirty values), the share of rows falls alike for all.  Trigrams of one language are counted before their vectors are
    bundled; sums are added up by a shuffle, and one vector a language comes to the driver.
    """
    rows = bounded_batches(labelled).filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    if max_rows_per_label is not None or max_rows is not None:
        per_label, most = (F.lit(x if x is not None else (1 << 62)) for x in (max_rows_per_label, max_rows))
        sizes = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")))
        wanted = sizes.agg(F.sum(F.least("n", per_label))).first()[0] or 0
        whole = min(1.0, max_rows / max(1, wanted)) if max_rows is not None else 1.0
        parts = {r["lang"]: whole * max_rows_per_label / r["n"] for r in sizes.filter(F.col("n") > per_label).collect()}
        share = F.coalesce(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col("lang")], F.lit(whole)) if parts else F.lit(whole)
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def add(batches):
        total: dict[str, np.ndarray] = {}
        count: dict[str, int] = {}
        for b in batches:
            for lang, n, x in zip(*(b.column(c).to_pylist() for c in ("lang", "n", "sums")), strict=True):
                total[lang] = total.get(lang, 0) + np.frombuffer(x, np.float64)
                count[lang] = count.get(lang, 0) + n
        if total:
            yield bundled_sums(total, count)

    total: dict[str, np.ndarray] = {}
    count: dict[str, int] = {}
    schema = "lang string, n long, sums binary"
    for r in rows.select("lang", "text").mapInArrow(lambda batches: text_sums(batches, dims, seed), schema).repartition("lang").mapInArrow(add, schema).toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["sums"], np.float64)
        count[r["lang"]] = count.get(r["lang"], 0) + r["n"]
    labels = sorted(total)
    raw = np.array([total[k] / count[k] for k in labels], np.float32).reshape(len(labels), dims)
    mean = raw.mean(axis=0) if len(labels) > 1 else np.zeros(dims, np.float32)
    centred = raw - mean
    return LanguageModel(labels, centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12), mean, dims, seed)


def text_sums(batches, dims: int, seed: int, most: int = 1 << 20):
    """(lang, texts, sum of their vectors) of batches (lang, text): a row for each language, and more where they are very many.

    Trigrams are weighed first and become vectors once for each language, not for each slice; about `most` of those beyond a to z, and 64 languages, wait for it.
    """
    sums: dict[str, np.ndarray] = {}
    sizes: dict[str, int] = {}
    weights: dict[str, np.ndarray] = {}
    others: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting = 0
    for whole in batches:
        for b in slices(whole, "text", 1 << 19):
            # texts of one language side by side
            pairs = sorted(zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True), key=lambda p: p[0])
            rows, ids, lengths = text_trigrams([t for _, t in pairs])
            shares = np.repeat(1 / np.maximum(lengths, 1), lengths)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            for x, own in itertools.groupby(range(len(pairs)), key=lambda i: pairs[i][0]):
                own = list(own)
                s, e = ends[own[0]], ends[own[-1] + 1]
                if s < e:
                    basic, more = np.split(np.bincount(rows[s:e], shares[s:e], BASIC**3), [BASIC**3])
                    weights[x] = weights[x] + basic if x in weights else basic
                    there = np.flatnonzero(more)
                    others.setdefault(x, []).append((ids[there], more[there]))
                    waiting += len(there)
                    sizes[x] = sizes.get(x, 0) + int((lengths[own] > 0).sum())
                if len(weights) > 64 or waiting > most:
                    settle(sums, weights, others, dims, seed)
                    waiting = 0
            if len(sums) > 1024:
                settle(sums, weights, others, dims, seed)
                yield bundled_sums(sums, sizes)
                sums, sizes, waiting = {}, {}, 0
    if sizes:
        settle(sums, weights, others, dims, seed)
        yield bundled_sums(sums, sizes)


def settle(sums: dict[str, np.ndarray], weights: dict[str, np.ndarray], others: dict[str, list[tuple[np.ndarray, np.ndarray]]], dims: int, seed: int) -> None:
    """Adds the vectors of each language's trigrams, by their weights, to its sum, and drops the weights."""
    for x, own in weights.items():
        there = np.flatnonzero(own)
        sums[x] = sums.get(x, 0) + own[there] @ trigram_table(dims, seed)[there].astype(np.float64)
        ids, which = np.unique(np.concatenate([i for i, _ in others[x]]), return_inverse=True)
        if len(ids):
            sums[x] += bundled(ids, np.bincount(which, np.concatenate([w for _, w in others[x]])).astype(np.float32), dims, seed)
    weights.clear()
    others.clear()


def bundled_sums(sums: dict[str, np.ndarray], sizes: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([sizes[x] for x in sums], pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["lang", "n", "sums"])


def predict(docs: DataFrame, model: LanguageModel, letters: bool = False) -> DataFrame:
    """docs plus lang_pred and score, and has_letter with `letters`, from `text` alone; a clash with such columns of docs replaces them.

    Null texts and texts without a letter: `und`, 0.  Repeated rows are scored each time.  Empty input: empty result.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[T.StructField("has_letter", T.BooleanType())] * letters]
    names = [f.name for f in added]
    keep = [c for c in docs.columns if c.lower() not in names]
    docs = bounded_batches(docs).select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*docs.schema.fields, *added])

    def score(batches):
        for b in batches:
            found = [model.judge(x) for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())[: len(names)])]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *names])

    return docs.mapInArrow(score, schema)
