"""Toxicity scores from a convolutional text classifier trained in numpy.

A word is hashed into three embedding tables: by itself, by its first bytes and by its first few more, so unseen forms of a known stem are near it
(and a chance collision in one table rarely meets one in another).  Filters of several
widths run over the words of a text, each keeps its maximum over the whole text, and a logistic layer reads the maxima.
A part of the labelled documents that takes no part in the gradients sets, for each language that the text itself is recognised as
(hyperdimensional profiles), the logit that becomes the score 0.5.

Every labelled document is learnt from.  They are dealt by a hash into bundles of bounded size; in a round each bundle is passed over from the same network by itself, and
the changes are averaged (local Adagrad).  Scoring is one narrow stage whose memory is one slice of texts.
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm import langid
from pagequarry.llm.common import U64, bounded_batches, materialise, release, scratch_dir, slices, text_buffer, word_hashes

WIDTHS = (1, 2, 3)
PAD = max(WIDTHS)
#: words whose windows are worked on together: their responses stay in a core's cache
TILE = 1 << 13
#: bytes of a word's stems
STEMS = (4, 6)
TABLES = 1 + len(STEMS)
#: everything but letters and digits ends a word here; bytes beyond ASCII belong to words
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def maxima(y: np.ndarray, first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Maxima of each document's rows first .. first + starts - 1: windows at its words and one of empty words, none that reaches into the next document."""
    return np.maximum.reduceat(y, np.stack([first, first + starts], axis=1).ravel(), axis=0)[::2]


def tiles(bounds: np.ndarray, tile: int):
    """(first document, end, first word, end, window starts of each document) of stretches of about `tile` words; a document beyond the tile goes by overlapping tiles of its own."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + tile, side="right")) - 1)
        if to == at + 1 and bounds[to] - bounds[at] > tile:
            end = int(bounds[to])
            for s in range(int(bounds[at]), end, tile):
                # windows that begin behind the tile are the next one's
                yield at, to, s, min(s + tile + PAD - 1, end), np.array([tile if s + tile < end else end + 1 - s])
        else:
            yield at, to, int(bounds[at]), int(bounds[to]), np.diff(bounds[at : to + 1]) + 1
        at = to


@dataclass
class Network:
    """tables (TABLES, 2**bits, dims), one (width * TABLES * dims, filters) matrix and bias for each width, and the logistic layer.

    Words come as their rows in the tables: uint16 (TABLES, words).
    """

    tables: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float

    @classmethod
    def fresh(cls, bits: int, dims: int, filters: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        shape = [(w * TABLES * dims, filters) for w in WIDTHS]
        return cls(
            rng.normal(0, 0.02, (TABLES, 1 << bits, dims)).astype(np.float32),
            [rng.normal(0, (2 / s[0]) ** 0.5, s).astype(np.float32) for s in shape],
            [np.zeros(filters, np.float32) for _ in shape],
            np.full(filters * len(WIDTHS), 0.5, np.float32) * rng.choice(np.float32([-1, 1]), filters * len(WIDTHS), p=[0.25, 0.75]),
            -1.0,
        )

    def pooled(self, words: np.ndarray, bounds: np.ndarray, tile: int = TILE) -> np.ndarray:
        """(documents, filters of all widths): maxima over all windows, at least 0; a text is followed by empty words."""
        out = np.zeros((len(bounds) - 1, sum(b.shape[0] for b in self.biases)), np.float32)
        for at, to, s, e, starts in tiles(bounds, tile):
            out[at:to] = np.maximum(out[at:to], self._tile(words[:, s:e], np.clip(bounds[at : to + 1], s, e) - s, starts))
        return out

    def embedded(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word vectors with PAD zero rows behind each document, first row of each document)."""
        n, (_, size, d) = len(bounds) - 1, self.tables.shape
        first = bounds[:-1] + np.arange(n) * PAD
        place = np.arange(words.shape[1]) + np.repeat(np.arange(n), np.diff(bounds)) * PAD
        padded = np.zeros((TABLES, words.shape[1] + n * PAD), words.dtype)
        padded[:, place] = words
        rows = np.add(padded.T, np.arange(TABLES) * size, out=np.empty(padded.shape[::-1], np.intp))
        x = self.tables.reshape(-1, d).take(rows.ravel(), axis=0).reshape(len(rows), TABLES * d).astype(np.float32, copy=False)
        x[((first + np.diff(bounds))[:, None] + np.arange(PAD)).ravel()] = 0
        return x, first

    def blocks(self) -> list[list[np.ndarray]]:
        """The filters' parts for the first, second, ... word of a window; widths rise, so the later parts are those of the last filters."""
        d = TABLES * self.tables.shape[2]
        return [[m[j * d : (j + 1) * d] for w, m in zip(WIDTHS, self.filters, strict=True) if w > j] for j in range(PAD)]

    def windows(self, x: np.ndarray) -> np.ndarray:
        """(filters of all widths, rows of x): each filter's value at the windows that start there, before its threshold at 0.

        One product serves all words of all windows; a later word's part is added to the row where its window starts.
        """
        blocks, f = self.blocks(), self.biases[0].shape[0]
        z = np.concatenate([m for block in blocks for m in block], axis=1).T @ x.T
        done = f * len(WIDTHS)
        y = z[:done]
        for j, block in enumerate(blocks[1:], 1):
            y[-f * len(block) :, :-j] += z[done : done + f * len(block), j:]
            done += f * len(block)
        y += np.concatenate(self.biases)[:, None]
        return y

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """windows(), at least 0, of each width: (rows of x, filters)."""
        return np.split(np.maximum(self.windows(x), 0).T, len(WIDTHS), axis=1)

    def _tile(self, words: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x, first = self.embedded(words, bounds)
        return maxima(self.windows(x).T, first, starts)

    def logits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.pooled(words, bounds) @ self.weights + self.bias


def gradients(network: Network, words: np.ndarray, bounds: np.ndarray, labels: np.ndarray, decay: float, tile: int = 4 * TILE) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss (and decay / 2 times the squares of filters and weights): for filters, biases and weights; for the bias; and for the vectors of the words that
    matter (numbers of words, rows).  They pass through the windows that hold the maxima, which are found tile by tile.
    """
    f, n, kind = network.biases[0].shape[0], len(labels), network.filters[0].dtype
    e = TABLES * network.tables.shape[2]
    pooled, where = np.zeros((n, f * len(WIDTHS)), kind), np.zeros((n, f * len(WIDTHS)), np.int64)
    for at, to, s, end, starts in tiles(bounds, tile):
        own = np.clip(bounds[at : to + 1], s, end)
        x, first = network.embedded(words[:, s:end], own - s)
        y = network.windows(x)
        rows = np.stack([a + y[:, a : a + m].argmax(axis=1) for a, m in zip(first.tolist(), starts.tolist(), strict=True)])
        best = y[np.arange(len(y)), rows]
        so_far, place = pooled[at:to], where[at:to]
        better = best > so_far
        so_far[better] = best[better]
        place[better] = (rows - first[:, None] + own[:-1, None])[better]
    error = (1 / (1 + np.exp(-(pooled @ network.weights + network.bias))) - labels).astype(kind) / n
    back = error[:, None] * network.weights * (pooled > 0)
    # a column for each word of each filter's window, in the order of blocks()
    blocks = network.blocks()
    columns = [slice(f * (len(WIDTHS) - len(block)), None) for block in blocks]
    grads, touched, dx = np.zeros((f * sum(WIDTHS), e), kind), np.zeros(0, np.int64), np.zeros((0, e), kind)
    if words.shape[1]:
        rows = np.concatenate([where[:, own] + j for j, own in enumerate(columns)], axis=1)
        own = np.concatenate([back[:, own] for own in columns], axis=1) * (rows < bounds[1:, None])  # words behind the end are empty
        rows = np.minimum(rows, words.shape[1] - 1)
        _, size, d = network.tables.shape
        vectors = network.tables.reshape(-1, d).take(words.T[rows] + np.arange(TABLES) * size, axis=0).reshape(*rows.shape, e)
        grads = np.einsum("nfd,nf->fd", vectors, own)
        i, filter_ = np.nonzero(own)
        if len(i):
            places = rows[i, filter_]
            parts = own[i, filter_][:, None] * np.concatenate([m.T for block in blocks for m in block])[filter_]
            order = np.argsort(places, kind="stable")
            ranked = places[order]
            new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            touched, dx = ranked[new], np.add.reduceat(parts[order], new, axis=0)
    cuts = iter(np.split(grads, sum(WIDTHS)))
    parts_of = [[] for _ in WIDTHS]
    for block in blocks:
        for k in range(len(WIDTHS) - len(block), len(WIDTHS)):
            parts_of[k].append(next(cuts).T)
    grads_f = [np.concatenate(own) + decay * matrix for own, matrix in zip(parts_of, network.filters, strict=True)]
    grads_b = np.split(back.sum(axis=0), len(WIDTHS))
    return [*grads_f, *grads_b, pooled.T @ error + decay * network.weights], float(error.sum()), touched, dx


@dataclass
class Learner:
    """A network and Adagrad's sums of squares: of the dense parameters, of the rows of the tables, of the bias."""

    network: Network
    sums: list[np.ndarray]
    table_sums: np.ndarray
    bias_sum: float = 1e-2

    @classmethod
    def of(cls, network: Network) -> Learner:
        return cls(network, [np.full(p.shape, 1e-2, np.float32) for p in (*network.filters, *network.biases, network.weights)], np.full(network.tables.shape[:2], 1e-2, np.float32))

    def dense(self) -> list[np.ndarray]:
        return [*self.network.filters, *self.network.biases, self.network.weights, *self.sums]

    def flat(self) -> np.ndarray:
        """All but the tables in one row of doubles."""
        return np.concatenate([*(p.ravel() for p in self.dense()), [self.network.bias, self.bias_sum]], dtype=np.float64)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The numbered rows of the tables, each with its sum of squares behind it."""
        return np.concatenate([self.network.tables.reshape(self.table_sums.size, -1)[at], self.table_sums.reshape(-1, 1)[at]], axis=1)

    def move(self, dense: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
        """Adds changes: of flat(), and of the numbered rows()."""
        done = 0
        for p in self.dense():
            p += dense[done : done + p.size].reshape(p.shape).astype(p.dtype)
            done += p.size
        self.network.bias += float(dense[done])
        self.bias_sum += float(dense[done + 1])
        t, row = np.divmod(at, self.table_sums.shape[1])
        self.network.tables[t, row] += rows[:, :-1].astype(np.float32)
        self.table_sums[t, row] += rows[:, -1].astype(np.float32)

    def step(self, words: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rate: float, decay: float) -> None:
        """Adagrad on the logistic loss of a few documents, in place."""
        network, d = self.network, self.network.tables.shape[2]
        grads, g, touched, dx = gradients(network, words, bounds, labels, decay)
        for p, grad, s in zip([*network.filters, *network.biases, network.weights], grads, self.sums, strict=True):
            s += grad * grad
            p -= rate * grad / np.sqrt(s)
        self.bias_sum += g * g
        network.bias -= rate * g / self.bias_sum**0.5
        grad = dx.reshape(-1, d)
        rows = (words[:, touched].T + np.arange(TABLES) * network.tables.shape[1]).ravel()
        sums, tables = self.table_sums.reshape(-1), network.tables.reshape(-1)
        np.add.at(sums, rows, (grad * grad).sum(axis=1))
        np.add.at(tables, (rows[:, None] * d + np.arange(d)).ravel(), (-rate * grad / np.sqrt(sums[rows])[:, None]).ravel())

    def pass_over(self, words: np.ndarray, bounds: np.ndarray, labels: np.ndarray, take: np.ndarray, batch: int, rate: float, decay: float, seed: list[int]) -> None:
        """One pass over the documents `take`, in an order that seed draws."""
        order = np.random.default_rng(seed).permutation(take)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = bounds[pick + 1] - bounds[pick]
            own = np.concatenate([words[:, s:e] for s, e in zip(bounds[pick].tolist(), bounds[pick + 1].tolist(), strict=True)], axis=1)
            self.step(own, np.concatenate([[0], np.cumsum(sizes)]), labels[pick], rate, decay)


def table_rows(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of all words in the tables, word offsets of the documents)."""
    hashes, _, _, bounds = word_hashes(*text_buffer(column), lower=True, separator=MARKS, stems=STEMS)
    return (hashes & U64((1 << bits) - 1)).astype(np.uint16), bounds


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit with the best F1, midway between the two neighbouring values; 0 without both classes."""
    if len(set(labels.tolist())) < 2:
        return 0.0
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    i = int(f1.argmax())
    ranked = logits[order]
    return float((ranked[i] + ranked[i + 1]) / 2) if i + 1 < len(ranked) else float(ranked[i] - 1)


@dataclass
class ToxicityModel:
    network: Network
    languages: langid.LanguageModel
    thresholds: dict[str, float]
    default: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Scores of whole texts, 0 to 1; a null or empty text is scored as one without words."""
        logits = self.network.logits(*table_rows(column, self.network.tables.shape[1].bit_length() - 1))
        cuts = [self.thresholds.get(x, self.default) for x in self.languages.names(column.to_pylist())] if self.thresholds else np.full(len(column), self.default)
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64) - np.array(cuts), -30, 30)))


def marked(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1) of the labels that are not null; of labels that repeat a doc_id the highest."""
    return labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def sampled(docs: DataFrame, labels: DataFrame, max_rows_per_class: int, max_text_bytes: int, max_sample_bytes: int) -> DataFrame:
    """doc_id, toxic, text of a bounded sample for looks at the data (fit learns from every labelled row), a row for each doc_id; of texts that share a doc_id the least."""
    usable = F.col("text").isNotNull() & (F.octet_length("text") <= max_text_bytes)
    lengths = materialise(docs.filter(usable).groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes")).join(marked(labels), "doc_id"))
    sizes = {r["toxic"]: r for r in lengths.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    shares = [min(1.0, max_rows_per_class / max(1, sizes[c]["n"]), max_sample_bytes / 2 / max(1, sizes[c]["bytes"])) if c in sizes else 0.0 for c in (0, 1)]
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    sample = lengths.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").filter(usable).join(F.broadcast(sample), "doc_id")  # at most about 2 * max_rows_per_class doc_ids
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


BUNDLE = "part int, trained0 long, trained1 long, held0 long, held1 long, words binary, sizes binary, labels binary, held binary, langs binary"


def bundles(docs: DataFrame, labels: DataFrame, languages: langid.LanguageModel, bits: int, bundle_bytes: int, most_broadcast: int = 4 << 20) -> DataFrame:
    """Every row of docs that has a text and a label, as rows of the tables, in bundles of about bundle_bytes of text (see BUNDLE), each a file of its own.

    The bundle of a row is a hash of doc_id and text.  Every fifth of either class of a bundle is held from the gradients.  Where more than most_broadcast documents have a label,
    texts and labels are shuffled to meet; labels are sent to the texts below that.
    """
    marks = materialise(marked(labels))
    if marks.count() <= most_broadcast:
        marks = F.broadcast(marks)
    texts = bounded_batches(docs).filter(F.col("text").isNotNull()).select("doc_id", "text")
    size = texts.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(marks, "doc_id").agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, math.ceil(size / bundle_bytes))
    code = {name: i for i, name in enumerate(languages.labels)}

    def hashed(batches):
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                words, bounds = table_rows(b.column("text"), bits)
                langs = pa.array([code.get(x, -1) for x in languages.names(b.column("text").to_pylist())], pa.int32())
                # the rows of a word side by side: repeated words are then repeated bytes, which compress
                flat = np.ascontiguousarray(words.T)
                yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("toxic"), langs, pa.array([flat[s:e].tobytes() for s, e in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["part", "doc_id", "toxic", "lang", "words"])

    def packed(table: pa.Table) -> pa.Table:
        part, ids, toxic, langs, words = (table.column(c).to_pylist() for c in ("part", "doc_id", "toxic", "lang", "words"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], words[i]))
        labels = np.array(toxic, np.uint8)[order]
        held = np.zeros(len(order), bool)
        for c in (0, 1):
            held[np.flatnonzero(labels == c)[(-part[0]) % 5 :: 5]] = True
        counts = [int(((labels == c) & (held == h)).sum()) for h in (False, True) for c in (0, 1)]
        sizes = np.array([len(words[i]) // (2 * TABLES) for i in order], np.int64)
        row = [part[0], *counts, b"".join(words[i] for i in order), sizes.tobytes(), labels.tobytes(), held.tobytes(), np.array(langs, np.int32)[order].tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(row, [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 5], strict=True)], names=[c.split()[0] for c in BUNDLE.split(", ")])

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")
    rows = texts.join(marks, "doc_id").select(part, F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")
    ready = rows.mapInArrow(hashed, "part int, doc_id long, toxic int, lang int, words binary").groupBy("part").applyInArrow(packed, BUNDLE)
    path = scratch_dir(docs.sparkSession)
    ready.write.option("maxRecordsPerFile", 1).parquet(path)
    return docs.sparkSession.read.schema(BUNDLE).parquet(path)


def opened(batches):
    """(part, words, word offsets, labels, held, languages) of each bundle."""
    for b in batches:
        for i in range(b.num_rows):
            words, sizes, labels, held, langs = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("words", np.uint16), ("sizes", np.int64), ("labels", np.uint8), ("held", bool), ("langs", np.int32)))
            yield b.column("part")[i].as_py(), np.ascontiguousarray(words.reshape(-1, TABLES).T), np.concatenate([[0], np.cumsum(sizes)]), labels, held, langs


#: rows of the tables that are added up together
CHUNK = 1 << 14


def train_round(packs: DataFrame, learner: Learner, everything: bool, batch: int, rate: float, decay: float, seed: list[int]) -> None:
    """Every bundle is passed over from the same learner, which then moves by the mean of their changes, a row of the tables by the mean over the bundles that changed it.
    A bundle counts with the number of its documents.

    A task adds up the changes of its bundles; chunks of the parameters are added up by a shuffle; the sums, of the network's size, come to the driver.
    """
    context = packs.sparkSession.sparkContext
    shared = context.broadcast(learner)  # a fixed size, whatever the data

    def run(batches):
        start, least = shared.value, None
        flat = start.flat()
        count = np.zeros(start.table_sums.size, np.int64)
        moved, dense, n = np.zeros((len(count), learner_width)), np.zeros(flat.shape), 0
        for part, words, bounds, labels, held, _ in opened(batches):
            take = np.arange(len(labels)) if everything else np.flatnonzero(~held)
            if not len(take):
                continue
            own = copy.deepcopy(start)
            own.pass_over(words, bounds, labels.astype(np.float32), take, batch, rate, decay, [*seed, part])
            at = np.flatnonzero(((own.network.tables != start.network.tables).any(axis=2) | (own.table_sums != start.table_sums)).ravel())
            count[at] += len(take)
            moved[at] += len(take) * (own.rows(at) - start.rows(at)).astype(np.float64)
            dense += len(take) * (own.flat() - flat)
            least = part if least is None else min(part, least)
            n += len(take)
        if n:
            yield changes(-1, least, np.array([n]), np.array([n]), dense)
            at = np.flatnonzero(count)
            for c in np.unique(at // CHUNK):
                own = at[at // CHUNK == c]
                yield changes(int(c), least, own, count[own], moved[own].astype(np.float32))
        release()

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table.column("least")), kind="stable")
        chunk = table.column("chunk")[0].as_py()
        ats, counts, values = (table.column(c).to_pylist() for c in ("at", "count", "change"))
        if chunk < 0:
            n = sum(int(np.frombuffer(counts[i], np.int64)[0]) for i in order)
            return pa.Table.from_batches([changes(chunk, 0, np.array([n]), np.array([n]), sum(np.frombuffer(values[i], np.float64) for i in order))])
        width = learner_width
        total, count = np.zeros((CHUNK, width)), np.zeros(CHUNK, np.int64)
        for i in order:
            at = np.frombuffer(ats[i], np.int32) - chunk * CHUNK
            total[at] += np.frombuffer(values[i], np.float32).reshape(-1, width)
            count[at] += np.frombuffer(counts[i], np.int64)
        at = np.flatnonzero(count)
        return pa.Table.from_batches([changes(chunk, 0, at + chunk * CHUNK, count[at], total[at].astype(np.float32))])

    learner_width = learner.network.tables.shape[2] + 1
    schema = "chunk int, least int, at binary, count binary, change binary"
    found = packs.mapInArrow(run, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    shared.destroy()
    dense, ats, rows = np.zeros(0), [], []
    for r in sorted(found, key=lambda r: r["chunk"]):
        count = np.frombuffer(r["count"], np.int64)
        if r["chunk"] < 0:
            dense = np.frombuffer(r["change"], np.float64) / count[0]
        else:
            ats.append(np.frombuffer(r["at"], np.int32))
            rows.append(np.frombuffer(r["change"], np.float32).reshape(-1, learner_width) / count[:, None])
    if len(dense):
        learner.move(dense, np.concatenate([np.zeros(0, np.int32), *ats]), np.concatenate([np.zeros((0, learner_width)), *rows]))


def changes(chunk: int, least: int, at: np.ndarray, count: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([chunk], pa.int32()), pa.array([least], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), count.astype(np.int64), change))]
    return pa.RecordBatch.from_arrays(values, names=["chunk", "least", "at", "count", "change"])


#: logits are told apart by 2**-20; a bin of them holds 2**14 such steps
STEP_BITS, BIN_BITS = 20, 14


def best_thresholds(judged: DataFrame, least_of_language: int) -> tuple[dict[str, float], float]:
    """(threshold of each language that has least_of_language documents of either class, threshold of all) of judged (lang, logit, toxic): best_threshold over all rows.

    Counts run within bins of logits, and start from the counts of the bins above, so no group holds more than 2**BIN_BITS distinct logits, and the bins of a language are bounded too.
    """
    most = F.lit(float(1 << 30))
    step = F.least(F.greatest(F.round(F.col("logit") * float(1 << STEP_BITS)), -most), most).cast("long").alias("step")
    keys = F.explode(F.array(F.concat(F.lit("="), F.coalesce("lang", F.lit(""))), F.lit(""))).alias("key")
    counts = [F.sum("hits").alias("hits"), F.sum("n").alias("n")]
    points = judged.select(keys, step, F.col("toxic").cast("long").alias("hits"), F.lit(1).cast("long").alias("n")).groupBy("key", "step").agg(*counts)
    points = materialise(points.withColumn("bin", F.shiftright("step", BIN_BITS)))
    whole, down = Window.partitionBy("key"), Window.partitionBy("key").orderBy(F.desc("bin"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    bins = points.groupBy("key", "bin").agg(*counts, F.max("step").alias("top"))
    before = [F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_before") for c in ("hits", "n")]
    bins = bins.select("key", "bin", *before, F.lead("top").over(down).alias("below"), F.sum("hits").over(whole).alias("all_hits"), F.sum("n").over(whole).alias("all_n"))
    order = Window.partitionBy("key", "bin").orderBy(F.desc("step"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    f1 = 2 * (F.col("hits_before") + F.sum("hits").over(so_far)) / (F.col("n_before") + F.sum("n").over(so_far) + F.col("all_hits"))
    cut = (F.col("step") + F.coalesce(F.lead("step").over(order), "below", F.col("step") - (2 << STEP_BITS))) / float(2 << STEP_BITS)
    ranked = points.join(bins, ["key", "bin"]).select("key", "step", "all_hits", "all_n", f1.alias("f1"), cut.alias("cut"))
    best = ranked.groupBy("key", "all_hits", "all_n").agg(F.max_by("cut", F.struct("f1", "step")).alias("cut")).collect()
    enough = {r["key"]: r["cut"] for r in best if min(r["all_hits"], r["all_n"] - r["all_hits"]) >= (least_of_language if r["key"] else 1)}
    return {key[1:]: cut for key, cut in sorted(enough.items()) if key}, enough.get("", 0.0)


def fit(docs: DataFrame, labels: DataFrame, bits: int = 16, dims: int = 8, filters: int = 16, epochs: int = 10, batch: int = 32, rate: float = 0.1, decay: float = 1e-5, least_of_language: int = 20, seed: int = 11, bundle_bytes: int = 16 << 20) -> ToxicityModel:
    """Learns labels.toxic from docs.text: from every row that has a text and a label, and from the whole text.

    docs: doc_id, text, lang (lang only trains the recogniser of languages, it is no input of a score).  labels: doc_id, toxic; null
    labels are left out, of labels that repeat a doc_id the highest counts, and texts that repeat a doc_id all have its label.
    A round is one pass over all documents, bundle by bundle (see train_round); four fifths of a bundle are learnt from, the others set the thresholds.  Where either part lacks a class, all are
    learnt from and all set them.  A task's memory is one bundle; only the network, of a fixed size, comes to the driver.
    bits is at most 16.  Without both classes the network stays as drawn and every score is below 0.5.
    """
    languages = langid.fit(docs)
    learner = Learner.of(Network.fresh(bits, dims, filters, seed))
    packs = bundles(docs, labels, languages, bits, bundle_bytes)
    have = packs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("trained0", "trained1", "held0", "held1")]).first()
    if not min(have["trained0"] + have["held0"], have["trained1"] + have["held1"]):
        return ToxicityModel(learner.network, languages, {}, float("inf"))
    everything = not min(have)
    for epoch in range(epochs):
        train_round(packs, learner, everything, batch, rate, decay, [seed, epoch])
    shared = packs.sparkSession.sparkContext.broadcast(learner.network)  # a fixed size, whatever the data
    names = [*languages.labels, langid.UNDETERMINED]

    def judge(batches):
        for _, words, bounds, labels, held, langs in opened(batches):
            logits = shared.value.logits(words, bounds)
            own = np.arange(len(labels)) if everything else np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in langs[own]], pa.string()), pa.array(logits[own].astype(np.float64)), pa.array(labels[own].astype(np.int32))], names=["lang", "logit", "toxic"])

    thresholds, default = best_thresholds(packs.mapInArrow(judge, "lang string, logit double, toxic int"), least_of_language)
    return ToxicityModel(learner.network, languages, thresholds, default)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs plus score and predicted, from `text` alone; a clash with such columns of docs replaces them.

    Null and empty texts get the score of a text without words.  Repeated rows are scored each time.
    """
    from pyspark.sql import types as T

    docs = bounded_batches(docs).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, whatever the data

    def run(batches):
        own = shared.value
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                s = own.score(b.column(b.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])
        release()

    return docs.mapInArrow(run, schema)
