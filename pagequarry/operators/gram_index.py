"""A stored index of character grams over blocks of rows, for many substring searches at once.

Rows are sorted and cut into small blocks.  For every gram (one to three characters, as a number) and every block that has it, the index holds the greatest
value that a row of the block can give to a term with that gram; these postings are written sorted by gram and block.  A term can only occur in blocks that have
all its grams, and there counts no more than the least of their values.  Both searches go through the postings in an order that lets them stop: by falling value
for the best rows (`best_rows`), by block for the first rows (`first_rows`).  What is left is decided by the rows themselves, which are read block by block.  Where there are so many
queries that nearly every block matters to some, the best rows come from one pass over the rows, without postings.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators.ranking import scratch, written

#: how many of a term's grams are looked up, those in the fewest blocks; more would only exclude a few more blocks
PROBES = 4
#: bits of a code point; three fit 63 bits
BITS = 21
#: a task's running number starts at its partition's number shifted by this (monotonically_increasing_id)
TASK_BITS = 33


def grams_of(text: str) -> np.ndarray:
    """The distinct grams of one to three characters of a text, as numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    pairs = c[:-1] << BITS | c[1:]
    return np.unique(np.concatenate([c, pairs, pairs[:-1] << BITS | c[2:]]))


def needed_by(term: str) -> list[int]:
    """The grams that any text with this term has: its triples, or the whole term if it is shorter."""
    c = [ord(x) for x in term]
    width = min(3, len(c))
    return sorted({sum(x << BITS * (width - 1 - j) for j, x in enumerate(c[i : i + width])) for i in range(len(c) - width + 1)}) if c else []


def triple(gram: Column) -> Column:
    """The three characters of a gram of three."""
    code = lambda shift: F.lpad(F.hex(F.shiftright(gram, shift).bitwiseAND(F.lit((1 << BITS) - 1))), 8, "0")
    return F.decode(F.unhex(F.concat(code(2 * BITS), code(BITS), code(0))), "UTF-32")


def _postings(batches):
    """(gram, block, best) of stored rows, some rows at a time: a gram's value in a row is its points there times the row's weight."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            found = []
            for block, low, weight, pieces, points in zip(*(part.column(c).to_pylist() for c in ("block", "low", "weight", "pieces", "points")), strict=True):
                grams = grams_of(low)
                value = np.ones(len(grams))
                for piece, p in zip(pieces, points, strict=True):
                    own = grams_of(piece)
                    place = np.minimum(np.searchsorted(grams, own), len(grams) - 1) if len(grams) else own[:0]
                    value[place[grams[place] == own[: len(place)]]] += p
                found.append((np.full(len(grams), block), grams, value * weight))
            if not found:
                continue
            block, gram, value = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(gram):
                continue
            order = np.lexsort((gram, block))
            block, gram, value = block[order], gram[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (gram[1:] != gram[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(block[first]), pa.array(np.maximum.reduceat(value, first))], names=["gram", "block", "best"])


def _needed(batches):
    """(term, n, gram): each gram a term needs, and how many these are."""
    for b in batches:
        terms = b.column(0).to_pylist()
        grams = [needed_by(t) for t in terms]
        n = [len(g) for g in grams]
        columns = [[t for t, k in zip(terms, n, strict=True) for _ in range(k)], [k for k in n for _ in range(k)], [g for own in grams for g in own]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["term", "n", "gram"])


def _occurrences(columns: list[str]):
    """The first `most` rows of a block that have each of its terms."""

    def scan(terms, rows):
        import ahocorasick

        machine, sent, out = ahocorasick.Automaton(), {}, []
        names, most = terms.column("term").to_pylist(), terms.column("most").to_pylist()
        for i, term in enumerate(names):
            machine.add_word(term, i)
        if len(machine) and rows.num_rows:
            machine.make_automaton()
            texts, order = rows.column("low").to_pylist(), np.argsort(rows.column("row").to_numpy())
            for r in order.tolist():
                for i in {hit for _, hit in machine.iter(texts[r])}:
                    if sent.get(i, 0) < most[i]:
                        sent[i] = sent.get(i, 0) + 1
                        out.append((i, r))
        at = pa.array([r for _, r in out], pa.int64())
        kept = rows.select(["row", *columns]).take(at)
        return pa.table([pa.array([names[i] for i, _ in out], pa.string()), pa.array([most[i] for i, _ in out], pa.int64()), *kept.columns], names=["term", "most", "row", *columns])

    return scan


def _best_of(k: int, at_once: int = 256, cells: int = 1 << 20):
    """(q, row, score) of each query's k best rows of a tile, ties to the first.

    The rows are taken some at a time, in order.  Their words are looked up once each, which gives the points of every term in every row; a query is scored where what its terms have at
    most there is above its k-th score so far: later rows that are as good come after.
    """

    def scan(rows, asked):
        import ahocorasick

        schema = ["q", "row", "score"]
        if not rows.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=schema)
        terms = asked.column("terms").combine_chunks()
        flat = terms.flatten().dictionary_encode()
        names, number, size = flat.dictionary.to_pylist(), flat.indices.to_numpy(), np.diff(terms.offsets.to_numpy())
        # queries by falling number of terms; nth[j]: the j-th term of all that have so many
        falling = np.argsort(-size, kind="stable")
        start, size = (np.cumsum(size) - size)[falling], size[falling]
        nth = [number[start[: np.searchsorted(-size, -j)] + j] for j in range(int(size.max()))]
        machine, known = ahocorasick.Automaton(), {}
        for i, name in enumerate(names):
            machine.add_word(name, i)
        machine.make_automaton()
        # a term without a space lies within a word
        words = (lambda t: {t}) if any(" " in name for name in names) else (lambda t: set(t.split(" ")))

        def held(text):
            if len(known) > 1 << 17:
                known.clear()
            out = set()
            for word in words(text):
                if (ids := known.get(word)) is None:
                    ids = known[word] = tuple({i for _, i in machine.iter(word)})
                out.update(ids)
            return out

        score, row, theta = np.zeros((len(size), k)), np.zeros((len(size), k), np.int64), np.zeros(len(size))
        rows = rows.take(pa.array(np.argsort(rows.column("row").to_numpy())))
        for first in range(0, rows.num_rows, at_once):
            part = rows.slice(first, at_once)
            own, weight, ids, values, sizes = part.column("row").to_numpy(), part.column("weight").to_numpy(), [], [], []
            for low, pieces, points in zip(*(part.column(c).to_pylist() for c in ("low", "pieces", "points")), strict=True):
                value = dict.fromkeys(held(low), 1.0)
                for piece, p in zip(pieces, points, strict=True):
                    for i in held(piece):
                        value[i] = value.get(i, 0.0) + p
                ids.extend(value)
                values.extend(value.values())
                sizes.append(len(value))
            there, at = np.unique(np.array(ids, np.int64), return_inverse=True)
            points = np.zeros((len(there) + 1, len(sizes)))
            points[at, np.repeat(np.arange(len(sizes)), sizes)] = values
            # terms that no row here has share the last line
            place = np.full(len(names), len(there))
            place[there] = np.arange(len(there))
            most, bound = (points * weight).max(axis=1)[place], np.zeros(len(size))
            for t in nth:
                bound[: len(t)] += most[t]
            # bounds add what scores multiply: rounding must not bring a bound below a score
            open_ = np.flatnonzero(bound * (1.0 + 1e-9) > theta)
            step = max(1, cells // len(sizes))
            for c in np.split(open_, range(step, len(open_), step)):
                s = np.zeros((len(c), len(sizes)))
                for t in nth:
                    n = np.searchsorted(c, len(t))
                    s[:n] += points[place[t[c[:n]]]]
                s *= weight
                better = s.max(axis=1) > theta[c]
                c, s = c[better], s[better]
                # the sort is stable, and what was there before comes first
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                s, r = np.concatenate([score[c], np.take_along_axis(s, best, 1)], axis=1), np.concatenate([row[c], own[best]], axis=1)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score[c], row[c] = np.take_along_axis(s, best, 1), np.take_along_axis(r, best, 1)
                theta[c] = score[c, k - 1]
        q, j = np.nonzero(score > 0)
        return pa.table([asked.column("q").to_numpy()[falling[q]], row[q, j], score[q, j]], names=schema)

    return scan


@dataclass
class GramIndex:
    """rows: the indexed rows with `block` and their lower-case text `low`; path: the folder; spans: (first block, blocks) of each part; order: the columns they are sorted by, if known."""

    rows: DataFrame
    path: str
    spans: list[tuple[int, int]]
    block_rows: int = 64
    order: list[str] | None = None
    #: whether the folder has postings and sizes
    stored: bool = True
    #: of the last best_rows: the (query_id, block) that were scored, and the value below which no posting was read
    scored: DataFrame | None = None
    floor: float = 0.0
    #: of the last first_rows: the last block that was read; None: all were
    reached: int | None = None

    @staticmethod
    def build(table: DataFrame, order: list[str], low: Column, pieces: Column | None = None, points: Column | None = None, weight: Column | None = None, block_rows: int = 64, path: str | None = None) -> GramIndex:
        """Indexes a table in the order of some columns, in a folder (the shared one by default).

        low: the lower-case text in which terms are searched.  A term that occurs there gets one point, and points[i] for each lower-case pieces[i] that it occurs in,
        times weight; pieces must be parts of low.  block_rows: a power of two.  In the shared folder, where nobody else opens it, postings are written when they are first asked for.
        """
        spark, kept = table.sparkSession, path is not None
        path = path or scratch(spark)
        none = lambda kind: F.array().cast(f"array<{kind}>")
        rows = table.withColumn("low", F.coalesce(low, F.lit("")))
        rows = rows.withColumn("pieces", none("string") if pieces is None else pieces).withColumn("points", none("double") if points is None else points)
        rows = rows.withColumn("weight", F.lit(1.0) if weight is None else weight)
        numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
        numbered.withColumn("block", F.shiftright("row", block_rows.bit_length() - 1)).write.parquet(f"{path}/rows")
        index = GramIndex.open(spark, path, block_rows, order)
        index.stored = False
        if kept:
            _ = index.sizes
        return index

    @staticmethod
    def open(spark: SparkSession, path: str, block_rows: int = 64, order: list[str] | None = None) -> GramIndex:
        """A stored index; only the number of blocks of each of its parts comes to the driver."""
        rows = spark.read.parquet(f"{path}/rows")
        shift = TASK_BITS - (block_rows.bit_length() - 1)
        parts = rows.groupBy(F.shiftright("block", shift).alias("part")).agg(F.max("block").alias("last")).orderBy("part").collect()
        return GramIndex(rows, path, [(r["part"] << shift, r["last"] - (r["part"] << shift) + 1) for r in parts], block_rows, order)

    @cached_property
    def postings(self) -> DataFrame:
        """gram, block, best, sorted by gram and block."""
        if not self.stored:
            found = self.rows.select("block", "low", "weight", "pieces", "points").mapInArrow(_postings, "gram long, block long, best double")
            # one exchange: what is dealt by range of (gram, block) is grouped where it is
            sorted_ = found.repartitionByRange("gram", "block").groupBy("gram", "block").agg(F.max("best").alias("best")).sortWithinPartitions("gram", "block")
            sorted_.write.parquet(f"{self.path}/postings")
        return self.rows.sparkSession.read.parquet(f"{self.path}/postings")

    @cached_property
    def sizes(self) -> DataFrame:
        """gram, blocks."""
        if not self.stored:
            self.postings.groupBy("gram").agg(F.count("*").alias("blocks")).write.parquet(f"{self.path}/sizes")
        return self.rows.sparkSession.read.parquet(f"{self.path}/sizes")

    def block_at(self, rank: int) -> int | None:
        """The block of a rank (from 0) in the index's order; None beyond the last."""
        for first, n in self.spans:
            if rank < n:
                return first + rank
            rank -= n
        return None

    def probes(self, terms: DataFrame) -> DataFrame:
        """term, grams (the PROBES of its grams that are in the fewest blocks) of the distinct terms all of whose grams are in the index."""
        found = terms.select("term").filter("term <> ''").distinct().mapInArrow(_needed, "term string, n int, gram long").join(self.sizes, "gram")
        rare = found.groupBy("term", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("blocks", "gram"))), 1, PROBES).alias("rare"), F.count("*").alias("known"))
        return rare.filter("known = n").select("term", F.col("rare.gram").alias("grams"))

    def first_rows(self, wanted: DataFrame, columns: list[str], reach: int = 8, group: int = 20_000) -> DataFrame:
        """term and `columns` of the first `most` rows, in the index's order, whose text has the term; wanted: term, most.

        Blocks are taken in order, in growing rounds.  A term that has its rows is in no later round, so of a frequent term's postings and rows only the first are read;
        a rare term has few postings.  A block's terms look for their places together, in one pass over each text; more than about `group` terms are parted.
        """
        todo = written(wanted.filter("term <> ''").groupBy("term").agg(F.max("most").alias("most")).join(self.probes(wanted), "term"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.rows.select("row", *columns).schema)
        found, at, left = None, -1, todo.count()
        key = Window.partitionBy("term").orderBy("row")
        while left:
            to = self.reached = self.block_at(reach - 1)
            here = lambda df: df.filter((F.col("block") > at) & (F.col("block") <= to) if to is not None else F.col("block") > at)
            asked = todo.select("term", "most", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
            blocks = asked.join(here(self.postings).select("gram", "block"), "gram").groupBy("term", "most", "n", "block").agg(F.count("*").alias("have")).filter("have = n")
            parts = -(-left // group)
            blocks = blocks.select("term", "most", "block", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part"))
            rows = here(self.rows).select("block", "low", "row", *columns).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
            hits = blocks.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInArrow(_occurrences(columns), f"term string, most long, {schema}")
            hits = hits.withColumn("_n", F.row_number().over(key)).filter("_n <= most").drop("_n", "most")
            found = written(hits if found is None else found.unionByName(hits))
            if to is None or to == self.spans[-1][0] + self.spans[-1][1] - 1:
                break
            have = found.groupBy("term").agg(F.count("*").alias("have"))
            todo = written(todo.join(have, "term", "left").filter("have IS NULL OR have < most").drop("have"))
            at, reach, left = to, reach * 4, todo.count()
        if found is None:
            return wanted.select("term").limit(0).join(self.rows.select(*columns).limit(0))
        limits = wanted.groupBy("term").agg(F.max("most").alias("most"))
        # the last round of a term may bring more than it lacked
        return found.join(limits, "term").withColumn("_n", F.row_number().over(key)).filter("_n <= most").select("term", *columns)

    @staticmethod
    def score() -> Column:
        """The score of a row for a column `terms`: each term's points, times the row's weight."""

        def points(term: Column) -> Column:
            own = F.zip_with("pieces", "points", lambda piece, p: F.when(F.contains(piece, term), p).otherwise(0.0))
            return F.aggregate(own, F.when(F.contains("low", term), 1.0).otherwise(0.0), lambda total, p: total + p)

        return F.aggregate("terms", F.lit(0.0), lambda total, t: total + points(t)) * F.col("weight")

    def best_by_pass(self, queries: DataFrame, k: int, tie: list[str], columns: list[str], tile_rows: int = 1 << 15) -> DataFrame:
        """best_rows in one pass: tiles of consecutive rows meet parts of the queries, and bring the k best of each query.

        There are some 32 tiles, or more of at most about `tile_rows`; a part's best rows are at most some 4 million, so its memory does not grow with the input.
        """
        if self.order != tie:
            again = GramIndex.build(self.rows.drop("block", "row"), tie, F.col("low"), F.col("pieces"), F.col("points"), F.col("weight"), self.block_rows)
            return again.best_by_pass(queries, k, tie, columns, tile_rows)
        spark, n = self.rows.sparkSession, self.rows.count()
        asked = written(queries.select("query_id", "terms").withColumn("q", F.monotonically_increasing_id()))
        parts = max(1, -(-asked.count() // max(1, min(1 << 17, (1 << 22) // k))))
        blocks = sum(n for _, n in self.spans)
        tiles = max(1, min(32, n // 256), n // tile_rows)
        # blocks are numbered anew from 0, without the gaps between parts
        shift, before, offsets = TASK_BITS - (self.block_rows.bit_length() - 1), 0, []
        for first, own in self.spans:
            offsets.append((first >> shift, before - first))
            before += own
        offsets = F.broadcast(spark.createDataFrame(offsets, "part long, offset long"))  # a row for each file of the index
        rows = self.rows.withColumn("part", F.shiftright("block", shift)).join(offsets, "part").withColumn("tile", F.floor((F.col("block") + F.col("offset")) * tiles / blocks))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        rows = rows.select("tile", "row", "low", "pieces", "points", "weight", each(parts).alias("part"))
        dealt = asked.select("q", "terms", F.pmod(F.xxhash64("q"), F.lit(parts)).alias("part"), each(tiles).alias("tile"))
        # a number of partitions that is given is kept: tiles are few megabytes, but work
        deal = lambda df: df.repartition(2 * tiles * parts, "tile", "part").groupBy("tile", "part")
        found = deal(rows).cogroup(deal(dealt)).applyInArrow(_best_of(k), "q long, row long, score double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "row"))
        top = written(found.withColumn("_n", rank).filter(F.col("_n") <= k).drop("_n"))
        merged = lambda df: df.hint("merge")
        return merged(top).join(self.rows.select("row", *columns), "row").join(merged(asked.select("q", "query_id")), "q").select("query_id", "score", *columns)

    def best_rows(self, queries: DataFrame, k: int, tie: list[str], columns: list[str], batch: int = 8, few: int = 256) -> DataFrame:
        """query_id, score and `columns` of each query's k rows of the highest score, ties by `tie`; rows without a score above 0 are no hits.

        queries: query_id, terms (lower-case strings; one that occurs twice counts twice, an empty one does not).  Of more than `few` distinct terms, and one for every 64 rows, all rows are read once
        (`best_by_pass`): there are few blocks that no query needs.  Else postings are read in layers of falling value.  A block's bound is the sum over the terms of the least value of its grams, or of the
        layer's floor where a gram has not come up yet.  Blocks are scored by falling bound; a query is done when the floor, for all its terms, is no more than its k-th score.
        """
        queries = queries.withColumn("terms", F.filter("terms", lambda t: t != "")).filter(F.size("terms") > 0)
        distinct = queries.select(F.explode("terms")).distinct().count()
        if distinct > few and 64 * distinct > self.rows.count():
            self.scored, self.floor = None, 0.0
            return self.best_by_pass(queries, k, tie, columns)
        # what grows with queries or blocks is merged: its files are far smaller than its rows (repeated queries), and a broadcast chosen by file size would bring the rows to the driver
        merged = lambda df: df.hint("merge")
        # bounds add what scores multiply: rounding must not bring a bound below a score
        slack = 1.0 + 1e-9
        terms = queries.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))
        probes = written(terms.select("term").join(self.probes(terms), "term").distinct())
        terms = written(terms.groupBy("query_id", "term", "n_terms").agg(F.count("*").alias("times")).join(probes.select("term"), "term"))
        open_ = written(terms.groupBy("query_id").agg(F.max("n_terms").alias("n_terms")).withColumn("theta", F.lit(0.0)))
        quantiles = self.postings.agg(F.percentile_approx("best", [0.99, 0.8], 1000)).first()[0] or []
        floors = [*sorted({float(q) for q in quantiles}, reverse=True), 0.0]
        ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), *tie)
        top = scored = None
        for floor in floors:
            asked = terms.join(merged(open_.select("query_id")), "query_id", "left_semi").select("term").distinct().join(merged(probes), "term").select("term", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
            layer = asked.join(self.postings.filter(F.col("best") >= floor), "gram").groupBy("term", "n", "block").agg(F.count("*").alias("have"), F.min("best").alias("least"))
            layer = layer.filter("have = n") if floor == 0 else layer
            most = F.when(F.col("have") == F.col("n"), F.col("least")).otherwise(F.lit(floor))
            bounds = merged(terms).join(layer.select("term", "block", most.alias("most")), "term").groupBy("query_id", "block").agg(F.sum(F.col("most") * F.col("times")).alias("sum"), F.sum("times").alias("seen"))
            bounds = bounds.join(merged(open_), "query_id").select("query_id", "block", ((F.col("sum") + (F.col("n_terms") - F.col("seen")) * floor) * slack).alias("bound"))
            bounds, step = written(bounds), batch
            while True:
                rest = bounds if scored is None else bounds.join(merged(scored), ["query_id", "block"], "left_anti")
                rest = rest.join(merged(open_.select("query_id", "theta")), "query_id").filter("bound >= theta")
                chosen = written(rest.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))).filter(F.col("_n") <= step).select("query_id", "block"))
                if not chosen.limit(1).count():
                    break
                scored = chosen if scored is None else scored.unionByName(chosen)
                hits = merged(chosen).join(self.rows, "block").join(merged(queries.select("query_id", "terms")), "query_id").filter(F.exists("terms", lambda t: F.contains("low", t))).withColumn("score", self.score())
                hits = hits.select("query_id", "score", *columns)
                hits = hits if top is None else hits.unionByName(top)
                top = written(hits.withColumn("_n", F.row_number().over(ranks)).filter(F.col("_n") <= k).drop("_n"))
                open_ = self._thresholds(open_, top, k)
                step *= 4
            if floor == 0:
                break
            # what is unread is below the floor; for one term that holds to the last bit
            unread = F.when(F.col("n_terms") == 1, F.lit(floor)).otherwise(F.col("n_terms") * floor * slack)
            open_ = written(open_.filter(~((F.col("theta") > 0) & (unread <= F.col("theta")))))
            if not open_.limit(1).count():
                break
        self.scored, self.floor = scored, floor
        if top is None:
            return queries.select("query_id").limit(0).withColumn("score", F.lit(0.0)).join(self.rows.select(*columns).limit(0))
        return top

    @staticmethod
    def _thresholds(open_: DataFrame, top: DataFrame, k: int) -> DataFrame:
        """The k-th score of each query that has k hits."""
        full = top.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("score").alias("kth")).filter(F.col("hits") >= k)
        rows = open_.join(full.hint("merge"), "query_id", "left")
        return written(rows.select("query_id", "n_terms", F.coalesce("kth", "theta").alias("theta")))
