"""N-gram Jaccard join with PartEnum signatures.

A document is its set of distinct `words`-word shingles.  Sets of neighbouring sizes share a band; within a band, similarity of at least
`percent` % bounds the symmetric difference by k.  The shingle domain is dealt by hash into n1 first-level partitions, each of those into n2 second-level ones,
and subsets of the second-level partitions are enumerated: the content of a subset is a signature.

* A small k: n1 = 1, n2 = k + 2, all subsets of two.  At most k second-level partitions differ, so one subset is equal in both sets.
* Larger ones: n1 = 0.6 (k + 1), n2 = 3, all subsets of two.  The first difference in a first-level partition spoils two of its three subsets, the next the
  third, so k differences spoil no more than n1 + k of the 3 n1 subsets; the others are equal in both sets.  Subsets are ranked by the number of their shingles, ties
  by their content.  Whatever ranks above the first of the equal ones is spoilt, so that one is among the first n1 + k + 1 of either set: those are its
  signatures.  The rest, with few shingles or none, would bring unlike sets together.

So every similar pair shares a signature.  Sets that share one are compared exactly: the smallest doc_id of a bucket
is its centre, a centre's members (over all its buckets) form a cluster, and every pair that shares a signature lies in some cluster.
Clusters are searched for components, not for all pairs; heavy ones are cut into pairs of blocks.  Equal sets are one
representative from the start.  Signatures and a first search come from hashes, which can only bring sets nearer; every link that is
found is then confirmed with numbers that stand for unlike words (exact_shingles), and sizes are counted with words compared byte for byte.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import LOWER, MASK, U64, alone, bounded_batches, by_partition, deal, distinct_spans, kgrams, materialise, mix, pack, ranges, release, slices, text_bytes, text_buffer, unpack, word_hashes
from pagequarry.llm.graph import components, salted_lookup

#: up to this k one first-level partition serves; beyond it there are so many for each difference
ENUMERATED = 5
FIRST_LEVEL = 0.6


def shingle_sets(column: pa.Array | pa.ChunkedArray, words: int, compare: bool = False) -> tuple[np.ndarray, ...]:
    """(sorted distinct shingle hashes of all documents, size of each set); ASCII upper case counts as lower case.

    With `compare` also the exact sizes: words of equal hash are compared byte for byte, and should unlike ones have met, exact_shingles counts.
    """
    buf, offsets = text_buffer(column)
    buf = LOWER[buf]
    hashes, starts, ends, bounds = word_hashes(buf, offsets)
    grams = mix(kgrams(hashes, words))
    out, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for i, (s, e) in enumerate(itertools.pairwise(bounds.tolist())):
        if e - s >= words:
            x = np.sort(grams[s : e - words + 1])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif e > s:
            # fewer words than a shingle: the whole sequence, which no longer text can equal
            x = mix(kgrams(hashes[s:e], e - s) + U64(0x51ED270B9F6A3D17 * (words - (e - s)) & MASK))
        else:
            continue
        out.append(x)
        sizes[i] = len(x)
    found = np.concatenate(out) if out else np.zeros(0, U64)
    if compare:
        number, heads = distinct_spans(buf, starts, ends, hashes)
        met = len(np.unique(hashes[heads])) < len(heads)
        return found, sizes, exact_shingles(column, words)[1] if met else sizes
    return found, sizes


def exact_shingles(column: pa.Array | pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of all documents, size of each set), as numbers: equal numbers are shingles of equal words, byte for byte, within this column.

    Words are numbered by their bytes, and a run of words by the numbers of its first and second part, so no hash decides.
    """
    buf, offsets = text_buffer(column)
    buf = LOWER[buf]
    hashes, starts, ends, bounds = word_hashes(buf, offsets)
    word, heads = distinct_spans(buf, starts, ends, hashes)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(count)), count)

    def joined(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, int]:
        """Numbers of pairs of numbers below `most`."""
        found, number = np.unique(left * most + right, return_inverse=True)
        return number, len(found)

    run, most, width = word, max(1, len(heads)), 1
    done, kinds, size = None, 1, 0
    # the number of every run of `words` words, put together from runs of powers of two; fewer are left at the end of the column
    while True:
        if words & width:
            if done is None:
                done, kinds, size = run, most, width
            else:
                n = len(run) - size
                done, kinds = joined(done[: max(0, n)], run[size : size + max(0, n)], max(kinds, most))
                size += width
        if size == words:
            break
        n = len(run) - width
        run, most = joined(run[: max(0, n)], run[width : width + max(0, n)], most)
        width *= 2
    first = np.arange(len(done))
    inside = doc[first] == doc[first + words - 1] if len(done) else np.zeros(0, bool)
    owner, value = [doc[first[inside]]], [done[inside]]
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        known: dict[tuple[int, ...], int] = {}
        owner.append(few)
        value.append(np.array([kinds + known.setdefault(tuple(word[bounds[i] : bounds[i + 1]].tolist()), len(known)) for i in few.tolist()], np.int64))
    owner, value = np.concatenate(owner), np.concatenate(value).astype(np.int64)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(owner[new], minlength=len(count)).astype(np.int64)


class Bands:
    """Bands of sizes: each holds sizes first..last, and last is about first / similarity**2."""

    def __init__(self, percent: int):
        self.percent = percent
        self.first = [1]

    def difference(self, last: int) -> int:
        """Largest symmetric difference of a similar pair of sizes up to `last`."""
        return 2 * last * (100 - self.percent) // (100 + self.percent)

    def last(self, band: int) -> int:
        while len(self.first) <= band + 1:
            at = self.first[-1]
            self.first.append(max(at, at * 10_000 // self.percent**2) + 1)
        return self.first[band + 1] - 1

    def of(self, size: int) -> int:
        band = 0
        while self.last(band) < size:
            band += 1
        return band

    def joined(self, size: int) -> list[int]:
        """The bands whose sets a set of this size can be similar to, as the smaller or equal one: its own, and perhaps the next."""
        own = self.of(size)
        return [own, own + 1] if 100 * size >= self.percent * (self.last(own) + 1) else [own]


def signatures(shingles: np.ndarray, band: int, k: int) -> np.ndarray:
    """Signatures of one set in one band."""
    salt = mix(np.array([band + 1], U64) * U64(0x9FB21C651E98DF25))[0]
    n1, n2 = (1, k + 2) if k <= ENUMERATED else (max(k // 2 + 1, math.ceil(FIRST_LEVEL * (k + 1))), 3)
    part = ((shingles ^ salt) * U64(0xC2B2AE3D27D4EB4F) >> U64(40)).astype(np.int64) % (n1 * n2)
    # the content of a partition: the sum of its mixed shingles
    order = np.argsort(part.astype(np.uint16) if n1 * n2 <= 65536 else part, kind="stable")
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(shingles)[order], dtype=U64)])
    count = np.bincount(part, minlength=n1 * n2)
    content = mix(np.diff(total[np.concatenate([[0], np.cumsum(count)])]) + mix(np.arange(1, n1 * n2 + 1).astype(U64) + salt)).reshape(n1, n2)
    count = count.reshape(n1, n2)
    a, b = np.triu_indices(n2, 1)
    subsets = mix(content[:, a] * U64(0x9E3779B97F4A7C15) + content[:, b]).ravel()
    if n1 == 1:
        return subsets
    return subsets[np.lexsort((subsets, -(count[:, a] + count[:, b]).ravel()))[: n1 + k + 1]]


def _linked(sizes: np.ndarray, shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components of one cluster; sizes and concatenated sets."""
    g = len(sizes)
    a_out: list[np.ndarray] = [np.zeros(0, np.int64)]
    b_out: list[np.ndarray] = [np.zeros(0, np.int64)]
    owner = np.repeat(np.arange(g), sizes)
    order = np.argsort(shingles)
    ranked = shingles[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    column = np.empty(len(order), np.int64)
    column[order] = np.cumsum(new) - 1
    alive = np.ones(g, bool)
    while True:
        # a set most of whose shingles nobody else has is similar to none
        use = alive[owner]
        seen = np.bincount(column[use], minlength=int(new.sum()))
        shared = np.bincount(owner[use], weights=(seen[column[use]] > 1), minlength=g)
        keep = alive & (100 * shared >= percent * sizes)
        if (keep == alive).all():
            break
        alive = keep
    rest = np.flatnonzero(alive)
    if len(rest) < 2:
        return a_out[0], b_out[0]
    starts = np.cumsum(sizes) - sizes
    flags = np.zeros(int(new.sum()), bool)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        queue = [seed]
        while queue and len(rest):
            at = queue.pop()
            own = column[starts[at] : starts[at] + sizes[at]]
            fits = (100 * sizes[rest] >= percent * sizes[at]) & (100 * sizes[at] >= percent * sizes[rest])
            near = rest[fits]
            if not len(near):
                continue
            flags[own] = True
            n = sizes[near]
            both = np.add.reduceat(flags[column[ranges(starts[near], n)]].astype(np.int64), np.cumsum(n) - n)
            flags[own] = False
            hit = near[100 * both >= percent * (sizes[at] + n - both)]
            if len(hit):
                a_out.append(np.full(len(hit), at, np.int64))
                b_out.append(hit)
                queue.extend(hit.tolist())
                rest = rest[~np.isin(rest, hit)]
    return np.concatenate(a_out), np.concatenate(b_out)


def _confirmed(column: pa.ChunkedArray, a: np.ndarray, b: np.ndarray, words: int, percent: int) -> np.ndarray:
    """Whether each link between two texts of the column holds for their words, byte for byte."""
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    shingles, sizes = exact_shingles(column.take(pa.array(used)), words)
    ends = np.cumsum(sizes)
    x, y = place[: len(a)], place[len(a) :]
    both = np.array([len(np.intersect1d(shingles[ends[i] - sizes[i] : ends[i]], shingles[ends[j] - sizes[j] : ends[j]], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    return 100 * both >= percent * (sizes[x] + sizes[y] - both)


def once(c: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (c, m) with the largest n of each."""
    order = np.lexsort((-n, m, c))
    c, m, n = c[order], m[order], n[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (m[1:] != m[:-1])
    return c[new], m[new], n[new]


def packed_pairs(c: np.ndarray, m: np.ndarray, n: np.ndarray, parts: int) -> pa.Table:
    """Packed rows of pairs by the hash of the pair."""
    rows = [(p, *pack(c[i], m[i], n[i])) for p, i in by_partition((mix(c.astype(U64) * U64(0x9E3779B97F4A7C15) + m.astype(U64)) % U64(parts)).astype(np.int64))]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "c", "m", "n"])


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, slice_bytes: int = 4 << 20, part_signatures: int = 1 << 19, batch_signatures: int = 1 << 19, block_shingles: int = 1 << 19) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text; other columns are ignored).

    Words are runs without ASCII white space, A-Z as a-z; two sets are linked when 100 * intersection >= percent * union.  Null and empty texts, and
    texts without words, have empty sets and link with nothing; fewer than `words` words are one shingle.  component_id is the smallest doc_id that links reach.
    A null doc_id takes no part and has a null component.  Rows that repeat a doc_id are one node.  Empty input: empty result.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measure(batches):
        alone("jaccard")
        for whole in batches:
            for b in slices(whole, "text", slice_bytes):
                shingles, own, n = shingle_sets(b.column("text"), words, True)
                ends = np.cumsum(own)
                sums = []
                for seed in (0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(shingles * U64(seed)), dtype=U64)])
                    sums.append(pa.array((total[ends] - total[ends - own]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *sums], names=["doc_id", "n_shingles", "s1", "s2"])
        release()

    features = materialise(docs.mapInArrow(measure, "doc_id long, n_shingles long, s1 long, s2 long"))
    key = ["n_shingles", "s1", "s2"]
    usable = features.filter("doc_id IS NOT NULL AND n_shingles > 0")
    equal = usable.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    copies = materialise(salted_lookup(usable, equal, key, "doc_id").filter("least < doc_id").select("doc_id", F.col("least").alias("rep")).distinct())

    parts = deal(text_bytes(docs) * 0.08, batch_signatures, part_signatures)

    def packed_signatures(found: list[np.ndarray], doc: list[np.ndarray], size: list[np.ndarray]) -> pa.RecordBatch:
        """Packed rows by partition, a signature of a document once."""
        sig, doc, size = np.concatenate(found), np.concatenate(doc), np.concatenate(size)
        order = np.lexsort((doc, size, sig))
        sig, doc, size = sig[order], doc[order], size[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
        sig, doc, size = sig[new], doc[new], size[new]
        rows = [(p, *pack(sig[i], doc[i], size[i])) for p, i in by_partition((sig >> U64(33)).astype(np.int64) % parts)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "sig", "doc", "size"])

    def sign(batches):
        alone("jaccard")
        bands = Bands(percent)
        kept: tuple[list, list, list] = ([], [], [])
        held, seen = 0, set()
        for whole in batches:
            for b in slices(whole, "text", slice_bytes):
                shingles, sizes = shingle_sets(b.column("text"), words)
                ids = b.column("doc_id").to_pylist()
                ends = np.cumsum(sizes)
                for i, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                    if not n or ids[i] is None:
                        continue
                    own = shingles[e - n : e]
                    # equal sets have equal signatures: one of them speaks for all, as copies are known by then
                    mark = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    if mark in seen:
                        continue
                    seen.add(mark)
                    for band in bands.joined(n):
                        sig = signatures(own, band, bands.difference(bands.last(band)))
                        for column, value in zip(kept, (sig, np.full(len(sig), ids[i], np.int64), np.full(len(sig), n, np.int32)), strict=True):
                            column.append(value)
                        held += len(sig)
                    if held >= batch_signatures:
                        yield packed_signatures(*kept)
                        kept, held = ([], [], []), 0
                        seen.clear()
        if held:
            yield packed_signatures(*kept)
        release()

    def stars(table: pa.Table) -> pa.Table:
        """(centre, member, size) of every bucket with two sets or more; a bucket is cut where sizes are too far apart."""
        sig, doc, size = (np.concatenate(unpack(table.column(c), t)) for c, t in (("sig", U64), ("doc", np.int64), ("size", np.int32)))
        order = np.argsort(sig)
        ranked = sig[order]
        twice = np.zeros(len(ranked), bool)
        same = ranked[1:] == ranked[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        order = order[np.lexsort((size[order], sig[order]))]
        sig, doc, size = sig[order], doc[order], size[order].astype(np.int64)
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (100 * size[:-1] < percent * size[1:])
        heads = np.flatnonzero(new)
        centre = np.minimum.reduceat(doc, heads) if len(heads) else doc
        members = np.diff(np.concatenate([heads, [len(sig)]]))
        centre, members = np.repeat(centre, members), np.repeat(members, members)
        keep = members > 1
        return packed_pairs(*once(centre[keep], doc[keep], size[keep]), parts)

    def unite(table: pa.Table) -> pa.Table:
        """The pairs that several signature partitions found, once each."""
        c, m, n = once(*(np.concatenate(unpack(table.column(x), np.int64)) for x in ("c", "m", "n")))
        return pa.table({"c": pa.array(c), "m": pa.array(m), "n": pa.array(n)})

    reps = docs.filter("doc_id IS NOT NULL")
    found = reps.mapInArrow(sign, "part int, sig binary, doc binary, size binary").groupBy("part").applyInArrow(stars, "part int, c binary, m binary, n binary")
    found = found.groupBy("part").applyInArrow(unite, "c long, m long, n long")
    pairs = found.join(copies, found.m == copies.doc_id, "left").select("c", F.coalesce("rep", "m").alias("m"), "n").groupBy("c", "m").agg(F.max("n").alias("n"))
    pairs = materialise(pairs)
    weight = pairs.groupBy("c").agg(F.sum("n").alias("weight"), F.count("*").alias("members")).filter("members > 1")
    blocks = F.greatest(F.ceil(F.col("weight") / block_shingles), F.ceil(F.col("members") / 2048)).cast("int")
    weight = materialise(weight.select("c", blocks.alias("blocks")))
    # clusters with one member go; heavy clusters become pairs of blocks, each member once for every other block
    rows = salted_lookup(pairs, weight, ["c"], "m", 8).filter("blocks IS NOT NULL")
    own = F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int")
    rows = rows.select("c", "m", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("c", "m", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = rows.join(reps, rows.m == reps.doc_id).select("c", "i", "j", "m", "text")
    groups = 4 * parts

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("c", "ascending"), ("i", "ascending"), ("j", "ascending"), ("m", "ascending")])
        c, i, j, m = (table.column(x).to_numpy() for x in ("c", "i", "j", "m"))
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        heads = np.concatenate([np.flatnonzero(new), [len(c)]])
        a, b = [], []
        text = np.concatenate([[0], np.cumsum([len(x) if x else 0 for x in table.column("text").to_pylist()])])[heads]
        at, cluster = 0, []
        while at < len(heads) - 1:  # some clusters at a time
            to = min(len(heads) - 1, max(at + 1, int(np.searchsorted(text, text[at] + (4 << 20), side="right")) - 1))
            if heads[to] - heads[at] > to - at:
                column = table.column("text").slice(int(heads[at]), int(heads[to] - heads[at]))
                shingles, sizes = shingle_sets(column, words)
                bound = np.concatenate([[0], np.cumsum(sizes)])
                found = []
                for s, e in itertools.pairwise((heads[at : to + 1] - heads[at]).tolist()):
                    if e - s > 1:
                        x, y = _linked(sizes[s:e], shingles[bound[s] : bound[e]], percent)
                        found.append((x + s, y + s, np.full(len(x), len(found))))
                        cluster.append((s, e))
                if found:
                    x, y, own = (np.concatenate(c) for c in zip(*found, strict=True))
                    good = _confirmed(column, x, y, words, percent) if len(x) else np.ones(0, bool)
                    # hashes can only bring sets nearer: where a link does not hold, the cluster is searched again with numbers of words
                    for i in np.unique(own[~good]).tolist():
                        s, e = cluster[i]
                        exact, n = exact_shingles(column.slice(s, e - s), words)
                        p, q = _linked(n, exact, percent)
                        x, y, keep = np.concatenate([x, p + s]), np.concatenate([y, q + s]), np.concatenate([good & (own != i), np.ones(len(p), bool)])
                        own, good = np.concatenate([own, np.full(len(p), -1)]), keep
                    a.append(m[int(heads[at]) + x[good]])
                    b.append(m[int(heads[at]) + y[good]])
                cluster.clear()
            at = to
        release()
        return pa.table({"a": pa.array(np.concatenate(a) if a else np.zeros(0, np.int64)), "b": pa.array(np.concatenate(b) if b else np.zeros(0, np.int64))})

    links = texts.groupBy(F.pmod(F.xxhash64("c", "i", "j"), F.lit(groups)).alias("g")).applyInArrow(verify, "a long, b long")
    classes = components(links)
    named = features.join(copies.distinct(), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    return named.join(classes, named.rep == classes.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
