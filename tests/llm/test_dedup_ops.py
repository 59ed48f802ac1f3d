"""op2, op4, op6, op8 and op10 and the pipeline against brute force."""

import hashlib
import re

import numpy as np
import pytest

from pagequarry.llm import embedding_dedup, graph, jaccard_join, queries, spans, substring_dedup, suffix_dedup, topk
from tests.conftest import MEDIUM, SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, block long")


def corpus(seed, n=60):
    """Copies, near copies, shared passages, edge cases."""
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("la", "mi", "so", "té", "Ru")]
    passage = " ".join(rng.choice(words, 70))
    rows = []
    for i in range(n):
        text = list(rng.choice(words, int(rng.integers(1, 160))))
        if i % 4 == 0:
            text[len(text) // 2 : len(text) // 2] = passage.split(" ")[: int(rng.integers(40, 71))]
        if i % 5 == 0 and rows:
            text = rows[int(rng.integers(len(rows)))][1].split(" ")
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = str(rng.choice(words))
        rows.append((int(i * 7 % n), " ".join(text)))
    rows += [rows[3], (n, None), (n + 1, ""), (n + 2, " \t\n"), (None, passage), (n + 3, (passage + "\n") * 3), (n + 4, "repeat " * 400), (n + 5, "repeat " * 300)]
    for k, size in enumerate((1024, 2048, 4096)):
        x, y = thue_morse(size)
        rows += [(n + 10 + 2 * k, f"{passage} {x} tail"), (n + 11 + 2 * k, f"{passage} {y} tail"), (n + 20 + 2 * k, x), (n + 21 + 2 * k, y)]
    return rows


def thue_morse(n):
    """A word over a and b and its complement: polynomial hashes modulo 2**64 know no difference from 1,024 on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def removed(rows, window):
    """Mask of every row: its windows start in a smaller doc_id as well."""
    first = {}
    for i, x in rows:
        for a in range(len(x) - window + 1 if i is not None else 0):
            w = x[a : a + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, x in rows:
        mask = np.zeros(len(x), bool)
        for a in range(len(x) - window + 1 if i is not None else 0):
            if first[x[a : a + window]] < i:
                mask[a : a + window] = True
        out.append(mask)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_words(spark, seed):
    rows = corpus(seed)
    words = [(i, tuple(WORD.findall(x or ""))) for i, x in rows]
    want = {(i, " ".join(w for w, m in zip(x, mask) if not m), int(mask.sum()), len(x)) for (i, x), mask in zip(words, removed(words, 50))}
    got = substring_dedup.remove_repeated_words(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["kept"], r["n_removed"], r["n_words"]) for r in got} == want and len(got) == len(rows)
    assert all(sum(e - s for s, e in zip(r["starts"], r["ends"])) == r["n_removed"] for r in got)
    laid = substring_dedup.remove_repeated_words(frame(spark, rows), layout=True).collect()
    assert {(r["doc_id"], " ".join(WORD.findall(r["kept"])), r["n_removed"], r["n_words"]) for r in laid} == want
    texts = {(i, t or "") for i, t in rows}
    assert all((r["doc_id"], r["kept"]) in texts for r in laid if not r["n_removed"])
    assert substring_dedup.remove_repeated_words(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_bytes(spark, seed):
    rows = corpus(seed)
    raw = [(i, (x or "").encode()) for i, x in rows]
    masks = removed(raw, 50)
    want = {(i, bytes(b for b, m in zip(x, mask) if not m), int(mask.sum()), int(np.sum(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))) for (i, x), mask in zip(raw, masks)}
    got = suffix_dedup.remove_repeated_bytes(frame(spark, rows)).collect()
    assert {(r["doc_id"], bytes(r["kept"]), r["n_removed"], len(r["starts"])) for r in got} == want and len(got) == len(rows)
    assert suffix_dedup.remove_repeated_bytes(frame(spark, [])).count() == 0


def test_tiles_of_long_documents(spark, monkeypatch):
    """A document beyond a tile is cut into overlapping tiles; nothing is missed at their borders."""
    paths = spans.Block.paths
    monkeypatch.setattr(spans.Block, "paths", lambda self, active, tile=64: paths(self, active, 64))
    rows = [r for r in corpus(5, 20)]
    words = [(i, tuple(WORD.findall(x or ""))) for i, x in rows]
    want = [int(m.sum()) for m in removed(words, 50)]
    active = np.array([i is not None for i, _ in rows])
    import pyarrow as pa

    block = spans.Block(pa.chunked_array([[x or "" for _, x in rows]]), spans.Windows(50, 12, True))
    total = sum(max(0, len(x) - 49) for (_, x), a in zip(words, active) if a)
    assert sum(int(c.sum()) for _, c, *_ in block.paths(active)) == total and sum(want) > 0


@pytest.mark.parametrize("window", [10, 4, 7])
def test_merged_transform_equals_sorting(window):
    """Shards' transforms, merged: the order, common prefixes and least codes are those of sorting all windows."""
    rng = np.random.default_rng(window)
    texts = [t for t in (bytes(rng.integers(97, 99, int(rng.integers(10, 40))).astype(np.uint8)) for _ in range(30)) if len(t) >= window]
    code = rng.permutation(len(texts)).astype(np.int64) << 32
    count = np.array([len(t) - window + 1 for t in texts])
    shard = rng.integers(0, 3, len(texts))
    got = suffix_dedup.least_codes(np.frombuffer(b"".join(texts), np.uint8), count, code, shard, window)
    first = {}
    for t, c in zip(texts, code.tolist()):
        for a in range(len(t) - window + 1):
            first[t[a : a + window]] = min(first.get(t[a : a + window], c + a), c + a)
    assert got.tolist() == [first[t[a : a + window]] for t in texts for a in range(len(t) - window + 1)]
    strings = suffix_dedup.Collection(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), 1)
    orders = [strings.suffix_order(np.flatnonzero(shard[strings.string] == z), window) for z in range(3)]
    position, common = suffix_dedup.merge(orders, [strings.rank[strings.before[o]] for o in orders], window)
    marked = [bytes([*t, 0]) for t in texts]
    rotations = [(m * 9)[o : o + window] for i in position.tolist() for m, o in [(marked[strings.string[i]], i - strings.starts[strings.string[i]])]]
    assert rotations == sorted(rotations)
    for x, y, c in zip(rotations, rotations[1:], common[1:].tolist()):
        assert c == next((i for i in range(window) if x[i] != y[i]), window)


def test_graph_compacts_paths_that_do_not_branch():
    """Edges over nodes; 1-2-3-4 is walked by two documents, 3 branches to 5 in a third."""
    spec = spans.Windows(2, 1, True)

    def paths(*walks):
        data = [np.array(w, np.uint64) for _, _, w in walks]
        n = np.array([len(x) - 1 for x in data])
        low = np.array([d for d, _, _ in walks])
        return spans.Paths(np.ones(len(walks), np.uint64), np.array([hash(tuple(w)) & 0xFFFF for _, _, w in walks], np.uint64), low, np.array([a for _, a, _ in walks]), low, n, np.concatenate(data), n + 1, np.arange(len(walks)))

    assert spec.grams == 2
    answer, count, source, place, starts = substring_dedup.compact_graph(paths((1, 10, [1, 2, 3, 4]), (7, 3, [1, 2, 3, 4]), (9, 0, [2, 3, 5])))
    at = np.cumsum(count) - count
    own = [list(zip(source[at[a] :][: count[a]].tolist(), place[at[a] :][: count[a]].tolist(), starts[at[a] :][: count[a]].tolist())) for a in answer.tolist()]
    # node 3 has two edges out: the run 1-2-3 ends there
    assert own[0] == own[1] == [(1, 10, True), (1, 11, False), (1, 12, True)]
    assert own[2] == [(1, 11, True), (9, 1, True)]


@pytest.mark.parametrize("by_words", [True, False])
def test_unlike_texts_of_one_hash_stop_the_job(spark, monkeypatch, by_words):
    """Passages that hashes propose are compared with the text at their source: here the source coordinates are made wrong."""
    rows = [(i, " ".join(f"{c}{i % 3}" for c in range(90))) for i in range(3)] + [(9, " ".join(f"{c}1" for c in range(80)))]
    module, name = (substring_dedup, "compact_graph") if by_words else (suffix_dedup, "resolver")
    real = getattr(module, name)

    def wrong(result):
        answer, count, source, place, starts = result
        return answer, count, source, place + 1, starts

    monkeypatch.setattr(module, name, (lambda paths: wrong(real(paths))) if by_words else (lambda window: lambda paths: wrong(real(window)(paths))))
    cut = substring_dedup.remove_repeated_words if by_words else suffix_dedup.remove_repeated_bytes
    with pytest.raises(Exception, match="another seed"):
        cut(frame(spark, rows)).collect()
    monkeypatch.undo()
    assert sum(r["n_removed"] > 0 for r in cut(frame(spark, rows), seed=3).collect()) == 1


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, n=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("percent", [85, 60])
def test_jaccard(spark, percent):
    rng = np.random.default_rng(percent)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("la", "MI", "so", "té")]
    rows = []
    for base in range(6):
        text = list(rng.choice(words, [3, 8, 20, 60, 150, 400][base]))
        for i in range(25):
            near = text.copy()
            for _ in range(int(rng.integers(0, 1 + len(text) // 20))):
                near[int(rng.integers(len(near)))] = str(rng.choice(words))
            if i % 6 == 0:
                near = [w.upper() if w.isascii() else w for w in near]
            rows.append((base * 100 + i, " ".join(near)))
    for k, size in enumerate((1024, 2048, 4096)):
        rows += [(800 + 4 * k + i, t) for i, w in enumerate(thue_morse(size)) for t in (w,)]
        rows += [(802 + 4 * k + i, " ".join(["one", "two", w, "three", w])) for i, w in enumerate(thue_morse(size))]
    rows += [(990, None), (991, ""), (992, "\n"), (993, "la"), (994, "la"), (995, "la la"), (None, rows[0][1]), rows[5]]
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union_find(ids, links)
    got = jaccard_join.jaccard_components(frame(spark, rows), percent=percent, block_shingles=3000).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert len(set(want.values())) < len(ids) - 30
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    bands = jaccard_join.Bands(85)
    for size in (1, 2, 5, 7, 12, 20, 31, 60, 200, 700):
        for _ in range(40):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            most = size * 15 // 115  # replaced shingles that leave a similarity of 85 %
            out = int(rng.integers(0, most + 1))
            b = np.concatenate([a[out:], rng.integers(0, 2**63, int(rng.integers(0, out + 1)), dtype=np.uint64)])
            if not len(b) or 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
                continue
            sig = [{(band, s) for band in bands.joined(len(x)) for s in jaccard_join.signatures(np.sort(x), band, bands.difference(bands.last(band))).tolist()} for x in (a, b)]
            assert sig[0] & sig[1]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed, n=300, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(0, n, 3):
        x[i] = x[i // 5] + rng.normal(size=dims) * 0.08
    rows = [(int(i), [float(v) for v in np.float32(x[i])], int(i % 3)) for i in range(n)]
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(40)] + [(rows[9][0], rows[9][1], rows[9][2])]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dims, 1), (903, [float("nan")] * dims, 1), (904, [None] * dims, 1), (905, rows[5][1], None), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (None, rows[5][1], 1), (908, [float("inf")] * dims, 1)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "vec_id long, embedding array<float>, label int, rep string, weight long")


def test_embedding_dedup(spark):
    rows = vectors(1)
    good = {i: (np.array(v, np.float64), y) for i, v, y in rows if i is not None and v and y is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = sorted(good)
    links = [(a, b) for a in ids for b in ids if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98]
    want = union_find(sorted({i for i, *_ in rows if i is not None}), links)
    degree = {i: sum(i in x for x in links) for i in want}
    rows += [(None, None, None), (None, rows[5][1], 1)]
    told = embedding_dedup.embedding_components(vector_frame(spark, rows), block_rows=64).collect()
    assert [tuple(r) for r in told if r["vec_id"] is None] == [(None, 0, None, True)] * 3
    got = {r["vec_id"]: r for r in told if r["vec_id"] is not None}
    assert len(got) == len(told) - 3 and set(got) == set(want)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(degree.values()) > 0
    assert all(got[i]["n_links"] <= degree[i] for i in want)
    assert sum(got[i]["component_id"] != want[i] for i in want) <= 0.01 * len(want)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in want)
    assert embedding_dedup.embedding_components(vector_frame(spark, [])).count() == 0


@pytest.mark.parametrize("scale", [256, 10_000_000])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    rows = vectors(2)
    q = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            q[i] = [int(np.floor(scale * float(c))) for c in v]
    want = []
    for i in q:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    got = topk.exact_top_k(vector_frame(spark, rows), "vec_id % 50 = 0", scale=scale).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.exact_top_k(vector_frame(spark, []), "vec_id % 50 = 0").count() == 0
    assert topk.exact_top_k(vector_frame(spark, rows[:1]), "vec_id % 50 = 0").count() == 0


def test_extreme_components(spark):
    rows = [(1, [1e200, 2e200], 0), (2, [1.0, 2.0], 0), (3, [1e-200, 2e-200], 0), (4, [2.0, -1.0], 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_components(docs).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_top_k(docs, "vec_id = 1").collect()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    at = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, SMALL).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert after.columns == docs.columns
            assert after.join(at, "doc_id", "left_anti").count() == 0
        if name == "n-gram Jaccard join":
            sets = {r["doc_id"]: shingles(r["text"], 5) for r in at.collect()}
            ids = sorted(sets)
            links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert {r["doc_id"] for r in after.collect()} == set(union_find(ids, links).values())
        if name == "substring dedup":
            words = [(r["doc_id"], tuple(WORD.findall(r["text"]))) for r in at.collect()]
            want = {i: [w for w, m in zip(x, mask) if not m] for (i, x), mask in zip(words, removed(words, 50))}
            assert {r["doc_id"]: WORD.findall(r["text"]) for r in after.collect()} == {i: w for i, w in want.items() if w}
        at = after
    assert corpus_pipeline.run(spark, SMALL).count() == at.count()


def test_digest_queries(spark):
    got = {r["doc_id"]: r for r in queries.op6_substring_dedup(spark, SMALL).collect()}
    words = [(r["doc_id"], tuple(WORD.findall(r["text"] or ""))) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for (i, x), mask in zip(words, removed(words, 50)):
        kept = " ".join(w for w, m in zip(x, mask) if not m)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(mask.sum()), hashlib.sha256(kept.encode()).hexdigest())


def test_embedding_recall_on_the_table(spark):
    """The table's own vectors and a near copy of each, against brute force; the standard codes, and codes beyond 64 bits."""
    rng = np.random.default_rng(9)
    own = [r for r in spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect() if r["embedding"]]
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in own]
    top = max(i for i, *_ in rows) + 1
    rows += [(top + k, [float(np.float32(c + d)) for c, d in zip(v, rng.normal(size=len(v)) * 0.17 * np.linalg.norm(v) / np.sqrt(len(v)))], y) for k, (_, v, y) in enumerate(rows)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([y for *_, y in rows])
    links = int((np.triu(x @ x.T, 1) >= 0.98)[label[:, None] == label[None]].sum())
    assert links > 0.8 * len(own)
    for bits, tables in ((None, None), (180, 9)):
        got = embedding_dedup.embedding_components(vector_frame(spark, rows), bits=bits, tables=tables).collect()
        assert len(got) == len(rows) and 0.99 * links <= sum(r["n_links"] for r in got) / 2 <= links


def test_codes_grow_with_the_table():
    assert embedding_dedup.layout(0) == embedding_dedup.layout(50_000) == (64, 6)
    for n in (10**6, 10**8, 10**10):
        bits, tables = embedding_dedup.layout(n)
        assert all(n / 2**w <= 4096 for _, w in embedding_dedup.substrings(bits, tables))
        flips = bits * np.arccos(0.98) / np.pi
        assert 2 * tables - 1 >= flips + 1.5 * np.sqrt(flips)
    with pytest.raises(ValueError):
        embedding_dedup.substrings(64, 1)


def test_language_stage_without_languages(spark):
    import corpus_pipeline

    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "more", None)]
    make = lambda rows: spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.reject_undetermined(spark, make(rows), SMALL).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in got) == [(1, "some words", None), (4, "more", None)]
    got = corpus_pipeline.reject_undetermined(spark, make([(5, "some words", "und"), *rows]), SMALL).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == [(1, "und"), (4, "und"), (5, "und")]


def test_embedding_recall_with_a_common_mean(spark):
    rng = np.random.default_rng(6)
    n, dims = 1200, 64
    x = rng.normal(size=(n, dims)) * 0.22 / np.sqrt(dims)
    x[1::2] = x[::2] + rng.normal(size=(n // 2, dims)) * 0.19 / np.sqrt(dims)
    x[:, 0] += 1.0
    rows = [(i, [float(v) for v in np.float32(y)], 0) for i, y in enumerate(x)]
    y = np.float32(x).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = int((np.triu(y @ y.T, 1) >= 0.98).sum())
    got = embedding_dedup.embedding_components(vector_frame(spark, rows)).collect()
    assert 0.9 * links <= sum(r["n_links"] for r in got) / 2 <= links and links > n // 4


def test_sketches_leave_out_no_link():
    rng = np.random.default_rng(7)
    for dims in (5, 16, 64):
        mean, r = embedding_dedup.rotation(rng.normal(size=(400, dims)), 64)
        a = rng.normal(size=(400, dims))
        for scale in (0.01, 0.2, 0.5):
            b = a + rng.normal(size=a.shape) * scale
            u, v = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (a, b))
            m = min(embedding_dedup.SKETCH, dims)
            s, t = (np.clip(np.rint(((z - mean) @ r)[:, :m] * embedding_dedup.STEPS), -127, 127) for z in (u, v))
            apart = np.linalg.norm(s - t, axis=1)
            assert (apart[(u * v).sum(axis=1) >= 0.98] <= embedding_dedup.sketch_radius(0.98)).all()


def test_two_texts_under_one_doc_id(spark):
    import corpus_pipeline

    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(3, x), (7, x), (7, y), (7, y), (8, x + " " + y)]
    words = [(i, tuple(WORD.findall(t))) for i, t in rows]
    want = sorted((i, " ".join(w for w, m in zip(t, mask) if not m)) for (i, t), mask in zip(words, removed(words, 50)))
    assert sorted((r["doc_id"], r["kept"]) for r in substring_dedup.remove_repeated_words(frame(spark, rows)).collect()) == want
    data = [(i, t.encode()) for i, t in rows]
    want = sorted((i, bytes(b for b, m in zip(t, mask) if not m)) for (i, t), mask in zip(data, removed(data, 50)))
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.remove_repeated_bytes(frame(spark, rows)).collect()) == want
    docs = frame(spark, [*rows, (9, y), (None, x), (10, None)]).select(*corpus_pipeline.COLUMNS)
    got = corpus_pipeline.one_of_each_group(spark, docs, SMALL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(3, x), (7, y), (8, x + " " + y), (10, None), (None, x)], key=str)


def test_links_of_hashes_are_confirmed_by_words(spark, monkeypatch):
    """Shingle hashes with few bits bring unlike sets together; words decide all the same."""
    real = jaccard_join.shingle_sets

    def coarse(column, words, compare=False):
        """All shingles but one hashed to few values for signatures and the search, so that sets of unlike words look alike; sizes stay."""
        found = real(column, words, compare)
        if compare:
            return found
        last = found[0][np.cumsum(found[1]) - 1]
        return (np.concatenate([np.append((np.arange(n - 1) + 7).astype(np.uint64), x) for n, x in zip(found[1], last)]), *found[1:])

    rows = [(i, " ".join(f"{'abcd'[i % 4]}{j}" for j in range(30)) + (f" end{i}" if i > 3 else "")) for i in range(8)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    import pyarrow as pa

    column = pa.chunked_array([[t for _, t in rows]])
    a, b = np.array([0, 0, 1, 2]), np.array([4, 1, 5, 3])
    assert jaccard_join._confirmed(column, a, b, 4, 85).tolist() == [True, False, True, False]
    monkeypatch.setattr(jaccard_join, "shingle_sets", coarse)
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == union_find(list(sets), links)


def test_signatures_meet_under_any_differences():
    """Differences placed to spoil as many subsets as they can: two in one first-level partition, one in the others."""
    rng = np.random.default_rng(8)
    bands = jaccard_join.Bands(80)
    for size in (30, 90, 300):
        band = bands.of(size)
        k = bands.difference(bands.last(band))
        assert k > jaccard_join.ENUMERATED
        for _ in range(30):
            a = np.sort(rng.integers(0, 2**63, size, dtype=np.uint64))
            gone = rng.permutation(size)[: k // 2]
            b = np.sort(np.concatenate([np.delete(a, gone), rng.integers(0, 2**63, k - k // 2, dtype=np.uint64)]))
            x, y = (set(jaccard_join.signatures(s, band, k).tolist()) for s in (a, b))
            assert x & y
            n1 = -(-6 * (k + 1) // 10)
            assert len(x) <= n1 + k + 1 < 3 * n1


def edge_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the stages use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "The cat, and the dog.", "en", "s", 21), (1, "The cat, and the dog.", "en", "s", 21), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id here", None, "s", 1), (4, " \t\n", "de", None, 3), (5, "12 34 !?", None, "s", 8)]
    rows += [(6, long, "en", "s", len(long)), (7, long + " more", "en", "s", 1), (8, "日本語 の 文", None, "s", 7), (None, None, None, None, None), (9, "x", "en", "s", 1), (10, "x", "en", "s", 1)]
    names = ("score", "predicted", "lang_pred", "kept", "block", "n_removed", "component_id", "toxic", "ids", "start")
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))


def test_pipeline_stages_on_edge_documents(spark):
    import unicodedata
    import zlib

    import corpus_pipeline
    import pyarrow as pa
    from tokenizers import Tokenizer

    from pagequarry.llm import toxicity

    docs = edge_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: (str(r[0]), str(r[1]))

    def kept(stage):
        out = stage(spark, docs, SMALL)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key)

    # toxicity: each text scored by itself
    model = toxicity.fit(docs.select(*corpus_pipeline.COLUMNS), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert kept(corpus_pipeline.reject_toxic) == sorted((r for r in rows if model.score(pa.array([r[1]], pa.string()))[0] < 0.5), key=key)
    # language: texts with a letter
    assert kept(corpus_pipeline.reject_undetermined) == sorted((r for r in rows if any(unicodedata.category(c)[0] == "L" for c in r[1] or "")), key=key)
    # groups: one row of each, rows without an id or a set stay
    sets = {i: shingles(t, 5) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = set(union_find(list(sets), links).values())
    assert kept(corpus_pipeline.one_of_each_group) == sorted([*dict(r for r in rows if r[0] in least).items(), *[r for r in rows if r[0] is None]], key=key)
    # repeats: rows without an id are left alone, a document that loses all its words goes
    words = [(i, tuple(WORD.findall(t or ""))) for i, t in rows]
    want = [(i, [w for w, m in zip(x, mask) if not m], mask.any()) for (i, x), mask in zip(words, removed(words, 50))]
    assert sorted(((i, WORD.findall(t or "")) for i, t in kept(corpus_pipeline.cut_repeats)), key=str) == sorted(((i, w) for i, w, m in want if w or not m), key=str)
    # packing: the ids of every text, and the end id
    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    pieces = corpus_pipeline.pack(spark, docs, SMALL).collect()
    ids = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows]
    assert sorted(sum(p["length"] for p in pieces if p["doc_id"] == i) for i in {i for i, _ in rows}) == sorted(sum(len(x) for j, x in ids if j == i) for i in {i for i, _ in rows})
    whole = {(i, x.tobytes()) for i, x in ids}
    for p in pieces:
        assert any(i == p["doc_id"] and x[4 * p["start"] : 4 * (p["start"] + p["length"])] == bytes(p["token_bytes"]) for i, x in whole) and p["ids_crc32"] == zlib.crc32(bytes(p["token_bytes"]))
    # empty tables
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_entries_are_dealt_to_bounded_partitions():
    from pagequarry.llm.common import deal

    assert deal(0, 10, 100) == 1 and deal(1000, 10_000, 100) == 10  # so many each
    assert deal(1e9, 64_000, 1 << 19) == 1000  # but rows of 64 entries
    assert deal(1e13, 64_000, 1 << 19) == -(-(10**13) // (16 << 20))  # and a bound for a partition
