"""op1, op3, op5, op7 and op9 against brute force, round trips and held-out accuracy."""

import copy
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pagequarry.llm import common, html_text, langid, packing, queries, sentencepiece_op, toxicity
from tests.conftest import MEDIUM

EDGE = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "the cat. The CAT, don't <|endoftext|> stop"), (5, "the cat. The CAT, don't <|endoftext|> stop"), (None, "no id"), (7, "日本語 ὈΔΥΣΣΕΎΣ 🙂 é x\r\n" * 3), (8, "word " * 30_000), (9, "x" * 5000), (10, "<|ENDOFTEXT|> A.\tB, don't. É. 1a, ...")]
#: words that polynomial hashes modulo 2**64 cannot tell apart
for _n in (1024, 2048, 4096):
    _bits = [bin(_i).count("1") & 1 for _i in range(_n)]
    EDGE += [(20 + _n + _k, " ".join(["it", *["".join(_x[_b] for _b in _bits) for _x in _pair], "is"])) for _k, _pair in enumerate((("ab", "ba"), ("ba", "ab"), ("ab",)))]


def frame(spark, rows=EDGE):
    """Extra columns with names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, block string, score double")


@pytest.mark.parametrize("most", [4096, 8])
def test_packing_matches_the_tokenizer(spark, most):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.with_ids(packing.pack_documents(frame(spark), path, max_length=most)).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= most and r["offset"] == 0 and len(r["token_ids"]) == r["length"] for r in got)
    for i, text in dict(EDGE).items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        copies = sum(x == i for x, _ in EDGE)
        assert all(r["doc_tokens"] == len(ids) for r in pieces)
        assert sum(r["length"] for r in pieces) == len(ids) * copies
        assert [x for r in pieces[::copies] for x in r["token_ids"]] == ids


def test_packing_of_random_strings():
    """Letters whose lower case ends in a mark, marks, special tokens: every word has the tokenizer's ids."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer, table = Tokenizer.from_file(path), packing.WordIds(path)
    rng = np.random.default_rng(4)
    letters = list("aBé\u0130.,'’1\u0301ßſ \n\u00a0日ｆǅ") + ["<|startoftext|>", "<|", "'S"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 12)))) for _ in range(6000)] + ["\u0130.", "\u0130, x", "a\u0130."]
    for some in (texts[i::7] for i in range(7)):
        ids, n = table.encode(*packing.text_buffer(pa.array(some)), 2)
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in some]
        assert n.tolist() == list(map(len, want))
        assert ids.tolist() == [x for w in want for x in w]


def test_packing_crc_and_empty(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    r = packing.pack_documents(frame(spark, [(1, "hello world")]), path).selectExpr("*", "crc32(token_bytes) AS c").collect()
    data = b"".join(bytes(x["token_bytes"]) for x in r)
    assert r[0]["c"] == zlib.crc32(bytes(r[0]["token_bytes"])) and np.frombuffer(data, "<u4")[-1] == 2
    assert packing.pack_documents(frame(spark, []), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(frame(spark), path, max_length=100)


def brute_viterbi(model, text):
    """Best score of any segmentation, by dynamic programming over all substrings."""
    pieces = {p: s for p, s, t in zip(model.pieces, model.scores, model.types) if t == sentencepiece_op.NORMAL}
    unknown = min(pieces.values()) - 10
    best = [0.0] + [float("-inf")] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 40), e):
            value = pieces.get(text[s:e], unknown if e - s == 1 else None)
            if value is not None:
                best[e] = max(best[e], best[s] + value)
    return best[-1]


def test_sentencepiece_is_optimal_and_round_trips(spark):
    model = sentencepiece_op.PieceModel.load(queries.tokenizer_path("piece_bpe_32k.model"))
    docs = frame(spark, [r for r in EDGE if r[0] != 8])
    got = sentencepiece_op.decode_documents(sentencepiece_op.encode_documents(docs, model), model).collect()
    encoder = sentencepiece_op.Encoder(model)
    known = {p for p, t in zip(model.pieces, model.types) if t == sentencepiece_op.NORMAL}
    unknown = min(s for s, t in zip(model.scores, model.types) if t == sentencepiece_op.NORMAL) - 10
    for r in got:
        assert r["decoded"] == (r["text"] or "")
        text = encoder.normalise(r["text"] or "")
        if len(text) < 200:
            runs = sum(model.scores[i] for i in r["ids"] if model.types[i] == sentencepiece_op.NORMAL)
            runs += unknown * sum(c not in known for c in text)
            assert runs == pytest.approx(brute_viterbi(model, text))
    clash = docs.withColumnRenamed("block", "ids").withColumnRenamed("source", "decoded")
    encoded = sentencepiece_op.encode_documents(clash, model, keep=("doc_id", "ids", "decoded", "lang"))
    assert sentencepiece_op.decode_documents(encoded, model).filter("decoded <> coalesce(text, '')").count() == 0
    assert sentencepiece_op.decode_documents(sentencepiece_op.encode_documents(docs.limit(0), model), model).count() == 0
    medium = spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(200)
    out = sentencepiece_op.decode_documents(sentencepiece_op.encode_documents(medium, model), model)
    assert out.filter("decoded <> text").count() == 0


def test_sentencepiece_unknown_without_bytes():
    model = sentencepiece_op.PieceModel(["<unk>", "a", "ab", "▁", "▁b"], [0, -2.0, -1.0, -3.0, -1.0], [2, 1, 1, 1, 1])
    encoder, decoder = sentencepiece_op.Encoder(model), sentencepiece_op.Decoder(model)
    assert encoder.encode("ab b") == [3, 2, 4]
    assert encoder.encode("zz ab") == [3, 0, 3, 2]
    ids, counts = encoder.encode_batch(pa.array(["ab b", None, "", "zz"]))
    assert counts.tolist() == [3, 0, 0, 2]
    assert decoder.decode_batch(ids.astype(np.int64), counts) == ["ab b", "", "", " ⁇ "]


def test_language_id_held_out(spark):
    got = queries.op5_language_id(spark, MEDIUM).filter("held_out").join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_language_id_edges(spark):
    model = langid.fit(frame(spark, [(1, "the cat and the dog"), (2, "of the house")]))
    got = langid.predict(frame(spark), model).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(EDGE)
    assert all((r["lang_pred"], r["score"]) == ("und", 0) for r in got if not (r["text"] or "").strip())
    none = langid.fit(frame(spark, []))
    assert {r["lang_pred"] for r in langid.predict(frame(spark), none).collect()} == {"und"}
    assert langid.predict(frame(spark, []), model).count() == 0


def test_language_profiles_against_plain_loops(spark):
    """Prototypes and cosines letter by letter: bind permuted letter vectors, bundle, centre, compare."""
    texts = [(1, "The cat, and the dog!", "en"), (2, "Of the house 12", "en"), (3, "der Hund und die Katze", "de"), (4, "über das Haus", "de"), (5, "el gato y el perro", "es"), (6, "??", "es"), (7, None, "es"), (8, "x", None)]
    labelled = spark.createDataFrame([(i, t, y) for i, t, y in texts], "doc_id long, text string, lang string")
    model = langid.fit(labelled, dims=64, seed=3)
    def vector(code):
        # 64 signs: the bits of a mixed number, lowest byte first, highest bit of a byte first
        mixed = mixed_number((mixed_number((code * common.BYTE_BASE + 3) & common.MASK)) & common.MASK)
        return np.array([1.0 if byte >> k & 1 else -1.0 for byte in mixed.to_bytes(8, "little") for k in range(7, -1, -1)])

    def profile(text):
        classes = [0]
        for c in (text or "") + " ":
            low = c.lower()
            k = 0 if not c.isalpha() else ord(low) - 96 if "a" <= low <= "z" else ord(low)
            if k or classes[-1]:
                classes.append(k)
        grams = [np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in zip(classes, classes[1:], classes[2:])]
        return np.mean(grams, axis=0) if any(classes) else None

    raw = {y: np.mean([p for _, t, z in texts if z == y and (p := profile(t)) is not None], axis=0) for y in ("de", "en", "es")}
    mean = np.mean(list(raw.values()), axis=0)
    for text in ("the hat", "die Maus", "el ratón y la luna", "Ω", "zzz 1 zzz"):
        v = profile(text) - mean
        cosines = {y: (p - mean) @ v / np.linalg.norm(p - mean) / np.linalg.norm(v) for y, p in raw.items()}
        best = max(cosines, key=cosines.get)
        label, score = model.predict(text)
        assert label == best and score == pytest.approx(min(1, max(0, cosines[best])), abs=1e-4)


def test_every_language_of_the_sample_is_learnt(spark):
    """No cap on languages; the rows that a fit reads are bounded in all and by language, for small languages and large ones alike."""
    rows = [(i, f"word{chr(97 + i % 26)} {chr(97 + i // 26 % 26)}text", f"l{i % 400:03}") for i in range(2000)]
    dirty = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(dirty, dims=64).labels == [f"l{i:03}" for i in range(400)]
    assert 60 < len(langid.fit(dirty, max_rows=100, dims=64).labels) < 150
    large = spark.createDataFrame([(i, "the cat", "en") for i in range(3000)] + [(5000 + i, "der Hund", "de") for i in range(5)], "doc_id long, text string, lang string")
    assert langid.fit(large, max_rows_per_label=50, dims=64).labels == ["de", "en"]


def test_letters_of_every_script_have_vectors_of_their_own(spark):
    greek, cyrillic = [chr(c) for c in range(0x3B1, 0x3CA)], [chr(c) for c in range(0x430, 0x450)]
    han, kana = [chr(c) for c in range(0x4E00, 0x4E40)], [chr(c) for c in range(0x3041, 0x3091)]
    codes = langid.letter_codes()[[ord(c) for c in greek + cyrillic + han + kana]]
    vectors = langid.letter_vectors(codes, 512, 7).astype(int)
    apart = vectors @ vectors.T - 512 * np.eye(len(codes), dtype=int)
    assert len(set(codes.tolist())) == len(codes) and np.abs(apart).max() < 200
    rng = np.random.default_rng(2)
    # two languages of one script differ only in how often they use its letters
    kinds = {"el": (greek, 0), "ru": (cyrillic, 0), "bg": (cyrillic, 1), "zh": (han, 0), "ja": (kana, 0)}

    def text(kind):
        letters, turn = kinds[kind]
        weight = np.roll(1 / np.arange(1, len(letters) + 1), turn * len(letters) // 2)
        return " ".join("".join(rng.choice(letters, 5, p=weight / weight.sum())) for _ in range(40))

    model = langid.fit(spark.createDataFrame([(i, text(k), k) for i, k in enumerate(list(kinds) * 20)], "doc_id long, text string, lang string"))
    told = [(k, model.predict(text(k))[0]) for k in list(kinds) * 20]
    assert sum(a == b for a, b in told) >= 98
    # a text with very many unlike trigrams goes by tiles
    ids, shares, _ = langid.trigrams("".join(rng.choice(han, 20_000)))
    assert len(ids) > 8192
    assert langid.bundled(ids, shares, 64, 7) == pytest.approx(langid.bundled(ids, shares, 64, 7, tile=1 << 20), abs=1e-4)


def test_toxicity_gradients():
    """The gradients of the network against differences of its loss."""
    rng = np.random.default_rng(1)
    net = toxicity.Network.fresh(4, 2, 3, 5)
    net.tables, net.filters = rng.normal(size=net.tables.shape), [rng.normal(size=f.shape) for f in net.filters]
    net.biases, net.weights = [rng.normal(size=b.shape) for b in net.biases], rng.normal(size=net.weights.shape)
    sizes = [5, 1, 0, 9]
    words, bounds = rng.integers(0, 16, (toxicity.TABLES, sum(sizes))).astype(np.uint16), np.concatenate([[0], np.cumsum(sizes)])
    y, decay = np.array([1.0, 0.0, 1.0, 0.0]), 0.01
    embedded = toxicity.Network.embedded

    def wide(self, words, bounds):
        x, first = embedded(self, words, bounds)
        place = np.arange(words.shape[1]) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * toxicity.PAD
        x = np.zeros(x.shape)
        x[place] = np.concatenate([t[w] for t, w in zip(self.tables, words)], axis=1)
        return x, first

    net.embedded = wide.__get__(net)

    def loss():
        x, first = net.embedded(words, bounds)
        z = np.concatenate([toxicity.maxima(r, first, np.diff(bounds) + 1) for r in net.responses(x)], axis=1) @ net.weights + net.bias
        squares = sum((f * f).sum() for f in net.filters) + (net.weights**2).sum()
        return np.mean(np.log1p(np.exp(z)) - y * z) + decay / 2 * squares

    dense, bias, touched, dx = toxicity.gradients(net, words, bounds, y, decay)
    table = np.zeros(net.tables.shape)
    for t in range(toxicity.TABLES):
        np.add.at(table[t], words[t, touched], dx[:, t * 2 : t * 2 + 2])
    for array, grad in [*zip([*net.filters, *net.biases, net.weights], dense), (net.tables, table)]:
        for i in rng.integers(0, array.size, 12):
            old = array.flat[i]
            array.flat[i] = old + 1e-6
            up = loss()
            array.flat[i] = old - 1e-6
            down = loss()
            array.flat[i] = old
            assert grad.flat[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    net.bias += 1e-6
    up = loss()
    net.bias -= 2e-6
    assert bias == pytest.approx((up - loss()) / 2e-6, abs=1e-5)


def mixed_number(h):
    """The 64-bit finaliser with plain integers."""
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & common.MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & common.MASK
    return h ^ h >> 31


def test_toxicity_scores_against_plain_loops(spark):
    """Words, their hashes, windows, maxima, logistic layer and thresholds, word by word; tiles and long texts alike."""
    rng = np.random.default_rng(4)
    bits, dims, filters = 6, 3, 4
    net = toxicity.Network.fresh(bits, dims, filters, 9)
    net.tables = rng.normal(size=net.tables.shape).astype(np.float32)
    net.biases = [rng.normal(size=filters).astype(np.float32) for _ in toxicity.WIDTHS]
    net.bias = 0.3

    def row(word):
        size = len(word)
        h = mixed_number((int.from_bytes(word[:8], "little") + size * common.TOKEN_BASE) & common.MASK)
        for lane in range(8, size, 8):
            h = mixed_number(((h ^ int.from_bytes(word[lane : lane + 8], "little")) * common.BYTE_BASE + lane) & common.MASK)
        return h & ((1 << bits) - 1)

    def logit(text):
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
        vectors = [np.concatenate([net.tables[t][row(w[:n])] for t, n in enumerate((len(w), *toxicity.STEMS))]).astype(float) for w in words]
        vectors += [np.zeros(toxicity.TABLES * dims)] * toxicity.PAD
        z, f = net.bias, 0
        for width, matrix, bias in zip(toxicity.WIDTHS, net.filters, net.biases, strict=True):
            for k in range(filters):
                best = 0.0
                for at in range(len(words) + 1):
                    window = np.concatenate(vectors[at : at + width])
                    best = max(best, bias[k] + float(window @ matrix[: len(window), k]))
                z += best * net.weights[f]
                f += 1
        return z

    texts = ["You VILE thing, you!", "", None, "?!", "a", "über straße naïve words-with-marks and 123abc", "incomprehensibilities " * 3 + "antidisestablishmentarianism", " ".join(rng.choice(["one", "two", "Three", "fourteen", "xylophonist"], 60))]
    want = [logit(t) for t in texts]
    rows, bounds = toxicity.table_rows(pa.array(texts, pa.string()), bits)
    assert net.logits(rows, bounds) == pytest.approx(want, abs=1e-4)
    for tile in (1, 4, 6, 16):
        assert net.pooled(rows, bounds, tile) @ net.weights + net.bias == pytest.approx(want, abs=1e-4)
    model = toxicity.ToxicityModel(net, langid.fit(frame(spark, [])), {}, 0.7)
    assert model.score(pa.array(texts, pa.string())) == pytest.approx([1 / (1 + np.exp(0.7 - z)) for z in want], abs=1e-5)

    def f1(cut, logits, labels):
        hits = sum(y for z, y in zip(logits, labels, strict=True) if z > cut)
        return 2 * hits / (sum(z > cut for z in logits) + sum(labels))

    for seed in range(20):
        rng = np.random.default_rng(seed)
        labels = np.array([0, 1, *rng.integers(0, 2, 20)])
        logits = rng.permutation(22) + labels * 6.0 + np.arange(22) / 100
        cut = toxicity.best_threshold(logits, labels)
        assert f1(cut, logits, labels) == pytest.approx(max(f1(c, logits, labels) for c in [logits.min() - 1, *logits[:-1]] if (logits > c).any()))


def test_toxicity_from_very_few_labels(spark):
    """Thresholds come from documents of both classes, however few there are."""
    for toxic, clean in ((1, 1), (1, 12), (6, 1), (2, 2)):
        rows = [(i, f"vile vile vile rotten number{i}") for i in range(toxic)] + [(100 + i, f"a kind and gentle word{i}") for i in range(clean)]
        labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
        model = toxicity.fit(frame(spark, rows), labels, bits=10)
        told = model.score(pa.array(["vile vile vile rotten"] * 3 + ["a kind and gentle"] * 3, pa.string())) >= 0.5
        assert told.tolist() == [True] * 3 + [False] * 3, (toxic, clean)


def test_toxicity_thresholds_differ_by_language(spark):
    """A text is judged by the threshold of the language it is recognised as."""
    model = toxicity.ToxicityModel(
        toxicity.Network.fresh(8, 2, 2, 1),
        langid.fit(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string")),
        {"en": 3.0, "de": -3.0},
        0.0,
    )
    texts = pa.array(["the dog and the cat", "die Katze und der Hund", ""])
    logits = model.network.logits(*toxicity.table_rows(texts, 8))
    assert model.score(texts) == pytest.approx(1 / (1 + np.exp(-(logits - np.array([3.0, -3.0, 0.0])))))
    assert toxicity.best_threshold(np.array([0.0, 1.0, 2.0, 5.0]), np.array([0, 0, 1, 1])) == 1.5


def test_toxicity_sample_is_bounded_and_empty_tables(spark):
    docs = frame(spark, [(i, "bad word " * 20 if i % 2 else "good word " * 20) for i in range(400)] + [(5, "bad")] * 50)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, 0), (6, None)], "doc_id long, toxic int")
    taken = toxicity.sampled(docs, labels, 10_000, 1 << 20, 64 << 20).collect()
    assert len(taken) == 400 and {r["text"] for r in taken if r["doc_id"] == 5} == {"bad"} and all(r["toxic"] == r["doc_id"] % 2 for r in taken)
    few = toxicity.sampled(docs, labels, 10_000, 1 << 20, 16_000).collect()
    assert 4_000 < sum(len(r["text"]) for r in few) < 32_000
    assert 20 < toxicity.sampled(docs, labels, 30, 1 << 20, 64 << 20).count() < 120
    assert {r["toxic"] for r in toxicity.sampled(docs, labels, 10_000, 185, 64 << 20).collect() if r["doc_id"] != 5} == {1}
    none = toxicity.fit(frame(spark, []), labels.limit(0), bits=8)
    assert toxicity.score_documents(frame(spark, []), none).count() == 0
    assert {r["predicted"] for r in toxicity.score_documents(frame(spark), none).collect()} == {0}


def test_toxicity_learns_and_scores_whole_texts(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 60))
        if i % 3 == 0:
            text.insert(int(rng.integers(60)), "Vile!")
        rows.append((i, " ".join(text)))
        labels.append((i, i % 3 == 0))
    labels = spark.createDataFrame([(i, int(y)) for i, y in labels] + [(1, None), (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit(docs.filter("doc_id < 450"), labels.filter("doc_id < 450"), bits=12)
    got = toxicity.score_documents(docs.filter("doc_id >= 450"), model).collect()
    assert sum((r["doc_id"] % 3 == 0) == r["predicted"] for r in got) >= 0.97 * len(got)
    # far behind in a text beyond one tile
    long = " ".join(rng.choice(words, 150_000))
    edge = toxicity.score_documents(frame(spark, [(1, long), (2, f"{long} vile {long}"), (3, None), (4, "")]), model).collect()
    assert [r["predicted"] for r in sorted(edge, key=lambda r: r["doc_id"])] == [0, 1, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in edge)
    untaught = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score_documents(docs, untaught).collect()} == {0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site header, with words, and commas</p></header>
<nav><ul><li><a href=/a>Menu one</a></ul></nav><div class="cookie-notice">We use cookies, dear reader.</div><div id="page"><article class="post"><h1>Head &amp; line</h1>
<p>First <b>bold</b>para&shy;graph,&nbsp;with a comma.<br>Second line<p>Unclosed one &lt;tag&gt;<script>var a="</p><p>bad";</script>
<div class="ad">Buy now</div><form><input name=q>Search</form><ul><li>item one<li>item two</ul><aside>Side</aside>
<section class="comments"><p>A reader comment, long enough, to count as a paragraph, surely.</p></section></article></div><div class="sidebar"><p>Sidebar, text, here</p></div><footer>&copy; me</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "Head & line First boldpara­graph, with a comma. Second line Unclosed one <tag> item one item two"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("plain  text") == "plain text"
    assert html_text.main_text("<p>a<p>b</div></section>c<") == "a bc<"
    assert html_text.main_text("<div><p>" + "word, " * 20 + "</p><p>short</p></div><div><a href=x>" + "link, " * 30 + "</a></div>") == ("word, " * 20).strip() + " short"
    deep = "<div>" * 20_000 + "<p>in</p>" + "</div>" * 20_000
    assert html_text.main_text(deep) == "in"
    assert html_text.main_text("<article><script>never ends") == ""


ARTICLE = "<article><h1>Head</h1><p>Some long text, with commas, and more.</p><p>Second, para.</p></article>"
WHOLE = "Head Some long text, with commas, and more. Second, para."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # words in other attributes or in the middle of a name mark nothing
        (f'<div style="overflow: hidden">{ARTICLE}</div>', WHOLE),
        (f'<div class="overflow-hidden main has-sidebar">{ARTICLE}</div>', WHOLE),
        ('<article><p title="the hidden valley">One, two.</p><p data-id="menu">Three</p><p hidden>no</p><p class="adBox">no</p></article>', "One, two. Three"),
        # set-aside elements that are never closed
        (f'<div class="ad"><div>promo</div>{ARTICLE}<footer>f</footer></body>', WHOLE),
        (f"<nav><ul><li>x</ul>{ARTICLE}", WHOLE),
        (f'<div><div class="ad">buy <p>now</p></div>{ARTICLE}</div>', WHOLE),
        # headers go, formulas stay
        ("<article><header><h1>H</h1></header><p>One, two.</p><math><mi>x</mi><mo>+</mo><mi>y</mi></math></article>", "One, two. x+y"),
        # scores decide: between articles, within one, without one
        (f"<article><p>short</p></article>{ARTICLE}", WHOLE),
        ('<article class="x y" id=z><div class="wrap"><h2>t</h2><div class="body"><p>a, b, c, d</p><ul><li>l1<li>l2</ul><table><tr><td>c1<td>c2</table></div></div></article><article><p>other</p></article>', "t a, b, c, d l1 l2 c1 c2"),
        ("<aside><article><p>teaser, one</p></article></aside><main><p>real, text</p></main>", "real, text"),
        ('<div><p>body, text, of, the, page, here</p></div><div class="post-comments"><p>c, d, e, f, g, h, i, j, k</p></div>', "body, text, of, the, page, here"),
        ("<div><p>first, real, one</p><h2>Title</h2><p>second, real</p></div><div><p><a href=/x/>link, link, link, link</a></p></div>", "first, real, one Title second, real"),
        ('<div class="comment"/><p>kept</p><my-box><p>b</p></my-box>', "kept b"),
    ],
)
def test_html_pages(page, text):
    assert html_text.main_text(page) == text


LONG = "Many words, with commas, and more of them. " * 6


@pytest.mark.parametrize(
    "part",
    [
        '<section id="related-work"><h2>Related work</h2><p>{}</p></section>', '<p id="social-history">{}</p>', '<h2 id="search-algorithms">{}</h2>', '<h2 id="notice-period">{}</h2>', '<p class="promoter-region">{}</p>',
        '<div class="social-science">{}</div>', '<section id="classified-ads"><p>{}</p></section>', '<p id="sponsorship">{}</p>', '<section id="search"><p>{}</p></section>', '<h3 id="comments">{}</h3>', '<p id="menu">{}</p>',
        '<div class="search-results-of-the-trial"><p>{}</p></div>', '<section id="banner-blindness">{}</section>', '<div id="header-files"><p>{}</p></div>', '<li class="related-species">{}</li>',
    ],
)
def test_slugs_of_headings_mark_nothing(part):
    """Names that begin with a word for menus or adverts, but are about something: the text stays, within the article and whole."""
    inner = part.format(LONG)
    page = f"<body><nav>Menu</nav><article><h1>Head</h1><p>{LONG}</p>{inner}<p>{LONG}</p></article><footer>f</footer></body>"
    words = re.sub("<[^>]*>", " ", inner).split()
    assert html_text.main_text(page).split() == ["Head", *LONG.split(), *words, *LONG.split()]


@pytest.mark.parametrize(
    "part",
    [
        '<div class="acme-sidebar">{}</div>', '<div class="post-comments"><p>{}</p></div>', '<section class="comments">{}</section>', '<section id="comments">{}</section>', '<div id="disqus_thread">{}</div>', '<div id="search">{}</div>',
        '<div class="cookie-notice">{}</div>', '<div id="newsletter-signup">{}</div>', '<div class="related-posts">{}</div>', '<ul class="share-buttons"><li>{}</li></ul>', '<p class="adBox">{}</p>', '<div class="widget_2">{}</div>',
        '<div class="related-stories-of-today"><p><a href=/x>{}</a></p></div>', '<section id="related"><a href=/x>{}</a></section>', '<div role="navigation">{}</div>', '<div class="ad-slot-3">{}</div>', '<div class="sponsored">{}</div>', '<div class="reader-comments">{}</div>',
    ],
)
def test_parts_that_are_set_aside(part):
    page = f"<body><article><h1>Head</h1><p>{LONG}</p>{part.format(LONG)}<p>{LONG}</p></article></body>"
    assert html_text.main_text(page).split() == ["Head", *LONG.split(), *LONG.split()]


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, "x"), (None, "u", "<p>x</p>", None)], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(pages).collect()
    assert [r["text"] for r in got][1:] == ["", "x"]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """Documents beyond any bound of a sample are learnt from: each toxic word stands in a few long texts only, and each bundle has words of its own."""
    rng = np.random.default_rng(3)
    calm = [f"calm{i}" for i in range(50)]
    rows = [(i, " ".join([*rng.choice(calm, 12), f"slur{i % 8}" * (i % 2)])) for i in range(1200)]
    long = " ".join(rng.choice(calm, 200_000))
    rows += [(2000 + i, f"{long} horrid {long[:50]}" if i % 2 else long) for i in range(4)] + [(7, "calm1 slur7 of another text")]
    docs = frame(spark, [*rows, (None, "calm1"), (3000, None), (3001, "without a label")])
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(1200), *range(2000, 2004), 3000]] + [(7, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    languages = langid.fit(docs)
    packs = toxicity.bundles(docs, labels, languages, 10, 1 << 20).cache()
    seen = list(toxicity.opened(packs.toArrow().to_batches()))
    counts = packs.selectExpr("count(*) n", "sum(trained0 + held0) c0", "sum(trained1 + held1) c1", "sum(held0 + held1) held").first()
    assert counts["n"] > 3 and (counts["c0"], counts["c1"]) == (602, 603)
    assert 0.15 * 1205 < counts["held"] < 0.25 * 1205
    want, bounds = toxicity.table_rows(pa.array([t for _, t in rows], pa.string()), 10)
    whole = sorted(w[:, s:e].tobytes() for _, w, b, *_ in seen for s, e in zip(b, b[1:]))
    assert whole == sorted(want[:, s:e].tobytes() for s, e in zip(bounds, bounds[1:]))
    assert toxicity.bundles(docs, labels, languages, 10, 1 << 20, most_broadcast=0).agg({"words": "count"}).first()[0] == counts["n"]
    # one round is the mean of the bundles' own passes
    start = toxicity.Learner.of(toxicity.Network.fresh(10, 4, 3, 2))
    got = copy.deepcopy(start)
    toxicity.train_round(packs, got, False, 32, 0.1, 1e-5, [5, 0])
    flats, tables, sizes, every = [], [], [], np.arange(start.table_sums.size)
    for part, words, offsets, y, held, _ in seen:
        own = copy.deepcopy(start)
        own.pass_over(words, offsets, y.astype(np.float32), np.flatnonzero(~held), 32, 0.1, 1e-5, [5, 0, part])
        flats.append(own.flat() - start.flat())
        tables.append(own.rows(every) - start.rows(every))
        sizes.append((~held).sum())
    assert got.flat() == pytest.approx(start.flat() + np.average(flats, axis=0, weights=sizes), abs=1e-5)
    changed = sum(n * t.any(axis=1) for n, t in zip(sizes, tables))
    assert got.rows(every) == pytest.approx(start.rows(every) + sum(n * t for n, t in zip(sizes, tables)) / np.maximum(changed, 1)[:, None], abs=1e-5)
    model = toxicity.fit(docs, labels, bits=12, bundle_bytes=1 << 20)
    told = model.score(pa.array([*(f"calm1 slur{i} calm2" for i in (1, 3, 5, 7)), "calm3 calm4", "calm5"], pa.string())) >= 0.5
    assert told.tolist() == [True] * 4 + [False] * 2


def test_toxicity_gradients_by_tiles():
    """Tiles, texts beyond one and empty texts give the gradients of whole texts."""
    rng = np.random.default_rng(6)
    net = toxicity.Network.fresh(6, 3, 4, 5)
    sizes = [0, 40, 3, 0, 1, 17, 0]
    words, bounds = rng.integers(0, 64, (toxicity.TABLES, sum(sizes))).astype(np.uint16), np.concatenate([[0], np.cumsum(sizes)])
    y = rng.integers(0, 2, len(sizes)).astype(np.float32)
    dense, bias, touched, dx = toxicity.gradients(net, words, bounds, y, 0.01)
    for tile in (1, 4, 16):
        other = toxicity.gradients(net, words, bounds, y, 0.01, tile)
        assert all(a == pytest.approx(b, abs=1e-6) for a, b in zip(dense, other[0])) and bias == pytest.approx(other[1], abs=1e-6)
        assert touched.tolist() == other[2].tolist() and dx == pytest.approx(other[3], abs=1e-6)
    empty = toxicity.gradients(net, words[:, :0], np.zeros(3, np.int64), y[:2], 0.0)
    assert len(empty[2]) == 0 and all(np.isfinite(g).all() for g in empty[0])


def test_toxicity_thresholds_of_all_rows(spark):
    """Thresholds counted by bins and windows are those of all logits in one array; ties count together."""
    rng = np.random.default_rng(8)
    rows = [("en" if i % 3 else "de", float(np.float32(rng.normal() * 2 + (i % 2) * (1.5 if i % 3 else 4))), i % 2) for i in range(3000)] + [("fr", 1.0, 0), (None, 2.0, 1), ("xx", -5e9, 0)]
    names, logits, labels = (np.array(x) for x in zip(*rows))
    found, default = toxicity.best_thresholds(spark.createDataFrame(rows, "lang string, logit double, toxic int"), 20)
    assert set(found) == {"en", "de"} and default == pytest.approx(toxicity.best_threshold(logits, labels), abs=1e-5)
    for name, cut in found.items():
        assert cut == pytest.approx(toxicity.best_threshold(logits[names == name], labels[names == name]), abs=1e-5)
    tied, one = toxicity.best_thresholds(spark.createDataFrame([("en", 1.0, y) for y in (1, 0, 1)] + [("en", 3.0, 1), ("en", -1.0, 0)], "lang string, logit double, toxic int"), 1)
    assert one == tied["en"] == 0.0


def test_language_profiles_learn_every_row_and_names_agree(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join("".join(rng.choice(list(a), 5)) for _ in range(6)) + " 12!?" * (i % 3), y) for i in range(300) for y, a in [(("x", "abcde"), ("y", "efghi"), ("z", "αβγδe"))[i % 3]]]
    rows += [(400, None, "x"), (401, "", "y"), (402, " ?", "z"), (403, "abc", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled.repartition(5), dims=128)
    vectors = {y: [langid.bundled(*langid.trigrams(t)[:2], 128, 7) for _, t, z in rows if z == y and langid.trigrams(t)[2]] for y in "xyz"}
    raw = np.array([np.mean(v, axis=0) for v in vectors.values()])
    assert model.mean == pytest.approx(raw.mean(axis=0), abs=1e-4)
    texts = [t for _, t, _ in rows] + ["a", " e ", "é", "a\nb", "?a?", "\ud800"]
    for most in (1, 100, 1 << 20):
        assert model.names(texts, most) == [model.predict(t)[0] for t in texts]
    assert langid.fit(frame(spark, [])).names(texts[:3]) == ["und"] * 3 and model.names([]) == []


def test_language_profiles_make_vectors_once_a_language(monkeypatch):
    """However many slices a task's texts come in, the trigrams of a to z become vectors once for each language; the sums are those of the texts."""
    rng = np.random.default_rng(12)
    texts = [(y, " ".join("".join(rng.choice(list(a), 5)) for _ in range(20_000))) for y, a in (("x", "abcde"), ("y", "efghiß")) * 5] + [("y", "ab"), ("x", "1 2")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts[at : at + 3])], names=["lang", "text"]) for at in range(0, len(texts), 3)]
    table, calls = langid.trigram_table, []
    monkeypatch.setattr(langid, "trigram_table", lambda dims, seed: calls.append(langid.BASIC) or table(dims, seed))
    got = [r for b in langid.text_sums(batches, 64, 7) for r in b.to_pylist()]
    assert len(calls) == 3  # one for each language, and one with what holds an ß
    monkeypatch.undo()
    assert {r["lang"]: r["n"] for r in got} == {"x": 5, "y": 6} and len(got) == 2
    for r in got:
        want = sum(langid.bundled(*langid.trigrams(t)[:2], 64, 7) for y, t in texts if y == r["lang"] and langid.trigrams(t)[2])
        assert np.frombuffer(r["sums"], np.float64) == pytest.approx(want, abs=1e-3)
    # few may wait
    assert [np.frombuffer(r["sums"], np.float64) for b in langid.text_sums(batches, 64, 7, 1) for r in b.to_pylist()] == [pytest.approx(np.frombuffer(r["sums"], np.float64), abs=1e-4) for r in got]
    # more languages than are kept unsettled
    many = [pa.RecordBatch.from_arrays([pa.array([f"l{i % 150}" for i in range(300)]), pa.array([f"abc{'de' * (i % 7)}" for i in range(300)])], names=["lang", "text"])] * 2
    assert sorted((r["lang"], r["n"]) for b in langid.text_sums(many, 64, 7) for r in b.to_pylist()) == sorted((f"l{i}", 4) for i in range(150))


def test_text_trigrams_of_odd_texts():
    """Trigrams of many texts at once are those of each text: gaps at borders, texts without letters, NUL, surrogates and other scripts."""
    rng = np.random.default_rng(13)
    for _ in range(400):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice([*"abzZ .1\0", "ä", "漢", "\ud800"], rng.integers(0, 8))) for _ in range(rng.integers(0, 6))]
        rows, others, sizes = langid.text_trigrams(texts)
        assert len(sizes) == len(texts) and sizes.sum() == len(rows)
        for text, own in zip(texts, np.split(rows, np.cumsum(sizes)[:-1]) if len(texts) else [], strict=True):
            basic = own[own < langid.BASIC**3].astype(np.uint64)
            first, rest = np.divmod(basic, np.uint64(langid.BASIC**2))
            second, third = np.divmod(rest, np.uint64(langid.BASIC))
            codes = np.concatenate([(first << np.uint64(42)) | (second << np.uint64(21)) | third, others[own[own >= langid.BASIC**3] - langid.BASIC**3]])
            ids, counts = np.unique(codes, return_counts=True)
            want, shares, _ = langid.trigrams(text)
            assert ids.tolist() == want.tolist() and counts / max(1, len(own)) == pytest.approx(shares)


def test_toxicity_windows_once_a_tile(monkeypatch):
    """All widths of a tile come from one product over a bounded number of words, and are the windows' values."""
    rng = np.random.default_rng(14)
    net = toxicity.Network.fresh(6, 3, 4, 5)
    sizes = [3, 0, 20_000, 1, *[50] * 400]
    words, bounds = rng.integers(0, 64, (toxicity.TABLES, sum(sizes))).astype(np.uint16), np.concatenate([[0], np.cumsum(sizes)])
    seen, windows = [], toxicity.Network.windows
    monkeypatch.setattr(toxicity.Network, "windows", lambda self, x: seen.append(len(x)) or windows(self, x))
    net.pooled(words, bounds)
    assert max(seen) <= 1.2 * toxicity.TILE and len(seen) <= 2 + sum(sizes) / toxicity.TILE * 1.5
    x = rng.normal(size=(12, toxicity.TABLES * 3)).astype(np.float32)
    padded = np.concatenate([x, np.zeros((toxicity.PAD, x.shape[1]), np.float32)])
    for k, (w, matrix, bias) in enumerate(zip(toxicity.WIDTHS, net.filters, net.biases, strict=True)):
        want = np.array([padded[i : i + w].ravel() @ matrix + bias for i in range(12)])
        assert windows(net, x)[k * 4 : k * 4 + 4].T == pytest.approx(want, abs=1e-4)
