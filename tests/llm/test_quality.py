"""op13 against plain loops."""

import math
import re
import zlib

import pytest

from pagequarry.llm import quality

WORD, TOKEN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\W]+|[^\x20\x09-\x0D\w]+")
GOOD = "the cat, and the dog; then a bird went to the far {} hill with {} others. "
JUNK = "$$$ win!! {} >>> click %%% now {} ### free!!! "


def counted(text):
    words = WORD.findall(text or "")
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated), failed


def grams(text):
    t = TOKEN.findall(text or "")
    return [zlib.crc32(g.encode()) % quality.BINS for g in t + [f"{a} {b}" for a, b in zip(t, t[1:], strict=False)]]


def judged(docs, labels):
    said = {}
    for i, q in labels:
        if i is not None and q is not None:
            said.setdefault(i, []).append(q)
    trusted = {i: min(q) == 1 for i, q in said.items()}
    aside = {i for i in trusted if zlib.crc32(str(i).encode()) % 5 == 0}
    raw, own = [0] * quality.BINS, [0] * quality.BINS
    for i, text in docs:
        for b in grams(text):
            raw[b] += 1
            own[b] += trusted.get(i, False) and i not in aside
    r, o = sum(raw) + quality.BINS, sum(own) + quality.BINS
    some = any(t and i not in aside for i, t in trusted.items())
    weight = [math.floor(65536.0 * (math.log((b + 1) / o) - math.log((a + 1) / r)) + 0.5) if some else 0 for a, b in zip(raw, own, strict=True)]
    rows = []
    for i, text in docs:
        g = grams(text)
        rows.append((i, *counted(text), math.floor(sum(weight[b] for b in g) / (len(g) * 64.0)) if g else 0))
    known = [(r[-1], trusted[r[0]]) for r in rows if r[0] in aside and not r[-2]]
    steps = sorted({s for s, _ in known})
    mistakes = [(sum(t for s, t in known if s < step) + sum(not t for s, t in known if s >= step), step) for step in steps]
    least = -math.inf
    if mistakes:
        step = min(mistakes)[1]
        below = [s for s in steps if s < step]
        least = (step + below[-1]) // 2 if below else step
    return sorted((r[0] is None, r[0] or 0, *r[1:-1], not r[-2] and r[-1] >= least, r[-1]) for r in rows)


def documents(n=60):
    docs = [(i, "".join((JUNK if i % 4 == 0 else GOOD).format(i * 31 + k, chr(97 + (i + k) % 26) * (k % 5 + 1)) for k in range(i % 9 + 1))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, GOOD * 9), (n + 3, "a b c " * 40), (n + 4, ("line one of many\n" * 5 + "\n \n") * 4), docs[7], docs[7], (7, "another text of this id " * 3)]
    docs += [(n + 5, "x"), (n + 6, "a b"), (n + 7, "a b a b a b"), (n + 8, " ".join(f"w{i}" for i in range(30_000))), (n + 9, "É ü 日本語 🙂🙂 _x_ " * 20), (n + 10, "p q r s p q r t " + "u" * 10 + " v w" * 30)]
    return docs


@pytest.mark.parametrize("labels", [[(i, int(i % 4 != 0)) for i in range(50)] + [(None, 1), (3, None), (5, 0), (999, 1)], [], [(i, 1) for i in range(0, 60, 3)], [(i, 0) for i in range(60)]])
def test_quality(spark, labels, monkeypatch):
    if not labels:
        monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    docs = documents()
    frame = spark.createDataFrame([(*d, 5, "clash", [1]) for d in docs], "doc_id long, text string, words int, n string, lines array<int>")
    table = spark.createDataFrame([(*x, 0, "t") for x in labels], "doc_id long, quality int, toxic int, trusted string")
    got = quality.judge(frame, table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "step").collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == judged(docs, labels)


def test_quality_without_broadcast_and_of_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    docs, labels = documents(24), [(i, int(i % 4 != 0)) for i in range(24)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.judge(frame(docs), table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "step").collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == judged(docs, labels)
    assert quality.judge(frame([]), table).count() == 0
    assert quality.judge(frame([]), table.limit(0)).count() == 0
