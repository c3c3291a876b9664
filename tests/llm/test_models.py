import math
import random
import zlib

import numpy as np

SF001 = "/root/testdata/sf0.001"
from corpusfold.llm import language_id as L
from corpusfold.llm import toxicity as X


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "a", "b", "ab", "▁a", "ba"])
    lattice = L.Lattice(pieces)
    p = np.random.default_rng(1).random((len(pieces), 2))
    by_hash = {int(h): i for i, h in enumerate(lattice.hashes)}
    row = {s: by_hash[int(L._hash(np.array([[ord(c) for c in s]]))[0])] for s in pieces}

    def brute(word, lang):
        if not word:
            return 1.0
        total = sum(p[row[word[:k]], lang] * brute(word[k:], lang) for k in range(1, min(6, len(word)) + 1) if word[:k] in row)
        return total + (L.UNKNOWN * brute(word[1:], lang) if word[0] not in row else 0.0)

    for w in ("ab", "abba", "baab", "axb"):
        got = L.word_scores([w], lattice, L._extended(p))[0]
        assert np.allclose(got, [math.log(brute("▁" + w, i)) for i in (0, 1)])
    # expected counts: each segmentation by its share
    counts = L.expected_counts(["ab"], np.ones(1), lattice, L._extended(p[:, :1]))[:len(pieces)]
    segs = [["▁", "a", "b"], ["▁", "ab"], ["▁a", "b"]]
    share = np.array([np.prod([p[row[s], 0] for s in seg]) for seg in segs])
    want = np.zeros(len(pieces))
    for seg, x in zip(segs, share / share.sum()):
        for s in seg:
            want[row[s]] += x
    assert np.allclose(counts, want)


def test_long_words_are_summed_whole():
    rng = random.Random(4)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 17))) for _ in range(300)} | {"a", "b", "c", "▁"})
    lattice = L.Lattice(pieces)
    assert lattice.longest == 16
    p = np.random.default_rng(1).random((len(pieces), 2)) / len(pieces)
    words = ["".join(rng.choice("abcx") for _ in range(n)) for n in (3, 23, 24, 25, 26, 60, 400)]
    got = L.word_scores(words, lattice, L._extended(p))
    row = {s: i for s, i in zip(pieces, lattice.find(np.array([L._hash(np.array([[ord(c) for c in s]]))[0] for s in pieces])))}
    for w, g in zip(words, got):
        for lang in (0, 1):
            f = [0.0]                                   # logarithms
            text = "▁" + w
            for j in range(1, len(text) + 1):
                parts = [math.log(p[row[text[j - k:j]], lang]) + f[j - k] for k in range(1, min(16, j) + 1) if text[j - k:j] in row]
                if text[j - 1] not in row:
                    parts.append(math.log(L.UNKNOWN) + f[j - 1])
                top = max(parts)
                f.append(top + math.log(sum(math.exp(x - top) for x in parts)))
            assert math.isclose(g[lang], f[-1], rel_tol=1e-9)
    one = L._extended(p[:, :1])
    for w in words[2:5]:                                # both ways of counting agree at the border
        edges = lattice.edges(next(L._by_length([w]))[1])
        plain = L.expected_counts([w], np.ones(1), lattice, one) if len(w) <= L.PLAIN else None
        long = L._long_counts(edges, np.ones(1), one)
        assert math.isclose(sum(long[i] * len(s) for s, i in row.items()) + long[-1], len(w) + 1, rel_tol=1e-9)
        assert plain is None or np.allclose(plain, long)


def test_whole_vocabulary():
    pieces = L.load_pieces(L.vocabulary())
    assert len(pieces) > 23_000 and max(map(len, pieces)) > 12


def test_many_languages_in_several_models(spark, monkeypatch):
    rng = random.Random(6)
    words = {f"l{i}": ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(12)] for i in range(7)}
    rows = [(n, " ".join(rng.choices(words[lang], k=15)), lang) for n, lang in enumerate(rng.choices(sorted(words), k=400))] + [(None, None, None), (900, "12", "l0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    one = {r.doc_id: r for r in L.identify(df).collect()}
    monkeypatch.setattr(L, "LANGS", 3)
    three = {r.doc_id: r for r in L.identify(df).collect()}
    assert one.keys() == three.keys() and all(three[k].lang_pred == r.lang_pred and math.isclose(three[k].score, r.score, abs_tol=1e-9) for k, r in one.items())
    assert sum(r.lang_pred == r.lang for r in one.values() if r.lang) >= 0.98 * 400


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    found = L.identify(docs, keep=["doc_id", "lang"]).select("*", L.held_out().alias("held_out")).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in found)


def test_languages_of_odd_documents(odd, empty):
    rows = L.identify(odd, names=("p", "q")).collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(rows[0].asDict())
    for r in rows:
        no_letters = not any(c.isalpha() for c in r.text or "")
        assert (r.p == "und") == no_letters and (r.q == 0.0) == no_letters
    assert L.identify(empty).collect() == []
    unlabelled = odd.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}


def toxic_corpus(spark, n=2400):
    rng = random.Random(2)
    bad = [f"bad{i}" for i in range(6)]
    docs, labels = [], []
    for i in range(n):
        w = [f"c{int(rng.random() ** 2 * 300)}" for _ in range(60)]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(bad) + rng.choice(["", "!", ","]))
        docs.append((i, " ".join(w)))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"),
            {i for i in range(n) if i % 9 == 0})


def test_held_out_toxicity(spark):
    docs, labels, toxic = toxic_corpus(spark)
    rows = X.toxicity(docs.repartition(4), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    caught = [r for r in held if r.doc_id in toxic and r.predicted]
    wrong = [r for r in held if r.doc_id not in toxic and r.predicted]
    assert len(caught) >= 0.9 * sum(r.doc_id in toxic for r in held) and len(wrong) <= 0.01 * len(held)
    again = {r.doc_id: r.score for r in X.toxicity(docs.repartition(2), labels).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_toxicity_of_odd_documents(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (3, None, 1), (5, 0, None), (20, 1, 1), (22, 0, 0)],
                                   "doc_id long, toxic int, quality int")
    rows = X.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert X.toxicity(empty, labels).collect() == []
    none = labels.where("false")
    assert {r.score for r in X.toxicity(odd, none).collect()} == {0.0}


def test_risk_stays_non_negative_part():
    p = X._Sparse([np.array([0])] * 20, np.arange(4))
    u = X._Sparse([np.array([0])] * 10 + [np.array([1])] * 90, np.arange(4))
    w, b = X.nnpu(p, u, 0.1, 4)
    assert w[0] + b > 1 and w[1] + b < -1
