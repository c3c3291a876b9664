import hashlib
import random

import pytest

SF001 = "/root/testdata/sf0.001"
from corpusfold.llm import components, ngram_join
from corpusfold.llm import queries as Q
from corpusfold.llm import substring_dedup as S
from corpusfold.llm.common import WORD_PATTERN  # noqa: F401


def ascii_words(text):
    return (text or "").encode().split()


def windows_brute(rows, size=20):
    """Result per (doc_id, text), by the definition; a null id ranks last."""
    ranked = {(float("inf") if d is None else d, t) for d, t in rows}
    first = {}
    for d, t in ranked:
        w = ascii_words(t)
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = {}
    for d, t in ranked:
        w, cut = ascii_words(t), set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (d, i):
                cut.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in cut)
        out[None if d == float("inf") else d, t] = (len(w), len(cut), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def check_windows(spark, df):
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    want = sorted((str(d), *windows_brute(rows)[d, t]) for d, t in rows)
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in S.remove_repeated_windows(df).collect())
    assert got == want
    return got


def test_windows_of_odd_documents(spark, odd):
    assert any(r[2] for r in check_windows(spark, odd))


def test_windows_at_every_alignment(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        n = rng.randrange(18, 40)
        at = rng.randrange(0, 60 - n + 1)
        rows.append((i, " ".join([f"a{i}_{j}" for j in range(rng.randrange(0, 15))] + passage[at:at + n] + [f"b{i}"] * rng.randrange(0, 30))))
    check_windows(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7))


def test_windows_of_one_id_with_two_texts(spark):
    t = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(1, t), (1, "y " + t), (2, t), (2, t)], "doc_id long, text string")
    check_windows(spark, df)


def test_windows_of_nothing(spark, empty):
    assert S.remove_repeated_windows(empty).collect() == []


def test_difference_cover():
    shifts = {(i, j) for i in range(S.PERIOD) for j in range(S.PERIOD)
              for d in range(S.PERIOD) if (i + d) % S.PERIOD in S.COVER and (j + d) % S.PERIOD in S.COVER}
    assert len(shifts) == S.PERIOD ** 2 and S.ANCHOR + S.PERIOD - 1 == S.WINDOW


def shingles(text, length=4):
    w = [x.lower() for x in ascii_words(text)]          # bytes.lower is A-Z only
    return frozenset(tuple(w[i:i + length]) for i in range(len(w) - length + 1)) if len(w) >= length else frozenset([tuple(w)] if w else [])


def components_brute(rows, length=4, percent=85):
    """component per row: vertices are doc_ids; a null id takes its class's."""
    sets = [(d, shingles(t, length)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    out = []
    for d, s in sets:
        same = [a for a, x in known if x == s]
        out.append((str(d), len(s), root(d) if d is not None else (root(min(same)) if same else None)))
    return sorted(map(str, out))


def check_components(df):
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    got = sorted(str((str(r.doc_id), r.n_shingles, r.component_id)) for r in ngram_join.jaccard_components(df).collect())
    assert got == components_brute(rows)


def test_components_of_odd_documents(odd):
    check_components(odd)


def test_components_of_near_copies(spark, monkeypatch):
    """Groups larger than a small column: stars, block products and spread columns all take part."""
    monkeypatch.setattr(ngram_join, "HEAVY_ROWS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 8)
    rng = random.Random(5)
    rows = []
    for g in range(3):
        base = [f"g{g}_{i}" for i in range(70)]
        for i in range(70):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            rows.append((g * 100 + i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(300)}" for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    check_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_components_join_through_two_texts_of_one_id(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(20)) for p in "ab")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_components_of_nothing(empty):
    assert ngram_join.jaccard_components(empty).collect() == []


@pytest.mark.parametrize("nodes", [components.FOREST_NODES, 5])
def test_components_of_paths_stars_and_random_links(spark, monkeypatch, nodes):
    monkeypatch.setattr(components, "FOREST_NODES", nodes)
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(500, i) for i in range(501, 600)]
    label = {x: x for pair in links for x in pair}
    while True:
        before = dict(label)
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
        if label == before:
            break
    df = spark.createDataFrame(links + [(900, 900)], "a long, b long").repartition(4)
    got = dict(map(tuple, components.connected_components(df).collect()))
    alone = {x for x in label if all(x not in pair or pair[0] == pair[1] for pair in links)}
    assert got == {x: y for x, y in label.items() if x not in alone}
    assert components.connected_components(df.where("false")).collect() == []


def test_stage_takes_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(50)]
    near = words[:25] + ["x"] + words[26:]              # 41 of 51 on five words (0.804), 43 of 51 on four (0.843)
    far = words[:20] + [f"z{i}" for i in range(30)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.one_of_each(df).collect()) == [1, 3]
    assert sorted(r.doc_id for r in ngram_join.one_of_each(df, 4, 85).collect()) == [1, 2, 3]


@pytest.mark.parametrize("copies", [1, 400])
def test_repeated_rows_send_their_places_once(spark, copies):
    rng = random.Random(11)
    text = " ".join(f"t{rng.randrange(50)}" for _ in range(300))
    rows = [(1, text)] * copies + [(2, text), (3, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = df.selectExpr("doc_id AS dk", "hash(text) AS th", "text")
    messages = keyed.mapInArrow(S._anchor_messages(4), S._MESSAGE)
    places = messages.groupBy("bucket").applyInArrow(S._repeated_anchors, S._FOUND)
    assert places.groupBy("dk", "th", "pos").count().where("count > 2").count() == 0
    got = {(r.doc_id, r.n_words, r.n_removed) for r in S.remove_repeated_windows(df).collect()}
    assert got == {(1, 300, 0), (2, 300, 300), (3, 2, 0)}
    assert S.remove_repeated_windows(df).count() == len(rows)


def test_registered(spark):
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in Q.QUERIES) == 1
    assert set(Q.ORACLE) <= set(Q.QUERIES)
    assert Q.QUERIES["op1_substring_dedup"](spark, SF001).columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_leading_columns_of_unrelated_documents(spark):
    """Documents that share common words hold rare ones too, which lead: no column is common to unrelated ones."""
    rng = random.Random(13)
    common = ["a", "b", "c"]
    texts = [" ".join(w for j in range(12) for w in ([rng.choice(common) for _ in range(8)] + [f"r{d}x{j}"])) for d in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    seen = df.selectExpr("*", "xxhash64(text) AS th").mapInArrow(ngram_join._rows, ngram_join._ROW)
    weight = ngram_join._word_weights(seen, 4)
    nothing = ngram_join.np.zeros(0, ngram_join.U64)
    lead = [ngram_join.np.frombuffer(r.lead, ngram_join.U64)
            for r in df.mapInArrow(ngram_join._leading_rows(weight, nothing, nothing), "doc_id long, n int, lead binary").collect()]
    assert len(lead) == 150 and min(map(len, lead)) > 5
    _, rows = ngram_join.np.unique(ngram_join.np.concatenate(lead), return_counts=True)
    assert rows.max() == 1
    check_components(df)


def test_only_columns_of_several_components_make_blocks(spark):
    """One column joins rows of two components, the others are each held by rows of one: those rows stay out."""
    entries = [(c, d, 9) for c, docs in ((1, range(0, 40)), (2, range(40, 80)), (3, (0, 40))) for d in docs]
    labels = spark.createDataFrame([(d, d // 40 * 40) for d in range(80)], "node long, label long")
    got = ngram_join._blocks(spark.createDataFrame(entries, "column long, doc long, n int"), labels).collect()
    assert {(r.column, r.doc) for r in got} == {(3, 0), (3, 40)}


def test_stage_deals_out_no_text_of_single_rows(spark, monkeypatch):
    rng = random.Random(17)
    base = " ".join(f"s{i}" for i in range(40))
    rows = [(1, base, "x"), (2, base + " tail", "y"), (None, base, "z"), (None, None, "p"), (None, None, "q"), (5, "", "r"), (5, "", "s"),
            (None, "one two", "t"), (6, None, "u")]
    rows += [(10 + i, " ".join(f"v{rng.randrange(5000)}" for _ in range(20)), "w") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string").repartition(4)
    dealt, join = [], ngram_join.by_keys
    monkeypatch.setattr(ngram_join, "by_keys", lambda rows, keys, on, how="left_semi": dealt.append((how, rows, keys)) or join(rows, keys, on, how))
    out = ngram_join.one_of_each(df)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, base), (5, ""), (6, None), (None, None), (None, "one two")] + [r[:2] for r in rows[9:]]))
    how, all_rows, several = dealt[-2]
    assert how == "left_semi" and all_rows.join(several, ["__no_id", "__id", "__th"], "left_semi").count() == 4
