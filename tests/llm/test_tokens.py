import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusfold.llm import token_counts as C
from corpusfold.llm import token_files as T
from corpusfold.llm.word_codec import WordCodec, load_tokenizer, vocabulary

TOKENIZER = load_tokenizer(vocabulary())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


_ANY = st.one_of(st.sampled_from(list("abcXYZ 'stredvml019.,!|<>_-\t\n\r\x0b\x0c\x1c\x1f\x7f\x85\xa0éÉßñÑÀÖ×÷ſİı²½ªº中あ한ǅΣςά̈€’–")),
                 st.sampled_from(["<|endoftext|>", "<|startoftext|>", " 's", "don't"]), st.characters(blacklist_categories=["Cs"]))
_PLAIN = st.sampled_from(list("abstredvmlSTRE'''  09.,!|_-\n\té ÀÞßÿ<>"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(_ANY, max_size=12), st.lists(_PLAIN, max_size=16)).map("".join), max_size=4))
def test_codec_and_counter_agree_with_the_library(texts):
    want = [ids_of(t) for t in texts]
    raw = [t.encode() for t in texts]
    ids, n = WordCodec.of(vocabulary()).encode_texts(raw)
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == list(map(len, want))
    offsets = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    assert C.WholeTokenCounter.of(vocabulary()).count(data, offsets).tolist() == list(map(len, want))


def test_whole_tokens_are_proved():
    whole = C.WholeTokenCounter.of(vocabulary()).whole
    assert len(whole) > 30_000 and all(len(ids_of(w)) == 1 for w in sorted(whole)[:500])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 2**32 - 1)), max_size=2500))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    starts, raw = T.pack_blocks(ids)
    assert (T.unpack_blocks(starts, np.frombuffer(raw, np.uint8), len(ids)) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(T.BLOCK, 5, np.uint32)
    ids[::50] = 2**31
    assert len(T.pack_blocks(ids)[1]) < 200


def test_a_broken_segment_is_an_error():
    with pytest.raises(ValueError):
        T.read_segment(b"XXXX" + bytes(30))


@pytest.mark.parametrize("segment", [1, 1 << 20])
def test_files_round_trip(spark, odd, tmpdir_path, monkeypatch, segment):
    monkeypatch.setattr(T, "SEGMENT_IDS", segment)
    T.write_token_files(odd, tmpdir_path + "/t")
    got = T.read_token_files(spark, tmpdir_path + "/t").orderBy("start").collect()
    rows = odd.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), ids_of(t) + [2]) for d, t in rows)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        start += r.n_tokens
    crc = {(r.start, r.ids_crc32) for r in T.read_token_files(spark, tmpdir_path + "/t", digest=True).collect()}
    assert crc == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_files_of_nothing(spark, empty, tmpdir_path):
    T.write_token_files(empty, tmpdir_path + "/t")
    assert T.read_token_files(spark, tmpdir_path + "/t").collect() == []


def test_counts(spark, odd, empty):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(odd).collect())
    assert got == sorted((str(d), len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 2048)
                         for d, t in odd.select("doc_id", "text").collect())
    assert C.token_counts(empty).collect() == []


def test_joined_pretokens_have_the_ids_of_single_ones():
    from corpusfold.llm.word_codec import WordCodec, vocabulary
    codec = WordCodec(vocabulary())
    strings = ["the", "'s", "s", "...", "7", "qzxvwkj", "'ll", "über", "<", "|>", "a" * 300] * 30
    assert list(codec.plain_ids(strings)) == list(codec.library_ids(strings))
    assert list(codec.plain_ids(["two words", "three more words"])) == list(codec.library_ids(["two words", "three more words"]))
    calls = []
    codec.tokenizer, library = type("Counted", (), {"encode_batch": lambda self, texts, **k: calls.append(len(texts)) or library.encode_batch(texts, **k)})(), codec.tokenizer
    assert len(list(codec.plain_ids(strings))) == 330 and calls == [6]


def test_span_hashes_do_not_depend_on_the_block(monkeypatch):
    import numpy as np

    from corpusfold.llm import common
    data = np.frombuffer(b" ".join(b"w%d" % (i % 97) * (1 + i % 5) for i in range(5000)), np.uint8)
    whole = common.Words(data, np.array([0, len(data)]))
    want = whole.hashes()
    common._POW.clear()
    monkeypatch.setattr(common, "HASH_BLOCK", 64)
    assert (whole.hashes() == want).all()
    assert len(common._POW["r"]) <= 65 and len(common.span_hashes(data, whole.starts[:0], whole.ends[:0])) == 0
    assert common.span_hashes(data, np.array([0]), np.array([len(data)])) is not None


def test_an_operator_drops_what_others_remember():
    from corpusfold.llm import common, word_codec
    word_codec._CODECS["left"] = object()
    assert list(common.released(iter, remembers=True)([1])) == [1] and "left" in word_codec._CODECS
    assert list(common.released(iter)([1])) == [1] and not word_codec._CODECS
