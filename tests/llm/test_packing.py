import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusfold.llm import packing as P
from corpusfold.llm.byte_codec import ByteCodec, byte_vocabulary
from corpusfold.llm.word_codec import load_tokenizer

TOKENIZER = load_tokenizer(byte_vocabulary())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


_ANY = st.one_of(st.sampled_from(list("abXYZ 'stredvml019.,!|<>_-\t\n\r\x0b\x0c\x1c\x7f\x85\xa0éÉßñ×÷ſı²ªº中한ǅ̈€")),
                 st.sampled_from(["<|endoftext|>", " 's", "don't", "  ", "\n\n", " \n "]), st.characters(blacklist_categories=["Cs"]))
_PLAIN = st.sampled_from(list("abstredvmlSTRE'''  09.,!|_-\n\t\x0b\x0cé ÀÞßÿ<>"))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.lists(_ANY, max_size=12), st.lists(_PLAIN, max_size=16)).map("".join), max_size=4))
def test_byte_codec_agrees_with_the_library(texts):
    want = [ids_of(t) for t in texts]
    ids, n = ByteCodec.of(byte_vocabulary()).encode_texts([t.encode() for t in texts])
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == list(map(len, want))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=60), st.booleans())
def test_every_rest_goes_to_the_cheapest_sequence_with_room(rests, last):
    total = sum(rests)
    rooms = [16] * (total // 16) + (P.powers_of_two(total % 16) if last else [])
    placed, left = P.assign(rests, rooms, last)
    room, cost, covered = list(rooms), [0.0] * len(rooms), defaultdict(list)
    before = 99
    held = {i: n for i, n in enumerate(rests)}
    for i, at, take, s in placed:
        n = held[i]
        assert n <= before and n == max(held.values())              # descending
        before = n
        fits = [cost[k] for k, r in enumerate(room) if r >= n]
        if fits:
            assert take == n and room[s] >= n and cost[s] == min(fits)
        else:
            assert take == room[s] == max(room)
        room[s] -= take
        cost[s] += P.piece_cost(take)
        held[i] -= take
        covered[i].append((at, take))
    assert not any(room) and sum(n for _, _, n in left) == total - sum(rooms)
    for i, at, n in left:
        covered[i].append((at, n))
    for i, parts in covered.items():
        ends = [0] + [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] == rests[i]


def check(rows, documents, length=2048, end=1):
    """Each id in one piece, digests, gapless offsets, and no padding."""
    want = sorted((str(d), tuple(ids_of(t) + [end])) for d, t in documents)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[str(r.doc_id), r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
        if "ids" in r:
            assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        used = 0
        for r in pieces:
            assert r.offset == used and r.length > 0
            used += r.length
        assert used == length or used < length and used & (used - 1) == 0
    texts = defaultdict(list)
    for d, ids in want:
        texts[d, len(ids)].append(ids)
    assert {k: len(v) * k[1] for k, v in texts.items()} == {k: sum(r.length for r in v) for k, v in by_doc.items()}
    for key, pieces in by_doc.items():
        same = texts[key]
        at = sorted((r.start, r.ids_crc32, r.length) for r in pieces)
        if len(same) == 1:
            assert [a for a, _, _ in at] == [sum(n for _, _, n in at[:i]) for i in range(len(at))]
        crc = {zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes()) for ids in same for a, _, n in at}
        assert {c for _, c, _ in at} <= crc


@pytest.mark.parametrize("group", [64, P.GROUP_TOKENS])
def test_packs_odd_documents_whole(spark, odd, group):
    rows = P.pack_documents(odd, group_tokens=group, with_ids=True).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()])


def test_the_query_packs_a_whole_table(spark):
    from odd_tables import SF001
    rows = P.op13_cost_packing(spark, SF001).collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()])


def test_sequences_and_reruns(spark, odd):
    pieces = P.pack_documents(odd, length=128, with_ids=True)
    rows, again = pieces.collect(), pieces.collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    whole = {r.sequence_id: r for r in P.sequences(pieces).collect()}
    for r in rows:
        s = whole[r.sequence_id]
        assert s.ids[r.offset:r.offset + r.length] == r.ids and sum(s.lengths) == len(s.ids) <= 128


def test_costs_are_balanced():
    rng = random.Random(3)
    rests = [min(1500, int(rng.paretovariate(1.1) * 60)) for _ in range(3000)]
    rooms = [2048] * (sum(rests) // 2048)
    placed, _ = P.assign(rests, rooms, False)
    cost, first_fit, room = np.zeros(len(rooms)), np.zeros(len(rooms)), np.array(rooms)
    for _, _, n, s in placed:
        cost[s] += P.piece_cost(n)
    for n in sorted(rests, reverse=True):               # descending too, but to the first sequence with room
        while n and room.any():
            s = int(np.argmax(room >= n)) if (room >= n).any() else int(np.argmax(room))
            take = min(n, int(room[s]))
            room[s] -= take
            first_fit[s] += P.piece_cost(take)
            n -= take
    assert cost.std() < 0.8 * first_fit.std() and cost.max() < first_fit.max()
    assert len(placed) < len(rests) * 1.03              # hardly any document is cut


def test_empty_and_blank(spark, empty):
    assert P.pack_documents(empty).collect() == []
    one = spark.createDataFrame([(5, None), (None, ""), (7, " ")], "doc_id long, text string").coalesce(1)
    rows = P.pack_documents(one, with_ids=True).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows) == [("5", 1), ("7", 2), ("None", 1)]
    check(rows, [(5, ""), (None, ""), (7, " ")])
