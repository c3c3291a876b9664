"""Items at exactly the largest edit distance that is looked for."""
import random

import pyarrow as pa
import pytest

from corpusfold.llm import decontaminate as D


def share_found(index_of, n, kind, trials=200, seed=31):
    rng = random.Random(1000 * seed + n)
    items = [(i, " ".join(f"b{rng.randrange(10**6)}" for _ in range(n))) for i in range(trials)]
    edits, texts = int(D.MAX_EDIT * n), []
    for _, text in items:
        w = text.split()
        if kind == "start replaced":
            w[:edits] = [f"n{rng.randrange(10**6)}" for _ in range(edits)]
        elif kind == "start cut off":
            w = w[edits:]
        elif kind == "end replaced":
            w[n - edits:] = [f"n{rng.randrange(10**6)}" for _ in range(edits)]
        else:
            for at in sorted(rng.sample(range(n), edits), reverse=True):
                w[at:at + 1] = [["new"], [], [w[at], "more"]][rng.randrange(3) if kind == "mixed" else 0]
        pad = [f"c{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
        texts.append(" ".join(pad + w + pad))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(trials)), "text": texts})
    got = {(r["doc_id"], r["item_id"]) for b in D._matches(index_of(items))([batch]) for r in b.to_pylist()}
    assert all(d == i for d, i in got)
    return len(got) / trials


@pytest.mark.parametrize("n", [25, 50, 80, 120])
@pytest.mark.parametrize("kind", ["start replaced", "start cut off", "end replaced"])
def test_edits_of_one_part_of_an_item(n, kind):
    assert share_found(D.Index, n, kind) >= D.RECALL


@pytest.mark.parametrize("n", [5, 6, 8, 10, 12, 13, 15, 24, 25, 40, 50, 120])
@pytest.mark.parametrize("kind", ["mixed", "substituted"])
def test_recall_at_exactly_the_largest_distance(n, kind):
    # two standard errors of 1,000 trials below the target; the seed is not that of repeats()
    assert share_found(D.Index, n, kind, trials=1000) >= D.RECALL - 0.014


def test_scripts_without_spaces():
    items = [(1, "床前明月光，疑是地上霜。"), (2, "吾輩は猫である。名前はまだ無い。"), (3, "สวัสดีชาวโลก"), (4, "東京"), (5, "霜"), (6, "𠀋𠀌𠀍𠀎𠀏"), (7, "GPT模型"),
             (8, "。、"), (9, "one two")]
    texts = ["诗：床前明月光，疑是地上霜。举头望明月", "床前明月光疑是地下霜", "彼は「吾輩は猫である」名前はまだ無い、と", "คำว่าสวัสดีชาวโลกครับ", "京東と東京都", "東 京",
             "x𠀋𠀌𠀍𠀎𠀏y", "用gpt模型。", "one two", "東", None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    got = {(r["doc_id"], r["item_id"], r["distance"]) for b in D._matches(D.Index(items))([batch]) for r in b.to_pylist()}
    assert got == {(0, 1, 0), (0, 5, 0), (1, 1, 1), (1, 5, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 4, 0), (6, 6, 0), (7, 7, 0), (8, 9, 0)}
