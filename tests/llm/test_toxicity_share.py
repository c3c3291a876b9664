"""Toxicity where a large share of the documents is toxic."""
import random

import pytest

from corpusfold.llm import toxicity as X


@pytest.mark.parametrize("share", [0.4, 0.5])
def test_large_toxic_share(spark, share):
    rng = random.Random(12)
    bad = [f"bad{i}" for i in range(6)]
    docs, labels, toxic = [], [], set()
    for i in range(2400):
        w = [f"c{int(rng.random() ** 2 * 300)}" for _ in range(60)]
        if rng.random() < share:
            toxic.add(i)
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(bad))
        docs.append((i, " ".join(w)))
        if rng.random() < 0.7:
            labels.append((i, int(i in toxic)))
    rows = X.toxicity(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                      spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted for r in held if r.doc_id in toxic) >= 0.9 * sum(r.doc_id in toxic for r in held)
    assert sum(r.predicted for r in held if r.doc_id not in toxic) <= 0.01 * len(held)
