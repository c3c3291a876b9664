"""Arrays of many splits against the JSON parser."""
import json
import random
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusfold.sources import arrays as A
from corpusfold.sources import jsonl as S

_TEXT = st.text(st.sampled_from(list('ab,[]{}":\\/ \n\té') + [" ", "日"]), max_size=12)
_VALUE = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-99, 99), _TEXT),
                      lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(_TEXT, x, max_size=3)), max_leaves=8)


def cut(text, sizes):
    """Elements of a text read in splits that end after the given numbers of pieces, and each split in chunks of two pieces."""
    data = text.encode()
    pieces = data.split(b",")
    if pieces[-1] == b"":
        pieces.pop()                                    # as the reader does
    splits, at = [], 0
    for n in [*sizes, len(pieces)]:
        if at < len(pieces):
            splits.append(pieces[at:at + n])
            at += n
    effects = []
    for i, rows in enumerate(splits):
        buf = np.frombuffer(b"".join(x + b"," for x in rows), np.uint8)
        inside = A.in_string(buf, False)
        depth = A._DEPTH[buf].astype(int)
        first = bytes(buf[~A._IS_SPACE[buf]][:1]).decode("latin-1") or None
        effects.append(SimpleNamespace(file="f", block=i, bytes=len(buf), size=len(data), turns=len(A.quotes(buf)) % 2 == 1,
                                       outside=int(depth[~inside].sum()), inside=int(depth[inside].sum()), first=first))
    starts = A.compose(effects)
    out, held, empty = [], b"", True
    for i, rows in enumerate(splits):
        cutter = A._Cutter("f", starts["f", i])
        for lo in range(0, len(rows), 2):
            cutter.feed(b"".join(x + b"," for x in rows[lo:lo + 2]))
        cutter.finish()
        for _, _, left, right, only, part in cutter.rows:
            held, empty = (held + part, empty and (only or right)) if left else (part, only)
            if not right:
                if held.strip(A._SPACE):
                    out.append(json.loads(held))
                elif not empty:
                    raise A.BrokenArray("missing")
                held = b""
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(_VALUE, max_size=6), st.lists(st.integers(1, 4), max_size=8), st.sampled_from([None, 1]), st.booleans(),
       st.sampled_from(["", " ", "\n\t "]), st.sampled_from(["", "  \n"]))
def test_any_splits_give_the_elements_of_the_parser(values, sizes, indent, ascii_, before, behind):
    text = before + json.dumps(values, indent=indent, ensure_ascii=ascii_) + behind
    assert cut(text, sizes) == values


@pytest.mark.parametrize("text", ['[1, 2', '[1, 2]]', '[1] 2', '[1],', '[1],\n', '[1,]', '[,1]', '[1,,2]', '{"a":1}', '[1], [2]', '["a, 1]', '1, 2', ' , [1]',
                                  '[1]\n,\n', '[ , ]', '[1, {"a": 2]'])
@pytest.mark.parametrize("sizes", [[], [1], [1, 1, 1], [2]])
def test_broken_files_are_errors(text, sizes):
    with pytest.raises(ValueError):
        cut(text, sizes)


def _small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture()
def small_splits(spark):
    _small_splits(spark, 256)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _value(rng, depth=0):
    text = lambda: "".join(rng.choice(list('ab,[]{}":\\ \n') + ["é", "日"]) for _ in range(rng.randrange(20)))
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return text()
    if kind == 2:
        return rng.choice([None, True, 7, -2.5])
    if kind < 5:
        return {f"k{i}": _value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_one_file_is_read_by_many_tasks(spark, small_splits, tmpdir_path):
    rng = random.Random(4)
    items = [{"prompt": f"p{i}", "code": json.dumps(_value(rng)), "more": _value(rng)} if i % 5 else _value(rng) for i in range(400)]
    items[50] = {"prompt": "long", "code": "x" * 3000, "more": None}           # over many splits
    for name, text in (("a.json", json.dumps(items)), ("b.json", json.dumps(items[:30], indent=2, ensure_ascii=False)), ("c.json", " [ ] \n")):
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write(text)
    read = spark.read.option("lineSep", ",").text(f"{tmpdir_path}/a.json")
    assert read.rdd.getNumPartitions() > 50
    got = A.array_elements(spark, tmpdir_path).orderBy("item_id").collect()
    assert [json.loads(r.raw) for r in got] == items + items[:30]
    assert len({r.item_id for r in got}) == len(got)
    rows = S.read_json_array(spark, f"{tmpdir_path}/a.json").orderBy("item_id").collect()
    assert [json.loads(r.raw) for r in rows] == [x for x in items if isinstance(x, dict)]
    first = S.read_json_array(spark, f"{tmpdir_path}/a.json", sample_size=60).orderBy("item_id").collect()
    assert [r.prompt for r in first] == [x.get("prompt") for x in items[:60] if isinstance(x, dict)]


@pytest.mark.parametrize("text,ok", [("[" + " " * 2000 + "]", True), ("[" + " " * 2000 + ",1]", False), ("[1," + " " * 2000 + "]", False),
                                     ('["' + "[" * 2000 + '"]', True), ("[1" + ",2" * 900 + "]" + " " * 700, True), ("[1" + ",2" * 900 + "]" + " " * 700 + "x", False)])
def test_odd_files_of_many_splits(spark, small_splits, tmpdir_path, text, ok):
    with open(f"{tmpdir_path}/a.json", "w") as f:
        f.write(text)
    if ok:
        got = [json.loads(r.raw) for r in A.array_elements(spark, tmpdir_path).orderBy("item_id").collect()]
        assert got == json.loads(text)
    else:
        with pytest.raises(Exception):
            A.array_elements(spark, tmpdir_path).collect()


def test_empty_file(spark, tmpdir_path):
    open(f"{tmpdir_path}/a.json", "w").close()
    assert A.array_elements(spark, tmpdir_path).collect() == []
