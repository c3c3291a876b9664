"""S1-S9 and A15 on file fixtures (FIXTURES.md section 4), written under a fresh temp dir."""
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusfold.sources import jsonl as S
from corpusfold.sources import sinks as SK

LINES = [
    ('{"prompt":"a","metadata":{"library":"pandas"}}', True),
    ("", False), ("   ", False), ("{bad", False), ("[1,2]", False), ("5", False),
    ("{}", True), ('{"a":NaN}', True), ('{"a":Infinity}', True), ('{"a":1,"a":2}', True),
    ("{'a':1}", False), ('{"a":1} junk', False), ('{"a":01}', False),
    ('{"metadata":"x","prompt":"m"}', True), ('{"metadata":[{"library":"q"}]}', True), ('{"metadata":7}', True), ('{"metadata":null}', True),
    ('{"prompt":5}', True), ('  {"prompt":"x"}  ', True), ('{"a":"\tb"}', False),
]


def _write(dirpath, name, text):
    p = os.path.join(dirpath, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_jsonl_leniency(spark, tmpdir_path):
    p = _write(tmpdir_path, "in.jsonl", "\n".join(l for l, _ in LINES) + "\n")
    rows = S.read_jsonl(spark, p).orderBy("item_id").collect()
    assert [r.raw for r in rows] == [l.strip() for l, keep in LINES if keep]
    assert rows[0].library == "pandas" and rows[0].prompt == "a"
    assert [r.library for r in rows if "metadata" in r.raw] == ["pandas", None, None, None, None]
    assert [r.prompt for r in rows if r.raw == '{"prompt":5}'] == ["5"]   # read as string (Q7)


def test_first_n_counts_physical_lines(spark, tmpdir_path):
    p = _write(tmpdir_path, "in.jsonl", "\n".join(l for l, _ in LINES) + "\n")
    rows = S.read_jsonl(spark, p, sample_size=7).collect()
    assert sorted(r.raw for r in rows) == sorted([LINES[0][0], "{}"])


def test_loader_keeps_non_objects_and_missing_is_empty(spark, tmpdir_path):
    p = _write(tmpdir_path, "in.jsonl", "\n".join(l for l, _ in LINES) + "\n")
    raws = [r.raw for r in S.load_items(spark, p, num_samples=6).collect()]
    assert sorted(raws) == sorted([LINES[0][0], "[1,2]", "5"])
    assert S.load_items(spark, p).count() == sum(keep for _, keep in LINES) + 2
    assert S.load_items(spark, os.path.join(tmpdir_path, "missing.jsonl")).count() == 0


def test_json_array_and_detection(spark, tmpdir_path):
    arr = [{"prompt": "p1", "code": "c"}, 5, "{\"prompt\":\"no\"}", [1], {"prompt": "p2"}]
    p = _write(tmpdir_path, "in.json", "  \n" + json.dumps(arr))
    assert S.detect_format(spark, p) == "json_array"
    rows = S.read_items(spark, p).collect()
    assert sorted(r.prompt for r in rows) == ["p1", "p2"]
    assert S.read_json_array(spark, p, sample_size=2).count() == 1   # first 2 elements: 1 object
    bad = _write(tmpdir_path, "bad.json", "[{\"a\": 1}, ")
    with pytest.raises(Exception):
        S.read_json_array(spark, bad).collect()


def test_validation_errors(spark, tmpdir_path):
    p = _write(tmpdir_path, "in.jsonl", "{}\n")
    assert S.validate_split_args(spark, p, ["a", "b"], "misc", create_misc=True) == ["a", "b", "misc"]
    with pytest.raises(ValueError):
        S.validate_split_args(spark, p, [" ", ""], "a")
    with pytest.raises(ValueError):
        S.validate_split_args(spark, p, ["a"], "b")
    with pytest.raises(ValueError):
        S.validate_split_args(spark, os.path.join(tmpdir_path, "nope"), ["a"], "a")


def test_count_valid_objects_and_union(spark, tmpdir_path):
    a = _write(tmpdir_path, "a.jsonl", "\n".join(l for l, _ in LINES) + "\n")
    b = _write(tmpdir_path, "b.jsonl", '{"prompt":"q"}\n{ }\n')
    counts = {r.source: r.valid_items for r in
              S.count_valid_objects(spark, {"a": a, "b": b, "c": os.path.join(tmpdir_path, "c")}).collect()}
    assert counts == {"a": sum(keep for _, keep in LINES) - 1, "b": 1, "c": 0}
    u = S.union_datasets(spark, {"a": a, "b": b})
    assert {r.expert for r in u.collect()} == {"a", "b"}


def test_domain_sink_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([(i, d, json.dumps({"i": i, "t": "é"}, ensure_ascii=False))
                                for i, d in enumerate(["x", "y", "x", "x"])], "item_id long, domain string, raw string")
    out = os.path.join(tmpdir_path, "out")
    SK.write_domains(df, out)
    back = SK.read_domains(spark, out)
    assert sorted((r.domain, r.raw) for r in back.collect()) == sorted((r.domain, r.raw) for r in df.collect())
    assert back.filter("domain = 'y'").count() == 1
    text = SK.render_text_report(spark.createDataFrame([("x", 3, 75.0, 4), ("y", 1, 25.0, 4)],
                                                       "domain string, cnt long, pct double, total long"))
    assert "Total Items: 4" in text and "x                    3 items ( 75.0%)" in text


def test_many_datasets_by_one_scan(spark, tmpdir_path):
    paths, want = {}, {}
    for i in range(40):
        d = os.path.join(tmpdir_path, f"set {i}+%41é")
        os.makedirs(os.path.join(d, "inner"))
        _write(d, "part-0.jsonl", "".join('{"prompt":"%d"}\n' % k for k in range(i % 4)))
        _write(os.path.join(d, "inner"), "x.jsonl", '{"prompt":"in"}\nbad\n')
        paths[f"e{i}"], want[f"e{i}"] = d, i % 4 + 1
    paths["e3i"], want["e3i"], want["e3"] = os.path.join(paths["e3"], "inner"), 1, 3          # the longer path takes its files
    paths["twin"], want["twin"] = paths["e2"], 3
    paths["none"], want["none"] = os.path.join(tmpdir_path, "none"), 0
    counts = S.count_valid_objects(spark, paths)
    assert {r.source: r.valid_items for r in counts.collect()} == want
    assert [r.source for r in counts.orderBy("position").collect()] == list(paths)
    plan = S.union_datasets(spark, paths)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    rows = S.union_datasets(spark, paths).collect()
    assert {e: sum(r.expert == e for r in rows) for e in want} == want and len({(r.item_id, r.expert) for r in rows}) == len(rows)
    first = S.union_datasets(spark, paths, num_samples=1).collect()
    assert all(sum(r.expert == e for r in first) <= 1 for e in want)
    assert S.union_datasets(spark, {"a": os.path.join(tmpdir_path, "none")}).collect() == []


def test_first_n_opens_the_first_files_only(spark, tmpdir_path):
    for i in range(6):
        _write(tmpdir_path, f"p{i}.jsonl", "".join('{"prompt":"%d"}\n' % (10 * i + k) for k in range(10)))
    assert [os.path.basename(f) for f in S.first_files(spark, tmpdir_path, 23)] == ["p0.jsonl", "p1.jsonl", "p2.jsonl"]
    assert sorted(int(r.prompt) for r in S.read_jsonl(spark, tmpdir_path, sample_size=23).collect()) == list(range(23))
    assert S.read_jsonl(spark, tmpdir_path, sample_size=0).collect() == []
    assert S.read_jsonl(spark, tmpdir_path, sample_size=999).count() == 60


def test_ordered_domain_files(spark, tmpdir_path):
    import glob
    df = spark.createDataFrame([(i, "hot" if i % 10 else "cold", json.dumps({"i": i})) for i in range(900)],
                               "item_id long, domain string, raw string").repartition(7)
    out = os.path.join(tmpdir_path, "ordered")
    for n in (4, 1):
        SK.write_domains(df, out, files_per_domain=n, domains=["hot", "cold", "none"])
        for domain in ("hot", "cold"):
            files = sorted(glob.glob(os.path.join(out, f"domain={domain}", "*.txt")))
            got = [json.loads(line)["i"] for f in files for line in open(f)]
            assert got == sorted(got) and len(files) <= n and set(got) == {i for i in range(900) if (i % 10 > 0) == (domain == "hot")}
            assert n == 1 or domain == "cold" or max(sum(1 for _ in open(f)) for f in files) < 400
        assert os.path.isdir(os.path.join(out, "domain=none"))
    assert not glob.glob(out + "-staging-*")


def test_batches_of_a_permutation(spark):
    from corpusfold.operators import prepare as D
    for n in (1, 2, 7, 64, 100):
        rows = spark.range(n).select(D.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(5)).alias("x")).collect()
        assert sorted(r.x for r in rows) == list(range(n))
    items = spark.createDataFrame([(i, None if i % 3 == 0 else "d" + str(i % 3)) for i in range(60)], "item_id long, domain string")
    rows = D.batch_sample(items, 30, 8).collect()
    taken = {}
    for r in rows:
        taken.setdefault((r.domain, r.step), []).append(r.item_id)
    assert len(taken) == 90 and all(len(v) == len(set(v)) == 8 for v in taken.values())
    counts = [sum(i in v for v in taken.values()) for i in range(60)]
    assert min(counts) >= 4 and max(counts) <= 24                       # 12 on average


def test_text_report_sections(spark):
    from corpusfold.operators import report as A
    df = spark.createDataFrame([(i, d, r, "p" * i, "c", lib) for i, (d, r, lib) in enumerate(
        [("x", "r1", "Numpy"), ("x", "r1", "numpy"), ("x", "r2", "torch"), ("y", "r1", None)])],
        "item_id long, domain string, reason string, prompt string, code string, library string")
    text = SK.render_text_report(A.domain_distribution(df, ["x", "y", "z"]), A.domain_text_stats(df), A.reason_top(df, k=10),
                                 A.domain_top_libraries(df))
    lines = text.split("\n")
    at = next(i for i, x in enumerate(lines) if x.startswith("  x  "))
    assert lines[at + 1:at + 6] == ["    - Avg prompt len: 1 chars", "    - Avg code len:   1 chars", "    - Avg lines:      1.0 lines",
                                    "    - Top libraries: numpy(2), torch(1)", ""]
    assert lines[0] == "=" * 80 and lines[4] == "Total Items: 4" and any(x.startswith("  z ") and "0 items" in x for x in lines)
    tail = lines.index("Top Classification Reasons:")
    assert [x.split() for x in lines[tail + 2:]] == [["r1", "3", "(", "75.0%)"], ["r2", "1", "(", "25.0%)"]]


def test_run_results_round_trip(spark, tmpdir_path):
    rounds = spark.createDataFrame([("a", 1, 0.5), ("b", 1, None)], "run string, step long, quality double")
    comparison = spark.createDataFrame([("a", "b", 12.5)], "run_a string, run_b string, improvement_percent double")
    SK.write_run_results(rounds, comparison, tmpdir_path + "/r")
    back = SK.read_run_results(spark, tmpdir_path + "/r", "run string, step long, quality double", "run_a string, run_b string, improvement_percent double")
    assert sorted(map(tuple, back[0].collect())) == [("a", 1, 0.5), ("b", 1, None)] and back[1].collect()[0].improvement_percent == 12.5


def test_split_corpus_end_to_end(spark, tmpdir_path):
    from corpusfold.plans.split import split_corpus
    items = [{"prompt": "Read CSV", "code": "import pandas as pd", "metadata": {"library": "pandas"}, "extra": [1]},
             {"prompt": "Get users", "code": "SELECT * FROM users WHERE id = 1;"},
             {"prompt": "hello", "code": ""}]
    p = _write(tmpdir_path, "in.jsonl", "\n".join(json.dumps(i) for i in items) + "\n{bad\n")
    out = os.path.join(tmpdir_path, "domains")
    res = split_corpus(spark, p, out, domains=["python", "sql"], default_domain="misc", create_misc=True)
    assert res.domains == ["python", "sql", "misc"]
    dist = {r.domain: r.cnt for r in res.distribution.collect()}
    assert dist == {"python": 1, "sql": 1, "misc": 1}
    back = {r.domain: r.raw for r in SK.read_domains(spark, out).collect()}
    assert json.loads(back["python"])["extra"] == [1]          # unread keys survive
    assert "Total Items: 3" in res.text_report()
    summ = res.summary()
    assert summ["total"] == 3 and summ["counts"] == {"python": 1, "sql": 1, "misc": 1}
    assert summ["top_reasons"]["Library: pandas"] == 1
    stats = res.statistics()
    assert list(stats["domains"]) == ["misc", "python", "sql"]
    assert stats["domains"]["python"]["top_libraries"] == {"pandas": 1}
    assert stats["domains"]["sql"]["avg_code_len"] == round(len("SELECT * FROM users WHERE id = 1;"), 2)
    res.save_reports(spark, os.path.join(tmpdir_path, "reports"))
    txt = "\n".join(r.value for r in spark.read.text(os.path.join(tmpdir_path, "reports", "report_txt")).collect())
    assert "Domain Distribution:" in txt
    imp = split_corpus(spark, p, os.path.join(tmpdir_path, "d2"), domains=["pandas", "sql", "py_core"],
                       default_domain="py_core", rules="imports")
    assert {r.domain: r.cnt for r in imp.distribution.collect()} == {"pandas": 1, "sql": 1, "py_core": 1}


def test_each_file_of_a_folder_has_its_own_format(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "parts")
    os.makedirs(d)
    _write(d, "part-0.txt", '{"prompt":"a"}\n')
    _write(d, "part-1.txt", "\n" * 300 + '  [{"prompt":"b"},\n 3, {"prompt":"c"}]')        # an array behind empty lines
    _write(d, "part-2.txt", " " * 5000 + '[{"prompt":"late"}]\n{"prompt":"d"}\n')           # beyond the head: JSON lines
    _write(d, "part-3.txt", "")
    fmt = {os.path.basename(r.file): r.fmt for r in S.file_formats(spark, d).collect()}
    assert fmt == {"part-0.txt": "jsonl", "part-1.txt": "json_array", "part-2.txt": "jsonl"}
    assert S.detect_format(spark, d) == "mixed"
    rows = S.read_items(spark, d).collect()
    assert sorted(r.prompt for r in rows) == ["a", "b", "c", "d"] and len({r.item_id for r in rows}) == 4
    assert S.read_items(spark, d, sample_size=1).count() == 1


def test_empty_domains_get_directories(spark, tmpdir_path):
    df = spark.createDataFrame([(0, "x", "{}")], "item_id long, domain string, raw string")
    out = os.path.join(tmpdir_path, "o")
    SK.write_domains(df, out, domains=["x", "empty"])
    assert os.path.isdir(os.path.join(out, "domain=empty"))
    assert SK.read_domains(spark, out).count() == 1


def test_eligible_list(spark):
    from corpusfold.operators import prepare as D
    counts = spark.createDataFrame([(0, "a", 60), (1, "b", 10), (2, "c", 50)], "position int, source string, valid_items long")
    assert D.eligible_expert_list(counts, 50) == ["a", "c"]
    with pytest.raises(ValueError):
        D.eligible_expert_list(counts, 100)
    items = spark.createDataFrame([(i, "d" + str(i % 2)) for i in range(40)], "item_id long, domain string")
    assert D.batch_sample(items, 2, 5, group_col=None).count() == 10
    assert D.batch_sample(items, 2, 5).count() == 20


def test_cli_split(spark, tmpdir_path, capsys):
    from corpusfold.__main__ import main
    p = _write(tmpdir_path, "in.jsonl", '{"prompt":"q","code":"SELECT a FROM b"}\n{"prompt":"x"}\n')
    assert main(["split", "--input", p, "--outdir", os.path.join(tmpdir_path, "o"), "--create-misc"]) == 0
    out = capsys.readouterr().out
    assert "Total Items: 2" in out and "SQL structure" in out
    assert main(["split", "--input", os.path.join(tmpdir_path, "missing"), "--outdir", tmpdir_path]) == 1
    assert main(["split", "--input", p, "--outdir", tmpdir_path, "--default-domain", "nope"]) == 1


def test_salted_domain_write(spark, tmpdir_path):
    import glob
    df = spark.createDataFrame([(i, "hot" if i % 10 else "cold", json.dumps({"i": i})) for i in range(300)],
                               "item_id long, domain string, raw string").repartition(7)
    out = os.path.join(tmpdir_path, "salted")
    SK.write_domains(df, out, files_per_domain=3, domains=["hot", "cold"])
    hot_files = [f for f in glob.glob(os.path.join(out, "domain=hot", "*.txt"))]
    assert 1 < len(hot_files) <= 3
    assert SK.read_domains(spark, out).count() == 300


def test_no_written_file_begins_with_a_planted_line(spark, tmp_path):
    from corpusfold.plans import queries_io as Q
    spark.range(0, 19 * 60, 19).selectExpr("id AS doc_id", "'text' AS text", "'en' AS lang", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("150", "false")):           # more files than items: lines of one item would be dealt over several
            spark.conf.set(n, v)
        assert Q.jsonl_read(spark, str(tmp_path)).where("problem_id IS NOT NULL").count() == 60
        assert Q.mixed_read(spark, str(tmp_path)).where("problem_id IS NOT NULL").count() == 120
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_many_files_are_listed_by_few_tasks(spark, tmp_path):
    from corpusfold.sources.arrays import LISTING, read_text
    files = []
    for i in range(60):
        files.append(str(tmp_path / f"f{i:02d}.txt"))
        (tmp_path / f"f{i:02d}.txt").write_text("[1]" if i % 3 else '{"prompt": "p"}')
    before, sc = spark.conf.get(LISTING), spark.sparkContext
    sc.setJobGroup("listing", "listing")
    try:
        assert read_text(spark, files).count() == 60
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("listing")]
        stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds]
        assert max(s.numTasks for s in stages if s) < 60
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(key, None)
    assert spark.conf.get(LISTING) == before
    assert [fmt for _, fmt in S._formats(spark, str(tmp_path))] == ["json_array" if i % 3 else "jsonl" for i in range(60)]
