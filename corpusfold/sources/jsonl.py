"""Lenient corpus sources.

* S1 ``read_jsonl``: one JSON object per line; blank, malformed and non-object
  lines are skipped silently. Lines are parsed with ``from_json`` (single
  quotes off, corrupt-record column on) and must start with ``{`` and end
  with ``}`` after stripping (``from_json`` tolerates trailing junk).
* S2 ``read_json_array``: whole file is one array; non-object elements are
  skipped, a file that does not parse is an error. Arrays are cut into elements
  by as many tasks as the file has splits (:mod:`corpusfold.sources.arrays`).
* S3 ``file_formats``: per file, the first non-space character of its first 4096
  bytes, read once through the file system's own interface, many files at a time: no
  line is read for it. ``read_items`` reads each file of a folder by its format.
* S4 ``sample_size``: first N physical lines (blank/bad lines use quota) *before*
  parsing. Files are opened in order until N lines are found; of those files the
  first N lines come by ``orderBy(...).limit(N)`` (each task keeps N).
* S5 ``load_items``: like S1 but non-object lines are kept; a missing path
  gives an empty DataFrame. All lines by default.
* S9 ``union_datasets``: ``{expert: path}``, any number of them, by one scan and a
  map from files to experts.
* A15 ``count_valid_objects``: valid, non-empty objects per source, likewise.

Rows carry ``item_id`` (increasing in file order within a file), the read
fields and ``raw`` (the stripped line, so unread keys survive).
"""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusfold.functions import rules as R
from corpusfold.functions.text import py_strip
from corpusfold.session import list_names, path_exists
from corpusfold.sources.arrays import array_elements, read_text

log = logging.getLogger(__name__)

ITEM_FIELDS = list(dict.fromkeys([*R.CODE_KEYS, *R.TEXT_KEYS]))
# metadata is read as text, whatever it is: an object that is not an object there is still a valid line
ITEM_SCHEMA = ", ".join(f"{k} string" for k in ITEM_FIELDS) + ", metadata string"
HEAD_CHARS = 4096
HEAD_THREADS = 16
_CORRUPT = "_corrupt_record"
_JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"}


def _parse(raw: Column) -> Column:
    return F.from_json(raw, f"{ITEM_SCHEMA}, {_CORRUPT} string", _JSON_OPTIONS)


def _project_item(df: DataFrame, parsed: str = "_j", carry: Sequence[str] = ()) -> DataFrame:
    cols = [F.col(f"{parsed}.{k}").alias(k) for k in ITEM_FIELDS]
    # null unless metadata is an object
    library = F.when(F.col(f"{parsed}.metadata").isNotNull(), F.get_json_object("raw", "$.metadata.library"))
    return df.select("item_id", *cols, library.alias("library"), "raw", *carry)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with a file-order key (file, block start, position in split)."""
    return (read_text(spark, path)
            .select("value", F.col("_metadata.file_path").alias("_f"),
                    F.col("_metadata.file_block_start").alias("_b"),
                    F.monotonically_increasing_id().alias("item_id")))


def _first_lines(lines: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return lines
    return lines.orderBy("_f", "_b", "item_id").limit(n)


def _valid(lines: DataFrame, keep_non_objects: bool, carry: Sequence[str] = ()) -> DataFrame:
    """The items of lines; ``carry`` names further columns to keep."""
    raw = py_strip("value")
    parsed = lines.select("item_id", *carry, raw.alias("raw"), _parse(raw).alias("_j"))
    is_obj = (F.col("raw").startswith("{") & F.col("raw").endswith("}")
              & F.col("_j").isNotNull() & F.col(f"_j.{_CORRUPT}").isNull())
    if keep_non_objects:
        # Valid JSON that is not an object is kept (fields null); blank and bad lines are not.
        valid_any = F.expr("try_parse_json(raw)").isNotNull()
        parsed = parsed.filter(is_obj | (valid_any & ~F.col("raw").startswith("{")))
    else:
        parsed = parsed.filter(is_obj)
    return _project_item(parsed, carry=carry)


def read_jsonl(spark: SparkSession, path: str | list[str], sample_size: int | None = None,
               keep_non_objects: bool = False) -> DataFrame:
    """S1 (+ S4): lenient JSONL reader."""
    if sample_size is not None:
        path = first_files(spark, path, sample_size)
        if not path:
            return empty_items(spark)
    return _valid(_first_lines(_lines(spark, path), sample_size), keep_non_objects)


def first_files(spark: SparkSession, path: str | list[str], n: int) -> list[str]:
    """The files that hold the first ``n`` lines, in file order; no file behind them is opened.

    Files are counted one after the other, each up to the lines still wanted, so what
    is read stays near n lines a split of the files returned.
    """
    found, wanted = [], n
    for file in sorted(spark.read.text(path).inputFiles(), key=unquote):
        if wanted <= 0:
            break
        found.append(unquote(file))
        wanted -= spark.read.text(found[-1]).limit(wanted).count()
    return found


def read_json_array(spark: SparkSession, path: str | list[str], sample_size: int | None = None) -> DataFrame:
    """S2 (+ S4): each file holds one JSON array; object elements become items."""
    el = array_elements(spark, path)
    if sample_size is not None:
        el = el.orderBy("item_id").limit(sample_size)
    el = el.select("item_id", F.parse_json("raw").alias("_v"))
    el = el.filter(F.expr("schema_of_variant(_v)").startswith("OBJECT")).select("item_id", F.expr("to_json(_v)").alias("raw"))
    return _project_item(el.withColumn("_j", _parse(F.col("raw"))))


def _heads(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """The first bytes of each file of any store, as text, ``HEAD_THREADS`` files at a time."""
    hadoop_path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def head(file: str) -> str:
        hpath = hadoop_path(unquote(file))
        stream = hpath.getFileSystem(conf).open(hpath)
        try:
            return bytes(stream.readNBytes(HEAD_CHARS)).decode("utf-8", "ignore")
        finally:
            stream.close()
    with ThreadPoolExecutor(HEAD_THREADS) as pool:
        return list(pool.map(head, files))


def _formats(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, format) of the files in ``path``, by their heads alone."""
    files = sorted(spark.read.text(path).inputFiles())
    return [(f, "json_array" if h.lstrip()[:1] == "[" else "jsonl") for f, h in zip(files, _heads(spark, files)) if h]


def file_formats(spark: SparkSession, path: str) -> DataFrame:
    """S3: (file, fmt) of every non-empty file: ``json_array`` if its head's first non-space character is ``[``, else ``jsonl``."""
    return spark.createDataFrame(_formats(spark, path), "file string, fmt string")


def detect_format(spark: SparkSession, path: str) -> str:
    """S3 for a path of one format; ``mixed`` if its files differ."""
    found = {fmt for _, fmt in _formats(spark, path)}
    return "mixed" if len(found) > 1 else next(iter(found), "jsonl")


def read_items(spark: SparkSession, path: str, fmt: str | None = None,
               sample_size: int | None = None) -> DataFrame:
    """S1-S4 entry point: detect (or take) the format and read; a folder may hold files of both formats.

    ``sample_size`` of a mixed folder counts lines and elements apart, the JSON lines first.
    """
    formats = None
    if fmt is None:
        formats = _formats(spark, path)
        kinds = {f for _, f in formats}
        fmt = "mixed" if len(kinds) > 1 else next(iter(kinds), "jsonl")
    if fmt == "json_array":
        return read_json_array(spark, path, sample_size)
    if fmt == "jsonl":
        return read_jsonl(spark, path, sample_size)
    if fmt != "mixed":
        raise ValueError(f"unknown format {fmt!r}")
    formats = formats if formats is not None else _formats(spark, path)
    lines, elements = ([unquote(f) for f, kind in formats if kind == k] for k in ("jsonl", "json_array"))
    lines, elements = read_jsonl(spark, lines, sample_size), read_json_array(spark, elements, sample_size)
    # ids of the two scans must differ: even and odd
    both = lines.withColumn("item_id", F.col("item_id") * 2).unionByName(elements.withColumn("item_id", F.col("item_id") * 2 + 1))
    return both if sample_size is None else both.orderBy(F.col("item_id") % 2, "item_id").limit(sample_size)


def empty_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"item_id bigint, {ITEM_SCHEMA.replace(', metadata string', '')}, "
                                     "library string, raw string")


def load_items(spark: SparkSession, path: str, num_samples: int | None = None) -> DataFrame:
    """Experiment loader: all lines, or the first ``num_samples``; bad lines skipped, non-objects kept;
    a missing file gives an empty result (logged)."""
    if not path_exists(spark, path):
        log.error("Dataset file not found: %s", path)
        return empty_items(spark)
    return read_jsonl(spark, path, sample_size=num_samples, keep_non_objects=True)


# ------------------------------------------------------------------ many datasets

def _plain(uri: str) -> str:
    """One spelling of a path: ``file:/a``, also where it is written ``file:///a``."""
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):///", r"\1:/", uri).rstrip("/")


def _existing(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, list[str]]:
    """{qualified path: experts} of the paths that are there; each parent folder is listed once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    names: dict[str, set[str]] = {}
    out: dict[str, list[str]] = {}
    for expert, p in paths.items():
        hpath = jvm.org.apache.hadoop.fs.Path(p)
        hpath = hpath.getFileSystem(conf).makeQualified(hpath)
        parent = hpath.getParent()
        folder = None if parent is None else parent.toString()
        if folder is not None and folder not in names:
            names[folder] = set(list_names(spark, folder))
        if folder is None or hpath.getName() in names[folder]:
            out.setdefault(_plain(hpath.toString()), []).append(expert)
    return out


def _owners(files: Sequence[str], paths: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(file, expert): a file belongs to the longest of the paths that lead to it, and to each expert of that path."""
    out = []
    for f in files:
        file = at = _plain(unquote(f))
        while at and at not in paths:
            at = at.rpartition("/")[0]
        out += [(file, e) for e in paths.get(at, ())]
    return out


def tagged_lines(spark: SparkSession, paths: Mapping[str, str], expert_col: str = "expert") -> DataFrame | None:
    """Lines of all datasets from one scan, tagged with their expert; None if no path is there.

    A folder stands for all files below it that no longer path names. The map from
    files to experts has a row a file, which the scan's plan holds too.
    """
    there = _existing(spark, paths)
    if not there:
        return None
    lines = spark.read.option("recursiveFileLookup", "true").text(list(there))
    owners = spark.createDataFrame(_owners(sorted(set(lines.inputFiles())), there), f"_f string, {expert_col} string")
    # one spelling for both sides; url_decode would take a plus for a space
    name = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    lines = lines.select("value", F.regexp_replace(name, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/").alias("_f"),
                         F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("item_id"))
    return lines.join(F.broadcast(owners), "_f")


def union_datasets(spark: SparkSession, paths: Mapping[str, str], num_samples: int | None = None,
                   expert_col: str = "expert") -> DataFrame:
    """Every expert's dataset, tagged, by one scan of all paths; ``num_samples`` takes each expert's first lines."""
    lines = tagged_lines(spark, paths, expert_col)
    if lines is None:
        return empty_items(spark).withColumn(expert_col, F.lit(None).cast("string"))
    if num_samples is not None:
        nth = F.row_number().over(Window.partitionBy(expert_col).orderBy("_f", "_b", "item_id"))    # a task keeps that many an expert
        lines = lines.withColumn("_nth", nth).where(F.col("_nth") <= num_samples)
    return _valid(lines, num_samples is not None, [expert_col])


def count_valid_objects(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Valid non-empty JSON objects per source (blank, malformed, non-object and ``{}`` lines
    excluded; a missing file counts 0), by one scan and one aggregation. Output ``(position, source, valid_items)``."""
    sources = spark.createDataFrame(list(enumerate(paths)), "position int, source string")
    lines = tagged_lines(spark, paths, "source")
    if lines is None:
        return sources.withColumn("valid_items", F.lit(0).cast("bigint"))
    items = _valid(lines, False, ["source"]).filter(~F.col("raw").rlike(r"^\{[\t-\r\x1c-\x1f\x85\p{Z}]*\}$"))
    counts = items.groupBy("source").agg(F.count(F.lit(1)).alias("valid_items"))
    return sources.join(counts, "source", "left").select("position", "source", F.coalesce("valid_items", F.lit(0)).cast("bigint").alias("valid_items"))


def validate_split_args(spark: SparkSession, input_path: str, domains: Sequence[str],
                        default_domain: str, create_misc: bool = False) -> list[str]:
    """S7 + S8: the effective domain list, or ``ValueError`` before any job starts."""
    doms = [d.strip() for d in domains if d and d.strip()]
    if not doms:
        raise ValueError("No domains specified")
    if create_misc and R.MISC_DOMAIN not in doms:
        doms = doms + [R.MISC_DOMAIN]
    if not path_exists(spark, input_path):
        raise ValueError(f"Input not found: {input_path}")
    if default_domain not in doms:
        raise ValueError(f"Default domain '{default_domain}' not in domains")
    return doms
