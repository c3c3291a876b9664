"""Operator 5 - exact top-k inner products by the three-phase uniform threshold.

Components become floor(256 x). The dimensions are dealt to ``NODES`` nodes. A node
holds its dimensions of all vectors and knows the scores of
these dimensions only; a vector's score is the sum of its own scores at all nodes.
For a block of queries:

1. *gather*: each node lists its k + 1 highest own scores of each query in a task. What a
   listed vector lacks is fetched from the other nodes; the (k + 1)-th highest whole score,
   tau, is a bound that k vectors besides the query reach;
2. *cutoff*: a vector whose score is at least tau has a node where its own score is at
   least tau / NODES. That cutoff is broadcast, and each node finds its entries from
   there on (a uniform threshold; own scores may be negative);
3. *resolve*: own scores that an entry lacks are fetched, for entries alone, and summed
   exactly; whole scores from tau on leave the task. The k best stay, ties to the smaller vec_id.

Equal vectors are one candidate (a class): its k + 1 smallest vec_ids stand for all
of it, since no query needs more of them, so a very common vector is neither
scored nor returned more than once. Queries that share a vector share a search.

Scale. The entries above the cutoff grow with vectors times queries, so they never leave
the task that finds them: the nodes' blocks are dealt by class, and the parts that all nodes
have of a block of classes lie in one row. They are written once and stay where they are;
both scans read them without a shuffle, and fetching is a look at another node's scores of
the same block. Queries go in blocks of ``QUERY_BLOCK`` classes, which with one
cutoff a query is what is shipped to the tasks; only the cutoffs and a block of queries pass through
the driver. What leaves a task is its k + 1 best listed scores of a query and the scores from
tau on. Products are exact: whole numbers below 2**53 in
doubles, or below 2**24 in floats where the components are that small.

Cases. Vectors that are null, empty, hold null or non-finite components, or whose
vec_id is null take no part; nor do those of another length than the query. Fewer
than k candidates: all of them. Rows that repeat a vec_id are one row for each
different vector; equal ones count once. A query never finds its own vec_id.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusfold.llm.common import by_keys, on_workers, read_table, released
from corpusfold.session import cut_lineage, scratch_path

TOP = 5
NODES = 2
BLOCK = 4096
QUERY_BLOCK = 4096
_SLICE = 256                    # queries multiplied with a block at once
_SCORE = "query long, cls long, score long"


def whole_components(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long array; null if a component is null or not finite."""
    x = F.col(vector)
    number = lambda v: v.cast("double")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(number(v)) & (F.abs(number(v)) < float("inf")))
    return F.when((F.size(x) > 0) & fine, F.transform(x, lambda v: F.floor(number(v) * scale).cast("long")))


def _hash_block(n: int) -> Column:
    return F.pmod(F.xxhash64("cls"), F.lit(n)).cast("int")


def _cuts(dim: int) -> list[int]:
    return [i * dim // NODES for i in range(NODES + 1)]


def node_blocks(classes: DataFrame, n: int) -> DataFrame:
    """The nodes' data: for each (block, dim) the classes' ids and, node by node, their components one after the other."""
    cut = [F.floor(F.col("dim") * i / NODES).cast("int") for i in range(NODES + 1)]
    part = lambda lo, hi: F.flatten(F.transform("rows.vector", lambda v: F.slice(v, lo + 1, hi - lo)))
    return (classes.select(_hash_block(n).alias("block"), "dim", "cls", "vector")
            .groupBy("block", "dim").agg(F.collect_list(F.struct("cls", "vector")).alias("rows"))
            .select("block", "dim", F.col("rows.cls").alias("ids"), F.array(*map(part, cut[:-1], cut[1:])).alias("parts")))


class Asked:
    """The queries of a block, by length: ids in order and components."""

    def __init__(self, rows: list):
        self.ids, self.vectors = {}, {}
        for dim in sorted({r.dim for r in rows}):
            own = sorted((r for r in rows if r.dim == dim), key=lambda r: r.cls)
            self.ids[dim] = np.array([r.cls for r in own], np.int64)
            self.vectors[dim] = np.array([r.vector for r in own], np.float64)

    def parts(self, dim: int, kind: type) -> list[np.ndarray]:
        cut = _cuts(dim)
        return [self.vectors[dim][:, cut[i]:cut[i + 1]].astype(kind) for i in range(NODES)]


def _own_scores(batch: pa.RecordBatch, asked: Asked):
    """(dim, ids, slice of the queries, own scores by node) of the blocks whose length is asked for."""
    for i, dim in enumerate(batch.column("dim").to_pylist()):
        if dim not in asked.ids:
            continue
        ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
        cut, parts = _cuts(dim), batch.column("parts")[i].values
        values = [parts[j].values.to_numpy(zero_copy_only=False).reshape(len(ids), cut[j + 1] - cut[j]) for j in range(NODES)]
        most = max(float(np.abs(v.astype(np.float64)).max(initial=0)) for v in values) * float(np.abs(asked.vectors[dim]).max(initial=0))
        kind = np.float32 if most * dim < 1 << 24 else np.float64
        values, queries = [v.astype(kind) for v in values], asked.parts(dim, kind)
        for at in range(0, len(queries[0]), _SLICE):
            some = slice(at, min(at + _SLICE, len(queries[0])))
            yield dim, ids, some, [q[some] @ v.T for q, v in zip(queries, values)]


def _scores(query: np.ndarray, cls: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(cls, pa.int64()), pa.array(score.astype(np.int64))],
                                      names=["query", "cls", "score"])


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(hit), hit.shape[1])


def _first(row: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k + 1 of each row in the given order (by row first), and their ranks."""
    r = row[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r, "left")
    return order[nth <= k], nth[nth <= k]


class Listed:
    """A node's local score lists: the k + 1 highest own scores of each query among the rows seen, with their whole scores."""

    def __init__(self, queries: int, k: int):
        self.k, self.own = k, np.full((queries, k + 1), -np.inf)
        self.cls, self.whole = np.zeros((queries, k + 1), np.int64), np.zeros((queries, k + 1))

    def add(self, some: slice, ids: np.ndarray, own: np.ndarray, owns: list[np.ndarray]) -> None:
        k, least = self.k, self.own[some].min(axis=1)
        if own.shape[1] > k + 1 and not np.isfinite(least).all():
            row, col = _places(own >= np.maximum(least, np.partition(own, -k - 1, axis=1)[:, -k - 1])[:, None])
        else:
            row, col = _places(own > least[:, None])
        if not len(row):
            return
        hit = np.unique(row)
        r = np.r_[np.repeat(hit, k + 1), row]
        parts = ((self.own, own[row, col]), (self.cls, ids[col]), (self.whole, sum(o[row, col].astype(np.float64) for o in owns)))
        score, cls, whole = (np.r_[held[some][hit].ravel(), new] for held, new in parts)
        best, nth = _first(r, np.lexsort((-score, r)), k)
        for held, x in ((self.own, score), (self.cls, cls), (self.whole, whole)):
            held[some.start + r[best], nth] = x[best]


def _gather(block, k: int):
    """Phase 1: the nodes' local score lists of a task, each listed vector with the scores that it lacks there."""
    def run(batches):
        asked: Asked = block.value
        lists: dict[int, list[Listed]] = {}
        for batch in batches:
            for dim, ids, some, owns in _own_scores(batch, asked):
                own_lists = lists.setdefault(dim, [Listed(len(asked.ids[dim]), k) for _ in range(NODES)])
                for own, listed in zip(owns, own_lists):
                    listed.add(some, ids, own, owns)
        for dim, own_lists in lists.items():
            own, cls, whole = (np.concatenate([getattr(x, name) for x in own_lists], axis=1) for name in ("own", "cls", "whole"))
            row, nth = np.nonzero(np.isfinite(own))
            cls, whole = cls[row, nth], whole[row, nth]
            order = np.lexsort((cls, row))                  # a class that several nodes list counts once
            new = np.r_[True, (np.diff(row[order]) != 0) | (np.diff(cls[order]) != 0)] if len(order) else np.zeros(0, bool)
            row, cls, whole = (x[order[new]] for x in (row, cls, whole))
            best, _ = _first(row, np.lexsort((-whole, row)), k)
            yield _scores(asked.ids[dim][row[best]], cls[best], whole[best])
    return released(run)


def _resolve(block, taus):
    """Phases 2 and 3: the nodes' entries at or above the cutoff, summed with what they lack; whole scores from tau on."""
    def run(batches):
        asked, tau = block.value, taus.value
        bounds = {dim: np.array([tau.get(x, -np.inf) for x in ids.tolist()]) for dim, ids in asked.ids.items()}
        for batch in batches:
            for dim, ids, some, owns in _own_scores(batch, asked):
                whole_from = bounds[dim][some]
                least = np.ceil(whole_from / NODES)[:, None]    # own scores are whole numbers
                entry = np.zeros(owns[0].shape, bool)
                for own in owns:
                    entry |= own >= least.astype(own.dtype)
                row, col = _places(entry)
                score = sum(own[row, col].astype(np.float64) for own in owns)
                fine = score >= whole_from[row]
                if fine.any():
                    yield _scores(asked.ids[dim][some][row[fine]], ids[col[fine]], score[fine])
    return released(run)


def _write_best_classes(spark: SparkSession, nodes: DataFrame, rows: list, k: int, out: str) -> None:
    """Add (query, cls, score) of the classes that may be among the k + 1 best of the queries ``rows`` of a block."""
    block = spark.sparkContext.broadcast(Asked(rows))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))
    # a class may be the query's own, and holds perhaps one id: the (k + 1)-th best class is reached by k others
    cut = nodes.mapInArrow(_gather(block, k), _SCORE).withColumn("nth", nth).where(F.col("nth") == k + 1).select("query", "score")
    taus = spark.sparkContext.broadcast({r.query: r.score for r in cut.collect()})      # one number a query of the block
    nodes.mapInArrow(_resolve(block, taus), _SCORE).write.mode("append").parquet(out)
    for held in (block, taus):
        held.destroy()


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: as Parquet, small whole numbers take a byte or two."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) that ``is_query`` marks."""
    spark = vectors.sparkSession
    on_workers(spark)
    rows = (vectors.select("vec_id", whole_components().alias("vector"), is_query.alias("is_query"))
            .where("vector is not null and vec_id is not null").withColumn("dim", F.size("vector")))
    rows = _written(rows.withColumn("cls", F.xxhash64("vector")), "topk-rows")
    # the k + 1 smallest ids of a class stand for it; the limit is applied before and after the shuffle
    # (a repeated row is counted once: its own id may stand k + 1 times)
    nth = F.dense_rank().over(Window.partitionBy("cls").orderBy("vec_id"))
    members = cut_lineage(rows.select("cls", "vec_id").withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth").distinct())
    classes = _written(rows.groupBy("cls").agg(F.first("vector").alias("vector"), F.first("dim").alias("dim")), "topk-classes")
    asked = cut_lineage(rows.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query")).distinct())
    queries = _written(by_keys(classes, cut_lineage(asked.select(F.col("query").alias("cls")).distinct()), "cls"), "topk-queries")

    # the stated query set against all rows, in blocks
    n_c, n_q = max(1, -(-classes.count() // BLOCK)), -(-queries.count() // QUERY_BLOCK)
    nodes = _written(node_blocks(classes, n_c), "topk-nodes")
    best = scratch_path(spark, "topk-best")
    for i in range(n_q):
        _write_best_classes(spark, nodes, queries.where(_hash_block(n_q) == i).collect(), k, best)
    found = spark.read.schema(_SCORE).parquet(best) if n_q else spark.createDataFrame([], _SCORE)

    # ids: the best k + 1 of a search without the query's own id
    ids = found.join(members.select("cls", "vec_id"), "cls")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = cut_lineage(ids.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select("query", "vec_id", "score"))
    answers = asked.join(ids, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return (answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all `embeddings`: the 5 best of all other rows for each vec_id divisible by 50."""
    return top_inner_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
