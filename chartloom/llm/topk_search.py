"""Exact top-k by inner product: term-at-a-time accumulation over postings, block by block.

Rows are vectors of integer weights by term.  Candidates and queries are dealt into blocks of bounded size; every query
block meets every candidate block in one cogrouped task.  There, a block's candidates become postings (for each term, the
rows that have it, with weights); each query's terms are taken one at a time, and the term's weight times its postings is
scattered into a dense array of scores.  Partition selection keeps the k best of a block; a rank over the blocks' survivors
merges them.  The query set is stated by the caller; nothing is pruned, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.runtime import ship

_QUERIES_AT_ONCE = 32


def quantised(column: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def usable(column: Column) -> Column:
    """True for vectors that are not null and hold finite components only."""
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _matrix(rows: pa.ChunkedArray) -> np.ndarray:
    """Lists of bigint as a matrix; shorter rows lack the later terms."""
    lists = rows.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def accumulated(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of every query against every candidate; exact integers, in the narrowest float that holds them, or int64."""
    terms = min(queries.shape[1], candidates.shape[1])
    most = float(np.abs(queries).sum(axis=1).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    postings = []
    for t in range(terms):
        docs = np.flatnonzero(candidates[:, t])
        dense = 2 * len(docs) > len(candidates)
        postings.append((None if dense else docs, candidates[:, t].astype(kind) if dense else candidates[docs, t].astype(kind)))
    product = np.empty((_QUERIES_AT_ONCE, len(candidates)), kind)
    for at in range(0, len(queries), _QUERIES_AT_ONCE):
        part, own = scores[at : at + _QUERIES_AT_ONCE], queries[at : at + _QUERIES_AT_ONCE]
        for t, (docs, weights) in enumerate(postings):
            rows = np.flatnonzero(own[:, t])
            if not len(rows) or not len(weights):
                continue
            if docs is None and len(rows) * 2 > len(own):
                np.multiply(own[:, t].astype(kind)[:, None], weights[None, :], out=product[: len(own)])
                part += product[: len(own)]
            elif docs is None:
                part[rows] += own[rows, t].astype(kind)[:, None] * weights[None, :]
            else:
                part[np.ix_(rows, docs)] += own[rows, t].astype(kind)[:, None] * weights[None, :]
    return scores


def _best(k: int):
    kind = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if queries.num_rows and candidates.num_rows:
            ids = candidates.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")  # a tie goes to the smaller id, that is to the earlier row
            ids, weights = ids[order], _matrix(candidates.column("weights"))[order]
            asked, keys, wanted = queries.column("vec_id").to_numpy(), queries.column("query").to_numpy(), _matrix(queries.column("weights"))
            for at in range(0, len(asked), 256):
                scores = accumulated(wanted[at : at + 256], weights)
                for q, key, row in zip(asked[at : at + 256], keys[at : at + 256], scores, strict=True):
                    a, b = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
                    rest = np.concatenate((row[:a], row[b:])) if b > a else row
                    if not len(rest):
                        continue
                    least = np.partition(rest, len(rest) - k)[len(rest) - k] if len(rest) > k else rest.min()
                    found = np.flatnonzero(rest >= least)
                    found = found[np.argsort(-rest[found].astype(np.float64) if rest.dtype != np.int64 else -rest[found], kind="stable")[:k]]
                    out[0].append(np.full(len(found), q, np.int64))
                    out[1].append(np.full(len(found), key, np.int64))
                    out[2].append(ids[found + (b - a) * (found >= a)])
                    out[3].append(rest[found].astype(np.int64))
        return pa.table([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in out], schema=kind)

    return run


def _repeated(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(vec_id, weights, copy): the rows, numbered where they repeat wholly; copies beyond `most` are left out."""
    n = F.count("*") if most is None else F.least(F.count("*"), F.lit(most))
    counted = rows.groupBy("vec_id", "weights").agg(n.alias("n"))
    return counted.select("vec_id", "weights", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = 2048, candidate_block: int | None = None) -> DataFrame:
    """(vec_id bigint, weights array<bigint>) twice -> (query_id, rank, vec_id, score): the k highest inner products of each.

    A candidate with the query's own vec_id is no result of it.  Ties go to the smaller vec_id.  Every row takes part, also
    one that repeats another or shares its vec_id; the queries of one vec_id share one ranking.  Null ids or weights must be
    filtered out before.  Vectors of unequal length lack the missing terms.  Fewer than k candidates give all; an empty side
    gives no rows.

    A block of candidates has 65,536 rows, or fewer (8,192 at least) where that keeps all cores busy; the queries are sent
    once to each block of candidates, and the candidates once to each block of queries.
    """
    spark = queries.sparkSession
    ship(spark)
    queries, candidates = _repeated(queries), _repeated(candidates, k)  # a candidate's copies beyond the k-th are in no result
    n = candidates.count()
    candidate_block = candidate_block or min(65_536, max(8_192, n // (2 * spark.sparkContext.defaultParallelism)))
    q_blocks = max(1, -(-queries.count() // query_block))
    c_blocks = max(1, -(-n // candidate_block))

    def blocks(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", "weights", "copy"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    asked = blocks(queries, "qb", q_blocks, "cb", c_blocks).withColumn("query", F.xxhash64("vec_id", "weights", "copy")).groupBy("qb", "cb")
    known = blocks(candidates, "cb", c_blocks, "qb", q_blocks).groupBy("qb", "cb")
    found = asked.cogroup(known).applyInArrow(_best(k), "query_id bigint, query bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
