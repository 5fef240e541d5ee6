"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one word from each of M full-dimensional codebooks. Codebooks are trained on a
bounded sample (``SAMPLE`` rows, taken by hash) one after another on what the ones before leave over; encoding
keeps a beam of the best partial sums. With the norm of the sum stored, the squared distance to a query is
``|q|^2 - 2 * sum of M looked-up products + norm``, so a query scores a vector by M additions. The best
``rerank`` codes of a query get their exact distance on the original vectors, in double precision.

Where the codes do not settle what is beyond these (a group of copies or near copies that share codes is larger
than ``rerank``), the search goes on: the k-th exact distance so far and the error stored with each code tell which
rows may still be among the k nearest, and all of them are ranked exactly. They travel once for each block of
queries; a task sends its k nearest of each query.

Every row is coded; codes are M bytes and a norm. Codes are scored in their own partitions against blocks of
queries; each task sends its best candidates of each query only, and these are merged by windows over (query,
salt) before (query). The codebooks (M * K words) are the only thing that is broadcast, and of fixed size.

Defined results: vectors that are null or zero, or hold a null, NaN or infinite component, or differ in
dimension from the trained codebooks, take no part, and neither do rows with a null id; equal vectors are ordered by
id; an id counts once, with the smallest of its vectors; with fewer candidates than asked, all; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.llm.common import checkpoint, possible_members

BOOKS, WORDS, BEAM = 16, 256, 8
#: Rows on which codebooks are trained, at most.
SAMPLE = 10_000
#: Codes of a query that are ranked exactly.
RERANK = 640
#: Standard deviations of a code's distance within which a row may still be nearer than the k-th found.
MARGIN = 3.0
#: Queries that a task scores together.
QUERY_BLOCK = 8192


def usable(vector: Column) -> Column:
    """Neither null nor zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(1)[None, :] - 2 * x @ words.T, axis=1)


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, steps: int = 8, sweeps: int = 2, seed: int = 7) -> np.ndarray:
    """(books, words, dimension) codebooks: k-means on residuals, then least squares over all books given the codes."""
    rng = np.random.default_rng(seed)
    rest, out = sample.astype(np.float64), []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(steps):
            at = _nearest(rest, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, rest)
            n = np.bincount(at, minlength=words)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
            if (n == 0).any():
                centres[n == 0] = rest[rng.choice(len(rest), int((n == 0).sum()))]
        rest = rest - centres[_nearest(rest, centres)]
        out.append(centres)
    codebooks = np.array(out)
    for _ in range(sweeps):
        codes = encode(sample, codebooks, beam)
        rest = sample - codebooks[np.arange(books)[None, :], codes].sum(1)
        for m in range(books):
            rest += codebooks[m, codes[:, m]]
            sums = np.zeros_like(codebooks[m])
            np.add.at(sums, codes[:, m], rest)
            n = np.bincount(codes[:, m], minlength=words)
            codebooks[m, n > 0] = sums[n > 0] / n[n > 0, None]
            rest -= codebooks[m, codes[:, m]]
    return codebooks


def encode(vectors: np.ndarray, codebooks: np.ndarray, beam: int = BEAM, block: int = 1024) -> np.ndarray:
    """Beam search: after each book the ``beam`` partial sums nearest to the vector go on."""
    books, words, dimension = codebooks.shape
    codebooks = codebooks.astype(np.float32)
    own = (codebooks * codebooks).sum(2)
    out = np.empty((len(vectors), books), np.int64)
    for at in range(0, len(vectors), block):
        rest = vectors[at : at + block].astype(np.float32)[:, None, :]
        n = len(rest)
        codes = np.zeros((n, 1, 0), np.int64)
        for m in range(books):
            # |r - c|^2 = |r|^2 + |c|^2 - 2 r.c for every partial sum's residual r
            errors = (rest * rest).sum(2)[:, :, None] + own[m] - 2 * (rest.reshape(-1, dimension) @ codebooks[m].T).reshape(n, -1, words)
            flat = errors.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // words, best % words
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - codebooks[m][word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], axis=2)
        out[at : at + block] = codes[np.arange(n), (rest * rest).sum(2).argmin(1)]
    return out


def build_index(vectors: DataFrame, id_col: str, vector_col: str, sample: int = SAMPLE, books: int = BOOKS, words: int = WORDS, beam: int = BEAM) -> tuple[DataFrame, np.ndarray | None]:
    """(id, codes, norm, error, vector) of every usable row, and the codebooks; None of an empty table.

    norm is the squared length of the coded sum, error its squared distance to the vector.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    # ids alone are shuffled to find the repeated ones, and vectors of these only
    repeated = checkpoint(rows.groupBy("id").count().filter("count > 1").select("id"))
    if not repeated.isEmpty():
        marked = possible_members(rows, F.col("id"), F.col("id"), repeated)
        rows = marked.filter(~F.col("__possible")).select("id", "vector").unionByName(marked.filter("__possible").groupBy("id").agg(F.min("vector").alias("vector")))
    drawn = rows.select(F.xxhash64("id", "vector").alias("turn"), F.col("vector").cast("array<double>").alias("vector")).orderBy("turn").limit(sample).toPandas()["vector"]
    if not len(drawn):
        return rows.select("id", F.lit(b"").alias("codes"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("error"), "vector"), None
    sizes = drawn.map(len)
    dimension = int(sizes.mode()[0])
    codebooks = train(np.stack(drawn[sizes == dimension].to_list()), books, min(words, 256), beam)
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = encode(x, shared.value, beam)
            sums = shared.value[np.arange(books)[None, :], codes].sum(1)
            packed = [c.tobytes() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array((sums * sums).sum(1)), pa.array(((x - sums) ** 2).sum(1)), batch.column(1)], names=["id", "codes", "norm", "error", "vector"])

    kind = vectors.schema[vector_col].dataType.simpleString()
    return rows.filter(F.size("vector") == dimension).mapInArrow(coded, f"id long, codes binary, norm double, error double, vector {kind}"), codebooks


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles; at least one row."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _smallest(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest finite scores, ties by id."""
    if len(score) > n:
        edge = np.partition(score, n - 1)[n - 1]
        inside, tied = np.flatnonzero(score < edge), np.flatnonzero(score == edge)
        keep = np.concatenate([inside, tied[np.argsort(ids[tied], kind="stable")][: n - len(inside)]])
    else:
        keep = np.arange(len(score))
    return keep[np.isfinite(score[keep])]


def search(index: DataFrame, codebooks: np.ndarray | None, queries: DataFrame, k: int = 10, rerank: int = RERANK, block: int = QUERY_BLOCK) -> DataFrame:
    """queries: (id, vector) -> (query_id, rank, id, score): the k nearest found, the query's own row left out.

    Query blocks meet every partition of codes; a task keeps ``rerank`` codes of each of its queries. Rows beyond
    these that may be nearer by their code are found in a second pass and ranked exactly.
    """
    spark = index.sparkSession
    if codebooks is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    books, _, dimension = codebooks.shape
    shared = spark.sparkContext.broadcast(codebooks)
    parts = max(1, index.rdd.getNumPartitions())
    asked = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    n_blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    # each share of the codes, drawn by hash, meets each block of queries; it has about rerank / parts of a query's
    # best codes, and what is beyond the number that it may send is left to the second pass
    send = min(rerank, 3 * -(-rerank // parts) + 64)
    share = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cell")
    cell = F.pmod(F.xxhash64("id", "norm"), F.lit(parts)).cast("int").alias("cell")
    codes = index.select(cell, "id", "codes", "norm", "error", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def scores(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place, query, squared distance to each code less that of the query to zero) of each query."""
        q, n = _matrix(left.column("query")), right.num_rows
        code = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(n, books)
        norm, ids = right.column("norm").to_numpy().astype(np.float32), right.column("id").to_numpy()
        for i, own in enumerate(left.column("query_id").to_numpy()):
            table = np.einsum("d,mkd->mk", q[i], shared.value).astype(np.float32)
            score = norm.copy()
            for m in range(books):
                score -= 2 * table[m][code[:, m]]
            score[ids == own] = np.inf
            yield i, q[i], score

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            names, ids = left.column("query_id").to_numpy(), right.column("id").to_numpy()
            for i, _, score in scores(left, right):
                keep = _smallest(score, ids, send)
                found.append(np.stack([np.full(len(keep), names[i], np.int64), ids[keep], score[keep].astype(np.float64).view(np.int64)]))
        q_id, c_id, bits = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        return pa.table({"query_id": q_id, "id": c_id, "guess": bits.view(np.float64)})

    def unsettled(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows that a query of the block has not ranked exactly, while they may be among its k nearest."""
        ids, open_ = right.column("id").to_numpy(), np.zeros(right.num_rows, bool)
        if left.num_rows and right.num_rows:
            error, norm = right.column("error").to_numpy(), right.column("norm").to_numpy()
            radius, last = left.column("radius").to_numpy(), left.column("last").to_numpy()
            for i, q, score in scores(left, right):
                # the code's squared distance is that of the row, plus the error, plus twice their product
                size = q @ q
                slack = 1e-5 * (size + norm)
                near = size + score <= radius[i] ** 2 + error + 2 * MARGIN * radius[i] * np.sqrt(error / dimension) + slack
                sent = np.zeros(len(ids), bool)
                sent[_smallest(score, ids, send)] = True
                open_ |= (near | np.isinf(radius[i])) & np.isfinite(score) & (~sent | (score >= last[i] - slack))
        ids = np.unique(ids[open_])
        block = left.column("block")[0].as_py() if len(ids) else 0
        return pa.table({"block": pa.array(np.full(len(ids), block, np.int32)), "id": ids})

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            names, ids, x = left.column("query_id").to_numpy(), right.column("id").to_numpy(), _matrix(right.column("vector"))
            for i, q in enumerate(_matrix(left.column("query"))):
                far = ((x - q) ** 2).sum(1)
                far[ids == names[i]] = np.inf
                keep = _smallest(far, ids, k)
                found.append(np.stack([np.full(len(keep), names[i], np.int64), ids[keep]]))
        q_id, c_id = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"query_id": q_id, "id": c_id})

    def ranked(chosen: DataFrame) -> DataFrame:
        pairs = chosen.distinct().join(index.select("id", "vector"), "id").join(asked.select("query_id", "query"), "query_id")
        squares = F.zip_with(F.col("vector").cast("array<double>"), F.col("query").cast("array<double>"), lambda a, b: (a - b) * (a - b))
        exact = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
        order = Window.partitionBy("query_id").orderBy("score", "id")
        return pairs.select("query_id", "id", exact.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")

    guesses = asked.select("*", share).groupBy("block", "cell").cogroup(codes.groupBy("block", "cell")).applyInArrow(scored, "query_id long, id long, guess double")
    best = Window.partitionBy("query_id").orderBy("guess", "id")
    chosen = guesses.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= rerank)
    last = checkpoint(chosen.groupBy("query_id").agg(F.max("guess").alias("last")))
    first = checkpoint(ranked(chosen.select("query_id", "id")))
    # fewer rows than k leave the radius open
    radius = first.groupBy("query_id").agg(F.when(F.max("rank") == k, F.max("score")).otherwise(F.lit(float("inf"))).alias("radius"))
    known = asked.join(radius, "query_id").join(last, "query_id")
    left_over = known.select("*", share).groupBy("block", "cell").cogroup(codes.groupBy("block", "cell")).applyInArrow(unsettled, "block int, id long")
    left_over = checkpoint(left_over)
    if left_over.isEmpty():
        return first
    rows = index.select("id", cell, "vector").join(left_over.distinct(), "id")
    more = asked.select("*", share).groupBy("block", "cell").cogroup(rows.groupBy("block", "cell")).applyInArrow(measured, "query_id long, id long")
    return ranked(first.select("query_id", "id").unionByName(more))


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    index, codebooks = build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    index = checkpoint(index)
    found = search(index, codebooks, index.filter(F.col("id") % 100 == 0).select("id", "vector"))
    return found.withColumnRenamed("id", "vec_id")
