"""Quality classifier by importance resampling.

Two bag-of-n-grams models over hashed features, one of a target (documents labelled good) and one of the raw
corpus, give each document the logarithm of its importance weight: the sum of log(target / raw) over its
features. A seeded Gumbel number for each document turns the k largest of weight + Gumbel into a sample without
replacement by weight.

Features are words and runs of signs, and pairs of neighbours, in ASCII lower case; a word next to itself is
one feature of its own. Raw counts cover every document; the target may be a bounded sample of the labelled
rows (``LABELLED``, drawn by hash), whose ids are small enough to broadcast. Both models have a fixed number of
buckets, whatever the corpus. The k-th score is found from a histogram of bounded size, exactly: the bin that it falls
in is divided again until it holds few rows or one score, and rows that are equal in everything are counted, not ranked.

Defined results: a null or empty text has no features and weight 0; repeated ids are rows of their own with the
same Gumbel number; ties go to the smaller id; without usable labels every weight is 0 and all rows are drawn
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.llm.common import WordHashes, checkpoint, mix64

BUCKETS = 1 << 15
#: Labelled rows of which the target's documents are taken, at most.
LABELLED = 20_000
#: Added to each bucket's count.
SMOOTHING = 1.0
BINS = 4096
#: Rows of a bin that are ranked by one window.
RANKED = 50_000
_TOKEN = re.compile(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\s]+").findall


def feature_buckets(text: str | None, hashes: WordHashes, buckets: int = BUCKETS) -> np.ndarray:
    ids = hashes.of(_TOKEN((text or "").encode().lower()))
    if len(ids) < 2:
        return (ids % np.uint64(buckets)).astype(np.int64)
    pairs = mix64(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:])
    pairs[ids[:-1] == ids[1:]] = 1
    return (np.concatenate([ids, pairs]) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; a task sends at most one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [feature_buckets(t, hashes, buckets) for t in batch.column(0).slice(at, 500).to_pylist()]
                total += np.bincount(np.concatenate(found), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(doc_id, n_features, log_weight) of every row of docs."""
    wanted, raw = bucket_counts(target, text_col, buckets), bucket_counts(docs, text_col, buckets)
    if wanted.sum():
        # both smoothed in proportion to their size, so that a bucket seen in neither has ratio 1
        wanted, raw = wanted / wanted.sum(), raw / raw.sum()
        floor = smoothing / buckets / 100
        ratio = np.log(wanted + floor) - np.log(raw + floor)
    else:
        ratio = np.zeros(buckets)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, weights = [], []
            for at in range(0, batch.num_rows, 500):
                for text in batch.column(1).slice(at, 500).to_pylist():
                    found = feature_buckets(text, hashes, buckets)
                    n.append(len(found))
                    weights.append(float(shared.value[found].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(weights, pa.float64())], names=["doc_id", "n_features", "log_weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(weigh, "doc_id long, n_features long, log_weight double")


def gumbel_top_k(weights: DataFrame, k: int, seed: int = 0, bins: int = BINS) -> DataFrame:
    """The k rows of the largest log_weight + Gumbel number, which is added as score."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) + 0.5) / float(1 << 53)
    scored = checkpoint(weights.withColumn("score", F.col("log_weight") - F.log(-F.log(uniform))))
    # signed logarithms spread any range of scores over the bins
    scored = scored.withColumn("place", F.signum("score") * F.log1p(F.abs("score")))
    inside, taken, missing = scored, [], k
    while True:
        found = inside.agg(F.min("place"), F.max("place"), F.count(F.lit(1))).first()
        low, high, n = found[0], found[1], found[2]
        if n <= missing:  # all of them, or an empty table
            taken.append(inside)
            break
        if n <= RANKED or low == high:
            taken.append(_ranked(inside, missing))
            break
        scale = bins / (high - low)
        bin_of = F.least(F.lit(bins - 1), F.floor((F.col("place") - F.lit(low)) * F.lit(scale)).cast("int"))
        above, cut = 0, 0
        for row in inside.groupBy(bin_of.alias("bin")).count().orderBy(F.col("bin").desc()).collect():  # at most bins rows
            if above + row["count"] > missing:
                cut = row["bin"]
                break
            above += row["count"]
        taken.append(inside.filter(bin_of > cut))
        inside, missing = inside.filter(bin_of == cut), missing - above
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.drop("place")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows by falling score, then id; equal rows are one row with a number of copies."""
    order = [F.col("score").desc(), *[c for c in rows.columns if c != "score"]]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("room", F.lit(k) - (F.sum("copies").over(upto) - F.col("copies")))
    return counted.filter("room > 0").select(*rows.columns, F.explode(F.sequence(F.lit(1), F.least("copies", "room"))).alias("copy")).drop("copy")


def resample_by_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, seed: int = 0) -> DataFrame:
    """(doc_id, n_features, log_weight, score) of the documents drawn: as many as the labels' share of good ones.

    labels: (doc_id, quality 0 or 1).
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    share = usable.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    drawn = usable.withColumn("turn", F.xxhash64(F.lit(seed), F.col("doc_id"))).orderBy("turn", "doc_id").limit(labelled).filter("quality = 1").select(F.col("doc_id").alias("good")).distinct()
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    target = plain.join(F.broadcast(drawn), F.col("doc_id") == F.col("good")).select("text")
    weights = importance_weights(plain, target)
    k = round((1.0 if share is None else share) * plain.count())
    return gumbel_top_k(weights, k, seed)


def op5_quality_resampling(spark, sf_dir: str) -> DataFrame:
    return resample_by_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
