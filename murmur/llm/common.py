"""Small helpers that several operators share: words, n-gram hashes, checkpoints."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are maximal runs outside these six ASCII characters; ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAKS = " \t\n\r\x0b\x0c"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (bytes) -> unsigned 64-bit hash, remembered up to a bound of entries."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n words; fewer than n words make one window of all of them, none make none."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * _MULTIPLIER + mix64(words[i : i + len(out)] + np.uint64(i + 1))
    return mix64(out)


def ensure_checkpoint_dir(spark) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; only a local session may do without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="murmur-checkpoint-"))


def checkpoint_path(spark, name: str) -> str:
    """A path for a written table in the shared folder of checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark, records: int = 1000):
    """What is computed inside hands texts to Python in Arrow batches of so many rows: Spark and the worker hold a whole one each, and Spark's usual one has ten times as many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(records, int(before)) if int(before) > 0 else records))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Slots of the bitmap that ``possible_members`` broadcasts: 8 MB, whatever the number of members.
SLOTS = 1 << 26


def possible_members(frame: DataFrame, key: Column, members: Column, table: DataFrame) -> DataFrame:
    """frame with a column __possible: false means that key is null or surely not among the members of table.

    A bitmap of SLOTS bits over hashed keys is built with partial sums and broadcast, 4 KB a row. Its size is
    fixed; with more members than slots it lets more rows through, so a join must still follow.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)) + 1
    bits = table.select(slot(members).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    at = F.bitmap_bit_position(slot(key))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = (F.call_function("shiftright", byte, (at % 8).cast("int")) % 2) == 1
    joined = frame.join(F.broadcast(bits), F.bitmap_bucket_number(slot(key)) == F.col("__bucket"), "left")
    return joined.withColumn("__possible", F.coalesce(held, F.lit(False)) & key.isNotNull()).drop("__bucket", "__bits")


def single_threaded_tokenizers() -> None:
    """Spark runs a task a core; the tokenizers library shall not start threads beside that."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(numbers: str) -> str:
    """SQL of the crc32 of a list of bytes: eight steps of shifting for each."""
    shift = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: {shift}), 4294967295)"
