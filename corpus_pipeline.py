"""The corpus pipeline: from the table ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet below the shared
folder of spark.checkpoint.dir and hands what it reads back to the next stage, so a lost executor never costs more
than the stage at hand. All stages but the last return the columns of documents.

1. quality rules: documents that they reject go.
2. n-gram Jaccard join (five words, 0.8): one document of each group of linked ones stays.
3. secret scans: every span found is masked, no document goes.
4. mixing sources: a source's documents go or repeat until it meets its target; the rows come in training order.
5. best-fit packing: a row for each piece of a document copy, with its sequence and its place there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from murmur.llm.common import checkpoint_path
from murmur.llm.mixing import mixed_documents
from murmur.llm.ngram_join import one_of_each_group
from murmur.llm.packing import pack_documents
from murmur.llm.quality_rules import keep_quality_documents
from murmur.llm.secrets import redact_secrets


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality_documents(docs)


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def secrets_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scans", secrets_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Token ids, hash samples and the packing's free numbers are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = checkpoint_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
