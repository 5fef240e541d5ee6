"""Quality rules: repetition coverage.

Every text is read once, whole, inside ``mapInArrow``; nothing is shuffled. Rolling hashes of several
n-gram lengths, in numpy, tell which n-grams occur again in the same text; the verdict holds the share of
characters inside duplicated n-grams and duplicated lines against limits for each length.

Defined results: a null or empty text has no words and fails the base rule; ties and repeated rows are
judged row by row; extra columns of the input are not touched (``quality_rules``) or kept
(``keep_quality_documents``); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import WORD_BREAKS, WordHashes, ngram_hashes

SYMBOLS = "#*$%&|<>"
#: n-gram length -> largest share of a text's word characters inside n-grams that occur twice or more.
DUPLICATE_LIMITS = {5: 0.30, 6: 0.28, 8: 0.25, 10: 0.22}
#: Largest share of word characters inside lines equal to another line of the text.
LINE_LIMIT = 0.30
#: Largest number of symbols for each word.
SYMBOL_LIMIT = 0.10
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, dup_ngram_share double, symbol_share double, base_failed boolean, kept boolean"


def repeated_windows(hashes: np.ndarray) -> np.ndarray:
    """Whether each window's hash occurs twice or more."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(hashes), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Whether each of ``length`` words lies in a window of n words that begins where ``starts`` is true."""
    edges = np.zeros(length + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None, hashes: WordHashes, limits: dict[int, float] = DUPLICATE_LIMITS) -> tuple:
    """The row of MEASURES of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, WORD_BREAKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines: dict[bytes, int] = {}
    for line in raw.split(b"\n"):
        if line.strip():
            lines[line] = lines.get(line, 0) + 1
    dup_lines = sum(lines.values()) - len(lines)
    line_chars = sum(c * len(b"".join(x.split()).decode()) for x, c in lines.items() if c > 1)
    repeat, share = 0, 0.0
    if n >= 3:
        ids = hashes.of(words)
        again = repeated_windows(ngram_hashes(ids, 3))
        if again.any():
            repeat = int(covered(again, 3, n).sum())
            sizes = np.fromiter((len(w.decode()) for w in words), np.int32, n)
            for k, most in limits.items():
                if k > n:
                    break
                # an n-gram that occurs again has 3-grams that occur again all along it
                inside = np.convolve(again, np.ones(k - 2, np.int32), "valid") == k - 2
                at = np.flatnonzero(inside)
                if not len(at):
                    break
                starts = np.zeros(n - k + 1, bool)
                starts[at[repeated_windows(ngram_hashes(ids, k)[at])]] = True
                share = max(share, float(sizes[covered(starts, k, n)].sum()) / word_chars / most)
    line_share = line_chars / word_chars if word_chars else 0.0
    symbol_share = symbols / n if n else 0.0
    base_failed = n < 50 or 100 * repeat > 50 * n
    kept = not base_failed and share <= 1 and line_share <= LINE_LIMIT and symbol_share <= SYMBOL_LIMIT
    return n, word_chars, symbols, dup_lines, repeat, line_share, share, symbol_share, base_failed, kept


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = [measure(t, hashes) for t in batch.column(batch.num_columns - 1).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 10
        types = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.bool_()] * 2
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        arrays = kept + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        names = batch.schema.names[:-1] + [x.split()[0] for x in MEASURES.split(", ")]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and the MEASURES. ``dup_ngram_share`` is the largest share over its length's limit."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measured, f"doc_id {kind}, {MEASURES}")


def keep_quality_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns as they were."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([measure(t, hashes)[-1] for t in texts], pa.bool_()))

    return docs.mapInArrow(passing, docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
