"""Substring dedup by content-defined chunking.

A gear hash of 16 bits rolls over the UTF-8 bytes of every whole text; a chunk ends, before the start of a character,
where the hash is larger than at the REACH places on either side. So chunks have more than REACH bytes, 2 * REACH on
average, and an end depends on the 16 + REACH bytes before it and the REACH after it only: chunks inside a repeated
passage are the same however much was inserted before it. Chunks that two or more
documents have (by digest) are repeats; runs of neighbouring repeats of enough words are the repeated passages.
Of a document's runs, those stretches are cut whose chunks all have a smaller id's document as their first; a chunk
is never cut in its first document, so nothing is lost from all of them.
A run misses up to a chunk of the passage at either side, so ``min_words`` is set below the length to be found.

Digests are counted with partial sums before any shuffle; the join that marks a document's chunks can be split
by Spark where one chunk is in very many documents; a document's own chunks are the largest group.

Defined results: null and empty texts have no chunks; documents with a null id take no part; rows of one id are
one document; a passage repeated inside one document only is no repeat; ties go to the smallest id, which keeps
its passage; an empty table gives an empty result; extra columns are kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH, MAX = 14, 512
#: Fewest words of a run that is reported: passages of over 50 words less what is lost on either side.
MIN_WORDS = 30
SPANS = "array<struct<start:int,end:int,words:int,first_doc:bigint>>"
CUTS = "array<struct<start:int,end:int>>"


def gear_table(seed: int = 11) -> np.ndarray:
    """A random 16-bit number for each byte but 0."""
    table = np.random.default_rng(seed).integers(0, 1 << 16, 256, np.uint16)
    table[0] = 0
    return table


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last 16 bytes, by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def peaks(h: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places where h is not 0, larger than at the ``reach`` places before and no smaller than at those after."""
    most, width = h, 1
    while 2 * width <= reach:  # most[i] = max of h[i : i + width]
        most, width = np.maximum(most[:-width], most[width:]), 2 * width
    most = np.maximum(most[: len(most) - (reach - width)], most[reach - width :])
    before, after = np.zeros_like(h), np.zeros_like(h)
    before[reach:] = most[: len(h) - reach]
    after[: len(most) - 1] = most[1:]
    return np.flatnonzero((h > before) & (h >= after))


def chunk_ends(raw: bytes, ends: list[int], most: int = MAX) -> list[int]:
    """The chunks' ends of one text, given where the hash has them (ascending); longer stretches are cut by length."""
    out, last, n = [], 0, len(raw)
    for end in [*ends, n]:
        while end - last > most:  # at a character
            last += most
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(index of the text, ends of its chunks, words that begin before each end)."""
    gap = b"\0" * 64
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    h = gear_hashes(data)
    h[data == 0] = 0
    h[:-1][data[1:] & 0xC0 == 0x80] = 0
    at = peaks(h) + 1
    space = (data == 32) | ((data >= 9) & (data <= 13)) | (data == 0)
    begins = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~space[1:] & space[:-1], out=begins[2:])
    start = 64
    for i, raw in enumerate(texts):
        n = len(raw)
        if n:
            lo, hi = np.searchsorted(at, (start + 1, start + n))
            ends = chunk_ends(raw, (at[lo:hi] - start).tolist())
            yield i, ends, begins[np.array(ends) + start] - begins[start]
        start += n + 64


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            ids = batch.column(0).slice(low, 500).to_pylist()
            texts = [t or b"" for t in batch.column(1).slice(low, 500).to_pylist()]
            owners, digests, places = [], [], []
            for i, ends, words in chunks(texts):
                raw, starts = texts[i], [0, *ends[:-1]]
                digests += [digest(raw[a:b]) for a, b in zip(starts, ends)]
                own = np.diff(words, prepend=0)
                # start, length and words in one number, in the order of starts
                places.append((np.array(starts, np.int64) << 24) + ((np.array(ends) - np.array(starts)) << 12) + own)
                owners.append((ids[i], len(ends)))
            doc = np.repeat(np.array([o for o, _ in owners], np.int64), [n for _, n in owners])
            place = np.concatenate(places) if places else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(doc), pa.array(place, pa.int64())], names=["digest", "doc", "place"])


def _runs(min_words: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans: list[list[int]] = []
                others: list[list[list[int]]] = []  # of each span, the stretches that other documents have first
                for x in found:
                    start, size, words = x["place"] >> 24, x["place"] >> 12 & 0xFFF, x["place"] & 0xFFF
                    if spans and spans[-1][1] == start:
                        spans[-1][1] = start + size
                        spans[-1][2] += words
                        spans[-1][3] = min(spans[-1][3], x["first"])
                    elif not spans or spans[-1][1] < start:
                        spans.append([start, start + size, words, x["first"]])
                        others.append([])
                    else:
                        continue
                    if x["first"] != doc:
                        if others[-1] and others[-1][-1][1] == start:
                            others[-1][-1][1] = start + size
                            others[-1][-1][2] += words
                        else:
                            others[-1].append([start, start + size, words])
                cuts = [o for s, own in zip(spans, others) if s[2] >= min_words for o in own if o[2] >= min_words]
                spans = [s for s in spans if s[2] >= min_words]
                if spans:
                    rows.append((doc, [dict(zip(("start", "end", "words", "first_doc"), s)) for s in spans], [dict(zip(("start", "end"), c)) for c in cuts]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("first_doc", pa.int64())]))
            cut = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], cut)], names=["doc_id", "spans", "cuts"])

    return runs


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, spans, cuts) of the documents that have a passage in common with another; start and end are UTF-8 byte offsets.

    first_doc is the smallest id among the documents of the run's chunks. cuts are the stretches of at least
    ``min_words`` words that documents of smaller ids hold; the rest of the run is the copy to keep.
    """
    plain = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.encode(F.col(text_col), "UTF-8").alias("raw"))
    cut = plain.mapInArrow(_chunk_rows, "digest long, doc long, place long")
    held = cut.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeats = held.filter("first != last").select("digest", "first")
    marked = cut.join(repeats, "digest").select("doc", F.struct("place", "first").alias("at"))
    return marked.groupBy("doc").agg(F.sort_array(F.collect_list("at")).alias("found")).mapInArrow(_runs(min_words), f"doc_id long, spans {SPANS}, cuts {CUTS}")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with every repeated passage cut out but in the document of the smallest id; all columns kept."""
    found = repeated_passages(docs, id_col, text_col, min_words).select(F.col("doc_id").alias("__id"), F.col("cuts").alias("__spans"))
    raw = F.encode(F.col(text_col), "UTF-8")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").cast("binary").alias("out"))
    step = lambda t, s: F.struct(s["end"].alias("at"), F.concat(t["out"], F.substring(raw, t["at"] + 1, s["start"] - t["at"])).alias("out"))
    rest = F.aggregate("__spans", zero, step, lambda t: F.concat(t["out"], F.substring(raw, t["at"] + 1, F.length(raw))))
    joined = docs.join(found, F.col(id_col) == F.col("__id"), "left")
    return joined.withColumn(text_col, F.when(F.size("__spans") > 0, F.decode(rest, "UTF-8")).otherwise(F.col(text_col))).select(*docs.columns)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.size("spans").alias("n_passages"), F.aggregate("spans", F.lit(0), lambda t, s: t + s["words"]).alias("n_words"), F.aggregate("cuts", F.lit(0), lambda t, s: t + s["end"] - s["start"]).alias("n_bytes_cut"), "spans")
