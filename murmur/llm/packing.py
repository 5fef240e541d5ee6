"""Best-fit packing, hierarchical over what does not fill up.

Texts are cut into pieces of at most a sequence's length; full pieces are sequences. The others are packed by
best fit inside each partition, in chunks of a bounded number of items. Nearly full bins are done; the others
are the items of the next round, over an eighth of the partitions, but no fewer than hold a chunk each. The rounds
end with one partition, or when another round no longer makes fewer bins of them (pieces of more than half a sequence
fit nowhere together), so what is left over never has to pass through one task. A round's items are ids and lengths;
tokens never move. Rounds are checkpointed, so each item is packed once.

Defined results: a null or empty text is its end id alone; repeated rows are packed as rows of their own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import checkpoint, small_batches
from murmur.llm.tokens import encoder

CAPACITY = 1024
#: A bin with no more than this left is done before the last round.
SLACK = 2
#: Items that one best-fit pass holds in memory.
CHUNK = 250_000
#: A round that leaves more than this share of the unfinished bins before it is the last one.
STALLED = 0.97
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIN = "fill int, items array<long>, lengths array<int>"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a piece (PIECE). A text of more than capacity tokens has full pieces after a first one that may be shorter."""
    last = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            ids_of = batch.column(0).to_pylist()
            for at in range(0, len(ids_of), 1000):
                for doc_id, text in zip(ids_of[at : at + 1000], batch.column(1).slice(at, 1000).to_pylist()):
                    ids = tokens.encode(text or "") + last
                    n = len(ids) // 4
                    start, length, piece = 0, n % capacity or capacity, 0
                    while start < n:
                        rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start, length, piece = start + length, capacity, piece + 1
            tokens.forget()
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=[x.split()[0] for x in PIECE.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECE)


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of the indices of sizes: largest first, each into the fullest bin that has room."""
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: a bin with r left
    bins = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        above = free >> size
        if above:
            left = size + (above & -above).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            left, chosen = capacity, []
            bins.append(chosen)
        chosen.append(i)
        left -= size
        if left:
            room[left].append(chosen)
            free |= 1 << left
    return bins


def _packed(capacity: int, chunk: int):
    names, types = [x.split()[0] for x in BIN.split(", ")], (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))

    def pack(fills: list, items: list, lengths: list) -> pa.RecordBatch:
        bins = best_fit(fills, capacity)
        columns = (
            [sum(fills[i] for i in b) for b in bins],
            [[x for i in b for x in items[i]] for b in bins],
            [[x for i in b for x in lengths[i]] for b in bins],
        )
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills, items, lengths = [], [], []
        for batch in batches:
            for held, column in zip((fills, items, lengths), batch.columns):
                held.extend(column.to_pylist())
            while len(fills) >= chunk:
                yield pack(fills[:chunk], items[:chunk], lengths[:chunk])
                fills, items, lengths = fills[chunk:], items[chunk:], lengths[chunk:]
        if fills:
            yield pack(fills, items, lengths)

    return packed


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, chunk: int = CHUNK) -> DataFrame:
    """PIECE rows -> the same with sequence_id and offset. Reads its input once."""
    with small_batches(pieces.sparkSession):
        pieces = checkpoint(pieces.withColumn("item", F.monotonically_increasing_id()))
    full = pieces.filter(F.col("length") == capacity).select("*", (F.col("item") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).select(F.col("length").cast("int").alias("fill"), F.array("item").alias("items"), F.array(F.col("length").cast("int")).alias("lengths"))
    before = rest.count()
    parts = max(1, -(-before // chunk))
    open_bins, done = rest.repartition(parts), None
    while True:
        packed = checkpoint(open_bins.mapInArrow(_packed(capacity, chunk), BIN))
        left = packed.filter(F.col("fill") < capacity - slack)
        n_left = left.count() if parts > 1 else 0
        after = max(-(-parts // 8), -(-n_left // chunk))
        last = parts == 1 or (after >= parts and n_left > STALLED * before)
        ready = packed if last else packed.filter(F.col("fill") >= capacity - slack)
        done = ready if done is None else done.unionByName(ready)
        if last:
            break
        before, parts = n_left, after
        open_bins = left.repartition(parts)
    offsets = F.transform(F.sequence(F.lit(0), F.size("lengths") - 1), lambda k: F.aggregate(F.slice("lengths", F.lit(1), k), F.lit(0), lambda s, x: s + x))
    # a bin's first item names it: items are in one bin each
    places = done.select((F.col("items")[0] * 2 + 1).alias("sequence_id"), F.explode(F.arrays_zip("items", offsets.alias("offsets"))).alias("at"))
    places = places.select("sequence_id", F.col("at.items").alias("item"), F.col("at.offsets").cast("long").alias("offset"))
    return full.unionByName(pieces.filter(F.col("length") < capacity).join(places, "item")).drop("item")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    return pack_pieces(token_pieces(docs, tokenizer_path, end_id, id_col, text_col, capacity), capacity, **options)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
