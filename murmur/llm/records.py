"""Token-ID / binary output: length-delimited binary records with masked checksums and an offset index.

One record, all numbers little-endian:

    u64  length of the payload
    u32  masked CRC-32 of those 8 bytes
    payload: i64 document id, u8 1 if that id is null, u8 bytes of a token id (2 or 4), the token ids
    u32  masked CRC-32 of the payload
    u8   0x0A, the end of the record

The mask rotates a checksum right by 15 bits and adds 0xA282EAD8, as files of records usually do, so that a
checksum of data which holds checksums is no weaker.

Spark's text writer writes the records: it puts a string's bytes and one line end into the file as they are.
So the files go through Spark's commit protocol to any store that Spark reaches, and lost executors or repeated
tasks leave no half files. Documents are range-partitioned and sorted by id; the numbers in file names follow the
ranges. The number of files grows with the bytes of the texts; where one id (or null) has more rows than a file, its
rows are spread over neighbouring files by a hash of the text.

Defined results: a null text is an empty one (its record has the end id only); null ids come first; repeated
ids are kept, each with a record; an empty table writes no records; extra columns are not written.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.llm.common import checkpoint_path
from murmur.llm.tokens import encoder

_LENGTH, _CHECK, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")
END = b"\n"
#: Bytes of text that a file is meant to hold; reading files back whole is limited to 2 GB.
FILE_BYTES = 64 << 20
#: One row a record, as read back; local_start counts the ids of the records before it in its file.
RECORD = "file string, offset long, size long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, width: int, ids: bytes) -> bytes:
    """A record but for its last byte, which the text writer adds."""
    payload = _HEAD.pack(doc_id or 0, doc_id is None, width) + ids
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CHECK.pack(masked(length)), payload, _CHECK.pack(masked(payload))))


def unframe(data, at: int = 0) -> tuple[int | None, int, memoryview, int]:
    """(id, width, ids, where the next record begins); a damaged record raises ValueError."""
    view = memoryview(data)
    length = view[at : at + 8]
    if len(length) < 8 or at + 12 > len(view) or _CHECK.unpack(view[at + 8 : at + 12])[0] != masked(length):
        raise ValueError(f"damaged length at byte {at}")
    end = at + 12 + _LENGTH.unpack(length)[0]
    if end + 5 > len(view) or view[end + 4 : end + 5] != END or _CHECK.unpack(view[end : end + 4])[0] != masked(view[at + 12 : end]):
        raise ValueError(f"damaged record at byte {at}")
    doc_id, null, width = _HEAD.unpack(view[at + 12 : at + 22])
    return None if null else doc_id, width, view[at + 22 : end], end + 5


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> None:
    """Encode every whole text, append end_id, and write the records in ascending order of id below path."""
    last = end_id.to_bytes(width, "little")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path, width)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 1000):
                part = [frame(i, width, tokens.encode(t or "") + last) for i, t in zip(ids[at : at + 1000], texts.slice(at, 1000).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["record"])
            tokens.forget()

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    in_order = plain.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id")
    in_order.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_records(spark, path: str) -> DataFrame:
    """One row a record (RECORD), with every checksum verified; ids_crc32 is over the ids as unsigned 32-bit integers."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, start, rows = content.as_buffer(), 0, 0, []
                data = memoryview(data)
                while at < len(data):
                    doc_id, width, ids, after = unframe(data, at)
                    wide = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4")
                    n = len(ids) // width
                    rows.append((file, at, after - at, doc_id, start, n, zlib.crc32(wide)))
                    at, start = after, start + n
                types = [pa.string()] + [pa.int64()] * 6
                columns = list(zip(*rows)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in RECORD.split(", ")])

    return spark.read.format("binaryFile").load(f"{path}/part-*").select("path", "content").mapInArrow(parsed, RECORD)


def write_index(spark, path: str) -> DataFrame:
    """Write the offset index of the record files beside them and return it: RECORD and start, the ids of all records before.

    Sums over files are one row a file; positions inside a file come from its reading.
    """
    records = read_records(spark, path)
    records.write.parquet(f"{path}-offsets")
    offsets = spark.read.parquet(f"{path}-offsets")
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    by_file = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    files = offsets.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    before = files.select("file", (F.sum("in_file").over(by_file) - F.col("in_file")).alias("before"))
    return offsets.join(before, "file").withColumn("start", F.col("before") + F.col("local_start")).drop("before", "local_start")


def shuffled_records(index: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, ids) of all records of an index in a seeded random order, each read by its offset alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            out: list = [None] * len(rows)
            handle, current = None, None
            for i in sorted(range(len(rows)), key=lambda i: rows[i][:2]):  # a file at a time
                file, offset, size = rows[i]
                if file != current:
                    store, name = fs.FileSystem.from_uri(file.replace("file:///", "file:/").replace("file:/", "file:///"))
                    handle, current = store.open_input_file(name), file
                doc_id, width, ids, _ = unframe(handle.read_at(size, offset))
                out[i] = (doc_id, [int.from_bytes(ids[k : k + width], "little") for k in range(0, len(ids), width)])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    turn = F.xxhash64(F.lit(seed), F.col("file"), F.col("offset"))
    return index.select("file", "offset", "size", turn.alias("turn")).orderBy("turn", "file", "offset").select("file", "offset", "size").mapInArrow(read, "doc_id long, ids array<long>")


def op4_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = checkpoint_path(spark, f"records-{uuid.uuid4().hex}")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return write_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "size")
