"""op4 and op6 against the tokenizers library on whole texts; files round-trip."""

import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from murmur.llm.packing import best_fit, op6_best_fit_packing, pack_documents, pack_pieces
from murmur.llm.records import frame, op4_token_records, read_records, shuffled_records, unframe, write_index, write_records
from murmur.llm.tokens import TextEncoder

WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json"


def whole(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("name", [WORD_FILE, BYTE_FILE])
def test_encoder_equals_the_library(name, rows, edge_rows):
    ids, tokens = whole(name), TextEncoder(public_tokenizers.path(name))
    awkward = ["a  b", " a", "a ", "\n\n a\t\tb", "don't can't I'LL we've", "x1y2", "a b", "a b", "İstanbul ſ ß", "<|endoftext|> x</w>", "é 가", "日本語 テキスト", "a\x85b", "﻿x", "...!!!", "12345 67", "\U0001f600 ok", "_a_b", "a’s ‘b’"]
    for text in awkward + [r["text"] for r in rows + edge_rows]:
        assert [x[0] for x in struct.iter_unpack("<I", tokens.encode(text or ""))] == ids(text)[:-1]


def test_token_records_match_brute_force(spark, sf, rows):
    ids, start = whole(WORD_FILE), 0
    got = {r["doc_id"]: r for r in op4_token_records(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        own, mine = ids(r["text"]), got[r["doc_id"]]
        assert (mine["start"], mine["n_tokens"], mine["ids_crc32"]) == (start, len(own), crc(own))
        start += len(own)


def test_records_round_trip_and_shuffle(edge, edge_rows, spark, tmp_path):
    path = str(tmp_path / "records")
    write_records(edge, path, public_tokenizers.path(WORD_FILE), 2)
    index = write_index(spark, path)
    ids = whole(WORD_FILE)
    want = sorted(((r["doc_id"], ids(r["text"])) for r in edge_rows), key=lambda x: (x[0] is not None, x[0], x[1]))
    by_id = lambda x: (x[0] is not None, x[0] or 0, x[1])
    got = [(r["doc_id"], list(r["ids"])) for r in shuffled_records(index, seed=4).collect()]
    assert sorted(got, key=by_id) == sorted(want, key=by_id)
    assert got != sorted(got, key=by_id)
    placed = sorted(index.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in placed] == [x[0] for x in want]
    assert [r["start"] for r in placed] == [sum(len(x[1]) for x in want[:i]) if not (want[i][0] is None or i and want[i - 1][0] == want[i][0]) else placed[i]["start"] for i in range(len(want))]


def test_damage_is_seen():
    data = frame(5, 2, b"\1\0\2\0") + b"\n"
    assert unframe(data)[:2] == (5, 2) and bytes(unframe(data)[2]) == b"\1\0\2\0"
    for i in range(len(data)):
        with pytest.raises(ValueError):
            unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
        with pytest.raises(ValueError):
            unframe(data[:i])


def test_records_of_an_empty_table(empty, spark, tmp_path):
    write_records(empty, str(tmp_path / "none"), public_tokenizers.path(WORD_FILE), 2)
    assert read_records(spark, str(tmp_path / "none")).count() == 0


def check_packing(got, data, capacity=1024):
    ids = whole(BYTE_FILE)
    want = defaultdict(list)
    for doc_id, text in data:
        own = ids(text)
        first = len(own) % capacity or capacity
        cuts = [0, *range(first, len(own) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id].append((k, a, b - a, crc(own[a:b])))
    mine = defaultdict(list)
    places = defaultdict(list)
    for r in got:
        mine[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= capacity
    return len(places), sum(n for p in places.values() for _, n in p)


def test_packing_matches_brute_force(spark, sf, rows):
    bins, tokens = check_packing(op6_best_fit_packing(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in rows])
    assert bins <= -(-tokens // 1024) * 1.02 + 1


def test_packing_edges(edge, edge_rows, empty):
    path = public_tokenizers.path(BYTE_FILE)
    check_packing(pack_documents(edge, path).collect(), [(r["doc_id"], r["text"]) for r in edge_rows])
    assert pack_documents(empty, path).count() == 0


def test_rounds_merge_what_is_left(spark):
    """Small chunks force several rounds; the bins are nearly as few as in one best-fit pass."""
    import random

    rng = random.Random(2)
    sizes = [rng.choice((rng.randint(1, 300), rng.randint(300, 1023))) for _ in range(4000)]
    frame = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    got = pack_pieces(frame, chunk=300).collect()
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in got) == list(range(4000))
    assert all(sum(n for _, n in p) <= 1024 for p in places.values())
    assert len(places) <= 1.02 * len(best_fit(sizes))


def test_texts_come_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            assert batch.num_rows <= 1000
            yield batch

    pieces = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "id % 9 + 1 AS length", "0L AS ids_crc32")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pack_pieces(pieces.mapInArrow(sizes, "doc_id long, piece int, start long, length long, ids_crc32 long")).count() == 3000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
