"""Decontamination, Merkle manifest and spelling variants against brute force, SQL and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murmur.llm import manifest
from murmur.llm.decontamination import OP11_SQL, contaminated_documents, op11_decontamination
from murmur.llm.manifest import OP12_SQL, op12_merkle_manifest
from murmur.llm.variants import OP13_SQL, near_pairs, op13_spelling_variants, spelling_variants, word_counts

UPPER = {c: c + 32 for c in range(65, 91)}


def same_as_sql(frame, sql, duck):
    relation = duck.sql(sql)
    assert sorted(relation.columns) == sorted(frame.columns)
    columns = sorted(frame.columns)
    at = [relation.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr) and got


# --- decontamination ---


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_hits(docs, items, window=10):
    patterns = []
    for item, text in items:
        w = split(text)
        patterns += [(item, tuple(w[i : i + window])) for i in range(max(len(w) - window, 0) + 1)] if w else []
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for item, p in patterns:
            for i in range(len(w) - len(p) + 1):
                if w[i] == p[0] and tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=repr)


def got_hits(frame):
    return sorted(((r["doc_id"], r["n_words"], tuple(i for h in r["hits"] for i in range(h["first"], h["last"] + 1)), tuple(r["items"])) for r in frame.collect()), key=repr)


ITEMS = [(1, "one"), (2, "alpha1 beta7! ALPHA2 beta1"), (3, None), (4, " .,- "), (5, " ".join(f"word{i % 9973} item{i}" for i in range(100, 130))), (None, "tail"), (10, "Ärger über Straße"), (10, "b c"), (11, "b c"), (12, "x x x")]


@pytest.mark.parametrize("part_words", [1_000_000, 20])
def test_hits_equal_brute_force(spark, edge, edge_rows, part_words):
    extra = [(500, "Der ÄRGER über Straße, Ärger über Straße."), (501, "alpha1 beta7 alpha1 beta7 alpha2 beta1"), (502, "a B-c d"), (503, "\U0001d400 tail \U0001d401")]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_hits([(r["doc_id"], r["text"]) for r in edge_rows] + extra, ITEMS)
    assert got_hits(contaminated_documents(docs, items, part_words=part_words)) == want and any(w[2] for w in want)


def test_hits_carry_offsets_of_the_original(spark):
    docs = spark.createDataFrame([(1, "\U0001f600 So: The—QUICK (brown) fox...")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "quick brown")], "item_id string, text string")
    # a dash that is no ASCII character is part of a word
    assert contaminated_documents(docs, items).collect()[0]["hits"] == []
    items = spark.createDataFrame([("q", "the—quick brown")], "item_id string, text string")
    hit = contaminated_documents(docs, items).collect()[0]["hits"][0]
    assert "\U0001f600 So: The—QUICK (brown) fox..."[hit["start"] : hit["end"]] == "The—QUICK (brown"


def test_a_long_item_is_cut_without_losing_windows(spark, monkeypatch):
    from murmur.llm import decontamination

    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    words = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(["junk", *words[i : i + 10 + i % 3], "junk"])) for i in range(90)]
    items = [(1, " ".join(words)), (2, " ".join(words[40:52]))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for part_words in (1_000_000, 30):
        assert got_hits(contaminated_documents(*frames, part_words=part_words)) == brute_hits(docs, items)


def test_decontamination_of_empty_tables(spark, empty, edge):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated_documents(empty, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []
    assert not any(r["hits"] for r in contaminated_documents(edge, none).collect())


def test_op11_equals_sql(spark, sf, duck):
    same_as_sql(op11_decontamination(spark, sf), OP11_SQL, duck)


# --- manifest ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, change=False):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"] and r["text"].translate(UPPER) if change else r["text"]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, i, leaf):
    beside = []
    for level in levels[:-1]:
        run = list(level[i // 16 * 16 : i // 16 * 16 + 16])
        beside += [d for k, d in enumerate(run) if k != i % 16]
        run[i % 16] = leaf
        leaf, i = h(*run), i // 16
    return leaf, beside


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(trees[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r))) for s in names}
    levels = {s: grow([brute_leaf(r) for r in leaves[s]]) for s in names}
    last = grow([levels[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(leaves[s]):
            change = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            below, beside = climb(levels[s], i, brute_leaf(r, change))
            root, above = climb(last, k, below)
            out.append((r["doc_id"], brute_leaf(r), levels[s][-1][0], last[-1][0], h(*beside, *above), root, root == last[-1][0]))
    return sorted(out, key=repr)


def got_manifest(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op12_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_manifest_of_edge_cases(spark, edge, edge_rows, tmp_path):
    got = got_manifest(spark, edge, tmp_path)
    assert got == brute_manifest(edge_rows) and {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("n, fan", [(1, 4096), (2, 4096), (17, 4096), (300, 2), (5000, 16)])
def test_manifest_of_trees_of_several_levels(spark, tmp_path, monkeypatch, n, fan):
    monkeypatch.setattr(manifest, "FAN", fan)
    rows = [dict(doc_id=i * 7919 % 100_003, text=f"Text {i}", lang=None, source=None if n > 2 and i % 50 == 0 else f"s{i % 20 if i % 3 else 0}", n_chars=i) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got_manifest(spark, frame, tmp_path) == brute_manifest(rows)


def test_manifest_of_an_empty_table(spark, empty, tmp_path):
    assert got_manifest(spark, empty, tmp_path) == []


def test_proofs_of_the_general_interface(spark, edge):
    rows = manifest.manifest(edge, ["doc_id", "text"]).withColumn("folded", manifest.fold(F.col("leaf"), F.col("path")))
    assert rows.filter("folded = root").count() == edge.count() and rows.select("root").distinct().count() == 1


def test_op12_equals_sql(spark, sf, duck):
    same_as_sql(op12_merkle_manifest(spark, sf), OP12_SQL, duck)


# --- variants ---


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            x = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if x % 97 == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(words):
    close = {w: [o for o in words if near(w, o)] for w in words}
    best = {w: min(c, key=lambda o: (-words[o], o)) for w, c in close.items() if c}
    form = {w: o if words[o] >= 2 * words[w] else None for w, o in best.items()}
    out = []
    for w, n in words.items():
        root = w
        while form.get(root):
            root = form[root]
        out.append((w, n, len(close[w]), form.get(w), words[form[w]] if form.get(w) else None, root))
    return sorted(out, key=repr)


def got_variants(frame):
    return sorted(((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect()), key=repr)


def test_variants_equal_brute_force(spark, edge, edge_rows):
    rng = random.Random(3)
    base = ["".join(rng.choice("aeinrstäéß") for _ in range(rng.randint(5, 9))) for _ in range(12)]
    texts = []
    for i in range(400):
        w = rng.choice(base)
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            p, c = rng.randrange(len(w) + 1), rng.choice("aeinrstäéßÉ")
            w = rng.choice((w[:p] + c + w[p:], w[:p] + w[p + 1 :], w[:p] + c + w[p + 1 :]))
        texts.append((i % 90, f"{w.title()}, {w} {w.upper()}-{w}"))
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    words = brute_words([(r["doc_id"], r["text"]) for r in edge_rows] + texts)
    counted = word_counts(docs)
    assert {r["word"]: r["n"] for r in counted.collect()} == words
    got = got_variants(spelling_variants(counted))
    assert got == brute_variants(words) and any(x[3] for x in got) and any(x[5] != x[3] and x[3] for x in got)


def test_every_near_pair_is_found_once(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(5, 7))) for _ in range(700)})
    found = [tuple(sorted((r["word_a"], r["word_b"]))) for r in near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()]
    assert sorted(found) == [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)]


def test_variants_of_chains_and_ties(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "aaaac": 6, "zzzzz": 5}
    got = got_variants(spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_variants(words) and dict((x[0], x[5]) for x in got)["aaaaa"] == "abbbb"


def test_variants_of_an_empty_table(spark, empty):
    assert spelling_variants(word_counts(empty)).collect() == []


def test_op13_equals_sql(spark, sf, duck):
    same_as_sql(op13_spelling_variants(spark, sf), OP13_SQL, duck)
