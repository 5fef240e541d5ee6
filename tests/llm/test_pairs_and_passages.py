"""op1, op2 and op3 against brute force."""

import math
import re

import numpy as np
import pytest

from murmur.llm import ann
from murmur.llm.ngram_join import ngram_jaccard_join, one_of_each_group, op2_ngram_join
from murmur.llm.substring_dedup import MIN_WORDS, op3_substring_dedup, repeated_passages, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(data, n, percent):
    """[(id, text)] -> [(id, set size, smallest id linked)], rows one by one."""
    sets = [shingle_set(t, n) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(data):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), math.inf))
    return sorted(((d, len(s), least.get(find(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(data, sets))), key=str)


def test_join_matches_brute_force(spark, sf, rows):
    got = op2_ngram_join(spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == components([(r["doc_id"], r["text"]) for r in rows], 4, 85)


def test_join_of_chains_hubs_and_near_misses(spark):
    rng = np.random.default_rng(5)
    data = []
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    for i in range(60):  # a chain: each differs a little from the one before
        base = base.copy()
        base[int(rng.integers(0, 300))] = f"new{i}"
        data.append((i, " ".join(base)))
    for i in range(40):  # texts about the threshold
        other = [f"v{x}" for x in rng.integers(0, 5000, 100 + i)]
        changed = other.copy()
        for at in rng.choice(len(changed), 1 + i % 5, replace=False):
            changed[at] = "changed"
        data += [(1000 + 2 * i, " ".join(other)), (1001 + 2 * i, " ".join(changed))]
    data += [(5000 + i, "a b c d e f g h " + "z " * (i % 9)) for i in range(30)]
    for n, percent in ((4, 85), (5, 80), (3, 50)):
        got = ngram_jaccard_join(spark.createDataFrame(data, "doc_id long, text string").repartition(3), n, percent).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == components(data, n, percent)


def test_join_edges(edge, edge_rows, empty):
    got = ngram_jaccard_join(edge, 4, 85).collect()
    want = components([(r["doc_id"], r["text"]) for r in edge_rows], 4, 85)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"] if r["doc_id"] is not None else None) for r in got), key=str) == want
    kept = one_of_each_group(edge)
    assert kept.columns == edge.columns
    want = components([(r["doc_id"], r["text"]) for r in edge_rows], 5, 80)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({d for d, _, c in want if d is not None and d == c})
    assert ids.count(None) == 2
    assert ngram_jaccard_join(empty).count() == 0 and one_of_each_group(empty).count() == 0


def test_join_of_rows_without_ids(spark):
    """Many rows with a null id and different texts: they take part without meeting each other by that id."""
    rng = np.random.default_rng(9)
    data = [(None, " ".join(f"w{x}" for x in rng.integers(0, 9000, 60))) for _ in range(2000)]
    data += [(i, data[i][1]) for i in range(50)] + [(None, data[0][1] + " more")]
    got = ngram_jaccard_join(spark.createDataFrame(data, "doc_id long, text string").repartition(5), 4, 85).collect()
    assert len(got) == len(data)
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in got if r["doc_id"] is not None} == {(i, i, int(i == 0)) for i in range(50)}


def test_join_of_a_large_cluster(spark):
    """A cluster of several row blocks: links between blocks count, and exact copies take part once."""
    rng = np.random.default_rng(10)
    base = [f"w{x}" for x in rng.integers(0, 5000, 160)]
    data = []
    for i in range(2300):
        text = base.copy()
        text[i % 160] = f"new{i // 160}"
        data.append((i, " ".join(text)))
    data += [(5000 + i, data[i % 7][1]) for i in range(700)] + [(9000, " ".join(base[:40]))]
    got = {r["doc_id"]: r for r in ngram_jaccard_join(spark.createDataFrame(data, "doc_id long, text string").repartition(6), 4, 85).collect()}
    sets = {i: shingle_set(data[i][1], 4) for i in (0, 1, 161, 2299)}
    for i, mine in sets.items():
        links = sum(100 * len(mine & o) >= 85 * len(mine | o) for j, o in ((j, shingle_set(data[j][1], 4)) for j in range(2300)) if j != i)
        assert got[i]["n_links"] == links > 1000
    assert {got[i]["component_id"] for i in (*range(2300), *range(5000, 5700))} == {0} and got[9000]["component_id"] == 9000


def nearest(vectors, queries, k):
    out = {}
    for q in queries:
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(vectors[q], v))), i) for i, v in vectors.items() if i != q)
        out[q] = d[:k]
    return out


def test_search_recall(spark, sf):
    vectors = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = nearest(vectors, [i for i in vectors if i % 100 == 0], 10)
    got = {}
    for r in sorted(ann.op1_nearest_neighbours(spark, sf).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == pytest.approx(math.dist(vectors[r["query_id"]], vectors[r["vec_id"]]), rel=1e-12)
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(got) == set(want)
    assert all(len(g) == 10 and g == sorted(g) for g in got.values())
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_search_recall_in_a_hot_group(spark):
    """Copies and near copies of one vector, more than are reranked: their codes do not tell them apart."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[:1500] = x[0] + 0.001 * rng.normal(size=(1500, 16))
    x[1500:2500] = x[1500]
    ids = rng.permutation(6000)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    index, books = ann.build_index(frame, "vec_id", "embedding", sample=2000, books=4, words=64)
    index = ann.checkpoint(index)
    asked = [int(ids[i]) for i in (*range(0, 1500, 100), *range(1500, 2500, 100), *range(2500, 6000, 300))]
    got = {}
    for r in ann.search(index, books, index.filter(ann.F.col("id").isin(asked)).select("id", "vector")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    exact = x.astype(np.float64)
    hits = []
    for q in asked:
        far = np.sqrt(((exact - exact[ids == q]) ** 2).sum(1))
        want = [int(i) for i in ids[np.lexsort((ids, far))] if i != q][:10]
        hits.append(len(set(want) & set(got[q].values())))
    assert min(hits[:15]) >= 9 and sum(hits[:15]) >= 148  # near copies
    assert hits[15:25] == [10] * 10  # copies: the smallest ids
    assert sum(hits[25:]) >= 0.9 * 10 * len(hits[25:])


def test_search_recall_where_few_rows_are_reranked(spark):
    """640 of 20,000 rows are ranked exactly; the others are left out by their codes."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 32)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    index, books = ann.build_index(frame, "vec_id", "embedding", sample=4000)
    index = ann.checkpoint(index)
    got = {}
    for r in ann.search(index, books, index.filter("id % 500 = 0").select("id", "vector")).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    exact, hits = x.astype(np.float64), 0
    for q in range(0, 20_000, 500):
        far = ((exact - exact[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & got[q])
    assert len(got) == 40 and hits >= 0.9 * 400


def test_search_of_repeated_ids(spark):
    """An id counts once, with the smallest of its vectors; rows without an id take no part."""
    data = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [1.0, 2.5]), (7, [9.0, 9.0]), (7, [1.0, 2.5]), (8, [1.0, 4.0]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    index, books = ann.build_index(frame, "vec_id", "embedding")
    got = ann.search(index, books, index.filter("id = 100").select("id", "vector")).collect()
    assert sorted((r["rank"], r["id"], r["score"]) for r in got) == [(1, 7, 0.5), (2, 8, 2.0)]


def test_search_of_many_equal_vectors(spark):
    """Ties go to the smaller ids, however the rows are dealt."""
    for parts in (3, 7):
        frame = spark.range(1, 5001).selectExpr("id AS vec_id", "array(1F, 2F, 3F) AS embedding").repartition(parts)
        index, books = ann.build_index(frame, "vec_id", "embedding", sample=300, books=2)
        index = ann.checkpoint(index)
        got = sorted((r["rank"], r["id"]) for r in ann.search(index, books, index.filter("id = 100").select("id", "vector")).collect())
        assert got == [(i, i) for i in range(1, 11)]


def test_search_edges(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0])]
    good = [(100, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [3.0, 4.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in bad + good], "vec_id long, embedding array<float>, rank int, codes string")
    index, books = ann.build_index(frame, "vec_id", "embedding")
    got = ann.search(index, books, index.filter("id = 100").select("id", "vector")).collect()
    assert [(r["rank"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 7), (2, 8), (3, 9)]
    none, books = ann.build_index(frame.limit(0), "vec_id", "embedding")
    assert books is None and ann.search(none, books, none.select("id", "vector")).count() == 0


def windows(text, n):
    words = (text or "").split()
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_passages_match_brute_force(spark, sf, rows):
    got = {r["doc_id"]: r["spans"] for r in op3_substring_dedup(spark, sf).collect()}
    for n, every in ((51, True), (MIN_WORDS - 12, False)):
        owners = {}
        for r in rows:
            for w in set(windows(r["text"], n)):
                owners.setdefault(w, set()).add(r["doc_id"])
        shared = {d for o in owners.values() if len(o) > 1 for d in o}
        if every:
            assert len(shared) > 10 and shared <= set(got)
        else:
            assert set(got) <= shared  # a document without any common passage is left alone
    texts = {r["doc_id"]: r["text"].encode() for r in rows if r["text"]}
    for doc, spans in list(got.items())[:50]:
        for s in spans:  # the words are really in another document as well
            part = texts[doc][s["start"] : s["end"]]
            assert len(part.split()) >= s["words"] - 1
            middle = b" ".join(part.split()[8:16])
            assert any(middle in b" ".join(t.split()) for d, t in texts.items() if d != doc)


def test_passages_resist_insertions(spark):
    rng = np.random.default_rng(1)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 90_000, n))
    passage = words(80)
    data = [(i, f"{words(40 + 3 * i)} {passage} {words(30 + i)}") for i in range(12)] + [(100 + i, words(200)) for i in range(12)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in repeated_passages(frame).collect()}
    assert set(got) == set(range(12))
    out = {r["doc_id"]: r["text"] for r in without_repeats(frame).collect()}
    core = " ".join(passage.split()[15:-15])
    assert core in out[0] and not any(core in out[i] for i in range(1, 12))
    assert all(out[100 + i] == data[12 + i][1] for i in range(12))


def test_short_passages_are_found_wherever_they_begin(spark):
    """Passages of 51 words in two documents each, at many offsets."""
    rng = np.random.default_rng(12)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 10))))) for _ in range(n))
    data = []
    for i in range(400):
        passage = words(51)
        data += [(2 * i + k, f"{words(int(rng.integers(3, 60)))} {passage} {words(int(rng.integers(3, 60)))}") for k in (0, 1)]
    data += [(5000 + i, words(100)) for i in range(100)]
    got = {r["doc_id"] for r in repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert len(got) >= 796 and max(got) < 800


def test_adjoining_passages_stay_somewhere(spark):
    """Q is first in document 5, P beside it in document 10: both stay in one document each."""
    rng = np.random.default_rng(6)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 90_000, n))
    q, p = words(120), words(120)
    data = [(5, f"{words(40)} {q} {words(40)}"), (10, f"{words(40)} {q} {p} {words(40)}"), (20, f"{words(40)} {q} {p} {words(40)}")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in without_repeats(frame).collect()}
    core = lambda x: " ".join(x.split()[30:-30])
    assert [d for d in (5, 10, 20) if core(q) in out[d]] == [5]
    assert [d for d in (5, 10, 20) if core(p) in out[d]] == [10]
    spans = {r["doc_id"]: r["spans"] for r in repeated_passages(frame).collect()}
    assert [len(spans[d]) for d in (5, 10, 20)] == [1, 1, 1] and spans[10][0]["first_doc"] == 5


def test_passages_edges(edge, edge_rows, empty):
    got = without_repeats(edge)
    assert got.columns == edge.columns
    out = got.collect()
    assert len(out) == len(edge_rows)
    for r in out:
        source = next(x for x in edge_rows if x["doc_id"] == r["doc_id"] and (x["text"] is None) == (r["text"] is None))
        if r["doc_id"] in (None, 0, 1, 3, 5, 9):
            assert r["text"] == source["text"]
    assert next(r for r in out if r["doc_id"] == 10)["text"].endswith("more")
    assert repeated_passages(empty).count() == 0 and without_repeats(empty).count() == 0


def test_texts_of_one_passage_leave_a_large_cluster(spark, monkeypatch):
    """Texts that share a passage and have words of their own are in no product of a large cluster; what links stays."""
    from murmur.llm import ngram_join

    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"own{i}x{j}" for j in range(60)) for i in range(120)]
    texts += [t + " tail" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    given = []
    products = ngram_join._products
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "_products", lambda members, percent: given.append(members.count()) or products(members, percent))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_jaccard_join(docs).collect()}
    assert got == {i: (i - 120 if i >= 120 else i, int(i >= 120 or i < 5)) for i in range(125)}
    assert given == [10]
