"""op5, op10 and the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from murmur.llm.pii import distinct_surrogates, op10_pii_surrogates, with_surrogates
from murmur.llm.resampling import feature_buckets, gumbel_top_k, importance_weights, op5_quality_resampling, resample_by_quality
from murmur.llm.common import WordHashes
from tests.llm.test_pairs_and_passages import components
from tests.llm.test_quality_secrets_mixing import base_spans, verdict
from tests.llm.test_tokens_packing_records import check_packing


def test_weights_match_brute_force(spark, sf, documents, rows):
    good = [r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()]
    target = documents.filter(documents.doc_id.isin(good))
    got = {r["doc_id"]: r for r in importance_weights(documents, target).collect()}
    hashes, n = WordHashes(), 1 << 15
    found = {r["doc_id"]: feature_buckets(r["text"], hashes) for r in rows}
    raw = sum(np.bincount(f, minlength=n) for f in found.values()).astype(float)
    own = sum(np.bincount(found[d], minlength=n) for d in found if d in set(good)).astype(float)
    ratio = np.log(own / own.sum() + 0.01 / n) - np.log(raw / raw.sum() + 0.01 / n)
    for d, f in found.items():
        assert got[d]["n_features"] == len(f) and got[d]["log_weight"] == pytest.approx(ratio[f].sum(), abs=1e-6)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    frame = spark.createDataFrame([(i, 1, float(w)) for i, w in enumerate(np.concatenate([rng.normal(0, 100, 500), np.zeros(500)]))], "doc_id long, n_features long, log_weight double")
    everything = sorted(((r["score"], r["doc_id"]) for r in gumbel_top_k(frame, 1000, 1).collect()), reverse=True)
    assert len(everything) == 1000
    for k in (0, 1, 77, 500, 999):
        got = gumbel_top_k(frame, k, 1, bins=8).collect()
        assert sorted(((r["score"], r["doc_id"]) for r in got), reverse=True) == everything[:k]


def test_top_k_of_repeated_and_tied_rows(spark, monkeypatch):
    """A third of all rows are one row; bins are divided again instead of being ranked whole."""
    from murmur.llm import resampling

    monkeypatch.setattr(resampling, "RANKED", 50)
    rows = [(7, 3, 0.5)] * 400 + [(i, 3, float(i % 5)) for i in range(800)] + [(None, 0, 0.0)] * 20
    frame = spark.createDataFrame(rows, "doc_id long, n_features long, log_weight double").repartition(3)
    whole = Counter((r["score"], r["doc_id"]) for r in gumbel_top_k(frame, len(rows), 1).collect())
    ranked = sorted(whole.elements(), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
    for k in (1, 100, 399, 700, 1219):
        got = Counter((r["score"], r["doc_id"]) for r in gumbel_top_k(frame, k, 1, bins=16).collect())
        assert got == Counter(ranked[:k])


def test_sample_prefers_good_documents(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    drawn = {r["doc_id"] for r in op5_quality_resampling(spark, sf).collect()}
    rate = lambda q: np.mean([d in drawn for d, v in labels.items() if v == q])
    assert rate(1) > rate(0) + 0.3


def test_resampling_edges(spark, edge, edge_rows, empty):
    labels = spark.createDataFrame([(5, 1), (9, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert 0 < resample_by_quality(edge, labels).count() <= len(edge_rows)
    assert resample_by_quality(edge, labels.limit(0)).count() == len(edge_rows)
    assert resample_by_quality(empty, labels).count() == 0
    named = edge.withColumnsRenamed({"size": "good", "rank": "place", "key": "score", "base": "log_weight"})
    assert resample_by_quality(named, labels).count() == resample_by_quality(edge, labels).count()


PII = [
    (1, "Write to Jane.Doe77@corp.example or call +1 (415) 555-2671, card 4111 1111 1111 1111."),
    (2, "jane.doe77@corp.example again; call 1-415 no; +1 415 555 2671 yes; host 192.168.4.17; ssn 123-45-6789"),
    (3, "Mrs. Anna Smith met Mr Boris Jones. Mrs Anna Smith left. Госпожа Мария Иванова пришла. IBAN GB82WEST12345698765432 ok"),
    (4, "No entity here, only version 1.2.3 and 1234 5678."),
]


def test_surrogates(spark):
    frame = spark.createDataFrame(PII, "doc_id long, text string")
    got = {r["doc_id"]: r for r in with_surrogates(frame, "k", count_col="n").collect()}
    one, two, three = (got[i]["text"] for i in (1, 2, 3))
    assert got[4]["text"] == PII[3][1] and [got[i]["n"] for i in (1, 2, 3, 4)] == [3, 4, 5, 0]
    for text, secret in ((one, "Doe77"), (one, "4111 1111"), (two, "192.168"), (two, "123-45-6789"), (three, "Smith"), (three, "Иванова"), (three, "WEST")):
        assert secret not in text
    mail = re.search(r"\S+@\S+org", one)[0]
    assert mail.lower() in two.lower()  # coreference over documents
    assert re.sub(r"\D", "", re.search(r"\+1[ ()\d-]+", one)[0]) == re.sub(r"\D", "", re.search(r"\+1[ ()\d-]+", two)[0])
    assert re.search(r"\+1 \(\d{3}\) 555-\d{4}, card \d{4} \d{4} \d{4} \d{4}\.", one)  # format
    card = [int(c) for c in re.sub(r"\D", "", re.search(r"card ([\d ]+)", one)[1])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(card))) % 10 == 0
    iban = re.search(r"IBAN (\S+)", three)[1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    names = re.findall(r"Mrs\.? (\w+ \w+)", three)
    assert names[0] == names[1] and re.search(r"Госпожа [А-Яа-я]+ [А-Яа-я]+ пришла", three)
    assert got[1]["text"] != {r["doc_id"]: r["text"] for r in with_surrogates(frame, "other").collect()}[1]


def test_surrogates_of_names(spark):
    """Titles or common given names; scripts, capitals, hyphens and initials stay; one person stays one."""
    texts = [
        "Dr. Jane Roe met John Miller and Mr J. R. Miller. Call 415-555-2671 or 00442079460958 or +44 2079460958.",
        "MR SMITH", "Mr SMITH and Mr Smith and John Smith.", "Κύριος Γιάννης Παπαδόπουλος ήρθε", "Frau Anna-Lena Meyer-Landrut", "Mr O'Brien", "Mr 王伟",
        "The Grand Hotel and Apache License, Version 2.0", "+1 (415) 555-2671",
    ]
    got = [r["text"] for r in sorted(with_surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect(), key=lambda r: r["doc_id"])]
    first = re.fullmatch(r"Dr\. (\w+) (\w+) met (\w+) (\w+) and Mr ([A-Z])\. ([A-Z])\. (\w+)\. Call (\d{3}-555-\d{4}) or (00442\d{9}) or (\+44 2\d{9})\.", got[0])
    assert first and first[4] == first[7] and "Miller" not in got[0] and "Jane" not in got[0]
    assert first[9].removeprefix("00") == re.sub(r"\D", "", first[10]) and first[9] != "00442079460958"
    assert got[1] == texts[1]  # a title is written as a title
    upper, lower, whole = re.fullmatch(r"Mr ([A-Z]+) and Mr ([A-Z][a-z]+) and \w+ ([A-Z][a-z]+)\.", got[2]).groups()
    assert upper.lower() == lower.lower() == whole.lower() != "smith"
    assert re.fullmatch(r"Κύριος [Α-Ωα-ωά-ώΆ-Ώ]+ [Α-Ωα-ωά-ώ]+ ήρθε", got[3]) and "Παπαδ" not in got[3]
    assert re.fullmatch(r"Frau [A-Z][a-z]+-[A-Z][a-z]+ [A-Z][a-z]+-[A-Z][a-z]+", got[4]) and "Meyer" not in got[4]
    assert re.fullmatch(r"Mr O'[A-Z][a-z]+", got[5]) and "Brien" not in got[5]
    assert re.fullmatch(r"Mr [\u4e00-\u9fff]+", got[6]) and got[6] != texts[6]
    assert got[7] == texts[7]
    assert re.sub(r"\D", "", got[8])[1:] == first[8].replace("-", "")  # one number in two formats


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    from murmur.llm.pii import keyed

    for key in ("k", "long " * 30):
        row = spark.createDataFrame([("héllo",)], "m string").select(keyed(key, __import__("pyspark").sql.functions.col("m")).alias("h")).first()
        assert row["h"] == hmac.new(key.encode(), "héllo".encode(), hashlib.sha256).hexdigest()


def test_surrogates_of_very_many_names(spark):
    """10^5 surnames and 10^4 given names of a kind: all distinct, none a real one."""
    names = spark.range(100_000).selectExpr("'surname latin' AS kind", "concat('n', translate(id, '0123456789', 'abcdefghij')) AS value")
    given = spark.range(10_000).selectExpr("'given latin f' AS kind", "concat('g', translate(id, '0123456789', 'abcdefghij')) AS value")
    got = distinct_surrogates(names.unionByName(given), "k").collect()
    assert len({(r["kind"], r["new"]) for r in got}) == len(got) == 110_000
    assert not {(r["kind"], r["new"]) for r in got} & {(r["kind"], r["value"]) for r in got}


def test_surrogates_stay_distinct(spark):
    """More people than a few names hold: every collision is settled."""
    people = spark.range(3000).selectExpr("'ip' AS kind", "concat('192.168.', id div 256, '.', id % 256) AS value")
    new = [r["new"] for r in distinct_surrogates(people, "k").collect()]
    assert len(new) == len(set(new)) == 3000


def test_surrogates_of_small_spaces(spark):
    """More entities than surrogates of their length: short addresses, a full prefix of phones, names of one title."""
    mails = [("email", f"{a}@example.com") for a in "abcdefghijklmnopqrstuvwxyz"] + [("email", f"{a}{b}@b.org") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijkl"]
    phones = [("phone", str(10000 + i)) for i in range(100)]
    few = spark.createDataFrame(mails + phones, "kind string, value string")
    names = spark.range(70_000).selectExpr("'person' AS kind", "concat('Mr N', translate(id, '0123456789', 'abcdefghij')) AS value")
    for entities in (few, names):
        got = distinct_surrogates(entities, "murmur").collect()
        new = {(r["kind"], r["new"]) for r in got}
        assert len(new) == len(got) == entities.count()
        assert not new & {(r["kind"], r["value"]) for r in got}
    texts = spark.createDataFrame([(i, f"write to {v} or +{10000 + i} now") for i, (_, v) in enumerate(mails[:100])], "doc_id long, text string")
    seen = [r["text"] for r in with_surrogates(texts, "murmur").collect()]
    assert len(set(seen)) == 100 and all(re.fullmatch(r"write to [a-p]{1,2}@[a-p.]*mail\d{6}\.example\.org or \+100\d{2,} now", t) for t in seen)


def test_surrogates_edges(edge, edge_rows, empty):
    got = with_surrogates(edge, "k")
    assert got.columns == edge.columns
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert Counter(key(r) for r in got.collect()) == Counter(key(r) for r in edge_rows)
    assert with_surrogates(empty, "k").count() == 0
    named = edge.withColumnsRenamed({"size": "n_entities", "rank": "put", "key": "own", "base": "hash"})
    counted = with_surrogates(named, "k", count_col="n_entities")
    assert sorted(counted.columns) == sorted(named.columns) and counted.count() == len(edge_rows)


def test_surrogates_leave_the_rest(spark, sf, rows):
    got = {r["doc_id"]: r for r in op10_pii_surrogates(spark, sf).collect()}
    assert len(got) == len(rows) and sum(r["n_entities"] for r in got.values()) > 0
    for r in rows:
        if got[r["doc_id"]]["n_entities"] == 0:
            assert got[r["doc_id"]]["text"] == r["text"]


def test_pipeline_stage_by_stage(spark, sf, rows, tmp_path):
    docs, stages = spark.read.parquet(f"{sf}/documents.parquet"), corpus_pipeline.STAGES
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(stages):
        stage(spark, docs, sf).write.parquet(path := str(tmp_path / str(i)))
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
        assert i == len(stages) - 1 or docs.columns == columns
    kept = [r for r in rows if verdict(r["text"])]
    assert sorted(r["doc_id"] for r in seen[0]) == sorted(r["doc_id"] for r in kept)
    alone = [d for d, _, c in components([(r["doc_id"], r["text"]) for r in kept], 5, 80) if d == c]
    assert sorted(r["doc_id"] for r in seen[1]) == sorted(alone)
    assert sorted(r["doc_id"] for r in seen[2]) == sorted(alone)
    before = {r["doc_id"]: r["text"] for r in seen[1]}
    for r in seen[2]:
        assert not base_spans(r["text"].replace("[SECRET]", "\n"))
        if not base_spans(before[r["doc_id"]]) and "[SECRET]" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    sizes = Counter()
    for r in seen[3]:
        sizes[r["source"]] += len(r["text"].split())
    own = {s: sum(len(r["text"].split()) for r in seen[2] if r["source"] == s) for s in {r["source"] for r in seen[2]}}
    assert max(Counter(r["doc_id"] for r in seen[3]).values()) <= 2 and math.isclose(sum(sizes.values()), 1.5 * sum(own.values()), rel_tol=0.05)
    copies = Counter(r["doc_id"] for r in seen[3])
    texts = {r["doc_id"]: r["text"] for r in seen[3]}
    check_packing(seen[4], [(d, texts[d]) for d, n in copies.items() for _ in range(n)])
