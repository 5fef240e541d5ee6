"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, and one scan of each text.

Normal form: A-Z in lower case, words are runs outside the ASCII characters that are no letters or digits. The automaton's
letters are words: each distinct word of the items is a letter of its alphabet, all other words are letter 0. So a
text is one string with a letter a word, a match ends at a word, and word boundaries need no test. Its patterns
are the items' windows of consecutive words; an item with fewer words is one window. All windows that occur, overlapping
ones too, are found in one scan. Words of a hit are mapped to the original: spans are its code points.

The items reach the executors as a broadcast, which is bounded: items are cut into pieces of PIECE_WORDS windows, and at
most about PART_WORDS words make an automaton. More items make more automata: each scans the texts in a pass of
its own, only texts with hits leave it, and hits of equal texts are merged. There is no limit on items or matches. With one
automaton there is no shuffle.

Defined results: a null text has no words; an item without words, or null, has no windows; items with a null id mark
words but are not counted or named; repeated ids of items count once; repeated rows of documents are rows of
the result; empty tables give no rows, or no hits; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import checkpoint, read_table

#: A word, in texts whose A-Z are lower case and in original ones.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Words of items that one automaton holds, about: some 100 MB of its nodes.
PART_WORDS = 200_000
#: Windows of a piece of an item.
PIECE_WORDS = 4096
HITS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"


def normal_words(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text in normal form; other characters than ASCII ones are parts of words."""
    return data.translate(_NORMAL).split()


class Automaton:
    """The windows of (item id as a string or null, words joined by blanks); an item may come in several pieces."""

    def __init__(self, pieces: list[tuple[str | None, str]], window: int):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.items: list[set] = []
        self.lengths: list[int] = []
        self.machine = ahocorasick.Automaton()
        for item, text in pieces:
            spelled = "".join(self.letters.setdefault(w, chr((i := len(self.letters)) + 1 + 2048 * (i >= 0xD7FF))) for w in text.encode().split())
            for at in range(max(len(spelled) - window, 0) + 1) if spelled else ():
                pattern = spelled[at : at + window]
                name = self.machine.get(pattern, None)
                if name is None:
                    name = len(self.items)
                    self.machine.add_word(pattern, name)
                    self.items.append(set())
                    self.lengths.append(len(pattern))
                if item is not None:
                    self.items[name].add(item)
        if self.items:
            self.machine.make_automaton()
        self._named: dict[frozenset, list[str]] = {}

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """Merged runs [first, last] of hit words in order, and the ids of the items whose windows occur, in order."""
        if not self.items:
            return [], []
        get = self.letters.get
        found = list(self.machine.iter("".join([get(w, "\0") for w in words])))
        if not found:
            return [], []
        runs: list[list[int]] = []
        for first, last in sorted((end - self.lengths[name] + 1, end) for end, name in found):
            if runs and first <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], last)
            else:
                runs.append([first, last])
        windows = frozenset(name for _, name in found)
        if windows not in self._named:
            if len(self._named) > 1000:
                self._named.clear()
            self._named[windows] = sorted(set().union(*(self.items[name] for name in windows)))
        return runs, self._named[windows]


def _pieces(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(item, words): items in normal form, cut so that each window is in one piece."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(ITEM_WORD), F.lit(0)).alias("w"))
    begins = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)), F.lit(PIECE_WORDS))
    cut = rows.filter(F.size("w") > 0).select("item", "w", F.explode(begins).alias("at"))
    return cut.select("item", F.slice("w", F.col("at"), F.lit(PIECE_WORDS + window - 1)).alias("w")).select("item", F.size("w").alias("n"), F.array_join("w", " ").alias("words"))


def _scanned(texts: DataFrame, pieces: list[tuple[str | None, str]], window: int, hits_only: bool) -> DataFrame:
    """(id or key, text) -> (id or key, n_words, hits, items), of all texts or of those with hits."""
    name, kind = texts.dtypes[0]
    shared = texts.sparkSession.sparkContext.broadcast(pieces)
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, part = batch.column(0).slice(at, 500), batch.column(1).slice(at, 500).cast(pa.binary())
                counts, hits, named, kept = [], [], [], []
                for i, data in enumerate(part.to_pylist()):
                    data = data or b""
                    words = normal_words(data)
                    runs, items = automaton.scan(words)
                    if hits_only and not runs:
                        continue
                    spans = [m.span() for m in _ORIGINAL.finditer(data.decode())] if runs else []
                    kept.append(i)
                    counts.append(len(words))
                    hits.append([dict(first=a, last=b, start=spans[a][0], end=spans[b][1]) for a, b in runs])
                    named.append(items)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), pa.array(counts, pa.int64()), pa.array(hits, arrow), pa.array(named, pa.list_(pa.string()))], names=[name, "n_words", "hits", "items"])

    return texts.mapInArrow(scan, f"`{name}` {kind}, n_words long, hits {HITS}, items array<string>")


def _merged(runs: Column) -> Column:
    """Runs in any order, overlapping or touching ones too -> merged ones."""

    def add(done: Column, x: Column) -> Column:
        top = F.element_at(done, -1)
        joined = F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"), top["start"].alias("start"), F.greatest(top["end"], x["end"]).alias("end"))
        touches = F.coalesce(F.try_element_at(done, F.lit(-1))["last"] + 1 >= x["first"], F.lit(False))
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(runs), F.array().cast(HITS), add)


def contaminated_documents(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, hits (runs of hit words: first and last word, start and end in code points of the original) and items (ids as strings, in order)."""
    pieces = _pieces(items, window, item_col, item_text_col)
    total = pieces.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // part_words))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if parts == 1:
        return _scanned(plain, [(r["item"], r["words"]) for r in pieces.select("item", "words").collect()], window, False)
    pieces = checkpoint(pieces.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(parts))))
    keyed = docs.select(F.sha2(F.col(text_col).cast("string"), 256).alias("key"), F.col(text_col).cast("string").alias("text"))
    found = None
    for i in range(parts):
        part = [(r["item"], r["words"]) for r in pieces.filter(F.col("part") == i).select("item", "words").collect()]
        # equal texts have equal hits: one of them is kept
        hit = _scanned(keyed, part, window, True).groupBy("key").agg(F.any_value("hits").alias("hits"), F.any_value("items").alias("items"))
        found = hit if found is None else found.unionByName(hit)
    merged = found.groupBy("key").agg(_merged(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = plain.select("doc_id", F.sha2("text", 256).alias("key"), F.size(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(ITEM_WORD), F.lit(0))).cast("long").alias("n_words"))
    return counted.join(checkpoint(merged), "key", "left").select("doc_id", "n_words", F.coalesce("hits", F.array().cast(HITS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
places AS (SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM d, (SELECT DISTINCT k FROM windows), unnest(range(1, len(w) - k + 2)) AS u(i)),
found AS (SELECT r, i, k, item_id FROM places JOIN windows USING (g, k)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, k FROM found), unnest(range(i, i + k)) AS u(p) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
