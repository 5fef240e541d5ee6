"""Spelling variants: words one edit apart, by bands of letter-parity bitmasks.

A word's mask has a bit for each letter, set where the letter occurs an odd number of times. Inserting or deleting a code
point flips one bit, replacing one flips two or none. The mask is split into three bands (a letter of code point c is in
band c mod 3), so two near words have an equal band. Equal bands alone would pair a fixed share of all words
of a length; so a key also holds what the edit left alone: of three parts of a word at most one is touched, and the
letters outside it are equal. A key is a length, a band with its bits, and a word without one of its parts; the longer
word of a pair leaves out one letter more. Candidates have an equal key, so lengths that differ by one at most; a
pair is looked at where its first band and its first part agree, and is verified by its edit distance.

Words are counted before anything is joined. Forms are one aggregation over the verified pairs. A form has
at least twice its word's count, so chains to the root have a bounded length and are followed by pointer doubling.

Defined results: a null text has no words; a null id is written as nothing in the words that lose a letter; repeated rows count
again; an empty table gives no words; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import checkpoint, crc32_sql, read_table

WORD_RUN = r"[a-zA-ZÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BANDS = PARTS = 3
#: Bits of a band.
BITS = 21


def bands(word: Column) -> Column:
    """array of BANDS longs: the parities of the letters of each band."""
    code = F.transform(F.split(word, ""), lambda c: F.ascii(c))

    def one(band: int) -> Column:
        return F.aggregate(code, F.lit(0).cast("long"), lambda m, c: F.when(c % BANDS == band, m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(c / BANDS).cast("int") % BITS))).otherwise(m))

    return F.array(*map(one, range(BANDS)))


def _without(word: Column, length: Column, part: Column, more: int) -> Column:
    """The word without a part of it, as parts of a word of that length are cut; more letters of the part go."""
    begin, end = (F.floor((part + i) * length / PARTS).cast("int") for i in (0, 1))
    return F.concat(F.substring(word, F.lit(1), begin), F.lit(" "), F.substring(word, end + 1 + more, F.length(word)))


def _keyed(words: DataFrame, more: int) -> DataFrame:
    """(word, n, bands) -> key, band, part and the word, as the word of a pair that has `more` letters more."""
    places = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(p).alias("part")) for b in range(BANDS) for p in range(PARTS)])
    rows = words.select("word", "n", "bands", F.explode(places).alias("p")).select("word", "n", "bands", "p.band", "p.part")
    length = F.length("word") - more
    key = F.xxhash64(length, "band", F.get("bands", F.col("band")), "part", _without(F.col("word"), length, F.col("part"), more))
    return rows.select(key.alias("key"), "band", "part", *[F.col(c).alias(f"{c}_{'ab'[more]}") for c in ("word", "n", "bands")])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n) of distinct words -> (word_a, n_a, word_b, n_b): every pair at edit distance one, once."""
    words = words.withColumn("bands", bands(F.col("word")))
    short, long = _keyed(words, 0), _keyed(words, 1)
    other = short.select("key", *[F.col(f"{c}_a").alias(f"{c}_b") for c in ("word", "n", "bands")], F.lit(0).alias("more"))
    other = other.unionByName(long.select("key", "word_b", "n_b", "bands_b", F.lit(1).alias("more")))
    met = short.join(other, "key").filter((F.length("word_b") == F.length("word_a") + F.col("more")) & ((F.col("more") == 1) | (F.col("word_a") < F.col("word_b"))))
    length = F.length("word_a")

    def agrees(band: int, part: int) -> Column:
        cut = lambda w, more: _without(F.col(w), length, F.lit(part), more)
        same = F.when(F.col("more") == 0, cut("word_a", 0) == cut("word_b", 0)).otherwise(cut("word_a", 0) == cut("word_b", 1))
        return same if band < 0 else F.get("bands_a", F.lit(band)) == F.get("bands_b", F.lit(band))

    first_band = F.when(agrees(0, 0), 0).when(agrees(1, 0), 1).otherwise(2)
    first_part = F.when(agrees(-1, 0), 0).when(agrees(-1, 1), 1).otherwise(2)
    once = met.filter((F.col("band") == first_band) & (F.col("part") == first_part))
    return once.filter(F.levenshtein("word_a", "word_b", 1) == 1).select("word_a", "n_a", "word_b", "n_b")


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, n) of distinct words -> word, n, n_near, form, form_n, root.

    form is the near word of largest n (ties: smallest in code-point order) if its n is at least twice the word's.
    """
    words = checkpoint(words.select("word", F.col("n").cast("long").alias("n")))
    sides = F.explode(F.array(F.struct(F.col("word_a").alias("word"), F.col("word_b").alias("o"), F.col("n_b").alias("m")), F.struct(F.col("word_b").alias("word"), F.col("word_a").alias("o"), F.col("n_a").alias("m"))))
    best = near_pairs(words).select(sides.alias("s")).select("s.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("least"), F.col("o"))).alias("best"))
    has = -F.col("best.least") >= 2 * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.o")).alias("form"), F.when(has, -F.col("best.least")).alias("form_n"))
    rows = checkpoint(rows)
    # n doubles at least with each step, so a chain has at most log2(largest n) of them
    steps = math.ceil(math.log2((words.agg(F.max("n")).first()[0] or 1) + 1)) + 1
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) + 1):
        roots = checkpoint(roots)
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, count: int = 3, noise: int = 97) -> DataFrame:
    """(word, n): words of at least length code points that occur at least count times.

    Where noise divides h, the crc32 of ``<id>:<run>``, a run loses its code point h mod its length; noise 0 leaves all as they are.
    """
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(name.alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(WORD_RUN), F.lit(0))).alias("run")).filter(F.length("run") >= length)
    if noise:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        at = (h % F.length("run")).cast("int")
        runs = runs.select(F.when(h % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run")).alias("run"))
    words = runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.filter((F.length("word") >= length) & (F.col("n") >= count))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(read_table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
points AS (SELECT *, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: unicode(c)::BIGINT) AS p FROM once),
bytes AS (SELECT doc_id, run, n, flatten(list_transform(p, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END)) AS b FROM points),
hashed AS (SELECT run, n, {crc32_sql('b')} AS h FROM bytes),
words AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
cuts AS (SELECT word, n, length(word) AS l, i, word[:i] || word[i + 2:] AS c FROM words, unnest(range(0, length(word))) AS u(i)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.c = b.c AND a.i = b.i AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.c = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.c = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (m = top) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.last WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, n) AS root FROM chain JOIN (SELECT word AS last, n FROM words) USING (last) GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
