"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. A text's set of n-gram hashes is a row of the incidence matrix; equal rows (exact copies of a set) are one
   class and take part once.
2. Column blocks. Sizes fall into buckets by the threshold t, and a linked pair differs in at most
   D = (1 - t) / (1 + t) * (size sum) n-grams. The hash range is cut into blocks of columns; a class sends a digest
   of its n-grams in a block, and a linked pair agrees on at least two blocks. Small sets have D and a few blocks
   more, and send them all, so that two must agree (blocks empty on both sides agree as well; a bound on a class's
   empty blocks says when they could be all that agrees, and only then they are sent). For larger sets the first
   ``drawn_blocks`` of these are enough: hashes scatter the D differences, and that all but one of those blocks hold
   one, or nothing, has odds of less than 10^-12 for a pair at the threshold and less above it, beside the odds of
   two sets sharing a 64-bit digest. A block holds about five n-grams, so an n-gram or a passage that
   very many texts share is no hot key: the others in its block tell the texts apart.
3. Candidates. Pairs within a digest of few classes need two agreeing digests; within a digest of many, all are
   tied to the smallest class, so that nothing grows with the square of a group. A task sends the digests of a
   class once. The components of these candidate links (clusters) hold every linked pair.
4. Row blocks. A cluster of more than a block's n-grams is dealt to row blocks by size bucket and hash; every pair
   of row blocks whose sizes allow a link is one product. The product runs over column chunks, accumulates overlap
   counts and stops when no pair can reach its size-derived bound any more. Links are exact.
5. Links are contracted within a product to one edge a class. That settles a cluster of one block; components over
   the edges of the others are the rest of the result.

Only one text of a class of a cluster is read again (with few others that a bitmap of fixed size lets through).
Hashes are 64 bits wide; at 10^9 distinct texts a collision of two sets has odds of about 3 in 100.

Defined results: a text without words, or null, has an empty set and links with nothing; a text with fewer
words than n has one n-gram of all its words; rows with a null id take part, and count as nothing when the
smallest id is chosen; repeated rows are copies; an empty table gives an empty result; extra columns are
ignored by ``ngram_jaccard_join`` and kept by ``one_of_each_group``.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.llm.common import WordHashes, checkpoint, mix64, ngram_hashes, possible_members, small_batches
from murmur.llm.components import connected_components

#: A digest of more classes than this ties all of them to one instead of pairing them.
PAIRED = 8
#: Digests on which a paired candidate agrees at least.
AGREE = 2
#: Odds that a pair at the threshold agrees on fewer than AGREE of the blocks drawn.
MISSED = 1e-12
#: Classes that a task remembers as sent.
REMEMBERED = 150_000
#: Classes and n-grams of a row block.
BLOCK_ROWS, BLOCK_NGRAMS = 6144, 3 << 20
#: Rows of a block that one product takes at a time.
TILE = 1024
#: Columns of the dense chunk that a product step fills.
CHUNK = 4096


def size_bounds(percent: int, most: int = 1 << 40) -> list[int]:
    """First size of each bucket: sizes of a linked pair are in the same or in neighbouring buckets."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return bounds


@cache
def drawn_blocks(percent: int) -> int:
    """Blocks sent of about D, for odds of MISSED.

    At the threshold a pair has t / (1 - t) common n-grams for each different one. With 17 / 16 D blocks, a block has
    no difference with probability exp(-16 u / 17) and something in common with 1 - exp(-16 u / 17 * t / (1 - t)),
    where u tells how far the pair's sizes lie below the largest of their level (t * t at least).
    """
    t = percent / 100
    if t >= 1:
        return AGREE
    agrees = min(math.exp(-u) * -math.expm1(-u * t / (1 - t)) for u in (16 / 17 * t * t, 8 / 17 * (1 + t * t), 16 / 17))
    sent = AGREE
    while (1 - agrees) ** sent + sent * agrees * (1 - agrees) ** (sent - 1) > MISSED:
        sent += 1
    return sent


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams, in ASCII lower case."""
    words = (text or "").encode().lower().split()
    return np.unique(ngram_hashes(hashes.of(words), n))


def set_digest(grams: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(grams.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _block_keys(grams: np.ndarray, percent: int, bounds: list[int]) -> np.ndarray:
    """Digests of a set's column blocks, for the two size levels at which it can meet a partner.

    Level l holds sizes of buckets l - 1 and l, so below bounds[l + 1]; D is the largest difference of a linked
    pair there. With slack more blocks than D, a linked pair agrees on slack blocks or more. One of the two has
    fewer than slack - AGREE + 1 empty blocks: then AGREE of those agreed on are not empty. Else both send their
    empty blocks too, and agree on slack digests. Where fewer blocks are enough, the first of them are sent.
    """
    out, bucket, scrambled = [], bisect_right(bounds, len(grams)) - 1, mix64(grams)
    drawn = drawn_blocks(percent)
    for level in (bucket, bucket + 1):
        most = 2 * (bounds[level + 1] - 1) * (100 - percent) // (100 + percent)
        if not most:
            continue  # two different sets of such sizes can't link
        slack = max(AGREE + 1, most // 16)
        blocks = most + slack
        all_sent = blocks <= drawn
        at = ((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        used = len(at) if all_sent else int(np.searchsorted(at, drawn))
        if used:
            at = at[:used]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            names = mix64((np.uint64(level) << np.uint64(40)) + at[first] + np.uint64(1))
            out.append(mix64(np.add.reduceat(scrambled[:used], first) ^ names))
            empty = blocks - len(first)
            if all_sent and empty > slack - AGREE:
                none = np.setdiff1d(np.arange(blocks, dtype=np.uint64), at[first])
                out.append(mix64(mix64((np.uint64(level) << np.uint64(40)) + none + np.uint64(1)) + np.uint64(0x5BD1E995)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _incidence(n: int, percent: int):
    bounds = size_bounds(percent)
    names = ["key", "class", "doc_id", "size"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done, nothing = WordHashes(), set(), np.empty(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, texts = batch.column(0).slice(at, 1000), batch.column(1).slice(at, 1000).to_pylist()
                keys, classes, sizes = [], [], []
                for text in texts:
                    grams = shingles(text, n, hashes)
                    name = set_digest(grams) if len(grams) else None
                    sizes.append(len(grams))
                    classes.append(name)
                    if name is None or name in done:
                        keys.append(nothing)
                        continue
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(name)
                    keys.append(_block_keys(grams, percent, bounds))
                # a document's own row meets nobody: its key only spreads the rows
                alone = mix64(np.arange(at + 1, at + 1 + len(texts), dtype=np.uint64) + np.uint64(abs(hash(tuple(sizes)))))
                own = [pa.array(alone.view(np.int64)), pa.array(classes, pa.int64()), ids, pa.array(sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays(own, names=names)
                sent = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
                owner = np.repeat(np.array([c or 0 for c in classes], np.int64), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(sent), pa.array(owner), pa.nulls(len(sent), ids.type), pa.nulls(len(sent), pa.int32())], names=names)

    return rows


def _meetings(sent: DataFrame) -> DataFrame:
    """Own rows as they are, and of each digest of two classes or more a row a class: to (the classes to link it with) and many."""
    by_key = Window.partitionBy("key")
    in_order = by_key.orderBy("class")
    fresh = F.when(F.lag("class").over(in_order) == F.col("class"), 0).otherwise(1)
    ranked = sent.withColumn("fresh", fresh).withColumn("met", F.sum("fresh").over(by_key))
    ranked = ranked.filter(F.col("size").isNotNull() | ((F.col("fresh") == 1) & (F.col("met") > 1)))
    before = F.array_compact(F.array(*[F.lag("class", i).over(in_order) for i in range(1, PAIRED)]))
    many = F.col("met") > PAIRED
    linked = ranked.withColumn("before", before).withColumn("least", F.first("class").over(in_order))
    to = F.when(F.col("size").isNull(), F.when(many, F.array("least")).otherwise(F.col("before")))
    return linked.select("doc_id", "class", "size", to.alias("to"), many.alias("many")).filter(F.col("size").isNotNull() | (F.size("to") > 0))


def _candidates(met: DataFrame) -> DataFrame:
    """Rows of _meetings -> candidate links (a, b)."""
    links = met.filter("to IS NOT NULL").select("many", F.explode("to").alias("a"), F.col("class").alias("b")).filter("a != b")
    agreed = links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("agree"), F.max("many").alias("many"))
    return agreed.filter(F.col("many") | (F.col("agree") >= AGREE)).select("a", "b")


def product(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which rows of two blocks (or of one with itself, b None) link: a boolean matrix."""
    both = a if b is None else a + b
    sizes = np.array([len(x) for x in both], np.int64)
    columns, place = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), sizes)
    n_a = len(a)
    if b is None:
        used = np.bincount(place, minlength=len(columns)) > 1
    else:
        used = (np.bincount(place[row < n_a], minlength=len(columns)) > 0) & (np.bincount(place[row >= n_a], minlength=len(columns)) > 0)
    keep = used[place]
    place, row = (np.cumsum(used) - 1)[place[keep]], row[keep]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    size_a, size_b = sizes[:n_a], sizes if b is None else sizes[n_a:]
    total = size_a[:, None] + size_b[None, :]
    bound = -(-percent * total // (100 + percent))
    counts = np.zeros(total.shape, np.float32)
    left = np.bincount(row, minlength=len(both))
    for begin in range(0, int(used.sum()), CHUNK):
        lo, hi = np.searchsorted(place, (begin, begin + CHUNK))
        dense = np.zeros((len(both), min(CHUNK, int(used.sum()) - begin)), np.float32)
        dense[row[lo:hi], place[lo:hi] - begin] = 1
        counts += dense[:n_a] @ (dense if b is None else dense[n_a:]).T
        left = left - np.bincount(row[lo:hi], minlength=len(both))
        rest = np.minimum(left[:n_a, None], (left if b is None else left[n_a:])[None, :])
        if not (counts + rest >= bound).any():
            break
    links = counts >= bound
    if b is None:
        np.fill_diagonal(links, False)
    return links


def _settle(sets: list[np.ndarray], at: list[int], percent: int, degree: np.ndarray, tie) -> None:
    """The products of row blocks at[0]:at[1] and at[1]:at[2] (or of the one with itself), in tiles of TILE rows.

    Adds to degree, and ties each linked row to the smallest row that it is connected with inside its tile.
    """
    own = len(at) == 2
    begins_a = range(at[0], at[1], TILE)
    for a in begins_a:
        rows_a = np.arange(a, min(a + TILE, at[1]))
        for b in range(a if own else at[1], at[1] if own else at[2], TILE):
            same = own and a == b
            rows_b = rows_a if same else np.arange(b, min(b + TILE, at[1] if own else at[2]))
            links = product([sets[i] for i in rows_a], None if same else [sets[i] for i in rows_b], percent)
            if not links.any():
                continue
            degree[rows_a] += links.sum(axis=1)
            if not same:
                degree[rows_b] += links.sum(axis=0)
            root_a, root_b, far = rows_a.copy(), rows_b.copy(), len(sets)
            while True:
                least_a = np.minimum(root_a, np.where(links, root_b[None, :], far).min(axis=1))
                least_b = np.minimum(root_b, np.where(links, least_a[:, None], far).min(axis=0))
                if (least_a == root_a).all() and (least_b == root_b).all():
                    break
                root_a, root_b = (least_b, least_b) if same else (least_a, least_b)
            for rows, root in ((rows_a, root_a), (rows_b, root_b)):
                for i in np.flatnonzero(root != rows):
                    tie(int(rows[i]), int(root[i]))


def _linked(percent: int):
    def group(table: pa.Table) -> pa.Table:
        """The products of one task -> (cluster, class, root, links): an edge to the smallest class it is connected with here."""
        parts: dict[tuple, dict[int, tuple[int, np.ndarray]]] = {}
        columns = [table.column(c).to_pylist() for c in ("cluster", "low", "high", "class", "block")]
        for cluster, low, high, name, block, grams in zip(*columns, table.column("grams")):
            parts.setdefault((cluster, low, high), {})[name] = (block, np.frombuffer(grams.as_buffer(), np.uint64))
        out: list[tuple] = []
        for (cluster, low, high), rows in parts.items():
            names = sorted(rows, key=lambda c: (rows[c][0], c))
            k, n_a = len(names), sum(rows[c][0] == low for c in names)
            if low != high and not 0 < n_a < k:
                continue
            degree, up = np.zeros(k, np.int64), list(range(k))

            def top(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            def tie(i: int, j: int) -> None:
                i, j = top(i), top(j)
                up[max(i, j)] = min(i, j)

            _settle([rows[c][1] for c in names], [0, k] if low == high else [0, n_a, k], percent, degree, tie)
            out += [(cluster, names[i], names[top(int(i))], int(degree[i])) for i in np.flatnonzero(degree)]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("cluster", "class", "root", "links"), zip(*out) if out else ((), (), (), ()))})

    return group


def _products(members: DataFrame, percent: int) -> DataFrame:
    """(class, cluster, size) -> (class, cluster, block, low, high, task): a row for each product that a class takes part in.

    A cluster within the bounds of a row block is one block, and several of them are a task. Others are dealt to
    blocks by size bucket and hash; low, high, parts and sizes are of blocks, so few rows. low is null for one block.
    """
    weight = F.greatest(F.lit(1 / BLOCK_ROWS), F.col("size") / BLOCK_NGRAMS)
    members = checkpoint(members.withColumn("bucket", F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent)).cast("long") if percent < 100 else F.lit(0).cast("long")))
    buckets = checkpoint(members.groupBy("cluster", "bucket").agg(F.sum(weight).alias("weight"), F.min("size").alias("least"), F.max("size").alias("most")))
    sums = buckets.groupBy("cluster").agg(F.sum("weight").alias("total"))
    bins = max(1, math.ceil(sums.filter("total <= 1").agg(F.sum("total")).first()[0] or 0))
    large = buckets.join(sums.filter("total > 1").select("cluster"), "cluster").withColumn("parts", F.ceil("weight"))
    dealt = members.join(large.select("cluster", "bucket", "parts"), ["cluster", "bucket"], "left")
    dealt = dealt.withColumn("block", F.col("bucket") * (1 << 32) + F.pmod(F.xxhash64("class"), "parts"))
    blocks = large.select("cluster", "least", "most", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "bucket").withColumn("block", F.col("bucket") * (1 << 32) + F.col("part"))
    low, high = (blocks.select("cluster", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "least", "most")]) for x in ("low", "high"))
    may = (F.col("block_low") <= F.col("block_high")) & (F.col("least_high") * percent <= F.col("most_low") * 100) & (F.col("least_low") * percent <= F.col("most_high") * 100)
    pairs = low.join(high, "cluster").filter(may).select("cluster", F.col("block_low").alias("low"), F.col("block_high").alias("high"))
    tasks = pairs.select("cluster", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    small = dealt.filter("parts IS NULL").select("class", "cluster", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("long").alias(c) for c in ("low", "high")], F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("task"))
    spread = dealt.filter("parts IS NOT NULL").select("class", "cluster", "block").join(tasks, ["cluster", "block"]).select("class", "cluster", "block", "low", "high", F.xxhash64("cluster", "low", "high").alias("task"))
    return checkpoint(small.unionByName(spread))


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id, component_id, n_links.

    class_id is the smallest id of the documents with the same set, component_id the smallest id reachable by
    links, n_links the number of other sets linked with this one.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        met = checkpoint(_meetings(plain.mapInArrow(_incidence(n, percent), "key long, class long, doc_id long, size int")))
    rows = met.filter("size IS NOT NULL").select("doc_id", "class", "size")
    classes = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.max("size").alias("size"))
    clusters = connected_components(_candidates(met))
    members = clusters.select(F.col("vertex").alias("class"), F.col("label").alias("cluster")).join(classes.select("class", "size"), "class")
    chosen = _products(_able(checkpoint(members), plain, classes, n, percent), percent)

    hashed = _sets(n, _texts(plain, classes, chosen.select("class").distinct()))
    found = hashed.join(chosen, "class").select("task", "cluster", "low", "high", "class", "block", "grams").groupBy("task").applyInArrow(_linked(percent), "cluster long, class long, root long, links long")
    with small_batches(docs.sparkSession):
        found = checkpoint(found)
    # low is null in a cluster of one block, whose roots are final
    several = chosen.filter("low IS NOT NULL").select("cluster").distinct()
    edges = found.join(several, "cluster", "left_semi").select(F.col("class").alias("a"), F.col("root").alias("b"))
    parts = connected_components(edges)
    settled = found.join(several, "cluster", "left_anti").select(F.col("class").alias("vertex"), F.col("root").alias("label"))
    degrees = found.groupBy("class").agg(F.sum("links").alias("n_links"))
    named = classes.join(parts.unionByName(settled).select(F.col("vertex").alias("class"), "label"), "class", "left").join(degrees, "class", "left").select("class", "class_id", F.coalesce("label", "class").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    smallest = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = checkpoint(named.join(smallest, "label").drop("label"))
    return rows.join(named, "class", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _texts(plain: DataFrame, classes: DataFrame, chosen: DataFrame) -> DataFrame:
    """One text of each chosen class, and few others that a bitmap of fixed size lets through."""
    first = classes.join(chosen, "class", "left_semi").filter("class_id IS NOT NULL")
    return possible_members(plain, F.col("doc_id"), F.col("class_id"), first).filter(F.col("__possible") | F.col("doc_id").isNull()).select("text")


def _able(members: DataFrame, plain: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(class, cluster, size) without the classes of large clusters that can't link with any other.

    A passage that many texts share ties them to one cluster, which grows with the table, and a class is sent once for each of its
    cluster's row blocks. A link needs percent of a set's n-grams in common, so a class with more n-grams of its own than
    the rest takes no part. Sums by n-gram and by class alone, so no n-gram gathers its texts in one task.
    """
    weight = F.greatest(F.lit(1 / BLOCK_ROWS), F.col("size") / BLOCK_NGRAMS)
    large = members.join(members.groupBy("cluster").agg(F.sum(weight).alias("total")).filter("total > 1").select("cluster"), "cluster", "left_semi")
    large = checkpoint(large)
    if large.isEmpty():
        return members
    with small_batches(members.sparkSession):
        grams = _sets(n, _texts(plain, classes, large.select("class")), each=True)
        # a class may come twice
        own = grams.groupBy("gram").agg(F.min("class").alias("class"), F.max("class").alias("last")).filter(F.col("class") == F.col("last"))
        own = checkpoint(own.groupBy("class").agg(F.count(F.lit(1)).alias("own")))
    unable = large.join(own, "class").filter(F.col("own") * 100 > F.col("size") * (100 - percent))
    return checkpoint(members.join(unable.select("class"), "class", "left_anti"))


def _sets(n: int, texts: DataFrame, each: bool = False) -> DataFrame:
    """(text) -> (class, grams), or with each a row (class, gram) for every n-gram; a task sends a class once, unless it has seen very many others since."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = WordHashes(), set()
        for batch in batches:
            classes, found = [], []
            for text in batch.column(0).to_pylist():
                grams = shingles(text, n, hashes)
                name = set_digest(grams)
                if not len(grams) or name in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add(name)
                classes.append(name)
                found.append(grams if each else grams.tobytes())
            if each:
                flat = np.concatenate(found) if found else np.empty(0, np.uint64)
                owner = np.repeat(np.array(classes, np.int64), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(flat.view(np.int64))], names=["class", "gram"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(found, pa.binary())], names=["class", "grams"])

    return texts.mapInArrow(sets, "class long, gram long" if each else "class long, grams binary")


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those linked, directly or through others, with one of a smaller id; all columns kept.

    Repeated rows of an id are one document; rows with a null id stay. Only rows whose id may be among those that
    go or repeat are shuffled.
    """
    joined = ngram_jaccard_join(docs, n, percent, id_col, text_col).filter("doc_id IS NOT NULL")
    ids = joined.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    touched = checkpoint(ids.filter("doc_id != component_id OR rows > 1").select(F.col("doc_id").alias("__gone"), (F.col("doc_id") != F.col("component_id")).alias("__linked")))
    marked = possible_members(docs, F.col(id_col).cast("long"), F.col("__gone"), touched)
    stay = marked.filter(~F.col("__possible")).drop("__possible")
    others = marked.filter("__possible").drop("__possible")
    kept = others.join(touched.filter("__linked").select("__gone"), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    return stay.unionByName(kept.dropDuplicates([id_col]))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)


OP2_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM texts, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM grams GROUP BY doc_id),
named AS MATERIALIZED (SELECT *, min(doc_id) OVER (PARTITION BY h) AS class_id FROM sets),
firsts AS (SELECT doc_id, n, g FROM grams JOIN named USING (doc_id) WHERE doc_id = class_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS total, count(*) AS shared FROM firsts a JOIN firsts b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs WHERE 100 * shared >= 85 * (total - shared)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
parts AS (SELECT x AS class_id, least(x, min(y)) AS component_id FROM reach GROUP BY x),
degrees AS (SELECT x AS class_id, count(*) AS n_links FROM edges GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, doc_id) AS class_id, coalesce(component_id, class_id, doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM documents LEFT JOIN named USING (doc_id) LEFT JOIN parts USING (class_id) LEFT JOIN degrees USING (class_id)
"""
