"""Merkle manifest of a dataset: coordinates of siblings are computed and looked up in a table of nodes.

Leaves are hashes of rows. A tree is described by its number of leaves alone: node i of level l covers leaves from
i * 16^l on, and the run that a leaf's ancestor belongs to has the coordinate (tree, l, index div 16^(l + 1)).
So nothing is traversed:

1. Leaves get their index within their tree by a range sort and running counts of its partitions.
2. The node table is built a level at a time, a sixteenth of the level below: a row a run with its digests.
3. A leaf needs, for each level, the run's other digests. All leaves of a run of 16 need the same coordinates above
   it, so the run explodes them once; they are joined with the node table, put in order of level and folded for each leaf.
4. The subroots are the leaves of a last tree. Its paths are looked up the same way and are one more
   coordinate of each source, its crown.

Runs near the top are needed by every leaf of a source: each row of the node table is copied for every FAN runs of leaves
below it, and coordinates name the copy, so no key of the join has more than FAN rows. All of it is DataFrame
functions; texts are hashed where they are read and do not move.

Defined results: nulls are written as ``-``, also a null id or source; a null source is a source and comes first; null
ids come first; rows of equal ids are ordered by their hash, and equal rows have equal leaves and a proof each; a source of
one row is its own subroot, a table of one source has its subroot as root; an empty table gives no rows; extra columns
are not hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.llm.common import checkpoint, crc32_sql, read_table

#: Nodes that become one.
RUN = 16
#: Runs of leaves that share a copy of a row of the node table.
FAN = 4096
PATH = "array<struct<at:bigint,digests:array<string>>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def written(value: Column) -> Column:
    """A value as it goes into a leaf: its bytes in UTF-8, counted, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def of_run(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the runs on its path."""
    return F.aggregate(path, leaf, lambda below, x: of_run(F.transform(x["digests"], lambda d, i: F.when(i == x["at"], below).otherwise(d))))


def siblings(path: Column) -> Column:
    """The digests that a proof consists of: of each run those beside the leaf's ancestor."""
    return F.flatten(F.transform(path, lambda x: F.filter(x["digests"], lambda d, i: i != x["at"])))


def indexed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with index (from 0, in the order within their tree) and n (rows of the tree).

    Ranges of (tree, order) are sorted on their own; counts are a row a tree and range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = checkpoint(rows.repartitionByRange(parts, tree, *order).withColumn("range", F.spark_partition_id()))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(tree, "range").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select(tree, "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy(tree, "range").orderBy(*order))
    return ranges.withColumn("index", place.cast("long") - 1).join(counts, [tree, "range"]).withColumn("index", F.col("index") + F.col("before")).drop("before", "range")


def _nodes_of(n: Column, level: int) -> Column:
    return F.ceil(n / RUN**level)


def _runs(rows: DataFrame, kept: Column) -> DataFrame:
    """(tree, n, index, ...) -> (tree, n, run, members): members in order, at most RUN."""
    member = F.array_sort(F.collect_list(F.struct("index", kept.alias("x"))))
    return rows.groupBy("tree", "n", F.floor(F.col("index") / RUN).alias("run")).agg(F.transform(member, lambda m: m["x"]).alias("members"))


@dataclass
class Forest:
    """runs: (tree, n, run, members) of leaves; nodes: (tree, n, level, run, digests) above them; tops: (tree, n, digest)."""

    runs: DataFrame
    nodes: DataFrame
    tops: DataFrame


def forest(leaves: DataFrame) -> Forest:
    """(tree, n, index, leaf: struct with digest) -> the runs, the node table and the top of each tree."""
    runs = checkpoint(_runs(leaves, F.col("leaf")))
    most = runs.agg(F.max("n")).first()[0] or 0
    digests = F.transform("members", lambda m: m["digest"])
    node = runs.select("tree", "n", F.col("run").alias("index"), F.when(F.col("n") == 1, F.get(digests, F.lit(0))).otherwise(of_run(digests)).alias("digest"))
    nodes, tops, level = None, None, 1
    while True:
        done = node.filter(_nodes_of(F.col("n"), level) == 1).select("tree", "n", "digest")
        tops = done if tops is None else tops.unionByName(done)
        if RUN**level >= most:
            break
        above = checkpoint(_runs(node.filter(_nodes_of(F.col("n"), level) > 1), F.col("digest")))
        rows = above.select("tree", "n", F.lit(level).alias("level"), "run", F.col("members").alias("digests"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
        node = above.select("tree", "n", F.col("run").alias("index"), of_run(F.col("members")).alias("digest"))
        level += 1
    if nodes is None:
        nodes = runs.filter("false").select("tree", "n", F.lit(0).alias("level"), "run", digests.alias("digests"))
    return Forest(runs, nodes, tops)


def look_up(trees: Forest, crowns: DataFrame) -> DataFrame:
    """(tree, n, run, members, path, crown): the runs above each run of leaves, from below, and what crowns (tree, n, crown) says of its tree."""
    n, run = F.col("n"), F.col("run")
    # levels above the run of leaves, and one more for the crown
    height = sum((F.when(_nodes_of(n, i) > 1, 1).otherwise(0) for i in range(1, 16)), F.lit(1))
    exploded = trees.runs.select("tree", "n", "run", F.explode(F.sequence(F.lit(1), height)).alias("level"))
    power = F.pow(F.lit(float(RUN)), F.col("level"))
    wanted = exploded.select("tree", "level", F.floor(run / power).alias("up"), F.floor(run / FAN).alias("copy"), "run", F.pmod(F.floor(run / power * RUN), F.lit(RUN)).alias("at"))
    last = F.least((run + 1) * power, F.ceil(n / RUN)) - 1
    copies = F.explode(F.sequence(F.floor(run * power / FAN), F.floor(last / FAN))).alias("copy")
    nothing = crowns.schema["crown"].dataType
    below = trees.nodes.withColumn("crown", F.lit(None).cast(nothing))
    heads = crowns.select("tree", "n", height.alias("level"), F.lit(0).cast("long").alias("run"), F.lit(None).cast("array<string>").alias("digests"), "crown")
    table = below.unionByName(heads).select("tree", "level", F.col("run").alias("up"), copies, "digests", "crown")
    found = wanted.join(table, ["tree", "level", "up", "copy"])
    step = F.when(F.col("digests").isNotNull(), F.struct("level", F.struct("at", "digests").alias("step")))
    paths = found.groupBy("tree", "run").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["step"]).cast(PATH).alias("path"), F.first("crown", ignorenulls=True).alias("crown"))
    return trees.runs.join(paths, ["tree", "run"])


def _each(looked_up: DataFrame, *kept: str) -> DataFrame:
    """A row a leaf: the columns of kept, leaf and path (its own run first; none in a tree of one leaf)."""
    one = looked_up.select("members", "n", "path", *kept, F.posexplode("members").alias("at", "leaf"))
    own = F.struct(F.col("at").cast("long").alias("at"), F.transform("members", lambda m: m["digest"]).alias("digests"))
    path = F.when(F.col("n") == 1, F.array().cast(PATH)).otherwise(F.concat(F.array(own).cast(PATH), "path"))
    return one.select(*kept, "leaf", path.alias("path"))


def merkle_proofs(leaves: DataFrame) -> DataFrame:
    """(source, id, leaf: struct with digest) -> leaf, subroot, root and path: the runs from the leaf's own to the root, each with the place of the leaf's ancestor.

    Trees are the sources, leaves in them are in the order of id; their tops are, in the bytewise order of sources, null first, the leaves of the last tree.
    """
    # the order of strings is that of sources, null first
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), F.col("id"), F.col("leaf.digest").alias("by"), "leaf")
    trees = forest(indexed(rows, "tree", "id", "by"))
    tops = trees.tops.select(F.lit("").alias("tree"), F.struct("tree", "n", "digest").alias("leaf"), F.col("tree").alias("source"))
    last = forest(indexed(tops, "tree", "source").select("tree", "n", "index", "leaf"))
    root = last.tops.select("tree", "n", F.struct(F.col("digest").alias("root")).alias("crown"))
    paths = _each(look_up(last, root), "crown")
    crowns = paths.select("leaf.tree", "leaf.n", F.struct(F.col("leaf.digest").alias("subroot"), "crown.root", "path").alias("crown"))
    each = _each(look_up(trees, checkpoint(crowns)), "crown")
    return each.select("leaf", "crown.subroot", "crown.root", F.concat("path", "crown.path").alias("path"))


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, leaf, subroot, root and path of every row, a leaf being the hash of columns."""
    leaf = digest(*[written(F.col(c)) for c in columns])
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), F.struct(leaf.alias("digest"), F.col(id_col).alias("doc_id")).alias("leaf"))
    return merkle_proofs(rows).select("leaf.doc_id", F.col("leaf.digest").alias("leaf"), "subroot", "root", "path")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    fields = [written(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    changed = F.when(tampered, digest(*fields, written(F.translate("text", UPPER, LOWER))))
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("source", F.col("doc_id").alias("id"), F.struct(digest(*fields, written(F.col("text"))).alias("digest"), "doc_id", changed.alias("changed")).alias("leaf"))
    proofs = merkle_proofs(rows).withColumn("folded_root", fold(F.coalesce("leaf.changed", "leaf.digest"), F.col("path")))
    return proofs.select("leaf.doc_id", F.col("leaf.digest").alias("leaf"), "subroot", "root", of_run(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


def _sql(levels: int = 4) -> str:
    """SQL of op12: the tables of nodes a level at a time, for sources and for their tops, up to 16^levels rows a source."""
    crc = crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")
    fields = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    tables = [
        f"base AS (SELECT row_number() OVER () AS r, coalesce('=' || source, '') AS tree, doc_id, sha256({fields} || {_field('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({fields} || {_field(f'translate(text, {UPPER!r}, {LOWER!r})')}) END AS changed FROM documents)",
        "s0 AS (SELECT r, tree, doc_id, leaf, coalesce(changed, leaf) AS other, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d FROM base)",
    ]

    def grow(x: str) -> None:
        for k in range(levels):
            tables.append(f"{x}{k + 1} AS (SELECT tree, i // 16 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {x}{k} WHERE tree IN (SELECT tree FROM {x}{k} GROUP BY tree HAVING count(*) > 1) GROUP BY tree, i // 16)")

    grow("s")
    nodes = " UNION ALL ".join(f"SELECT {k} AS k, tree, i, d FROM s{k}" for k in range(levels + 1))
    tables.append(f"sn AS ({nodes})")
    tables.append("t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, tree AS source FROM (SELECT tree, arg_max(d, k) AS d FROM sn GROUP BY tree))")
    grow("t")
    nodes = " UNION ALL ".join(f"SELECT {k} AS k, tree, i, d FROM t{k}" for k in range(levels + 1))
    tables.append(f"tn AS ({nodes})")
    # f: the folded digest so far, p: the siblings so far
    tables.append("f0 AS (SELECT r, tree, i, other AS f, '' AS p FROM s0)")

    def climb(x: str, begin: int, node: str) -> int:
        for k in range(levels):
            run = f"(SELECT k.r, string_agg(CASE WHEN n.i = k.i THEN k.f ELSE n.d END, '' ORDER BY n.i) AS all_of, coalesce(string_agg(n.d, '' ORDER BY n.i) FILTER (n.i != k.i), '') AS beside FROM f{begin + k} k JOIN {x}{k} n ON n.tree = {node} AND n.i // 16 = k.i // 16 WHERE {node} IN (SELECT tree FROM {x}{k} GROUP BY tree HAVING count(*) > 1) GROUP BY k.r)"
            tables.append(f"f{begin + k + 1} AS (SELECT f.r, f.tree, f.i // 16 AS i, coalesce(sha256(u.all_of), f.f) AS f, f.p || coalesce(u.beside, '') AS p FROM f{begin + k} f LEFT JOIN {run} u USING (r))")
        return begin + levels

    at = climb("s", 0, "k.tree")
    tables.append(f"f{at + 1} AS (SELECT f.r, f.tree, t.i, f.f, f.p FROM f{at} f JOIN t0 t ON t.source = f.tree)")
    at = climb("t", at + 1, "''")
    return f"""WITH {', '.join(tables)}
    SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified
    FROM s0 JOIN (SELECT tree, arg_max(d, k) AS subroot FROM sn GROUP BY tree) USING (tree) CROSS JOIN (SELECT arg_max(d, k) AS root FROM tn) JOIN (SELECT r, f, p FROM f{at}) USING (r)"""


OP12_SQL = _sql()
