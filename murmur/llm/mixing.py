"""Mixing sources to target weights: a time-varying curriculum.

Each source's weight schedule is integrated over training time; a document copy's place in its source's
cumulative token demand, inverted through that integral, is its training position, and the copies are
range-sorted by position.

A source's documents are put in a keyed random order (md5 of the id). Running sums over that order are taken
in two levels, (source, bucket) sums first and then inside each bucket, so a source that holds a third of all
rows never meets in one task. Only the table of sources (one row a source) is ever in one task.

Beyond whole epochs a source needs some documents once more. They are taken in the random order too, but those that
are more than a hundredth of what is needed stand behind all others, those of more than a tenth behind these, and those
that are larger than it never come (``tier``): one very long document can't end the taking far from the target.

Defined results: a null text has size 0; null sources are one source, ordered last; documents with equal ids
are ordered by their order of reading; documents of size 0 take part with 0 words; an empty table gives an
empty result. Extra columns are kept by ``mixed_documents`` and ignored by ``curriculum_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.llm.common import WORD, checkpoint

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Weight of a source over training time, as (time, weight) knots joined by lines; sources take them in turn.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def inverse_of_demand(schedule, y: Column) -> Column:
    """The time at which the share y of the schedule's integral has been asked for."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    total, done, branches = sum(areas), 0.0, []
    for (t0, w0), (t1, w1), area in zip(schedule, schedule[1:], areas):
        slope, rest = (w1 - w0) / (t1 - t0), (y - F.lit(done / total)) * F.lit(total)
        inside = (F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * rest) - F.lit(w0)) / F.lit(slope) if slope else rest / F.lit(w0)
        done += area
        branches.append((done / total, F.lit(t0) + inside))
    out = branches[-1][1]
    for upto, value in reversed(branches[:-1]):
        out = F.when(y < F.lit(upto), value).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: (source_key, source_size). Adds rank, weight and target.

    Reshare-until-none-is-above has a closed form: target = least(cap, level * weight), where the level is
    found over the sources in the order of cap / weight.
    """
    by_key, by_ratio = Window.orderBy("source_key"), Window.orderBy("ratio", "source_key")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_key) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    levels = ranked.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - (F.sum("cap").over(upto) - F.col("cap"))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(everything)["level"]
    return levels.withColumn("level", level).select("source_key", "source_size", "rank", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    source, text = F.col(source_col), F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source.cast("string"))).alias("source_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("turn"),
        *more,
    ).withColumn("bucket", F.substring("turn", 1, 3))


def _tiered(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds the source's columns, epochs (copies of every document), over (words needed beyond them) and tier."""
    joined = sized.join(targets, "source_key")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    joined = joined.withColumn("epochs", epochs).withColumn("over", F.col("target") - F.col("epochs") * F.col("source_size"))
    size = F.col("size").cast("double")
    return joined.withColumn("tier", F.when(size * 100 <= F.col("over"), 0).when(size * 10 <= F.col("over"), 1).when(size <= F.col("over"), 2).otherwise(3))


def _before(tiered: DataFrame) -> DataFrame:
    """One row a source and bucket: the words before it in the source's random order, and in that of each tier."""
    upto = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("source_key")
    own = [F.sum(F.when(F.col("tier") == i, F.col("size")).otherwise(0)).alias(f"own{i}") for i in range(4)]
    earlier = [F.sum(f"own{i}").over(upto) - F.col(f"own{i}") for i in range(4)]
    lower = [sum((F.sum(f"own{j}").over(whole) for j in range(i)), F.lit(0)) for i in range(4)]
    tiers = F.array(*[a + b for a, b in zip(lower, earlier)])
    return tiered.groupBy("source_key", "bucket").agg(*own).select("source_key", "bucket", sum(earlier, F.lit(0)).alias("before"), tiers.alias("tier_before"))


def _placed(tiered: DataFrame, buckets: DataFrame, most: float) -> DataFrame:
    """Adds end (where the document ends in its source's random order), extra_end (in that of the tiers) and extra (taken once more)."""
    order, upto = ("turn", "doc_id", "size"), (Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy("source_key", "bucket").orderBy(*order).rowsBetween(*upto)
    within = Window.partitionBy("source_key", "bucket", "tier").orderBy(*order).rowsBetween(*upto)
    return (
        tiered.join(buckets, ["source_key", "bucket"])
        .withColumn("end", F.col("before") + F.sum("size").over(inside))
        .withColumn("extra_end", F.element_at("tier_before", F.col("tier") + 1) + F.sum("size").over(within))
        .withColumn("extra", (F.col("extra_end") <= F.col("over")) & (F.col("epochs") < F.lit(most)))
        .drop("bucket", "before", "tier_before")
    )


def curriculum_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, schedules=SCHEDULES, seed: str = "mix", payload: bool = False) -> DataFrame:
    """One row a document: doc_id, source_key, size, source_size, target, copies, taken, positions (one a copy).

    With payload, a column doc holds all columns of the input. The documents taken once more than the others are
    a prefix of the source's tiered random order that ends at or before the target, and then the one document whose
    size fills the remaining gap best.
    """
    sized = checkpoint(_sized(docs, id_col, text_col, source_col, seed))
    targets = checkpoint(source_targets(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, most))
    tiered = _tiered(sized, targets)
    buckets = checkpoint(_before(tiered))

    placed = _placed(tiered, buckets, most)
    gaps = placed.groupBy("source_key").agg(F.min(F.col("over") - F.when(F.col("extra"), F.col("extra_end")).otherwise(F.lit(0))).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    fills = checkpoint(
        placed.join(gaps, "source_key")
        .filter(~F.col("extra") & (F.col("epochs") < F.lit(most)) & (off < F.col("gap")))
        .groupBy("source_key")
        .agg(F.min(F.struct(off.alias("off"), F.col("turn"), F.col("end"))).alias("fill"), F.first("gap").alias("gap"))
        .select("source_key", "gap", F.col("fill.end").alias("fill_end"))
    )
    if payload:
        whole = _sized(docs, id_col, text_col, source_col, seed, F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
        placed = _placed(_tiered(whole, targets), buckets, most)

    filled = F.coalesce((F.col("end") == F.col("fill_end")) & (F.col("size") > 0), F.lit(False))
    whole_epochs = F.transform(F.sequence(F.lit(0), F.col("epochs")), lambda c: (c * F.col("source_size") + F.col("end") - F.col("size")).cast("double"))
    once_more = F.when(F.col("extra"), F.array((F.col("epochs") * F.col("source_size") + F.col("extra_end") - F.col("size")).cast("double"))).when(filled, F.array(F.col("target") - F.col("gap")))
    starts = F.concat(F.slice(whole_epochs, F.lit(1), F.col("epochs")), F.coalesce(once_more, F.array().cast("array<double>")))

    def position(start: Column) -> Column:
        share_of = F.when(F.col("target") > 0, F.least(F.lit(1.0), (start + F.col("size") / 2) / F.col("target"))).otherwise(F.lit(0.0))
        out = inverse_of_demand(schedules[-1], share_of)
        for i, schedule in enumerate(schedules[:-1]):
            out = F.when(F.col("rank") % len(schedules) == i, inverse_of_demand(schedule, share_of)).otherwise(out)
        return out

    return (
        placed.join(fills, "source_key", "left")
        .withColumn("copies", F.col("epochs") + F.when(F.col("extra") | filled, 1).otherwise(0))
        .withColumn("positions", F.transform(starts, position))
        .select("doc_id", "source_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions", *(["doc"] if payload else []))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The training stream: every copy that the mix takes, with the columns of docs, range-sorted by training position."""
    copies = curriculum_mix(docs, id_col, payload=True, **options).select("doc", F.explode("positions").alias("at"))
    return copies.orderBy("at").select("doc.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents by the production weights, in the order of training; position is the first copy's."""
    mixed = curriculum_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    position = F.when(F.size("positions") > 0, F.round(F.col("positions")[0], 6)).alias("position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", position).orderBy("position", "doc_id")


_POSITION = """CASE rank % 3 WHEN 0 THEN y
    WHEN 1 THEN -0.5 + sqrt(0.25 + 2 * y)
    ELSE 1.5 - sqrt(2.25 - 2 * y) END"""

#: The same mix in DuckDB: the schedules 1, 0.5 + t and 1.5 - t have these inverses.
OP7_SQL = f"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS source_key,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix' || coalesce(doc_id::VARCHAR, '')) AS turn FROM documents),
placed0 AS (
  SELECT *, (sum(size) OVER (PARTITION BY source_key ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS fin,
    (sum(size) OVER (PARTITION BY source_key))::BIGINT AS source_size FROM sized),
sources AS (
  SELECT source_key, source_size, row_number() OVER (ORDER BY source_key) - 1 AS rank,
    CASE (row_number() OVER (ORDER BY source_key) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM (SELECT DISTINCT source_key, source_size FROM placed0)),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source_key, rank, least(cap, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio), 1e300) * weight) AS target FROM levels),
needed AS (
  SELECT p.*, rank, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INTEGER AS epochs,
    target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS beyond
  FROM placed0 p JOIN targets USING (source_key)),
placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source_key ORDER BY CASE WHEN size * 100 <= beyond THEN 0 WHEN size * 10 <= beyond THEN 1 WHEN size <= beyond THEN 2 ELSE 3 END,
    turn, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS extra_fin FROM needed),
marked AS (
  SELECT *, extra_fin <= beyond AND epochs < 2 AS extra,
    min(beyond - CASE WHEN extra_fin <= beyond AND epochs < 2 THEN extra_fin ELSE 0 END) OVER (PARTITION BY source_key) AS gap FROM placed),
fills AS (
  SELECT source_key, arg_min(fin, (abs(size - gap), turn, fin)) AS fill_end FROM marked
  WHERE NOT extra AND epochs < 2 AND abs(size - gap) < gap GROUP BY source_key),
copied AS (
  SELECT m.*, coalesce(fin = fill_end AND size > 0, false) AS filled,
    epochs + CASE WHEN extra OR coalesce(fin = fill_end AND size > 0, false) THEN 1 ELSE 0 END AS copies
  FROM marked m LEFT JOIN fills USING (source_key)),
shares AS (
  SELECT *, CASE WHEN target > 0 THEN least(1.0::DOUBLE, (CASE WHEN epochs > 0 THEN (fin - size)::DOUBLE WHEN filled THEN target - gap ELSE (extra_fin - size)::DOUBLE END + size / 2) / target) ELSE 0.0 END AS y FROM copied)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INTEGER AS copies,
  CASE WHEN copies > 0 THEN round({_POSITION}, 6) END AS position
FROM shares
"""
