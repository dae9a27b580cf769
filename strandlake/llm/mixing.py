"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Null texts have size 0; a null source is a source like any other and comes last. Rows with a null id
and repeated rows take part (rows that are equal in id and size are interchangeable). Other columns are
ignored. Sources without words have target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import stored, table
from strandlake.operators.ranks import global_rank

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 17
WORD = "[^\\x20\\x09-\\x0D]+"
BUCKET_ROWS = 4096


def words(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which min(cap, level * weight) sums to ``total``.

    Each round clamps the sources that the level takes over their cap and shares what they leave among the
    others by weight. The state is one number, each round one aggregation over the sources.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        r = sources.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("full"),
                        F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open")).first()
        if r["n"] == clamped or not r["open"]:
            return level if r["open"] else float("inf")
        level, clamped = (total - r["full"]) / r["open"], r["n"]


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target: the share of all words, capped at ``epochs`` times the source's own."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "rank")
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(ranked.select("source", "source_size", cycle.alias("weight"), (F.col("source_size") * epochs).alias("cap")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(ranked, share * total)
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def draw(name: str, seed: int) -> Column:
    """A seeded 60-bit number of an id, the same in every run and engine."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def mix(sized: DataFrame, goal: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and taken to rows (doc_id, source, size).

    target / source_size epochs: every document is repeated its whole number of times, and the fraction is
    taken from the source's documents in seeded order until the words are reached; the document at the
    limit is repeated in part. The running sums go through (source, bucket) totals of the seeded order, so
    that no source is sorted in one task.
    """
    n = sized.count()
    buckets = max(16, n // BUCKET_ROWS)
    rows = sized.withColumn("_h", draw("doc_id", seed)).withColumn("_b", F.floor(F.col("_h") / F.lit((1 << 60) / buckets)))
    sums = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target")
    plan = sums.join(goal, sums["_s"].eqNullSafe(goal["_s"])).select(sums["_s"], "_c", "_start", "source_size", "target")
    inner = Window.partitionBy("source", "_b").orderBy("_h", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_s"]) & (rows["_b"] == plan["_c"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.floor("target").cast("long") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), extra - F.col("_start") - F.col("_in")))
    return rows.withColumn("taken", (whole * F.col("size") + part).cast("long")).drop("_h", "_b", "_s", "_c", "_start", "_in")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken; the one at a source's limit is taken whole if over half of it is.

    Documents without words cost nothing and are kept as often as their source is repeated whole (once at
    least). Weights are met over words, so clean documents leave only where their source weighs too much.
    """
    light = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size")))
    goal = targets(light, weights, share, epochs)
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       words().alias("size"))
    taken = mix(rows, goal, seed)
    whole = F.floor(F.col("taken") / F.greatest("size", F.lit(1)))
    part = F.col("taken") - whole * F.col("size")
    times = F.when(F.col("size") > 0, whole + (2 * part > F.col("size")).cast("long")).otherwise(
        F.greatest(F.lit(1), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))))
    return taken.withColumn("_n", times).filter("_n > 0").select(F.explode(F.array_repeat("_row", F.col("_n").cast("int"))).alias("_row")).select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size")))
    return mix(sized, targets(sized)).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT source, source_size, weight, {MOST_EPOCHS} * source_size AS cap,
         row_number() OVER (ORDER BY {MOST_EPOCHS} * source_size / weight, source) AS k
  FROM sources),
levels AS (
  SELECT k, cap, weight,
         ({SHARE} * (SELECT sum(source_size)::BIGINT FROM sources)
          - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
         / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level
  FROM ordered),
chosen AS (SELECT k, level FROM levels WHERE level * weight < cap ORDER BY k LIMIT 1),
goal AS (
  SELECT source, source_size,
         least(cap::DOUBLE, coalesce((SELECT level FROM chosen), 'infinity'::DOUBLE) * weight) AS target
  FROM ordered),
placed AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
         ('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
            AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole
  FROM placed)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM summed
"""
