"""Mixing sources to target weights, in DataFrame operations only.

Sizes are added up per source; shares of the wanted total by weight, stopped at `max_repeat` times a
source's size, give targets; target / size is a source's repetition rate. Every document is taken
floor(rate) times and once more by a Bernoulli draw with the probability of the fraction f: its hash u, turned
by j / TURNS around the unit circle, is below f. Each turn j is such a draw of all documents; a source takes
the turn whose sum of words comes nearest its target, so few documents or a few very long ones do not throw
it off. The choice reads ids and sizes alone, and the copies follow from a document's own id: texts
are never sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, materialize, own_names, settled, table

WORD = r"[^\x20\x09-\x0D]+"
TURNS = 16
SEED = "mix-1"
#: The fixed weights of the query, repeated along the sources in order of their names.
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MAX_REPEAT = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def _draw() -> Column:
    """[0, 1) from the first 32 bits of MD5 of a row's id, or of its text where it has none."""
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), id_)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _copies(draw: Column, rate: Column, turn: Column) -> Column:
    """floor(rate), and one more if the turned draw is below the fraction."""
    at = draw + turn / F.lit(float(TURNS))
    return (F.floor(rate) + ((at - F.floor(at)) < (rate - F.floor(rate))).cast("int")).cast("long")


def targets(sources: DataFrame, total_share: float = TOTAL, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sources(source_key, weight, source_size), one row a source, with its `target`.

    With L such that sum(min(L * weight, cap)) is the wanted total, the target is min(L * weight, cap):
    what giving the excess over caps to the others by weight comes to. L follows from running sums in
    the order of cap / weight. One row a source is ordered here, never documents.
    """
    caps = sources.withColumn("cap", F.col("source_size") * max_repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    w = Window.orderBy("ratio", "source_key")
    whole = Window.partitionBy()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * F.lit(total_share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the first source in this order that its share does not fill sets the level of all after it
    caps = caps.withColumn("level", level).withColumn("free_level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(whole)["level"])
    target = F.when(F.col("free_level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("free_level") * F.col("weight")))
    return caps.withColumn("target", target).drop("cap", "ratio", "level", "free_level")


def cycle_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`weight` by the place of each source in order of code points, the null source last."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int")))


def mixture_plan(docs: DataFrame, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): a light row (doc_id, __key, __size, __draw) for every row of docs, and a row for every
    source: __key, __source_size, __target, __rate and __turn. Both are in shared storage."""
    light = docs.select("doc_id", _key().alias("__key"), F.col("source").alias("__source"), word_count(F.col("text")).alias("__size"), _draw().alias("__draw"))
    light = materialize(light, "mix-sizes")
    sources = light.groupBy("__key").agg(F.first("__source").alias("source"), F.sum("__size").alias("source_size"))
    sources = cycle_weights(sources) if weights is None else sources.join(weights, sources["source"].eqNullSafe(weights["source"])).drop(weights["source"])
    plan = targets(sources.withColumnRenamed("__key", "source_key"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = materialize(plan.select(F.col("source_key").alias("__key"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), rate.alias("__rate")), "mix-rates")
    sums = [F.sum(F.col("__size") * _copies(F.col("__draw"), F.col("__rate"), F.lit(j))).alias(f"__s{j}") for j in range(TURNS)]
    taken = join_checked(light, plan, "__key").groupBy("__key").agg(*sums)
    off = F.array(*[F.struct(F.abs(F.col(f"__s{j}") - F.col("__target")).alias("off"), F.lit(j).alias("turn")) for j in range(TURNS)])
    turned = materialize(plan.join(taken, "__key").withColumn("__turn", F.array_min(off)["turn"]).drop(*[f"__s{j}" for j in range(TURNS)]), "mix-plan")
    return light.drop("__source"), turned


def repetitions(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, __size, __source_size, __target and __copies for every row of docs(doc_id, text, source).

    weights: (source, weight), by default WEIGHTS in turn. Null and empty texts have size 0; long texts are
    counted whole. A source without words has target 0 and no copies. Rows with null source are a
    source of their own. Rows of one doc_id, and rows without one that are alike in text, draw alike. Of turns
    that come equally near the first is taken. An empty table gives no rows; other columns are not read.
    """
    light, plan = mixture_plan(docs, weights)
    rows = join_checked(light, plan, "__key")
    return rows.select("doc_id", "__size", "__source_size", "__target", _copies(F.col("__draw"), F.col("__rate"), F.col("__turn")).alias("__copies"))


def mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The mixture: rows of docs with all their columns, each as often as repetitions() says."""

    def run(d: DataFrame) -> DataFrame:
        plan = settled(lambda: mixture_plan(d, weights)[1], "mix-turns")
        rows = join_checked(d.withColumn("__key", _key()), plan.select("__key", "__rate", "__turn"), "__key")
        copies = _copies(_draw(), F.col("__rate"), F.col("__turn"))
        return rows.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))

    return own_names(docs, ("doc_id", "text", "source"), run)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetitions(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE('s' || source, 'n') AS k, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || COALESCE(doc_id::VARCHAR, md5(COALESCE(text, '')))), 1, 8))::BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM documents),
s AS (SELECT k, min(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
c AS (SELECT *, source_size * 2 AS cap, (source_size * 2)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - COALESCE(sum(cap) OVER o, 0)::DOUBLE)
              / (sum(weight) OVER () - COALESCE(sum(weight) OVER o, 0))::DOUBLE AS level
      FROM c WINDOW o AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (ratio, k)) AS free_level FROM l WHERE level < ratio),
t AS (SELECT k, source_size, CASE WHEN free_level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, free_level * weight) END AS target
      FROM l LEFT JOIN f ON TRUE),
r AS (SELECT doc_id, size, source_size, target, d.k, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
      FROM d JOIN t ON d.k = t.k),
n AS (SELECT *, j, (floor(rate) + CASE WHEN (draw + j / 16.0::DOUBLE) - floor(draw + j / 16.0::DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM r CROSS JOIN (SELECT unnest(range(16)) AS j)),
o AS (SELECT k, j, abs(sum(size * copies)::DOUBLE - max(target)) AS off FROM n GROUP BY k, j),
b AS (SELECT k, arg_min(j, (off, j)) AS j FROM o GROUP BY k)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM n JOIN b ON n.k = b.k AND n.j = b.j
"""
