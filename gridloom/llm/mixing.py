r"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions are used.  The sources' totals form a table with one
row per source; the water level is found on it with running sums over the
sources in the order in which they hit their caps, which gives the fixpoint of
"clamp, then share the excess by weight" at once.  A source's target is taken
as floor(target / size) whole repetitions of all its documents plus a part of
one repetition: documents in a seeded order until the target is reached, the
last of them in part.  Where that order stops is found on sums per hash
bucket, level by level: of each source's 4096 buckets at most, the one in which
it stops, of that one's 4096 again, and so on until a bucket holds few
documents.  So no task ever sees a source as a whole, a window never more than
4096 sums or about as many documents of a source, and texts are never shuffled.
The water level is found in one task, from one row per source.

Defined cases: a null source is a source of its own and comes last; a null or
blank text has size 0 and is taken 0 words; rows with equal doc_id (or null
ids) share one place in the seeded order, and if the order stops there, each
takes the same share, rounded down; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import any_names, cut, small

#: Weights by the sources' order, total share of all sizes, most epochs, seed.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1:"
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source that share a bucket of the last level, about; hex digits of the place that a level looks at (16**3 buckets).
PER_BUCKET, DIGITS = 4096, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """The document's place in the seeded order, as hex digits."""
    return F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> also weight, target: min(cap, level * weight), summing to share of all if the caps allow."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    everything = Window.partitionBy()
    x = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_epochs).cast("double")).withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("left", F.col("budget") - before).withColumn("rest", rest)
    full = F.col("left") * F.col("weight") / F.col("rest") >= F.col("cap")
    # every source up to the last full one is at its cap; the first one that isn't sets the level
    x = x.withColumn("open", (~full).cast("int")).withColumn("opened", F.max("open").over(by_fill.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.when(F.col("opened") == 1, F.struct("left", "rest"))
    level = F.first(first, ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("level", level)
    target = F.when(F.col("opened") == 0, F.col("cap")).otherwise(F.col("level.left") * F.col("weight") / F.col("level.rest"))
    return x.select("source", "source_size", "weight", target.alias("target"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes: doc_id, source, size, place; sources: source, source_size, target, whole, stop, share, of).

    A document is taken whole * size words, plus size if its place is before
    `stop`, plus size * share / of, rounded down, if it is at `stop`.
    """
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = cut(d.withColumn("place", place(F.col("doc_id"))))
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    seen = totals.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("n")).first()
    depth = 0
    while 16 ** (DIGITS * depth) * PER_BUCKET < (seen["most"] or 0):
        depth += 1
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).cast("long")
    levels = water_fill(totals.select("source", "source_size")).withColumn("whole", whole)
    levels = cut(levels.withColumn("extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    # where a source's order stops: a prefix of places, with the words still to take there
    stops = levels.filter("extra > 0").select(F.col("source").alias("s"), F.lit("").alias("prefix"), F.col("extra").alias("open"))

    def within(known: int) -> DataFrame:
        same = F.col("source").eqNullSafe(F.col("s"))
        return sizes.join(small(stops, seen["n"]), same & (F.substring("place", 1, known) == F.col("prefix")) if known else same)

    for level in range(1, depth + 1):
        sums = within(DIGITS * (level - 1)).groupBy("s", F.substring("place", 1, DIGITS * level).alias("prefix"), "open").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("s").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        stops = sums.filter((F.col("before") < F.col("open")) & (F.col("open") <= F.col("before") + F.col("words")))
        stops = cut(stops.select("s", "prefix", (F.col("open") - F.col("before")).alias("open")))
    inside = within(DIGITS * depth)
    inside = inside.groupBy("s", "place", "open").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    inside = inside.filter((F.col("before") < F.col("open")) & (F.col("open") <= F.col("before") + F.col("words")))
    ends = inside.select("s", F.col("place").alias("stop"), (F.col("open") - F.col("before")).alias("share"), F.col("words").alias("of"))
    sources = levels.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "weight", "extra")
    return sizes, small(cut(sources), seen["n"])


def taken(size: Column, at: Column) -> Column:
    part = F.when(F.col("stop").isNull() | (at > F.col("stop")), F.lit(0)).when(at < F.col("stop"), size).otherwise(F.floor(size * F.col("share") / F.col("of")))
    return (F.col("whole") * size + part).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for each document."""
    sizes, sources = plan(docs)
    s = sources.withColumnRenamed("source", "s")
    joined = sizes.join(s, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source_size", "target", taken(F.col("size"), F.col("place")).alias("taken"), "source")


@any_names
def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken whole, and its first words where a repetition is a part of one."""
    names = docs.columns
    _, sources = plan(docs)
    s = sources.select(*[F.col(c).alias(f"__{c}") for c in sources.columns])
    x = docs.withColumn("__size", word_count(F.col("text"))).join(s, F.col("source").eqNullSafe(F.col("__source")))
    at = place(F.col("doc_id"))
    own = F.floor(F.col("__size") * F.col("__share") / F.col("__of")).cast("int")
    copies = F.col("__whole") + F.when(at < F.col("__stop"), 1).otherwise(0)
    part = F.when((at == F.col("__stop")) & (own > 0), own).otherwise(F.lit(0))
    x = x.withColumn("__copies", copies.cast("int")).withColumn("__part", part.cast("int"))
    wholes = F.array_repeat(F.lit(-1), F.col("__copies"))
    # a plan of 0 repetitions drops the row; a text without words is kept once, as it has no words to count
    wholes = F.when(F.col("__size") == 0, F.array(F.lit(-1))).otherwise(F.concat(wholes, F.when(F.col("__part") > 0, F.array("__part")).otherwise(F.array().cast("array<int>"))))
    x = x.withColumn("__take", F.explode(wholes))
    whole_text = F.col("__take") < 0
    cut_text = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.col("__take"), F.lit(1))), " ")
    x = x.withColumn("text", F.when(whole_text, F.col("text")).otherwise(cut_text))
    if "n_chars" in names:
        x = x.withColumn("n_chars", F.when(whole_text, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return x.select(*names)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, CAST(source_size * 2 AS DOUBLE) AS cap,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight,
         CAST(SUM(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget
  FROM s),
f AS (
  SELECT *, budget - COALESCE(SUM(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         SUM(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         row_number() OVER o AS nth
  FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
l AS (SELECT MIN(nth) AS nth FROM f WHERE NOT lft * weight / rest >= cap),
t AS (
  SELECT f.source, f.source_size,
         CASE WHEN l.nth IS NULL OR f.nth < l.nth THEN f.cap ELSE g.lft * f.weight / g.rest END AS target
  FROM f CROSS JOIN l LEFT JOIN f g ON g.nth = l.nth),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.whole,
         CAST(round(e.target) AS BIGINT) - e.whole * e.source_size AS extra,
         CAST(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
         CAST(SUM(d.size) OVER (PARTITION BY d.source, d.place) AS BIGINT) AS own
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + CASE WHEN extra <= upto - own THEN 0 WHEN extra > upto THEN size
            WHEN own = 0 THEN 0 ELSE floor(size * (extra - (upto - own)) / own) END AS BIGINT) AS taken, source
FROM c
"""
