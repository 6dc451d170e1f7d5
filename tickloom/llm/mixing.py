"""Mixing sources to target weights by hash-threshold histograms.

Each source has a weight and a budget of words, its target.  A source is taken
whole as often as its target allows, and the rest of the target by a threshold
on a 36-bit hash of doc_id: the documents at or below it are taken once more.
The threshold isn't found by sorting.  Words are summed by source and by the
hash's first 12 bits; the bucket in which the budget runs out is refined by the
next 12 bits, and that one's by the last 12.  Budgets nest: a larger target only
moves the threshold up.

Targets: sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...;
their targets share all words.  A target stops at `MOST` times its source's
words, and the excess is shared again by weight: target = min(MOST * size,
level * weight), for the one level that spends everything.

Defined cases: a null text has no words and is taken 0 times over; a null doc_id
hashes like an empty text; documents that share an id are taken alike; a null
source is a source.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, settled, small, table

#: No document is taken more often than this.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Hash bits of each level of histograms, and the levels.
BITS = 12
LEVELS = 3


def words(text: str | Column) -> Column:
    """The number of words in a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def hashed(doc_id: str) -> Column:
    """36 bits: the first nine hexadecimal digits of the id's MD5."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target, from source and size (partial sums by source are enough).

    Sources are few next to documents: the window without a key runs over their sums.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    total = total.withColumn("weight", weight.cast("long")).withColumn("most", MOST * F.col("source_size"))
    # Sources reach their limit in the order of most / weight.  Once those up to one
    # have, the others share what is left; the level is the first at which the next one doesn't.
    reach = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(reach), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(reach), F.lit(0))
    total = total.withColumn("level", left / weights)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(every)
    target = F.least(F.col("most").cast("double"), level * F.col("weight"))
    return total.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """source, times and threshold: each document is taken `times`, and once more if its
    hash is at or below the threshold.  rows: source, size, hash; goals: from `targets`.

    The taken words are as near to the target as whole documents in hash order come:
    the last hash is taken if that leaves the smaller gap.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = goals.withColumn("times", whole.cast("long"))
    state = state.withColumn("left", F.col("target") - F.col("times") * F.col("source_size"))
    # below: hashes under it are taken; inside: the first bits of the bucket to refine.
    state = settled(state.select("source", "times", "left", F.lit(0).cast("long").alias("below")))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        width = 1 << (BITS * (LEVELS - level))
        bucket = F.shiftright("hash", shift)
        s = state.select(F.col("source").alias("own"), "below")
        inside = rows.join(small(s), rows["source"].eqNullSafe(s["own"])) if level else rows.withColumn("below", F.lit(0).cast("long"))
        inside = inside.where((F.col("hash") >= F.col("below")) & (F.col("hash") < F.col("below") + width))
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("n").over(upto)).withColumnRenamed("source", "own")
        both = state.join(sums, state["source"].eqNullSafe(sums["own"]), "left")
        # The first bucket that doesn't fit whole is refined; what is before it is taken.
        over = F.when(F.col("upto") > F.col("left"), F.struct("bucket", "upto"))
        fits = F.when(F.col("upto") <= F.col("left"), F.col("upto"))
        nearer = (F.col("over.upto") + F.col("spent") < 2 * F.col("left")).cast("long")
        state = settled(
            both.groupBy("source", "times", "left", "below")
            .agg(F.min(over).alias("over"), F.coalesce(F.max(fits), F.lit(0)).alias("spent"))
            .select(
                "source",
                "times",
                (F.col("left") - F.col("spent")).alias("left"),
                F.when(F.col("over").isNull(), F.col("below") + width).otherwise(F.shiftleft("over.bucket", shift) + (nearer if not shift else 0)).alias("below"),
            )
        )
    return state.select("source", "times", (F.col("below") - 1).alias("threshold"))


def mix(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns `carry` with the struct `mix`: size, source_size, target, times (how often
    the mix takes the document) and taken (the words).

    Sizes and hashes are computed once and kept in the shared folder, with the
    columns that are carried.
    """
    names = {c: f"c{i}" for i, c in enumerate(carry)}
    rows = table(
        docs.select(
            *[F.col(f"`{c}`").alias(a) for c, a in names.items()],
            F.col("source").alias("source"),
            words(F.col(f"`{text}`")).alias("size"),
            hashed("doc_id").alias("hash"),
        ),
        "mixing",
    )
    light = rows.select("source", "size", "hash")
    goals = settled(targets(light))
    cuts = thresholds(light, goals)
    plan = goals.join(cuts.withColumnRenamed("source", "cut_of"), goals["source"].eqNullSafe(F.col("cut_of"))).drop("cut_of")
    plan = small(settled(plan.withColumnRenamed("source", "plan_of")))
    times = F.least(F.col("times") + (F.col("hash") <= F.col("threshold")).cast("long"), F.lit(MOST).cast("long"))
    out = rows.join(plan, rows["source"].eqNullSafe(plan["plan_of"]), "left")
    return out.select(
        *[F.col(a).alias(c) for c, a in names.items()],
        F.struct("size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken")).alias(fresh(carry, "mix")),
    )


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(docs, ["doc_id"]).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def taken(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their columns; one taken several times is repeated."""
    name = fresh(docs.columns, "mix")
    rows = mix(docs, docs.columns)
    # A sequence from 1 would count down to 0: those taken no time are dropped first.
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)["times"]))
    return rows.where(F.col(name)["times"] > 0).select(*[f"`{c}`" for c in docs.columns], repeats.alias("mix_repeat")).drop("mix_repeat")


#: The mix of `documents` in DuckDB's SQL: budgets run out in the order of the hash.
PLAN_SQL = r"""
WITH base AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS hash
  FROM {docs}),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS most,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sums),
levels AS (
  SELECT a.source, a.source_size, a.most, a.weight,
         (SELECT sum(source_size) - coalesce(sum(most) FILTER (WHERE most * a.weight < a.most * weight), 0) FROM weighed)::DOUBLE
         / (SELECT sum(weight) - coalesce(sum(weight) FILTER (WHERE most * a.weight < a.most * weight), 0) FROM weighed)::DOUBLE AS level
  FROM weighed a),
goals AS (
  SELECT source, source_size,
         least(most::DOUBLE, (SELECT max(level) FROM levels WHERE level * weight <= most) * weight) AS target
  FROM levels),
counted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM goals),
spent AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, g.times,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(b.size) OVER (PARTITION BY b.source, b.hash) AS own,
         g.target - g.times * g.source_size AS budget
  FROM base b JOIN counted g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * least(times + CASE WHEN upto <= budget OR upto + (upto - own) < 2 * budget THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM spent
"""
