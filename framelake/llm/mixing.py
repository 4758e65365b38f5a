"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output over
its share of the input. A document's count is the Poisson quantile, at that
mean, of a uniform number hashed from seed, key and text; at a mean above
``DRAW_RATE``, the sum of several such counts of equal means, of independent
hashes. It is exploded by its count, and all copies are shuffled by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: A source table of at most so many rows is broadcast (about 10 MB with its cumulative probabilities).
BROADCAST_SOURCES = 20_000
SALTS = 64
#: The greatest mean of one draw: there exp(-mean) is still exact enough. A sum of Poisson counts is a Poisson count.
DRAW_RATE = 200.0


def hashed(*parts: Column) -> Column:
    """The MD5 of the parts; null parts count as the text ``-``."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    return F.conv(F.substring(hashed(*parts), 1, 13), 16, 10).cast("bigint").cast("double") / float(2**52)


def cumulative(rate: Column) -> Column:
    """P(X <= i) for i = 0, 1, ... up to the mean plus 12 deviations and 20: beyond it is 1 in double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("sums"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * rate / i
        return F.struct(term.alias("term"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + term)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), first, step)["sums"]


def mixing_rates(docs: DataFrame, source: str, weights: dict[str, float] | None, exponent: float, size: float) -> tuple[DataFrame, int]:
    """Per source (null is one too): __mix_docs, rate, __mix_draws, __mix_cdf (of one draw); and how many sources there are.

    ``weights`` name target shares (others get none); else a source's target is
    its count to the power ``exponent``. ``size`` is the output's expected rows
    over the input's. A rate is split into draws of equal means of at most 200.
    """
    counts = docs.groupBy(F.col(source).cast("string").alias("__mix_key")).agg(F.count("*").alias("__mix_docs"))
    if weights is None:
        target = F.pow(F.col("__mix_docs").cast("double"), F.lit(float(exponent)))
    else:
        given = [F.when(F.col("__mix_key") == F.lit(k), F.lit(float(v))) for k, v in weights.items()]
        target = F.coalesce(*given, F.lit(0.0)) if given else F.lit(0.0)
    whole = counts.withColumn("target", target)
    totals = whole.agg(F.sum("target").alias("targets"), F.sum("__mix_docs").alias("docs"), F.count("*").alias("sources")).first()
    share = F.col("target") / F.lit(float(totals.targets)) if totals.targets else F.lit(0.0)
    rate = share * F.lit(float(size) * (totals.docs or 0)) / F.col("__mix_docs")
    rated = whole.select("__mix_key", "__mix_docs", rate.alias("rate"))
    rated = rated.withColumn("__mix_draws", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("rate") / DRAW_RATE)))
    return rated.withColumn("__mix_cdf", cumulative(F.col("rate") / F.col("__mix_draws"))), totals.sources


def _quantile(u: Column) -> Column:
    return F.size(F.filter("__mix_cdf", lambda p: p <= u))


def _further(identity: tuple[Column, ...]) -> Column:
    """The sum of all draws after the first; the identity is hashed once for them."""
    turns = F.sequence(F.lit(1).cast("bigint"), F.col("__mix_draws") - 1)
    return F.transform(F.array(hashed(*identity)), lambda h: F.aggregate(turns, F.lit(0), lambda n, j: n + _quantile(uniform(F.lit("draw"), h, j))))[0]


def replicated(
    spark: SparkSession, docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: dict[str, float] | None = None,
    exponent: float = 0.7, size: float = 1.0, seed: int = 17, partitions: int | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as often as its Poisson count, in a global shuffle; with mix_rate, mix_copy (from 0) and mix_order.

    The count depends on seed, key and text only, so a task that is run again
    gives the same copies; repeated rows get equal counts. A null source is a
    source, a null key or text is hashed as ``-``. Empty tables give no rows.
    Columns of the input stay, and those named mix_rate, mix_copy or mix_order
    are replaced. Rates meet the documents by a broadcast when there are at most
    20,000 sources, else by a join that deals each source over 64 salts. No rate
    is too high; a document's copies must fit into one array.
    """
    work = Workspace(spark, "mixing")
    rates, sources = mixing_rates(docs, source, weights, exponent, size)
    rates = work.stage(rates, "rates").withColumnRenamed("rate", "mix_rate")
    names = [c for c in docs.columns if c not in ("mix_rate", "mix_copy", "mix_order")]
    identity = (F.lit(seed), F.col(key), F.col(text))
    rows = docs.select(*names, F.col(source).cast("string").alias("__mix_source"))
    if sources <= BROADCAST_SOURCES:
        rated = rows.join(F.broadcast(rates), F.col("__mix_source").eqNullSafe(F.col("__mix_key")))
    else:
        salt = F.pmod(F.xxhash64(*identity), F.lit(SALTS))
        dealt = rates.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        rated = rows.withColumn("__mix_s", salt).join(dealt, F.col("__mix_source").eqNullSafe(F.col("__mix_key")) & (F.col("__mix_s") == F.col("__mix_salt")))
    u = uniform(*identity)
    counted = rated.withColumn("__mix_u", u).withColumn("__mix_n", _quantile(F.col("__mix_u")) + F.when(F.col("__mix_draws") > 1, _further(identity)).otherwise(0))
    copies = counted.where("__mix_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("__mix_n") - 1)))
    shuffled = copies.withColumn("mix_order", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col(key).cast("string"), F.col("mix_copy").cast("string"), F.md5(F.coalesce(F.col(text), F.lit("-"))))))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shuffled.select(*names, "mix_rate", "mix_copy", "mix_order").repartition(n, "mix_order").sortWithinPartitions("mix_order")


def expected_copies(rate: float, u: float) -> int:
    """The Poisson quantile in plain Python, for tests."""
    n, term = 0, math.exp(-rate)
    total = term
    while total <= u and n < rate + 12 * math.sqrt(rate) + 20:
        n += 1
        term = term * rate / n
        total += term
    return n
