"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets the mean repetition rate target mass / own mass. A document's
copy count inverts the Poisson distribution of that mean at a uniform number
taken from a seeded hash of its id, so counts are reproducible, need no state,
and are independent between documents. Copies are then put in one global random
order.

Cases: a null source is a source of its own. Mass is UTF-8 bytes, null texts
weigh nothing. A source without mass, or with weight 0, gets rate 0 and so no
rows. Repeated rows with one id get equal counts. Extra columns pass through;
the operator's own columns (n_copies, copy_no, shuffle_key) replace any of the
same name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage, table

SEED = "mix-1"
EPOCHS = 1.0


def hash_uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of md5(seed:parts)."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... far into the tail; logarithms keep large rates from underflow."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("logp"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        logp = acc["logp"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(logp.alias("logp"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(logp))).alias("cdf"))

    grown = F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]
    return F.when(rate > 0, grown).otherwise(F.array(F.lit(2.0)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """One row per source: its mass and mean repetition rate. Equal weights unless given (unnamed sources: 0)."""
    mass = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")).alias("mass"))
    if weights is None:
        wanted = F.when(F.col("mass") > 0, 1.0).otherwise(0.0)
    else:
        wanted = F.lit(0.0)
        for name, w in weights.items():
            wanted = F.when(F.col("source") == name, float(w)).otherwise(wanted)
        wanted = F.when(F.col("mass") > 0, wanted).otherwise(0.0)
    mass = mass.withColumn("weight", wanted)
    total = mass.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_mass") * F.lit(float(epochs)) / F.col("mass")).otherwise(0.0)
    return mass.join(F.broadcast(total)).select(F.col("source").alias("rate_source"), "mass", rate.alias("rate"))  # total is one row


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Documents repeated to the target weights, in global random order.

    The rates are written out first: the join below then broadcasts them only if
    the written size is under Spark's threshold, and is a split-able shuffle join
    beyond it.
    """
    rates = stage(source_rates(docs, weights, epochs).select("rate_source", poisson_cdf(F.col("rate")).alias("rate_cdf")), "rates")
    docs = docs.drop("n_copies", "copy_no", "shuffle_key")
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col("rate_source")))
    u = hash_uniform(seed, F.col("doc_id"))
    counted = joined.withColumn("n_copies", F.size(F.filter("rate_cdf", lambda c: c <= u))).filter("n_copies > 0").drop("rate_cdf", "rate_source")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy_no"))))
    return keyed.orderBy("shuffle_key", "doc_id", "copy_no")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "n_copies", "copy_no", "shuffle_key")


OP8_SQL = f"""
WITH RECURSIVE mass AS (
  SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS mass FROM documents GROUP BY source),
total AS (SELECT sum(mass) AS all_mass, sum(CASE WHEN mass > 0 THEN 1.0::DOUBLE ELSE 0 END) AS all_weight FROM mass),
rates AS (
  SELECT source, CASE WHEN mass > 0 THEN 1.0::DOUBLE / all_weight * all_mass * {EPOCHS}::DOUBLE / mass ELSE 0 END AS rate FROM mass, total),
cdf(source, rate, k, logp, c) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates WHERE rate > 0
  UNION ALL
  SELECT source, rate, k + 1, logp + ln(rate) - ln((k + 1)::DOUBLE), c + exp(logp + ln(rate) - ln((k + 1)::DOUBLE))
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
tables AS (SELECT source, list(c ORDER BY k) AS steps FROM cdf GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.source,
         len(list_filter(t.steps, lambda x: x <= (('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE))::INTEGER AS n_copies
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, n_copies, copy_no, md5('{SEED}-order:' || doc_id || ':' || copy_no) AS shuffle_key
FROM (SELECT doc_id, source, n_copies, unnest(range(1, n_copies + 1))::INTEGER AS copy_no FROM drawn)
"""
