"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's repetition rate is its target share of the mixture divided by its share of the corpus, in characters (an
empty text counts as one). A document's number of copies is a Poisson variable with that mean: a number in [0, 1)
hashed from the seed and doc_id is inverted on the cumulative distribution, which is worked out once a source. Rates over
256 are split into equal parts and the parts' draws added, so the tables stay short. Documents are exploded by
their count and dealt out by a hash of seed, doc_id and copy, ordered by it within partitions: a global shuffle in one
exchange, whose keys are even whatever the source sizes.

Targets are given as weights by source, or follow from the source sizes raised to `temperature` (1 keeps the corpus as
it is, 0 makes sources equal).

Defined results: null sources are one source, null texts count as empty, repeated rows are drawn alike, a source without
a given weight has rate 0, an empty table gives no rows. Columns `copy` and `shuffle_key` are appended; input columns
of those names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import unused
from tidemark.session import cut

SEED, TEMPERATURE, EPOCHS = 42, 0.5, 1.0
#: Mean of one draw at most; larger rates are sums of draws.
PART_MEAN = 256
#: Source tables up to so many rows are broadcast; the number of rows is counted first. Larger ones are joined by salted keys.
BROADCAST_ROWS, SALTS = 10_000, 32


def hashed_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(src, size, rate): mean copies of a document of each source; pre-aggregated, so a large source costs one row a task."""
    sized = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), F.greatest(F.coalesce(F.char_length(text_col), F.lit(0)), F.lit(1)).cast("long").alias("n"))
    sizes = cut(sized.groupBy("src").agg(F.sum("n").alias("size")))
    if weights is None:
        weighted = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))) if weights else F.create_map().cast("map<string,double>")
        weighted = sizes.withColumn("w", F.coalesce(F.try_element_at(given, F.col("src")), F.lit(0.0)))
    all_ = weighted.agg(F.sum("w").alias("sum_w"), F.sum("size").alias("total"))  # one row
    share = F.when(F.col("sum_w") > 0, F.col("w") / F.col("sum_w")).otherwise(F.lit(0.0))
    return weighted.join(F.broadcast(all_)).select("src", "size", (share * F.col("total") * F.lit(epochs) / F.col("size")).alias("rate"))


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k from 0 to far beyond the mean, as an array."""
    steps = F.sequence(F.lit(1), F.ceil(mean + F.sqrt(mean) * 12 + 24).cast("int"))
    start = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("table"))

    def add(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(mean) - F.log(k.cast("double"))
        return F.struct(log_p.alias("log_p"), (acc["sum"] + F.exp(log_p)).alias("sum"), F.concat(acc["table"], F.array(acc["sum"] + F.exp(log_p))).alias("table"))

    return F.when(mean > 0, F.aggregate(steps, start, add, lambda acc: acc["table"])).otherwise(F.array(F.lit(1.0)))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs replicated to the target mixture and shuffled: all columns, `copy` from 1, `shuffle_key`."""
    plain = docs.drop("copy", "shuffle_key")
    src, parts, table, salt, u, n = unused(plain, "src", "parts", "table", "salt", "u", "n")
    part = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    rates = source_rates(docs, weights, temperature, epochs, source_col, text_col)
    rates = cut(rates.select(F.col("src").alias(src), part.alias(parts), poisson_table(F.col("rate") / part).alias(table)))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if rates.count() <= BROADCAST_ROWS:
        joined = plain.join(F.broadcast(rates), source == F.col(src))
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = plain.join(salted, (source == F.col(src)) & (F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int") == F.col(salt)))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    one = lambda j: F.size(F.filter(table, lambda p: p <= hashed_unit(F.lit(str(seed)), key, j.cast("string"))))
    draw = hashed_unit(F.lit(str(seed)), key, F.lit("1"))
    single = F.size(F.filter(table, lambda p: p <= F.col(u)))
    drawn = joined.withColumn(u, draw).withColumn(n, F.when(F.col(parts) == 1, single).otherwise(F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda a, j: a + one(j))))
    copies = drawn.where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), key, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    # Rows of one id, or of none, have one key and are dealt apart by their texts.
    dealt = copies.withColumn("shuffle_key", order).repartition("shuffle_key", F.xxhash64(text_col)).sortWithinPartitions("shuffle_key")
    return dealt.select(*plain.columns, F.col("copy").cast("long").alias("copy"), "shuffle_key")


#: The query mix_sources(documents) in DuckDB's SQL.
MIX_SQL = f"""
WITH d AS (SELECT *, coalesce(source, '') AS src, greatest(coalesce(length(text), 0), 1) AS n FROM documents),
s AS (SELECT src, sum(n)::DOUBLE AS size FROM d GROUP BY src),
r AS (SELECT src, pow(size, {TEMPERATURE}) / sum(pow(size, {TEMPERATURE})) OVER () * sum(size) OVER () * {EPOCHS} / size AS rate FROM s),
p AS (SELECT src, rate / greatest(ceil(rate / {PART_MEAN}), 1) AS mean, greatest(ceil(rate / {PART_MEAN}), 1)::INT AS parts FROM r),
k AS (SELECT src, parts, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS cdf
      FROM (SELECT src, parts, mean, unnest(generate_series(0, ceil(mean + sqrt(mean) * 12 + 24)::INT)) AS k FROM p)),
t AS (SELECT src, any_value(parts) AS parts, list(cdf) AS cdf FROM k GROUP BY src),
c AS (SELECT d.*, list_sum(list_transform(generate_series(1, parts), lambda j: len(list_filter(cdf, lambda q: q <=
        ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || j::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0))))::BIGINT AS copies
      FROM d JOIN t USING (src)),
x AS (SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, copies))::BIGINT AS copy FROM c)
SELECT *, ('0x' || substr(md5('{SEED}/order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key FROM x
"""
