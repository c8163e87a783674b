"""Tokens and cost per stage. An unknown cost is NULL and stays NULL in every sum; it is never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas import fixed

TOKENS = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")
RATES = dict(zip(TOKENS, ("input", "cache_write", "cache_read", "output")))


def attempts_from_responses(responses: DataFrame) -> DataFrame:
    """One row per billed attempt of each call: exchange_id, stage, seq, requested_model, model, usage.

    A call that fell back lists every attempt; only its first counts as a request. An attempt without
    a model is the requested one, else the one that served the call.
    """
    attempts = F.when(F.size(F.coalesce("usage.iterations", F.array())) > 0, F.col("usage.iterations")).otherwise(
        F.array(F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("model"),
                         *[F.col(f"usage.{t}").alias(t) for t in _order(responses)]))
    )
    rows = responses.select(
        "exchange_id", "stage", "seq", "requested_model", F.col("model").alias("served"),
        F.posexplode(attempts).alias("n", "attempt"),
    )
    return rows.select(
        "exchange_id", "stage", (F.col("seq") * 1000 + F.col("n")).alias("seq"),
        F.coalesce("attempt.model", "requested_model", "served", F.lit("unknown")).alias("model"),
        (F.col("n") == 0).cast("bigint").alias("requests"),
        *[F.coalesce(f"attempt.{t}", F.lit(0)).cast("bigint").alias(t) for t in TOKENS],
        F.lit(True).alias("metered"),
    )


def _order(responses: DataFrame) -> list[str]:
    """Token fields in the order the iterations struct declares them."""
    item = responses.schema["usage"].dataType["iterations"].dataType.elementType
    return [f.name for f in item.fields if f.name in TOKENS]


def attempts_from_turns(turns: DataFrame) -> DataFrame:
    """Agent turns (exchange_id, stage, seq, model, usage) whose input counts include cache traffic.

    A turn without usage is a call whose tokens never arrived.
    """
    read, write = (F.coalesce(f"usage.{c}", F.lit(0)) for c in ("cached_tokens", "cache_write_tokens"))
    metered = F.col("usage").isNotNull()
    return turns.select(
        "exchange_id", "stage", "seq", F.when(metered, F.regexp_replace("model", "^.*/", "")).alias("model"),
        F.lit(1).cast("bigint").alias("requests"),
        F.greatest(F.coalesce("usage.input_tokens", F.lit(0)) - read - write, F.lit(0)).cast("bigint").alias(TOKENS[0]),
        write.cast("bigint").alias(TOKENS[1]), read.cast("bigint").alias(TOKENS[2]),
        F.coalesce("usage.output_tokens", F.lit(0)).cast("bigint").alias(TOKENS[3]),
        metered.alias("metered"),
    )


def priced(attempts: DataFrame, prices: DataFrame) -> DataFrame:
    """Attempts with their cost: price by model id, else by the id without its snapshot date."""
    ids = attempts.withColumn("model_id", F.regexp_replace("model", "^.*/", "")).withColumn(
        "family", F.regexp_replace("model_id", fixed.MODEL_DATE_SUFFIX, "")
    )
    exact = prices.select(F.col("model").alias("model_id"), F.struct(*RATES.values()).alias("exact"))
    family = prices.select(F.col("model").alias("family"), F.struct(*RATES.values()).alias("undated"))
    joined = ids.join(exact, "model_id", "left").join(family, "family", "left")
    rate = F.coalesce("exact", "undated")
    cost = sum((F.col(t) * rate[r] for t, r in RATES.items()), F.lit(0.0)) / 1_000_000
    return joined.select(
        *attempts.columns, F.when(F.col("metered"), cost).alias("cost"),
        (F.col("metered") & rate.isNull()).alias("unpriced"),
    )


def known_sum(cost: Column) -> Column:
    """The sum of costs, NULL as soon as one of them is unknown."""
    return F.when(F.count(F.lit(1)) == F.count(cost), F.sum(cost))


def usage_parts(priced_attempts: DataFrame, keys: tuple[str, ...] = ("exchange_id", "stage")) -> DataFrame:
    """Partial sums per model: what the stage totals and the streaming meter are built from."""
    return priced_attempts.groupBy(*keys, "model").agg(
        F.sum("requests").alias("requests"),
        *[F.sum(t).alias(t) for t in TOKENS],
        F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unknown"),
        F.max("unpriced").alias("unpriced"), F.min("seq").alias("first_seq"),
        F.sum(F.when(F.col("metered"), 0).otherwise(F.col("requests"))).alias("unmetered_requests"),
    )


def combined(parts: DataFrame, keys: tuple[str, ...] = ("exchange_id", "stage")) -> DataFrame:
    """Partial sums of several batches as one row per key and model."""
    return parts.groupBy(*keys, "model").agg(
        *[F.sum(c).alias(c) for c in ("requests", *TOKENS, "cost", "unknown", "unmetered_requests")],
        F.max("unpriced").alias("unpriced"), F.min("first_seq").alias("first_seq"),
    )


def roll_up(parts: DataFrame, keys: tuple[str, ...] = ("exchange_id", "stage")) -> DataFrame:
    """Stage totals from partial sums; the model lists hold distinct models, first seen first."""

    def seen(condition: Column) -> Column:
        return F.transform(
            F.array_sort(F.collect_list(F.when(condition, F.struct("first_seq", "model")))), lambda x: x["model"]
        )

    return parts.groupBy(*keys).agg(
        F.sum("requests").alias("requests"),
        *[F.sum(t).alias(t) for t in TOKENS],
        F.when(F.sum("unknown") == 0, F.sum("cost")).alias("cost_usd"),
        seen(F.col("model").isNotNull()).alias("models"),
        seen(F.col("unpriced") & F.col("model").isNotNull()).alias("unpriced_models"),
        F.sum("unmetered_requests").alias("unmetered_requests"),
    )


def stage_usage(attempts: DataFrame, prices: DataFrame, keys: tuple[str, ...] = ("exchange_id", "stage")) -> DataFrame:
    return roll_up(usage_parts(priced(attempts, prices), keys), keys)


def with_every_stage(usage: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Every exchange with all stages; a stage that made no call used nothing and cost nothing."""
    stages = F.explode(F.array(*[F.lit(s) for s in fixed.USAGE_STAGES])).alias("stage")
    frame = exchanges.select("exchange_id", stages)
    full = frame.join(usage.withColumn("recorded", F.lit(True)), ["exchange_id", "stage"], "full_outer")
    counts = ["requests", *TOKENS, "unmetered_requests"]
    none = F.array().cast("array<string>")
    return full.select(
        "exchange_id", "stage", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.when(F.col("recorded").isNull(), F.lit(0.0)).otherwise(F.col("cost_usd")).alias("cost_usd"),
        F.coalesce("models", none).alias("models"), F.coalesce("unpriced_models", none).alias("unpriced_models"),
    )


def merged(usage: DataFrame, keys: tuple[str, ...] = ("stage",)) -> DataFrame:
    """Usage of many exchanges summed; one unknown cost makes the sum unknown."""
    return usage.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("requests", *TOKENS, "unmetered_requests")], known_sum(F.col("cost_usd")).alias("cost_usd")
    )


def total_cost(usage: DataFrame, keys: tuple[str, ...] = ("exchange_id",)) -> DataFrame:
    """Cost over all stages of an exchange; exchanges with no usage rows have no total."""
    return usage.groupBy(*keys).agg(known_sum(F.col("cost_usd")).alias("cost_usd"))


def run_costs(usage: DataFrame, cases: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """What a run used: sums by stage, its cost, and its cost per case.

    ``usage``: exchange rows by stage with ``keys``; ``cases``: a row per case with ``keys``. One unknown cost
    makes the stage's, the run's and the mean cost unknown. A run whose cases made no call cost nothing known.
    """
    stages = merged(usage, (*keys, "stage"))
    row = F.struct("stage", "requests", *TOKENS, "unmetered_requests", "cost_usd")
    totals = stages.groupBy(*keys).agg(known_sum(F.col("cost_usd")).alias("cost_usd"), F.array_sort(F.collect_list(row)).alias("usage"))
    counts = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"))
    both = counts.join(totals, list(keys), "left") if keys else counts.crossJoin(totals)  # one row each
    return both.withColumn("cost_usd_mean", F.col("cost_usd") / F.nullif(F.col("cases"), F.lit(0)))
