"""Scores per case, rates per run, routing and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas import fixed


def retrieved_refs(sections: DataFrame, definitions: DataFrame) -> DataFrame:
    """Sections that count as retrieved: those read, and those holding an attached definition."""
    keys = ("case_id", "part", "section")
    return sections.select(*keys).unionByName(definitions.select(*keys)).distinct()


def retrieval_scores(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """case_id, retrieval_hit, retrieval_recall of in-scope cases."""
    expected = cases.filter(~F.col("out_of_scope")).select(F.col("id").alias("case_id"), F.inline("expected"))
    found = expected.join(retrieved.withColumn("found", F.lit(1)), ["case_id", "part", "section"], "left")
    share = F.coalesce("found", F.lit(0))
    return found.groupBy("case_id").agg(
        (F.max(share) == 1).alias("retrieval_hit"), F.avg(share).alias("retrieval_recall")
    )


def answer_scores(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """case_id, grounding, refusal_correct and dropped claims of answered cases."""
    joined = answers.withColumnRenamed("answer_id", "case_id").join(
        cases.select(F.col("id").alias("case_id"), "out_of_scope"), "case_id"
    )
    cited = F.size(F.filter("sentences", lambda s: F.size(s["citations"]) > 0))
    claims = cited + F.size("dropped")
    grounding = F.when(~F.col("refused"), F.when(claims > 0, cited / claims).otherwise(0.0))
    return joined.select(
        "case_id", grounding.alias("grounding"), (F.col("refused") == F.col("out_of_scope")).alias("refusal_correct"),
        F.size("dropped").alias("n_dropped"),
    )


def case_scores(
    cases: DataFrame, errors: DataFrame, retrieval: DataFrame | None = None, answers: DataFrame | None = None
) -> DataFrame:
    """One row per case with the scores of the stages that ran; an errored case has none."""
    out = cases.select(F.col("id").alias("case_id"), "out_of_scope").join(errors, "case_id", "left")
    empty = {
        "retrieval_hit": "boolean", "retrieval_recall": "double", "grounding": "double", "refusal_correct": "boolean",
        "n_dropped": "int",
    }
    for scores in (retrieval, answers):
        if scores is not None:
            out = out.join(scores, "case_id", "left")
    for name, kind in empty.items():
        value = F.col(name) if name in out.columns else F.lit(None).cast(kind)
        out = out.withColumn(name, F.when(F.col("error").isNull(), value))
    return out


def verdicts(responses: DataFrame) -> DataFrame:
    """Judge responses (with a ``content`` array) as score, verdict, rationale; a bad one is an error row."""
    text = F.try_element_at(F.filter("content", lambda b: b["type"] == "text"), F.lit(1))["text"]
    parsed = F.from_json(text, "fundamento STRING, veredicto STRING")
    df = responses.withColumn("answer_text", text).withColumn("parsed", parsed)
    scores = F.create_map(*[F.lit(x) for kv in fixed.VERDICTS.items() for x in kv])
    error = (
        F.when(F.col("answer_text").isNull(), "no text block")
        .when(F.col("parsed.veredicto").isNull() | F.col("parsed.fundamento").isNull(), "not a verdict")
        .when(~F.col("parsed.veredicto").isin(*fixed.VERDICTS), F.concat(F.lit("unknown verdict "), "parsed.veredicto"))
    )
    df = df.withColumn("error", error)
    good = F.col("error").isNull()
    return df.select(
        *[c for c in responses.columns if c not in ("content", "raw", "usage", "stop_reason")],
        F.when(good, F.element_at(scores, F.col("parsed.veredicto"))).alias("correctness"),
        F.when(good, F.col("parsed.veredicto")).alias("verdict"),
        F.when(good, F.trim("parsed.fundamento")).alias("rationale"), "error",
    )


def _rate(base: Column, ok: Column) -> Column:
    return F.when(F.count_if(base) > 0, F.count_if(base & F.coalesce(ok, F.lit(False))) / F.count_if(base))


def run_aggregate(scores: DataFrame, stage: str = "full", judged: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rates of a run. A case that errored is a failure in every rate it belongs to.

    Rates of a stage that did not run are NULL. Cases whose judge call failed leave the mean and are
    counted. Expects the columns of ``case_scores`` (and correctness, judge_error when judged).
    """
    stages = fixed.STAGES[stage]
    outside = F.col("out_of_scope")
    errored = F.col("error").isNotNull()
    claimed = errored | F.col("grounding").isNotNull()

    def when_run(name: str, value: Column, kind: str = "double") -> Column:
        return value if name in stages else F.lit(None).cast(kind)

    columns = [
        F.count(F.lit(1)).alias("cases"), F.count_if(~outside).alias("in_scope"), F.count_if(outside).alias("out_of_scope"),
        F.count_if(errored).alias("errors"),
        when_run("retrieval", _rate(~outside, F.col("retrieval_hit"))).alias("retrieval_hit_rate"),
        when_run("retrieval", F.avg(F.when(~outside, F.when(errored, 0.0).otherwise(F.col("retrieval_recall"))))).alias("retrieval_recall_mean"),
        when_run("answer", _rate(claimed, F.col("grounding") == 1.0)).alias("grounded_rate"),
        when_run("answer", F.coalesce(F.sum("n_dropped"), F.lit(0)), "bigint").alias("dropped_claims"),
        when_run("answer", _rate(outside, F.col("refusal_correct"))).alias("refusal_rate_out_of_scope"),
        when_run("answer", _rate(~outside, ~F.col("refusal_correct"))).alias("false_refusal_rate_in_scope"),
    ]
    if judged:
        columns += [
            F.avg(F.when(errored, 0.0).otherwise(F.col("correctness"))).alias("correctness_mean"),
            F.count_if(F.col("judge_error").isNotNull()).alias("judge_errors"),
        ]
    if "latency_s" in scores.columns:
        columns.append(F.avg("latency_s").alias("latency_s_mean"))
    return scores.groupBy(*keys).agg(*columns)


def routing_rows(cases: DataFrame) -> DataFrame:
    """Per case (id, expected parts, routed parts): hit, missing and extra parts."""
    expected = F.array_sort(F.array_distinct("expected"))
    missing = F.array_except("expected", "routed")
    extra = F.filter("routed", lambda p: ~F.array_contains("expected", p))
    return cases.withColumn("expected", expected).select(
        *cases.columns, missing.alias("missing"), extra.alias("extra"), (F.size(missing) == 0).alias("hit"),
    )


def routing_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.avg(F.col("hit").cast("int")).alias("accuracy"),
        F.avg((F.col("hit") & (F.size("extra") == 0)).cast("int")).alias("exact"),
    )


def routing_recall(rows: DataFrame) -> DataFrame:
    """Share of the cases expecting a part that were routed to it."""
    return (
        rows.select(F.explode("expected").alias("part"), "routed")
        .groupBy("part")
        .agg(F.avg(F.array_contains("routed", F.col("part")).cast("int")).alias("recall"), F.count(F.lit(1)).alias("cases"))
    )


def compare_runs(left: DataFrame, right: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Two runs of the same cases side by side; a case only one run has shows as missing."""
    a = left.select("case_id", *[F.col(m).cast("double").alias(f"{m}_a") for m in metrics], F.lit(True).alias("in_a"))
    b = right.select("case_id", *[F.col(m).cast("double").alias(f"{m}_b") for m in metrics], F.lit(True).alias("in_b"))
    return a.join(b, "case_id", "full_outer").select(
        "case_id", *[c for m in metrics for c in (f"{m}_a", f"{m}_b")],
        *[(F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_diff") for m in metrics],
        F.when(F.col("in_a").isNull(), "right").when(F.col("in_b").isNull(), "left").otherwise("both").alias("present"),
    )


def fingerprint(cases: DataFrame, order: str = "id") -> DataFrame:
    """A hash of a case set: equal sets give equal hashes.

    Row digests are combined as a sum of 32-bit chunks per column, so nothing is gathered in one task.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(cases.columns))), 256)
    chunks = [F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    summed = cases.select(digest.alias("d")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"c{i}") for i, c in enumerate(chunks)]
    )
    joined = F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"c{i}").cast("string") for i in range(8)])
    return summed.select(F.sha2(joined, 256).alias("cases_sha256"))


def served_models(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("model").isNotNull()).agg(F.array_sort(F.collect_set("model")).alias("served_models"))
