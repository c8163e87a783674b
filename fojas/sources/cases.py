"""Evaluation cases, candidates and run reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fojas import fixed, schemas


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of JSONL files with their place: source, at, value.

    ``at`` grows along a file but is not its line number; counting lines would need one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("at"), "value"
    )
    return lines.filter(F.trim("value") != "")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def case_rows(lines: DataFrame) -> DataFrame:
    """Lines as cases, or with the first thing wrong with them.

    Order of the checks: JSON, object, keys, texts, scope flag, expected sections, their agreement,
    duplicate id (every row of an id after its first).
    """
    v = F.try_parse_json("value")
    df = lines.withColumn("v", v)
    kind = _kind(F.col("v"))
    keys = F.json_object_keys("value")
    at = lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    no_text = lambda k: ~((_kind(at(k)) == "STRING") & F.coalesce(text(k).rlike(r"(?U)\S"), F.lit(False)))
    refs = F.try_variant_get("v", "$.expected_secciones", "array<variant>")
    bad_ref = F.exists(
        F.coalesce(refs, F.array().cast("array<variant>")),
        lambda r: (_kind(r) != "OBJECT<parte: STRING, seccion: STRING>")
        | (F.try_variant_get(r, "$.parte", "string") == "") | (F.try_variant_get(r, "$.seccion", "string") == ""),
    )
    scope = F.try_variant_get("v", "$.out_of_scope", "boolean")
    error = (
        F.when(F.col("v").isNull(), "invalid JSON")
        .when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
        .when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in fixed.CASE_KEYS]))) > 0, "unknown keys")
        .when(no_text("id"), "id must be a non-empty string")
        .when(no_text("question"), "question must be a non-empty string")
        .when(no_text("reference_answer"), "reference_answer must be a non-empty string")
        .when(_kind(at("out_of_scope")) != "BOOLEAN", "out_of_scope must be true or false")
        .when(~F.startswith(_kind(at("expected_secciones")), F.lit("ARRAY")) | bad_ref, "expected_secciones must be a list of sections")
        .when(scope == (F.size(refs) > 0), "expected sections do not fit the scope")
    )
    df = df.select(
        *lines.columns, text("id").alias("id"), text("question").alias("question"),
        F.transform(refs, lambda r: F.struct(
            F.try_variant_get(r, "$.parte", "string").alias("part"), F.try_variant_get(r, "$.seccion", "string").alias("section"),
        )).alias("expected"),
        text("reference_answer").alias("reference_answer"), scope.alias("out_of_scope"),
        F.coalesce(text("source"), F.lit("owner")).alias("case_source"), error.alias("shape_error"),
    )
    firsts = df.filter(F.col("shape_error").isNull()).groupBy("id").agg(F.min(F.struct("source", "at")).alias("first_at"))
    df = df.join(firsts, "id", "left")
    duplicate = F.when(F.struct("source", "at") > F.col("first_at"), "duplicate case id")
    return df.withColumn("error", F.coalesce("shape_error", duplicate)).drop("shape_error", "first_at")


def cases(rows: DataFrame) -> DataFrame:
    """The valid cases of ``case_rows``."""
    return rows.filter(F.col("error").isNull()).select(
        "id", "question", "expected", "reference_answer", "out_of_scope", F.col("case_source").alias("source")
    )


def read_plain_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases without validation, as the routing set is read."""
    return spark.read.schema(
        f"id STRING, question STRING, expected_secciones ARRAY<STRUCT<{schemas.SECTION_REF}>>, out_of_scope BOOLEAN"
    ).json(path)


def select_cases(all_cases: DataFrame, ids: DataFrame) -> DataFrame:
    """The named cases; an id no case has fails instead of silently running fewer."""
    wanted = ids.select("id").distinct().join(all_cases.withColumn("known", F.lit(True)), "id", "left")
    checked = F.when(
        F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown case id "), "id")).cast("boolean")
    ).otherwise(True)
    return wanted.filter(checked).drop("known")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates, failing on an unknown status."""
    rows = spark.read.schema(schemas.CANDIDATES).json(path)
    ok = F.col("status").isin(fixed.PENDING, fixed.ACCEPTED, fixed.REJECTED)
    problem = F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("none")))).cast("boolean")
    return rows.filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(problem))


def write_candidates(candidates: DataFrame, path: str) -> None:
    candidates.select([f.split()[0] for f in schemas.CANDIDATES.split(", ")]).write.mode("overwrite").json(path)


def clashes(accepted: DataFrame, existing: DataFrame) -> DataFrame:
    """Accepted cases whose id the evaluation set already holds."""
    return accepted.join(existing.select("id"), "id", "left_semi")


def append_cases(accepted: DataFrame, existing: DataFrame, path: str) -> None:
    """Append cases in the set's own JSON shape; a clash of ids fails the job before anything is written."""
    taken = existing.select("id", F.lit(True).alias("taken")).distinct()
    checked = accepted.join(taken, "id", "left").filter(
        F.when(F.col("taken"), F.raise_error(F.concat(F.lit("case already exists: "), "id")).cast("boolean")).otherwise(True)
    )
    refs = F.transform("expected", lambda e: F.struct(e["part"].alias("parte"), e["section"].alias("seccion")))
    checked.select(
        "id", "question", refs.alias("expected_secciones"), "reference_answer", "out_of_scope", "source"
    ).write.mode("append").json(path)


REPORT = (
    "schema_version INT, stages ARRAY<STRING>, pipeline STRUCT<name: STRING, index_versions: ARRAY<STRUCT<parte: STRING,"
    " content_hash: STRING, edicion: STRING, enmienda: STRING, from_cache: BOOLEAN>>>,"
    " cases ARRAY<STRUCT<id: STRING, question: STRING, error: STRING, routed_partes: ARRAY<STRING>,"
    f" visited_nodes: ARRAY<STRING>, retrieved_secciones: ARRAY<STRUCT<{schemas.SECTION_REF}>>,"
    " definiciones: ARRAY<STRUCT<parte: STRING, seccion: STRING, term: STRING>>>>"
)


def read_reports(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Run reports with ``error`` where one cannot be replayed; ``report`` names a report by file and content.

    A report is a line, as ``write_report`` writes them, or with ``one_per_file`` a whole file.
    """
    rows = spark.read.text(path, wholetext=one_per_file).filter(F.trim("value") != "")
    name = F.concat_ws("#", F.col("_metadata.file_path"), F.md5("value"))
    return replayable(rows.select(name.alias("report"), F.from_json("value", REPORT).alias("r")).select("report", "r.*"))


def replayable(reports: DataFrame) -> DataFrame:
    error = (
        F.when(~F.coalesce(F.col("schema_version").isin(*fixed.REPLAYABLE_SCHEMAS), F.lit(False)), "report schema cannot be replayed")
        .when(~F.array_contains("stages", "retrieval"), "report did not run the retrieval stage")
    )
    return reports.withColumn("error", error)


def recorded_cases(reports: DataFrame) -> DataFrame:
    """Cases of replayable reports with what they retrieved."""
    return reports.filter(F.col("error").isNull()).select("report", F.inline("cases"))


def replay_status(all_cases: DataFrame, recorded: DataFrame) -> DataFrame:
    """Whether each case can replay its recording: ok, missing, errored or changed."""
    rec = recorded.select("id", F.col("question").alias("recorded_question"), F.col("error").alias("recorded_error"), F.lit(True).alias("found"))
    status = (
        F.when(F.col("found").isNull(), "missing").when(F.coalesce("recorded_error", F.lit("")) != "", "errored")
        .when(F.col("recorded_question") != F.col("question"), "changed").otherwise("ok")
    )
    return all_cases.join(rec, "id", "left").withColumn("replay", status).drop("recorded_question", "recorded_error", "found")


def version_mismatches(recorded_versions: DataFrame, loaded: DataFrame) -> DataFrame:
    """Recorded parts (part, content_hash) whose loaded version differs or is missing."""
    now = loaded.select("part", F.col("content_hash").alias("loaded_hash"))
    return recorded_versions.join(now, "part", "left").filter(~F.col("content_hash").eqNullSafe(F.col("loaded_hash")))


def write_report(report: DataFrame, path: str) -> None:
    """Report rows (header fields and case results) as JSON, one to a line."""
    report.write.mode("overwrite").json(path)


def record_responses(responses: DataFrame, path: str) -> None:
    """Append questions with their prompt's document order and the raw response."""
    responses.write.mode("append").parquet(path)
