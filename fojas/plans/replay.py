"""Evaluation runs in three modes: retrieval alone, answers over what an earlier run retrieved, and both at once.

Recorded references are resolved against the corpus that is loaded now. What cannot be replayed as it was
recorded is an error of its case, never of the run, and counts as a failure in the case's rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fojas.operators import retrieval as RT
from fojas.plans import jobs as J
from fojas.sources import cases as C

NOT_REPLAYABLE = {"missing": "no recorded retrieval", "errored": "the recorded run failed", "changed": "the question changed since the recording"}


def index_versions(reports: DataFrame) -> DataFrame:
    """The part versions that replayable reports ran on: part, content_hash."""
    rows = reports.filter(F.col("error").isNull()).select(F.inline("pipeline.index_versions"))
    return rows.select(F.col("parte").alias("part"), "content_hash").distinct()


def references(recorded: DataFrame) -> DataFrame:
    """Recorded cases as references: question_id, rank, part, section, term (null for a section)."""
    def listed(column: str, term) -> DataFrame:
        rows = recorded.select(F.col("id").alias("question_id"), F.posexplode(column).alias("rank", "r"))
        return rows.select("question_id", "rank", F.col("r.parte").alias("part"), F.col("r.seccion").alias("section"), term.alias("term"))

    return listed("retrieved_secciones", F.lit(None).cast("string")).unionByName(listed("definiciones", F.col("r.term")))


def recorded_retrieval(
    corpus: dict[str, DataFrame], cases: DataFrame, recorded: DataFrame, recorded_versions: DataFrame, root: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections and definitions of every case that can be replayed, in their recorded order, and the errors of the others.

    ``recorded``: rows of ``cases.recorded_cases``, one for each case; ``recorded_versions``: see ``index_versions``. A case
    cannot be replayed if it was not recorded, failed or asked something else then, if a part it refers to is loaded
    in another version than was recorded, or if a reference is not in the corpus. Errors: case_id, error.
    """
    status = C.replay_status(cases.select("id", "question"), recorded)
    reason = F.coalesce(*[F.when(F.col("replay") == s, text) for s, text in NOT_REPLAYABLE.items()])
    unfit = status.withColumn("error", reason).filter("error IS NOT NULL").select(F.col("id").alias("case_id"), "error")
    fit = status.filter("replay = 'ok'").select(F.col("id").alias("question_id"))
    refs = RT.replayed(references(recorded).join(fit, "question_id", "left_semi"), corpus["parts"], corpus["sections"], corpus["definitions"])
    stale = C.version_mismatches(recorded_versions, corpus["parts"]).filter(F.col("loaded_hash").isNotNull()).select("part").distinct()
    other = F.when(F.col("stale"), F.concat(F.lit("part loaded in another version: "), "part"))
    checked = refs.join(stale.withColumn("stale", F.lit(True)), "part", "left").withColumn("error", F.coalesce("error", other)).drop("stale")
    checked = J.written(checked, f"{root}/references")
    broken = checked.filter("error IS NOT NULL").groupBy(F.col("question_id").alias("case_id")).agg(F.min("error").alias("error"))
    errors = J.written(unfit.unionByName(broken), f"{root}/errors")
    whole = checked.join(errors.select(F.col("case_id").alias("question_id")), "question_id", "left_anti").drop("error")
    sections = whole.filter("term IS NULL").drop("term", "def_ord")
    definitions = whole.filter("term IS NOT NULL").drop("section_ord")
    return sections, definitions, errors


def run(
    corpus: dict[str, DataFrame], cases: DataFrame, root: str, stage: str = "full", responses: DataFrame | None = None, urls: DataFrame | None = None,
    routes: DataFrame | None = None, events: DataFrame | None = None, versions: DataFrame | None = None,
    recorded: DataFrame | None = None, recorded_versions: DataFrame | None = None, judgements: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Case results and rates of a run in one of the modes ``retrieval``, ``answer`` and ``full``.

    ``answer`` takes what each case retrieved from ``recorded``; the others retrieve by ``routes`` and ``events``. All but
    ``retrieval`` read the model's ``responses`` (answer_id, raw), an answer for each case; cases for which nothing was
    retrieved are refused without one. What later steps read more than once is written under ``root``.
    """
    if stage == "answer":
        sections, definitions, errors = recorded_retrieval(corpus, cases, recorded, recorded_versions, root)
    else:
        (sections, definitions), errors = J.retrieve(corpus, routes, events, versions), None
        sections, definitions = J.written(sections, f"{root}/sections"), J.written(definitions, f"{root}/definitions")
    answered = None
    if stage != "retrieval":
        asked = cases.select(F.col("id").alias("question_id"))
        if errors is not None:
            asked = asked.join(errors.select(F.col("case_id").alias("question_id")), "question_id", "left_anti")
        mine = responses.join(asked.select(F.col("question_id").alias("answer_id")), "answer_id", "left_semi")
        answered = J.written(J.answers(corpus, mine, sections, definitions, urls, asked), f"{root}/answers")
    return J.evaluate(cases, sections, definitions, answered, judgements, stage, errors)
