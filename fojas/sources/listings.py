"""The listing sheet: one row per part with its title and share link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fojas import fixed
from fojas.functions import text as T


def sheet_ids(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with the sheet id their configuration names; ``error`` where there is none."""
    found = F.nullif(F.regexp_extract(html, fixed.SHEET_ID, 1), F.lit(""))
    return pages.withColumn("sheet_id", found).withColumn("error", F.when(found.isNull(), "no sheet id in page"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV sheets as (sheet, row_no, cells). Cells may span lines; row 1 is the header.

    One sheet is one file and is parsed by one task, so the row numbers are per file.
    """
    names = [f"c{i}" for i in range(len(fixed.SHEET_COLUMNS))]
    raw = (
        spark.read.option("header", False).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "misfit")
        .schema(", ".join(f"{n} STRING" for n in [*names, "misfit"])).csv(path)
    )
    # A row of another width is kept as such: its surplus or missing cells make it narrower here.
    cells = F.when(F.col("misfit").isNull(), F.array(*names)).otherwise(F.array(*names[:-1]))
    placed = raw.select(F.col("_metadata.file_path").alias("sheet"), F.monotonically_increasing_id().alias("at"), cells.alias("cells"))
    row = F.row_number().over(Window.partitionBy("sheet").orderBy("at"))
    return placed.select("sheet", row.alias("row_no"), "cells")


def header_errors(rows: DataFrame) -> DataFrame:
    """Sheets whose first row is not the expected header."""
    names = F.transform("cells", T.strip)
    return rows.filter((F.col("row_no") == 1) & ~(names.eqNullSafe(F.array(*[F.lit(c) for c in fixed.SHEET_COLUMNS]))))


def query_value(query: Column, key: str) -> Column:
    """First value of a key in a query string, decoded; '' when absent."""
    raw = F.regexp_extract(query, rf"(?:^|&){key}=([^&]*)", 1)
    return F.try_url_decode(raw)


def listing_rows(rows: DataFrame) -> DataFrame:
    """Data rows of sheets with their fields or the first thing wrong with them.

    The checks run in the order columns, part, duplicate, title, link; blank rows and the repeated
    header are left out. A code listed twice is an error from its second valid row on.
    """
    rows = rows.filter(F.col("row_no") > 1).withColumn("c", F.transform("cells", lambda x: T.strip(F.coalesce(x, F.lit("")))))
    rows = rows.filter(F.exists("c", lambda x: x != ""))
    cell = lambda i: F.coalesce(F.try_element_at("c", F.lit(i)), F.lit(""))
    rows = rows.select(
        "sheet", "row_no", "c", cell(1).alias("raw_part"), cell(2).alias("raw_title"), cell(3).alias("share_url"),
    )
    width = F.size("c") == len(fixed.SHEET_COLUMNS)
    repeated = (F.lower("raw_part") == "parte") & F.lower("raw_title").isin(*fixed.SHEET_TITLE_HEADERS)
    rows = rows.filter(~(width & repeated))
    title = T.collapse(F.replace("raw_title", F.lit("**"), F.lit("")))
    link_query = F.regexp_extract("share_url", fixed.SHARE_LINK, 2)
    rows = rows.select(
        "sheet", "row_no", "share_url", width.alias("wide"),
        F.regexp_extract("raw_part", fixed.LISTING_CODE, 1).alias("part"), title.alias("title"),
        F.regexp_extract("share_url", fixed.SHARE_LINK, 1).alias("token"),
        F.when(link_query != "", query_value(link_query, "path")).alias("folder"),
        F.when(link_query != "", query_value(link_query, "openfile")).alias("file_id"),
    )
    bad_folder = F.col("folder").isNotNull() & (
        ~F.startswith("folder", F.lit("/")) | ~F.coalesce("file_id", F.lit("")).rlike(r"(?U)^\d+\z")
    )
    shape = F.when(~F.col("wide"), "columns").when(F.col("part") == "", "unexpected part")
    content = (
        F.when(F.col("title") == "", "no title").when(F.col("share_url") == "", "no link")
        .when((F.col("token") == "") | bad_folder, "unexpected link")
    )
    rows = rows.withColumn("content_error", content).withColumn("shape_error", shape)
    # The first valid row of a code per sheet, by aggregation: a hot code costs one partial row per task.
    firsts = (
        rows.filter(F.col("shape_error").isNull() & F.col("content_error").isNull())
        .groupBy("sheet", "part").agg(F.min("row_no").alias("first_row"))
    )
    rows = rows.join(firsts, ["sheet", "part"], "left")
    duplicate = F.when(F.col("row_no") > F.col("first_row"), "listed twice")
    error = F.coalesce("shape_error", duplicate, "content_error")
    return rows.select(
        "sheet", "row_no", F.nullif("part", F.lit("")).alias("part"), "title", "share_url", F.nullif("token", F.lit("")).alias("token"),
        "folder", "file_id", F.when(F.col("file_id").isNull(), F.concat("share_url", F.lit("/download"))).alias("download_url"),
        error.alias("error"),
    )


def listings(rows: DataFrame) -> DataFrame:
    """Valid listings only; see ``listing_rows`` for what was wrong with the others."""
    return listing_rows(rows).filter(F.col("error").isNull()).drop("error", "row_no")


def require_valid(rows: DataFrame) -> DataFrame:
    """The same rows, failing the job on the first one that has an error."""
    where = F.concat_ws(" ", F.lit("row"), F.col("row_no").cast("string"), F.coalesce("part", F.lit("")), "error")
    return rows.filter(F.when(F.col("error").isNotNull(), F.raise_error(where).cast("boolean")).otherwise(True))


def find_listings(requested: DataFrame, listed: DataFrame) -> DataFrame:
    """Requested parts with their listing; ``error`` for a part the sheet does not list."""
    found = requested.join(listed.withColumn("listed", F.lit(True)), "part", "left")
    return found.withColumn("error", F.when(F.col("listed").isNull(), "not listed")).drop("listed")


def folder_files(listed: DataFrame, folders: DataFrame) -> DataFrame:
    """Where the file a folder listing names can be fetched.

    ``folders``: part, xml (the multistatus answer for the listing's folder).
    """
    schema = "response ARRAY<STRUCT<href: STRING, propstat: ARRAY<STRUCT<prop: STRUCT<fileid: STRING>>>>>"
    parsed = folders.select("part", F.from_xml("xml", schema, {"ignoreNamespace": "true"}).alias("x"))
    entries = parsed.select("part", F.inline("x.response")).select(
        "part", "href", F.try_element_at(F.filter("propstat.prop.fileid", lambda x: x.isNotNull()), F.lit(1)).alias("file_id")
    )
    wanted = listed.filter(F.col("file_id").isNotNull())
    first = entries.filter(F.col("href").isNotNull()).groupBy("part", "file_id").agg(F.min("href").alias("href"))
    found = wanted.join(first, ["part", "file_id"], "left")
    return found.select(
        *wanted.columns, F.concat(F.lit(fixed.SHARE_HOST), "href").alias("file_url"),
        F.when(F.col("href").isNull(), F.concat(F.lit("file "), "file_id", F.lit(" not found in shared folder"))).alias("error"),
    )
