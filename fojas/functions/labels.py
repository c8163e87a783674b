"""Printed labels: footer versions, page numbers, citation lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fojas import fixed
from fojas.functions import text as T


def footer_version(footer: Column) -> Column:
    """struct<edition, amendment, date> from a footer; NULL when no edition is printed.

    Whichever edition form appears first in the footer counts. Each pattern is searched for once.
    """

    def edition(line: Column) -> Column:
        in_roman = F.upper(F.regexp_extract(line, fixed.EDITION_ROMAN, 1))
        return T.let(F.regexp_extract(line, fixed.EDITION_NUMBER, 1), lambda number: F.when(number != "", T.roman(number)).otherwise(in_roman))

    def amendment(mark: Column) -> Column:
        return F.when(mark == "", None).when(mark.rlike(r"^\d+\z"), T.roman(mark)).otherwise(F.upper(mark))

    def version(line: Column) -> Column:
        mark = T.let(F.regexp_extract(footer, fixed.AMENDMENT, 1), amendment)
        date = T.let(F.lower(T.collapse(F.regexp_extract(footer, fixed.FOOTER_DATE, 1))), lambda d: F.nullif(d, F.lit("")))
        return F.when(line != "", F.struct(edition(line).alias("edition"), mark.alias("amendment"), date.alias("date")))

    return T.let(F.regexp_extract(footer, fixed.EDITION, 0), version)


def printed_label(footer: Column, header: Column) -> Column:
    """The page number a reader sees: from the footer, else "n.m" from the running header."""
    from_header = F.when(
        header.rlike(fixed.HEADER_LABEL),
        F.concat_ws(
            ".", F.regexp_extract(header, fixed.HEADER_LABEL, 1), F.regexp_extract(header, fixed.HEADER_LABEL, 2)
        ),
    )
    return F.coalesce(F.nullif(F.regexp_extract(footer, fixed.FOOTER_LABEL, 1), F.lit("")), from_header)


def footer_context(edition: Column, amendment: Column, date: Column) -> Column:
    """"Edición V, Enmienda I, mayo 2026", leaving out what is not printed."""
    return F.when(
        edition.isNotNull(),
        F.concat_ws(
            ", ", F.concat(F.lit("Edición "), edition), F.concat(F.lit("Enmienda "), F.nullif(amendment, F.lit(""))),
            F.nullif(date, F.lit("")),
        ),
    ).otherwise("")


def version_label(edition: Column, amendment: Column, date: Column) -> Column:
    base = F.concat_ws(" ", F.concat(F.lit("Edición "), edition), F.concat(F.lit("Enmienda "), F.nullif(amendment, F.lit(""))))
    return F.when(
        edition.isNotNull(),
        F.concat(base, F.coalesce(F.concat(F.lit(" ("), F.nullif(date, F.lit("")), F.lit(")")), F.lit(""))),
    )


def printed_or_none(c: Column) -> Column:
    return F.coalesce(c, F.lit("None"))


def pages_label(start: Column, end: Column, printed_start: Column, printed_end: Column) -> Column:
    single = T.fill_template("página PDF {a} (página impresa {b})", a=start, b=printed_or_none(printed_start))
    several = T.fill_template(
        "páginas PDF {a}-{b} (páginas impresas {c}-{d})",
        a=start, b=end, c=printed_or_none(printed_start), d=printed_or_none(printed_end),
    )
    return F.when(start == end, single).otherwise(several)


def citation_line(number: Column, c: Column) -> Column:
    """One numbered line of the citation list."""
    version = version_label(c["edition"], c["amendment"], c["date"])
    pages = pages_label(
        c["pdf_page_start"], c["pdf_page_end"], c["printed_page_start"], c["printed_page_end"]
    )
    return F.concat(
        T.fill_template(
            "[{n}] Parte {part}, Sección {section} ({title}), {pages}",
            n=number, part=c["part"], section=c["section"], title=c["title"], pages=pages,
        ),
        F.coalesce(F.concat(F.lit(", "), version), F.lit("")),
        F.lit(" - "),
        c["source_url"],
    )
