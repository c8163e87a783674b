"""Column functions over text: cleaning, tokens, references, sentence pieces.

All of them are JVM-side expressions. Offsets are code points (``length``/``substring``), never
regex offsets, so they stay right outside the basic plane.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fojas import fixed

LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_RARE_BREAKS = "\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029"


def _folding_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form is ASCII letters and digits plus marks (built by rule): those
    of one letter or digit as two strings, those of several by their form."""
    source, target, several = [], [], {}
    for point in (*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0x2100, 0x2190), *range(0x2460, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)).lower()
        if base.isascii() and base.isalnum():
            if len(base) == 1:
                source.append(chr(point))
                target.append(base)
            else:
                several.setdefault(base, "")
                several[base] += chr(point)
    return "".join(source), "".join(target), several


_FOLD_FROM, _FOLD_TO, _FOLD_SEVERAL = _folding_tables()
_HAS_SEVERAL = "[" + "".join(_FOLD_SEVERAL.values()) + "]"
# a class of so many signs is slow, so it only looks at those from the first of them on
_BEFORE_SEVERAL = rf"[\x00-\x{{{ord(min(''.join(_FOLD_SEVERAL.values()))) - 1:X}}}]+"


def collapse(c: Column) -> Column:
    """One space for every run of whitespace, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    # from the end back to the last sign that is no space: trying every run of spaces for the end is slow
    return F.regexp_extract(c, r"(?Us)^\s*(.*\S)?\s*\z", 1)


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def nonblank(c: Column) -> Column:
    return c.rlike(r"(?U)\S")


def lines(c: Column) -> Column:
    # looking for each of the other breaks and cutting at one sign costs a fraction of the pattern
    rare = functools.reduce(Column.__or__, [F.contains(c, F.lit(x)) for x in _RARE_BREAKS])
    return F.when(rare, F.split(c, LINE_BREAKS)).otherwise(F.split(c, "\n"))


def clean_block(c: Column) -> Column:
    """Every line with single spaces and no margins; empty lines removed."""
    cleaned = F.transform(lines(c), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(cleaned, lambda x: x != ""), "\n")


def roman(n: Column) -> Column:
    """Roman numeral with X as the largest sign, so 40 is XXXX."""
    units = F.array(*[F.lit(u) for u in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")])
    n = n.cast("int")
    return F.concat(F.repeat(F.lit("X"), (n / 10).cast("int")), F.element_at(units, (n % 10) + 1))


def fold(c: Column) -> Column:
    """Lowercase with accents removed and compatibility forms spelled out; other letters stay as they are."""

    def folded(lowered: Column) -> Column:
        spelled = lowered
        for form, signs in _FOLD_SEVERAL.items():
            spelled = F.regexp_replace(spelled, f"[{signs}]", form)
        one = lambda x: F.regexp_replace(F.translate(x, _FOLD_FROM, _FOLD_TO), r"\p{M}+", "")
        beyond = F.when(F.regexp_replace(lowered, _BEFORE_SEVERAL, "").rlike(_HAS_SEVERAL), one(spelled)).otherwise(one(lowered))
        return F.when(lowered.rlike(r"[^\x00-\x7F]"), beyond).otherwise(lowered)

    return let(F.lower(c), folded)


def words(c: Column) -> Column:
    """Accent-free lowercase words of a-z and 0-9; any other letter splits a word."""
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is evaluated once, also when the body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n consecutive tokens, joined by a space."""

    def runs(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def phrase(term: Column) -> Column:
    """What a defined term looks like in running text: no parentheticals, one space, lowercase."""
    return F.lower(collapse(F.regexp_replace(term, fixed.PARENTHETICAL, " ")))


def phrase_pattern(p: Column) -> Column:
    """Pattern matching a phrase as whole words, each with an optional plural ending.

    Its first sign is looked at before the word boundary, which is slow to find.
    """
    quote = lambda w: F.regexp_replace(w, r"(?U)([^\w\s])", r"\\$1")
    quoted = F.transform(F.split(p, " "), lambda w: F.concat(quote(w), F.lit("(?:s|es)?")))
    return F.concat(F.lit("(?Uiu)(?="), quote(F.left(p, F.lit(1))), F.lit(r")(?<!\w)"), F.array_join(quoted, r"\s+"), F.lit(r"(?!\w)"))


def part_codes(c: Column) -> Column:
    """Part codes a text names, first appearance first."""
    groups = F.regexp_extract_all(c, F.lit(fixed.PART_REFERENCE), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, codes_in)))


def codes_in(group: Column) -> Column:
    found = F.regexp_extract_all(group, F.lit(r"(?U)" + fixed.PART_CODE), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*fixed.NOT_PART_CODES))


def section_ids_in(group: Column) -> Column:
    """(part, number) of every section id in a matched reference list."""
    return F.arrays_zip(
        F.regexp_extract_all(group, F.lit(fixed.SECTION_ID_PARTS), F.lit(1)).alias("part"),
        F.regexp_extract_all(group, F.lit(fixed.SECTION_ID_PARTS), F.lit(2)).alias("number"),
    )


def matches_at(c: Column, pattern: str, grouped: bool = True) -> Column:
    """array<struct<at, line, text, group>>: each match of a pattern with its code-point offset and the line breaks before it.

    Both come from the pieces between matches. Each search reads the whole text, so what is used again is bound (an
    expression inside several lambdas is evaluated for each of them), and ``group`` is left out if not ``grouped``.
    """
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)) if grouped else None

    def placed(ms: Column) -> Column:
        reach = lambda x: F.struct(F.length(x).alias("n"), line_breaks(x).alias("b"))
        taken = F.transform(ms, lambda m: F.struct(m.alias("text"), reach(m).alias("own")))
        gaps = F.transform(F.slice(F.split(c, pattern), F.lit(1), F.size(ms)), reach)
        return let(F.zip_with(gaps, taken, lambda gap, m: F.struct(*[(gap[f] + m["own"][f]).alias(f) for f in "nb"])), lambda passed: summed(taken, passed))

    def summed(taken: Column, passed: Column) -> Column:
        sums = lambda f: running_sums(F.transform(passed, lambda x: x[f]))
        zipped = F.arrays_zip(taken.alias("m"), sums("n").alias("n"), sums("b").alias("b"), *([groups.alias("g")] if grouped else []))
        return F.transform(zipped, lambda x: F.struct(
            (x["n"] - x["m"]["own"]["n"]).alias("at"), (x["b"] - x["m"]["own"]["b"]).alias("line"), x["m"]["text"].alias("text"),
            *([x["g"].alias("group")] if grouped else []),
        ))

    kind = "array<struct<at:int,line:int,text:string" + (",group:string>>" if grouped else ">>")
    return let(found, lambda ms: F.when(F.size(ms) > 0, placed(ms).cast(kind)).otherwise(F.when(ms.isNotNull(), F.array().cast(kind))))


def line_breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _either(words: set[str]) -> str:
    """A pattern for any of some words that reads their common beginnings once."""
    rests = {w[0]: {x[1:] for x in words if x[:1] == w[0]} for w in sorted(words) if w}
    ways = "|".join(first + _either(rest) for first, rest in rests.items())
    return ways and (f"(?:{ways})?" if "" in words else f"(?:{ways})" if len(rests) > 1 else ways)


_CLAIM_WORD = rf"(?<![a-z]){_either({*fixed.NUMBER_WORDS, *fixed.MONTHS})}(?![a-z])"


def claim_tokens(c: Column) -> Column:
    """What makes a text checkable: numbers by value (digits or words) and month names.

    Numbers stay strings: values can be longer than any integer type.
    """
    values = F.create_map(*[F.lit(x) for w, n in fixed.NUMBER_WORDS.items() for x in (w, str(n))])

    def tokens(text: Column) -> Column:
        digits = F.transform(
            F.regexp_extract_all(text, F.lit(fixed.NUMBER), F.lit(0)),
            lambda n: F.regexp_replace(F.regexp_replace(n, "[.,]", ""), r"^0+(?=\d)", ""),
        )
        plain = F.regexp_replace(fold(text), r"[^\x00-\x7F]+", "")
        spelled = F.transform(
            F.regexp_extract_all(plain, F.lit(_CLAIM_WORD), F.lit(0)), lambda w: F.coalesce(F.element_at(values, w), w)
        )
        return F.array_distinct(F.concat(digits, spelled))

    return let(F.when(F.contains(c, F.lit("(")), F.regexp_replace(c, fixed.PARAGRAPH_MARK, " ")).otherwise(c), tokens)


def sentence_pieces(c: Column) -> Column:
    """The text cut after sentence ends and line breaks; the pieces concatenate to the text."""
    return F.split(c, fixed.SENTENCE_CUT)


def running_ends(pieces: Column, stretch: int = 100) -> Column:
    """Cumulative lengths of an array of strings, row-locally."""
    return running_sums(F.transform(pieces, lambda p: F.length(p)), stretch)


def running_sums(numbers: Column, stretch: int = 100) -> Column:
    """Cumulative sums of an array of whole numbers, row-locally.

    Added up in stretches, then over the stretches: an array grows by copying, and these stay short.
    """

    def upto(lengths: Column) -> Column:
        return F.aggregate(
            lengths, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n))
        )

    def ends(lengths: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / stretch).cast("int")), lambda k: upto(F.slice(lengths, k * stretch + 1, F.lit(stretch))))
        return let(some, lambda parts: let(
            upto(F.transform(parts, lambda p: F.element_at(p, -1))),
            lambda sums: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda e: e + F.when(k > 0, F.get(sums, k - 1)).otherwise(0)))),
        ))

    return let(numbers, lambda n: F.when(F.size(n) > 0, ends(n)).otherwise(F.when(n.isNotNull(), F.array().cast("array<int>"))))


def without_markup(c: Column) -> Column:
    return strip(F.regexp_replace(c, fixed.MARKUP, ""))


def capitalize(c: Column) -> Column:
    """Uppercase the first letter, skipping quotes and other marks before it."""
    pattern = r"(?Us)^([\W\d_]*)([^\W\d_])(.*)\z"
    return F.when(
        c.rlike(fixed.LETTER),
        F.concat(
            F.regexp_extract(c, pattern, 1), F.upper(F.regexp_extract(c, pattern, 2)), F.regexp_extract(c, pattern, 3)
        ),
    ).otherwise(c)


def excerpt(c: Column, limit: int = fixed.EXCERPT_CHARS) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(rstrip(F.left(c, F.lit(limit))), F.lit(" [...]")))


def reflow(c: Column) -> Column:
    """Undo PDF line wrapping: join hyphenation, keep list markers at the start of a line."""
    joined = F.replace(c, F.lit("-\n"), F.lit(""))
    marked = F.regexp_replace(joined, r"\n(\([a-zA-Z0-9]+\))\n", "\u0000$1 ")
    return F.replace(F.replace(marked, F.lit("\n"), F.lit(" ")), F.lit("\u0000"), F.lit("\n"))


def fill_template(template: str, **values: Column) -> Column:
    """A fixed text with ``{name}`` slots filled from columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name].cast("string"))
    return F.concat(*parts)
