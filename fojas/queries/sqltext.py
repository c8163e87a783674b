"""SQL fragments the oracle statements share."""

from __future__ import annotations

from fojas import fixed

NUMBER_MAP = "MAP {" + ", ".join(f"'{w}': '{n}'" for w, n in fixed.NUMBER_WORDS.items()) + "}"
MONTH_LIST = ", ".join(f"'{m}'" for m in fixed.MONTHS)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def words(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[a-z0-9]+')"


def claim_tokens(x: str) -> str:
    text = rf"regexp_replace({x}, '\((?:\p{{L}}{{1,4}}|\d{{1,2}})\)', ' ', 'g')"
    digits = (
        rf"list_transform(regexp_extract_all({text}, '\d+(?:[.,]\d+)*'),"
        r" lambda n: regexp_replace(regexp_replace(n, '[.,]', '', 'g'), '^0+(\d)', '\1'))"
    )
    plain = rf"regexp_extract_all(regexp_replace({fold(text)}, '[^\x00-\x7F]', '', 'g'), '[a-z]+')"
    spelled = (
        f"list_filter(list_transform({plain}, lambda w: map_extract({NUMBER_MAP}, w)[1]), lambda w: w IS NOT NULL)"
    )
    months = f"list_filter({plain}, lambda w: w IN ({MONTH_LIST}))"
    return f"list_distinct(list_concat({digits}, {spelled}, {months}))"


def cut_marked(x: str) -> str:
    """The text with a control mark after every sentence end and line break."""
    return (
        rf"replace(regexp_replace({x}, '([.!?:;](?:\*\*|__)?)(\s|$)', '\1' || chr(30) || '\2', 'g'),"
        " chr(10), chr(10) || chr(30))"
    )


def capitalize(x: str) -> str:
    pattern = r"'(?s)^([^\p{L}]*)(\p{L})(.*)$'"
    return (
        f"CASE WHEN regexp_matches({x}, '\\p{{L}}') THEN regexp_extract({x}, {pattern}, 1)"
        f" || upper(regexp_extract({x}, {pattern}, 2)) || regexp_extract({x}, {pattern}, 3) ELSE {x} END"
    )


def without_markup(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\*\*|__|^\s*(?:#+|[-*•]|\d+[.)])\s+', '', 'g')")
