"""Personal data: direct identifiers by pattern, and terms that give them away by co-occurrence.

Emails, IP addresses, card and phone numbers are found by pattern and check. Each is an entity. The
words of a document are counted with each entity the document mentions, wherever in it they stand. A
term reveals an entity when most documents that hold the term mention the entity (``least_share``), the
entity gets likelier by ``least_bits`` bits of information, and enough different texts show it
(``least_texts``). Revealing terms are marked wherever they occur.

DataFrame functions only. Offsets come from the lengths of the pieces between matches, so no match is
looked for twice at one place; all groupings are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fojas.llm.common import written

KINDS = ("email", "ip", "card", "phone", "term")
# The contract's patterns. Look-behinds only keep the engine from trying again inside a run it has
# rejected; possessive ends only keep it from recursing. Neither changes a match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARKS = {"email": "@", "ip": ".", "phone": "+"}
WORD = r"[\p{L}\p{N}]"


def _pieces(kind: Column, text: Column, pattern: Column) -> Column:
    """All pieces of a text between matches, each with the match after it (null after the last)."""
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(between.alias("piece"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    return F.transform(
        zipped,
        lambda x, i: F.struct(
            kind.alias("kind"), i.cast("long").alias("n"), F.length(x["piece"]).cast("long").alias("skip"), x["hit"].alias("hit"),
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.reverse(F.split(digits, ""))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def valid(kind: Column, hit: Column) -> Column:
    digits = _digits(hit)
    part = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "email", True).when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(8, 15)).otherwise(True)
    )


def _spans(pieces: DataFrame) -> DataFrame:
    """(id, th, kind, n, skip, hit, ...) to matches with ``start`` and ``stop``. Equal rows count once."""
    rows = pieces.distinct()
    upto = Window.partitionBy("id", "th", "kind", "n0").orderBy("n")
    step = F.col("skip") + F.coalesce(F.length("hit"), F.lit(0))
    rows = rows.withColumn("start", F.sum(step).over(upto) - F.coalesce(F.length("hit"), F.lit(0)))
    return rows.filter(F.col("hit").isNotNull()).withColumn("stop", F.col("start") + F.length("hit"))


def base_matches(docs: DataFrame) -> DataFrame:
    """(id, th, kind, start, stop, hit) of all valid direct identifiers; th marks the text."""
    text = F.col("text")
    parts = []
    for kind, pattern in PATTERNS.items():
        likely = text.contains(MARKS[kind]) if kind in MARKS else F.lit(True)
        if kind != "email":
            likely = likely & text.rlike("[0-9]")
        parts.append(F.when(likely, _pieces(F.lit(kind), text, F.lit(pattern))).otherwise(F.array()))
    rows = docs.filter("text is not null").select("id", F.xxhash64("text").alias("th"), F.explode(F.concat(*parts)).alias("x"))
    rows = rows.select("id", "th", F.lit("").alias("n0"), "x.*")
    return _spans(rows).filter(valid(F.col("kind"), F.col("hit"))).drop("n0", "n", "skip")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), rf"(?!{WORD})(?s:.)"), lambda w: F.length(w) >= 3)


def _once(docs: DataFrame) -> DataFrame:
    """(id, th, text) of each document: rows that are repeated come once. Only those are shuffled."""
    rows = docs.filter("text is not null").select("id", F.xxhash64("text").alias("th"), "text")
    again = written(rows.groupBy("id", "th").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("id_"), F.col("th").alias("th_")), "again")
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["id", "th"]))


def revealing_terms(docs: DataFrame, base: DataFrame, least_texts: int, least_share: float, least_bits: float) -> DataFrame:
    """(term, entity, n_together, n_term, bits) of terms that reveal an entity.

    All words of a document count with all its entities. Equal texts hold the same of both, so a text is
    counted once with the number of its documents; sums are exact, and so is the number of texts. Terms and
    entities that can't pass go before they meet: those in too few texts, entities in so many documents
    that not even a certain sign has the bits, and pairs whose term is in too many documents for the share.
    """
    value = F.when(F.col("kind") == "email", F.lower("hit")).when(F.col("kind") == "ip", F.col("hit")).otherwise(_digits(F.col("hit")))
    once, total = _once(docs), docs.count()
    mentions = base.select("id", "th", F.concat_ws(":", "kind", value).alias("entity")).distinct().groupBy("th", "entity").agg(F.count("*").alias("n"))
    mentions = written(mentions, "mentions")
    entities = mentions.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"))
    able = (F.col("texts") >= least_texts) & (F.log2(F.lit(float(max(1, total))) / F.col("n_entity")) >= least_bits)
    mentions = written(mentions.join(entities.filter(able).drop("texts"), "entity"), "entities")
    words = lambda rows: rows.select("th", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).filter(~F.col("term").rlike("^[0-9]+$"))
    if mentions.isEmpty():
        return mentions.select(F.lit("").alias("term"), "entity", F.lit(0).cast("long").alias("n_together"), F.lit(0).cast("long").alias("n_term"), F.lit(0.0).alias("bits"))
    beside = written(words(once.join(mentions.select("th").distinct(), "th", "left_semi")).distinct(), "beside")
    wanted = beside.groupBy("term").agg(F.count("*").alias("texts")).filter(F.col("texts") >= least_texts).select("term")
    held = words(once).groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term")  # a semi-join would go before the sums
    pairs = beside.join(held, "term").join(mentions, "th").filter(F.col("n_entity") / F.col("n_term") >= least_share)
    found = pairs.groupBy("term", "entity").agg(F.sum("n").alias("n_together"), F.count("*").alias("texts"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    share = F.col("n_together") / F.col("n_term")
    bits = F.log2(share * F.lit(float(max(1, total))) / F.col("n_entity"))
    found = found.withColumn("share", share).withColumn("bits", bits)
    return found.filter((F.col("texts") >= least_texts) & (F.col("share") >= least_share) & (F.col("bits") >= least_bits)).select("term", "entity", "n_together", "n_term", "bits")


def term_matches(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """All occurrences of terms (term) in all documents, as ``base_matches`` gives identifiers."""
    texts = docs.filter("text is not null").select("id", F.xxhash64("text").alias("th"), "text")
    holders = texts.select("id", "th", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(terms.select("term").distinct(), "term").distinct()
    holders = written(holders, "holders")
    pattern = F.concat(F.lit(rf"(?iu)(?<!{WORD})"), F.col("term"), F.lit(rf"(?!{WORD})"))
    rows = texts.join(holders, ["id", "th"]).select("id", "th", F.col("term").alias("n0"), F.explode(_pieces(F.lit("term"), F.col("text"), pattern)).alias("x"))
    return _spans(rows.select("id", "th", "n0", "x.*")).drop("n0", "n", "skip")


def find(docs: DataFrame, least_texts: int = 5, least_share: float = 0.8, least_bits: float = 4.0) -> DataFrame:
    """(id, text) to (id, th, spans array<struct<kind, start, stop>>) of documents with any: characters,
    end exclusive, by kind and start.

    Terms inside a direct identifier are not marked again. Rows with one id and one text are one
    document; a null id is an id like others. Null and empty texts have no spans.
    """
    docs = docs.select("id", "text")
    base = written(base_matches(docs), "identifiers")
    terms = written(revealing_terms(docs, base, least_texts, least_share, least_bits), "terms")
    more = term_matches(docs, terms)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = base.select("id", "th", place.alias("k"), "start", "stop").unionByName(more.select("id", "th", place.alias("k"), "start", "stop"))
    spans = spans.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("k", "start", "stop"))).alias("s"))
    inside = lambda x, y: (y["k"] < len(KINDS)) & (y["start"] <= x["start"]) & (x["stop"] <= y["stop"])
    own = F.filter("s", lambda x: (x["k"] < len(KINDS)) | ~F.exists("s", lambda y: inside(x, y)))
    named = F.transform(own, lambda x: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"]).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return spans.select("id", "th", named.alias("spans"))


def listed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each row of (id, text): counts by kind, hash of the base spans, all spans in writing."""
    rows = docs.select("id", F.xxhash64("text").alias("th"))
    cond = rows["id"].eqNullSafe(found["id"]) & (rows["th"] == found["th"])
    rows = rows.join(found, cond, "left").select(rows["id"], F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written_out = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "term")
    return rows.select("id", *(count(k) for k in KINDS[:4]), F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, text, clean_text): direct identifiers replaced by their kind; revealing terms with digits by
    [NUMBER], others by [TERM]. A span that begins inside an earlier one is covered by that one."""
    rows = docs.select("id", "text", F.xxhash64("text").alias("th"))
    cond = rows["id"].eqNullSafe(found["id"]) & (rows["th"] == found["th"])
    rows = rows.join(found, cond, "left").select(rows["id"], "text", F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))).alias("spans"))
    mark = lambda x: F.when(x["kind"] != "term", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).when(F.substring(F.col("text"), x["start"].cast("int") + 1, (x["stop"] - x["start"]).cast("int")).rlike("[0-9]"), "[NUMBER]").otherwise("[TERM]")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(x["stop"].alias("at"), F.concat(a["out"], F.array(F.substring(F.col("text"), a["at"].cast("int") + 1, (x["start"] - a["at"]).cast("int")), mark(x))).alias("out")))
    done = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"].cast("int") + 1, F.lit(2**31 - 1))))
    return rows.select("id", "text", F.coalesce(done, F.col("text")).alias("clean_text"))
