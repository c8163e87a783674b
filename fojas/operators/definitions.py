"""Which defined terms a text uses.

A phrase is found by an equi-join on one token or token pair (with plural endings), the one of its pairs that the
fewest texts hold, then confirmed by its pattern on the whole text: no cross join, however many terms and
texts there are, and no task that gets all texts of a stop word.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fojas import fixed
from fojas.functions import text as T

TOKEN = r"(?U)\w+|[^\w\s]"
#: Keys of the join that the texts of one token are dealt over.
SALTS = 64
#: Keys of phrases that are sent to every task, at some hundred bytes each.
FEW_KEYS = 100_000


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def _text_keys(c: Column) -> Column:
    """Distinct tokens and neighbouring token pairs of a text."""

    def keys(tokens: Column) -> Column:
        following = F.slice(tokens, F.lit(2), F.size(tokens))
        pairs = F.zip_with(tokens, following, lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit(""))))
        return F.array_distinct(F.concat(tokens, pairs))

    return T.let(_tokens(c), keys)


def keys_held(texts: DataFrame, wanted: DataFrame, key: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """(key, k), each once: which of the wanted keys (k; few enough for every task) a text holds.

    Tokens meet the beginnings of wanted keys before any pair is put together, so pairs are made only where one
    can be wanted. A plan that uses the result twice shuffles it once and so reads the texts once.
    """
    paired = F.contains("k", F.lit(" "))
    begins = wanted.groupBy(F.substring_index("k", " ", 1).alias("a")).agg(F.max(~paired).alias("alone"), F.max(paired).alias("paired"))
    # A text without a key is in no join by it; said here, since only equal plans are shuffled once for both uses.
    keyed = texts.filter(functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in key]))
    tokens = keyed.select(*key, _tokens(F.col("text")).alias("t"))
    followed = F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b"))
    met = tokens.select(*key, F.inline(followed)).join(F.broadcast(begins), "a")
    both = F.array(F.when(F.col("alone"), F.col("a")), F.when(F.col("paired"), F.concat("a", F.lit(" "), "b")))
    held = met.select(*key, F.explode(both).alias("k")).join(F.broadcast(wanted), "k", "left_semi")
    return held.select(*key, "k").distinct()


def _phrase_keys(p: Column) -> Column:
    """The ways to look a phrase up, each an array of keys of which its texts hold one: its token, or any
    two neighbouring tokens of several."""
    endings = lambda t: F.array(t, F.concat(t, F.lit("s")), F.concat(t, F.lit("es")))
    joined = lambda a, b: F.flatten(F.transform(endings(a), lambda x: F.transform(endings(b), lambda y: F.concat_ws(" ", x, y))))

    def keys(tokens: Column) -> Column:
        pairs = F.transform(F.slice(tokens, F.lit(2), F.size(tokens)), lambda b, i: joined(F.get(tokens, i), b))
        return F.when(F.size(tokens) > 1, pairs).otherwise(F.array(endings(F.get(tokens, F.lit(0)))))

    return T.let(_tokens(p), keys)


def by_file(definitions: DataFrame) -> DataFrame:
    """Definitions keyed by file and phrase; of several with one phrase in a file the first counts."""
    d = definitions.withColumn("phrase", T.phrase(F.col("term"))).filter(F.col("phrase") != "")
    first = d.groupBy("content_hash", "phrase").agg(F.min_by(F.struct(*definitions.columns), "def_ord").alias("d"))
    return first.select("phrase", "d.*")


def by_phrase(definitions: DataFrame) -> DataFrame:
    """Definitions keyed by phrase; of several with one phrase the first defined counts.

    The files are taken to be valid together: of several editions give those of one time (``editions``).
    """
    first = by_file(definitions).groupBy("phrase").agg(F.min_by(F.struct(*definitions.columns), "content_hash").alias("d"))
    return first.select("phrase", "d.*")


def _ways(phrases: DataFrame) -> DataFrame:
    return phrases.select("phrase", _phrase_keys(F.col("phrase")).alias("ways"))


def rarest_keys(texts: DataFrame, phrases: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(phrase) plus ``keys``: the keys to look it up by, of the pair that the fewest texts hold.

    Only pairs of phrases that have a choice are counted. ``held``: the keys that texts hold, where they are known.
    """
    ways = _ways(phrases)
    several = ways.filter(F.size("ways") > 1).select("phrase", F.posexplode("ways").alias("way", "keys"))
    if held is None:
        wanted = several.select(F.explode("keys").alias("k")).distinct()
        held = texts.select(F.explode(_text_keys(F.col("text"))).alias("k")).join(wanted, "k")
    often = held.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    counted = several.select("phrase", "way", F.explode(F.array_distinct("keys")).alias("k")).join(often, "k", "left")
    weight = counted.groupBy("phrase", "way").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    best = weight.groupBy("phrase").agg(F.min_by("way", F.struct("n", "way")).alias("way"))
    return ways.join(best, "phrase", "left").select("phrase", F.array_distinct(F.get("ways", F.coalesce("way", F.lit(0)))).alias("keys"))


def candidates(texts: DataFrame, phrases: DataFrame, key: tuple[str, ...] = ("text_id",), few_keys: int = FEW_KEYS) -> DataFrame:
    """(key, p): phrases (as structs, with their pattern) that a text may use, one row each or several.

    Phrases of at most ``few_keys`` keys in all are sent to every task: texts stay where they are. Of
    more, texts are dealt over SALTS keys of the join by their own key and each phrase is given to all
    of them, so a stop word's texts do not meet in one task either way.
    """
    fields = phrases.columns
    # One or two plain words are found for certain by their key; other phrases need their pattern.
    plain = F.col("phrase").rlike(r"(?U)^\w+( \w+)?\z")
    p = F.struct(*fields, T.phrase_pattern(F.col("phrase")).alias("pattern"), plain.alias("plain")).alias("p")
    ways = _phrase_keys(F.col("phrase"))
    size = phrases.agg(F.coalesce(F.sum(F.array_size(F.flatten(ways))), F.lit(0)).alias("keys"), F.coalesce(F.max(F.size(ways)), F.lit(0)).alias("ways")).first()
    few, named = size["keys"] <= few_keys, phrases.select("phrase").distinct()
    held = keys_held(texts, _ways(named).select(F.explode(F.flatten("ways")).alias("k")).distinct(), key) if few else None
    if size["ways"] > 1:
        rarest = rarest_keys(texts, named, held)
    else:
        rarest = named.select("phrase", F.array_distinct(F.get(ways, F.lit(0))).alias("keys"))
    keyed = phrases.select("phrase", p).join(rarest, "phrase").select("p", F.explode("keys").alias("k"))
    if few:
        return held.join(F.broadcast(keyed), "k").select(*key, "p")
    words = texts.select(*key, F.explode(_text_keys(F.col("text"))).alias("k"))
    keyed = keyed.select("p", "k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return words.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).join(keyed, ["k", "salt"]).select(*key, "p")


def matched(texts: DataFrame, phrases: DataFrame, key: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """Each text with the phrases it uses: key, found (an array of structs of ``phrases``' columns).

    The candidates of a text are gathered by its key, so a text is joined and read once, whatever it
    matches; they are at most as many as its distinct tokens and pairs.
    """
    fields = phrases.columns
    gathered = candidates(texts, phrases, key).groupBy(*key).agg(F.collect_set("p").alias("candidates"))
    joined = gathered.join(texts.select(*key, "text"), list(key))
    hits = F.filter("candidates", lambda p: p["plain"] | F.call_function("regexp_like", F.col("text"), p["pattern"]))
    return joined.select(*key, F.transform(hits, lambda p: F.struct(*[p[f].alias(f) for f in fields])).alias("found"))


def _one_each(found: DataFrame, *columns: str) -> DataFrame:
    """A row for each phrase in ``found``.

    By way of ``inline_outer``: before ``inline`` Spark puts a filter on the array's size, pushes it below the
    search and so searches every text twice.
    """
    return found.select(*columns, F.inline_outer("found")).filter(F.col("phrase").isNotNull())


def uses(texts: DataFrame, phrases: DataFrame, key: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """(key, phrase): every phrase each text uses as a whole phrase."""
    return _one_each(matched(texts, phrases.select("phrase"), key), *key)


def pointers(definitions: DataFrame) -> DataFrame:
    """(def_hash, def_ord, target): definitions that only point to another one of their file, with that one.

    A definition is known by its file's hash and its place there, since places start anew in every file.
    """
    target = F.regexp_extract(T.collapse(F.col("text")), fixed.POINTER, 1)
    pointing = definitions.select(F.col("content_hash").alias("def_hash"), "def_ord", T.phrase(target).alias("phrase")).filter(F.col("phrase") != "")
    named = by_file(definitions).select("phrase", F.col("content_hash").alias("def_hash"), F.struct(F.col("content_hash").alias("def_hash"), "def_ord").alias("target"))
    return pointing.join(named, ["def_hash", "phrase"]).drop("phrase")


def section_terms(texts: DataFrame, definitions: DataFrame, key: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """Terms each section uses, and whether a longer used term of the same file already covers a one-word one.

    This depends on the corpus alone, so it is computed once per version and joined per question. A corpus
    may hold several editions of a file of definitions: a phrase is looked for once and given for each of
    the files that define it (as many as editions), and ``editions.restricted`` picks the valid ones.
    """
    terms = by_file(definitions).groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct(F.col("content_hash").alias("def_hash"), "def_ord"))).alias("defs"))
    single = terms.filter(~F.contains("phrase", F.lit(" "))).select("phrase")
    others = terms.select(F.col("phrase").alias("text_id"), F.col("phrase").alias("text"))
    inside = uses(others, single).filter(F.col("text_id") != F.col("phrase"))
    longer = inside.groupBy("phrase").agg(F.collect_list("text_id").alias("longer"))
    found = matched(texts, terms.join(longer, "phrase", "left"), key)
    covering = F.filter("found", lambda g: F.contains(g["phrase"], F.lit(" ")))
    found = _one_each(found.withColumn("covering", covering), *key, "covering").select(*key, "covering", "phrase", "longer", F.inline("defs"))
    covers = F.exists("covering", lambda g: F.array_contains(F.col("longer"), g["phrase"]) & F.exists(g["defs"], lambda d: d["def_hash"] == F.col("def_hash")))
    return found.select(*key, "phrase", "def_hash", "def_ord", F.coalesce(covers, F.lit(False)).alias("covered"))


def attach(
    retrieved: DataFrame, terms: DataFrame, pointed: DataFrame, per_section: int = fixed.DEFINITIONS_PER_SECTION,
    total: int = fixed.DEFINITIONS_TOTAL, key: tuple[str, ...] = ("text_id",),
) -> DataFrame:
    """Definitions given with each question's sections, capped per section and in total, in order.

    ``retrieved``: question_id, rank and the section key; with ``n_sections`` a row stands for so many sections of
    the same terms and has the rank of their first. Within a section longer phrases come first,
    then terms fewer of the question's sections use; a definition that only points brings its target
    right after it. Both caps are top-k windows, so tasks keep k rows per group before shuffling.
    """
    many = F.col("n_sections") if "n_sections" in retrieved.columns else F.lit(1)
    hits = retrieved.select("question_id", "rank", *key, many.alias("many")).join(terms, list(key))
    often = hits.groupBy("question_id", "phrase").agg(F.sum("many").alias("freq"))
    specific = hits.filter(~F.col("covered")).join(often, ["question_id", "phrase"])
    order = Window.partitionBy("question_id", "rank").orderBy(-F.size(F.split("phrase", " ")), "freq", "phrase")
    top = specific.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_section)
    # An item and its target: two places, in that order.
    linked = top.join(pointed, ["def_hash", "def_ord"], "left")
    both = F.filter(F.array(F.struct("def_hash", "def_ord"), "target"), lambda d: d.isNotNull())
    items = linked.select("question_id", "rank", "place", F.posexplode(both).alias("step", "d")).select("question_id", "rank", "place", "step", "d.*")
    first = items.groupBy("question_id", "def_hash", "def_ord").agg(F.min(F.struct("rank", "place", "step")).alias("seen"))
    listed = Window.partitionBy("question_id").orderBy("seen")
    return first.withColumn("def_rank", F.row_number().over(listed)).filter(F.col("def_rank") <= total).drop("seen")
