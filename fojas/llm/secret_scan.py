"""Secret scans: known forms by pattern, and random strings by how badly a tokenizer compresses them.

A byte-pair vocabulary learned from text spends few tokens on words and names, and many on characters
drawn at random: prose and identifiers run to two and a half characters a token and more, keys and
passwords of letters and digits to one and a half. So every run of key characters is cut into parts,
parts that are known digests, identifiers or numbers are put aside, and what is left of at least
``least_chars`` is a secret if it has at most ``most_ratio`` characters a token.

Rows are worked on where they are read; nothing is shuffled. The vocabulary (a fixed file) goes to the
tasks once. The patterns do not go back over what they have read, and a run is encoded in stretches, so the
time for a text grows with its length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas.llm.common import text_chunks

KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind string, start long, stop long>>"
# The contract's patterns. A run of fewer characters than asked for holds no longer one, so
# the least length stands in two of them; the first must take what it finds, so its length is tested after.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_VALUE = 8

RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
PART = re.compile(r"[A-Za-z0-9]+")
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
ONE_CASE_HEX = re.compile(r"[0-9]*(?:[0-9a-f]*|[0-9A-F]*)")
LABELLED = re.compile(r"(?:sha1|sha256|sha384|sha512|md5)-[A-Za-z0-9+/]+={0,2}", re.IGNORECASE)
#: Words of names in code and paths, with a version or a count at their end at most.
NAME_PART = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+[A-Za-z]?")
LONGEST_NAME_PART = 15
#: Strings of fewer different characters repeat themselves; twenty drawn at random, even of hex digits, have more.
FEWEST_CHARACTERS = 8
#: Characters that are encoded at once; a vocabulary's merges seldom reach further.
STRETCH = 256
_ENCODERS: dict[tuple[str, str], Tokens] = {}


class Tokens:
    """How many tokens a string takes."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.model = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> int:
        return sum(len(self.model.encode_ordinary(text[a : a + STRETCH])) for a in range(0, len(text), STRETCH))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of matches of known forms, in characters."""
    out = []
    lower = text.lower()  # only to see quickly what most texts lack
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def known(part: str) -> bool:
    """Whether letters and digits are a number or have a digest's form."""
    return part.isdigit() or len(part) in DIGESTS and ONE_CASE_HEX.fullmatch(part) is not None


def remainder(run: str) -> tuple[int, int] | None:
    """The place in a run that is neither digest nor identifier; None where that is all of it.

    A name has several parts, each a word; a run of one part is left to the vocabulary.
    """
    if LABELLED.fullmatch(run):
        return None
    aside = [(m.start(), m.end()) for m in UUID.finditer(run)] if run.count("-") >= 4 else []
    parts = [m for m in PART.finditer(run) if not any(a <= m.start() < b for a, b in aside)]
    rest = [m for m in parts if not known(m[0])]
    if not rest:
        return None
    if len(parts) > 1 and all(len(m[0]) <= LONGEST_NAME_PART and NAME_PART.fullmatch(m[0]) for m in rest):
        return None
    end = rest[-1].end()
    return rest[0].start(), len(run) if run[end:].strip("=") == "" else end


def random_spans(text: str, run: re.Pattern[str], tokens: Tokens, least_chars: int, most_ratio: float) -> list[tuple[int, int, int]]:
    out = []
    for m in run.finditer(text):
        place = remainder(m[0]) if len(m[0]) >= least_chars else None
        if place and place[1] - place[0] >= least_chars:
            some = m[0][place[0] : place[1]]
            if len(set(some)) >= FEWEST_CHARACTERS and len(some) <= most_ratio * tokens(some):
                out.append((m.start() + place[0], 3, m.start() + place[1]))
    return out


def spans_of(text: str, run: re.Pattern[str], tokens: Tokens, least_chars: int, most_ratio: float) -> list[tuple[int, int, int]]:
    """All spans by start and kind; random strings that touch a known form are that form's."""
    base, more = base_spans(text) if run.search(text) else [s for s in base_spans(text) if s[1] != 2], []
    for s in random_spans(text, run, tokens, least_chars, most_ratio):
        if not any(b[0] < s[2] and s[0] < b[2] for b in base):
            more.append(s)
    return sorted(base + more)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or group of spans that overlap, replaced by the first one's kind."""
    out, at = [], 0
    for start, kind, stop in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, ranks: str, pattern: str, least_chars: int = 20, most_ratio: float = 2.0) -> DataFrame:
    """(id, text) to (id, spans array<struct<kind, start, stop>>, clean_text), a row for each row.

    Spans are in characters, end exclusive, by start and then kind. ``ranks`` names the vocabulary's file on the driver
    and ``pattern`` its way of cutting text. Null and empty texts have no spans, and a null text stays null;
    ids may be null or repeat; texts of any length are read whole; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with open(ranks, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a fixed file of about a megabyte
    if least_chars < 8:
        raise ValueError("shorter strings say nothing about chance")
    run = re.compile(rf"(?:[A-Za-z0-9+/_-]){{{least_chars - 2},}}={{0,2}}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks, pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = Tokens(vocabulary.value, pattern)
        tokens = _ENCODERS[key]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for at, to, raw in text_chunks(batch):
                texts = [t.decode() for t in raw]
                found = [spans_of(t, run, tokens, least_chars, most_ratio) for t in texts]
                rows = [[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spans] for spans in found]
                there = batch.column("text").slice(at, to - at).is_valid().to_pylist()
                clean = [masked(t, s) if ok else None for t, s, ok in zip(texts, found, there)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), pa.array(rows, kind), pa.array(clean, pa.string())], names=["id", "spans", "clean_text"])

    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(work, f"id long, spans {SPANS}, clean_text string")


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def listed(found: DataFrame) -> DataFrame:
    """(id, spans) to counts by kind, the hash of the base spans and all spans in writing."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != KINDS[-1])
    return found.select("id", *(count(k) for k in KINDS), F.sha2(_listing(base), 256).alias("base_sha256"), _listing(F.col("spans")).alias("spans"))
