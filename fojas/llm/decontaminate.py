"""Benchmark decontamination with an FM-index per shard of training texts.

Every task indexes its documents shard by shard (about ``SHARD_BYTES`` of text; a document is never
cut), searches all benchmark windows backward through the wavelet ranks, locates the occurrences by
sampled suffix positions and merges them to spans. Words that occur in no benchmark item can be in no
match, so they all become the separator, and runs shorter than the shortest window are left out: the
index holds only words that a window could cover. No shuffle; a lost task indexes its shards again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fojas.llm.common import ALNUM_WORDS, text_chunks, word_hashes, word_places
from fojas.llm.fm_index import FMIndex

SHARD_BYTES = 8 << 20
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>, clean_text string"


class Windows:
    """The windows of all items as rows of symbols, and the items that hold each."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        items = [(str(i), t.encode()) for i, t in items if i is not None and t]
        hashes, first = word_hashes([t for _, t in items], ALNUM_WORDS) if items else (np.zeros(0, np.uint64), [0])
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        holders: dict[tuple[int, ...], set[str]] = {}
        for k, (item, _) in enumerate(items):
            own = (symbols[first[k] : first[k + 1]] + 1).tolist()
            for j in range(max(1, len(own) - width + 1) if own else 0):
                holders.setdefault(tuple(own[j : j + width]), set()).add(item)
        self.groups = []
        for m in sorted({len(w) for w in holders}):
            rows = [w for w in holders if len(w) == m]
            self.groups.append((m, np.array(rows, np.int64), [sorted(holders[w]) for w in rows]))
        self.shortest = self.groups[0][0] if self.groups else 0
        slots = 1 << max(16, len(self.vocabulary).bit_length() + 4)
        self.maybe = np.zeros(slots, bool)
        self.maybe[(self.vocabulary & np.uint64(slots - 1)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Words to symbols from 1, 0 for words of no item."""
        out = np.zeros(len(hashes), np.int64)
        likely = np.flatnonzero(self.maybe[(hashes & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[likely]), max(0, len(self.vocabulary) - 1))
        same = self.vocabulary[at] == hashes[likely] if len(self.vocabulary) else np.zeros(0, bool)
        out[likely[same]] = at[same] + 1
        return out


def _runs(symbols: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of symbols other than 0 within a document, of ``shortest`` at least, each followed by 0; and
    the word at each place."""
    n = len(symbols)
    inside = symbols > 0
    opens = np.zeros(n, bool)
    opens[first[:-1][first[:-1] < n]] = True
    starts = np.flatnonzero(inside & (opens | ~np.concatenate(([False], inside[:-1]))))
    stops = np.flatnonzero(inside & np.concatenate((~inside[1:] | opens[1:], [True]))) + 1
    keep = stops - starts >= shortest
    starts, stops = starts[keep], stops[keep]
    sizes = stops - starts + 1
    place = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    text = np.append(symbols, 0)[place]
    text[np.cumsum(sizes) - 1] = 0
    return text, place


def matches(symbols: np.ndarray, first: np.ndarray, windows: Windows) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, list[list[str]]]]]:
    """Words inside an occurrence of a window; and (word, row, items of rows) of all occurrences."""
    cover, found = np.zeros(len(symbols) + 1, np.int64), []
    if windows.shortest:
        text, place = _runs(symbols, first, windows.shortest)
        if len(text):
            index = FMIndex(text)
            for m, phrases, holders in windows.groups:
                which, lo, hi = index.search(phrases)
                counts = hi - lo
                rows = np.repeat(lo - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
                at = place[index.locate(rows)] if len(rows) else rows
                np.add.at(cover, at, 1)
                np.add.at(cover, at + m, -1)
                found.append((at, np.repeat(which, counts), holders))
    return np.cumsum(cover[:-1]) > 0, found


def _judge(windows, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Windows = windows.value
        for batch in batches:
            for at, to, texts in text_chunks(batch, most_rows=20_000, size=SHARD_BYTES):
                hashes, starts, ends, first = word_places(texts, ALNUM_WORDS)
                hit, found = matches(known.symbols(hashes), first, known)
                items: dict[int, set[str]] = {}
                for words, rows, holders in found:
                    docs = np.searchsorted(first, words, "right") - 1
                    for d, r in np.unique(np.stack((docs, rows), axis=1), axis=0).tolist():
                        items.setdefault(d, set()).update(holders[r])
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[first[1:]] - total[first[:-1]]
                spans, clean = [[]] * len(texts), [None] * len(texts)
                base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
                for d in range(len(texts)):
                    if n_hit[d]:
                        own = np.concatenate(([False], hit[first[d] : first[d + 1]], [False])).astype(np.int8)
                        turns = np.diff(own)
                        pairs = list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist()))
                        spans[d] = [{"start": a, "stop": b} for a, b in pairs]
                        if keep_text:
                            pieces, last = [], 0
                            for a, b in pairs:
                                pieces.append(texts[d][last : starts[first[d] + a] - base[d]])
                                last = ends[first[d] + b - 1] - base[d]
                            clean[d] = b"\n".join([*pieces, texts[d][last:]]).decode()
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in batch.schema.names), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()),
                        pa.array([sorted(items.get(d, ())) for d in range(len(texts))], pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(clean, pa.string()),
                    ],
                    names=[*batch.schema.names, "n_words", "n_hit", "items", "spans", "clean_text"],
                )

    return run


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, keep_text: bool = False, max_item_chars: int = 50_000_000) -> DataFrame:
    """(id, text) and benchmark (item_id, text) to a row per document: words, words hit, items found, spans.

    Words are runs of ASCII digits, letters and all characters beyond ASCII, A-Z lower-cased. A window is
    ``width`` consecutive words of an item, or a whole shorter item. Spans are (first word, word after the
    last) of merged occurrences; ``clean_text`` (with ``keep_text``, where anything was hit) is the text
    with every span replaced by a line end. Null and empty texts have no words; items with null id or
    text are left out; repeated documents and items give equal rows; empty tables give no rows or no hits.
    Only the named columns are read. Benchmark sets don't grow with the corpus: one of over
    ``max_item_chars`` characters is refused, to be judged in parts.
    """
    return beside(docs.select(F.col("id").cast("long").alias("id"), "text"), items, width, keep_text, max_item_chars).drop("text")


def beside(docs: DataFrame, items: DataFrame, width: int = 10, keep_text: bool = False, max_item_chars: int = 50_000_000) -> DataFrame:
    """All columns of ``docs`` plus those that ``decontaminate`` finds."""
    spark = docs.sparkSession
    rows = items.select("item_id", "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > max_item_chars:
        raise ValueError(f"the benchmark has {size} characters; at most {max_item_chars} are searched at once")
    windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in rows.collect()], width))
    added = T._parse_datatype_string(RESULT)
    docs = docs.drop(*added.fieldNames())
    return docs.mapInArrow(_judge(windows, keep_text), T.StructType([*docs.schema, *added]))


def cleaned(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Documents (doc_id, text, n_chars, others) with benchmark spans cut out of their texts.

    A text that was cut and has no word left takes its row with it; n_chars is counted anew where
    something was cut. Rows are judged one by one, in place; those with null id too.
    """
    found = beside(docs, items, width, keep_text=True)
    cut = F.col("n_hit") > 0
    found = found.filter(~cut | (F.col("n_words") > F.col("n_hit")))
    text = F.when(cut, F.col("clean_text")).otherwise(F.col("text"))
    return found.withColumn("n_chars", F.when(cut, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).withColumn("text", text).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
