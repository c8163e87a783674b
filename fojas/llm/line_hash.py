"""Line deduplication with a sharded minimal perfect hash over repeated line hashes.

Lines that at least two documents hold are known by two 64-bit hashes. They are split into shards, and
each shard becomes one row: a minimal perfect hash that gives every known line a slot, and arrays of
fingerprints, counts and first documents in slot order. The arrays need about 24 bytes a line, the
lines' texts are not kept. Documents' line hashes stream past their shard's arrays: a task holds one
shard and one batch of probes, never a line's occurrences together. Where a shard's lines are held by so many
documents that their probes would weigh on one task, the shard is copied and its probes are dealt over the
copies.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fojas.llm.common import BLANKS, ascii_lower, mix, text_chunks, written

LINES_PER_SHARD = 100_000
GAMMA = 2.0


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays, where a key owns the first bit
    that no other key of its level wants. Keys that collide on all levels are listed."""

    LEVELS = 40

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, at = [], 0
        for bits in levels:
            rank = np.cumsum(bits, dtype=np.int64) - bits + at
            at += int(bits.sum())
            self.ranks.append(rank)
        self.listed = at

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < cls.LEVELS:
            size = int(GAMMA * len(left)) + 1
            place = cls._place(left, len(levels), size)
            own = np.bincount(place, minlength=size) == 1
            levels.append(own)
            left = left[~own[place]]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; any slot, or -1, for a key that is not in the set."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            place = self._place(keys[open_], level, len(bits))
            own = bits[place]
            out[open_[own]] = self.ranks[level][place[own]]
            open_ = open_[~own]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.listed + at[same]
        return out


class Shard:
    """A shard's arrays in slot order."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        self.index, self.prints, self.counts, self.firsts = index, prints, counts, firsts

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> Shard:
        keys = mix(h1 ^ mix(h2))
        index = PerfectHash.of(keys)
        order = np.empty(len(keys), np.int64)
        order[index.slots(keys)] = np.arange(len(keys))
        return cls(index, h2[order], np.minimum(counts, 2**32 - 1).astype(np.uint32)[order], firsts[order])

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which probes are known, and of all (0 where unknown) the count and the first document."""
        slot = self.index.slots(mix(h1 ^ mix(h2)))
        if not len(self.prints):
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        known = (slot >= 0) & (self.prints[slot] == h2)
        return known, np.where(known, self.counts[slot], 0), np.where(known, self.firsts[slot], 0)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        levels = {f"level{i}": np.packbits(b) for i, b in enumerate(self.index.levels)}
        sizes = np.array([len(b) for b in self.index.levels], np.int64)
        np.savez(out, sizes=sizes, rest=self.index.rest, prints=self.prints, counts=self.counts, firsts=self.firsts, **levels)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        z = np.load(io.BytesIO(data))
        levels = [np.unpackbits(z[f"level{i}"], count=int(n)).astype(bool) for i, n in enumerate(z["sizes"])]
        return cls(PerfectHash(levels, z["rest"]), z["prints"], z["counts"], z["firsts"])


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, shortest: int) -> DataFrame:
    """(id, th, line, h1, h2) of all lines whose key has at least ``shortest`` characters; th marks the text."""
    lines = docs.filter("id is not null and text is not null").select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    lines = lines.select("id", "th", "line", line_key(F.col("s")).alias("k")).filter(F.length("k") >= shortest)
    return lines.select("id", "th", "line", F.xxhash64("k").alias("h1"), F.xxhash64("k", F.lit(7)).alias("h2"))


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    u = lambda c: rows[c].to_numpy(np.int64).view(np.uint64)
    blob = Shard.of(u("h1"), u("h2"), rows.n.to_numpy(np.int64), rows["first"].to_numpy(np.int64)).to_bytes()
    return pd.DataFrame({"shard": [key[0]], "arrays": [blob]})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, arrays = None, None
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        blobs = batch.column("arrays")
        turns = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
        for a, b in zip(turns, [*turns[1:], len(shard)]):
            if shard[a] != at:
                at, arrays = shard[a], None
            if blobs[a].is_valid:
                arrays = Shard.from_bytes(blobs[a].as_py())
                a += 1
            if arrays is None or a == b:
                continue
            part = batch.slice(a, b - a)
            u = lambda c: part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)  # noqa: B023, E731
            known, _, firsts = arrays.probe(u("h1"), u("h2"))
            drop = known & (firsts != part.column("id").to_numpy(zero_copy_only=False))
            yield part.select(["id", "th", "line"]).filter(pa.array(drop))


def dropped_lines(docs: DataFrame, shortest: int = 10) -> DataFrame:
    """(id, th, lines): the numbers of lines that go, of documents that lose any.

    All lines probe the arrays of their shard. A shard whose lines occur more often than an average shard's, as
    one with a line that every document holds, is copied as many times, and its probes are dealt over
    the copies: there are at most twice as many copies as shards.
    """
    spark = docs.sparkSession
    lines = line_hashes(docs, shortest)
    counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    known = written(counted.filter("first < last").drop("last"), "lines")
    total = known.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total.keys // LINES_PER_SHARD + 1)
    shard = F.pmod("h1", F.lit(shards))
    busy = known.groupBy(shard.alias("shard")).agg(F.sum("n").alias("n"))
    copies = (F.lit(1) + F.floor(F.col("n") / F.lit(max(1, total.lines // shards)))).cast("int").alias("copies")
    busy = written(busy.select("shard", copies).filter("copies > 1"), "busy")  # a row for each shard at most
    index = known.select(shard.alias("shard"), "h1", "h2", "n", "first").groupBy("shard").applyInPandas(_build, "shard long, arrays binary")
    index = index.join(F.broadcast(busy), "shard", "left").select("arrays", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"), "shard")
    none = F.lit(None)
    slot = (F.shiftleft(F.col("shard"), 24) + F.col("copy")).alias("shard")
    index = index.select(slot, "arrays", *(none.cast("long").alias(c) for c in ("id", "th", "h1", "h2")), none.cast("int").alias("line"))
    probes = lines.withColumn("shard", shard).join(F.broadcast(busy), "shard", "left")
    probes = probes.withColumn("copy", F.coalesce(F.pmod(F.xxhash64("id", "th", "line"), F.col("copies")).cast("int"), F.lit(0)))
    probes = probes.select(slot, none.cast("binary").alias("arrays"), "id", "th", "h1", "h2", "line")
    both = index.unionByName(probes).repartition(shards, "shard").sortWithinPartitions("shard", F.col("arrays").isNull())
    out = both.mapInArrow(_probe, "id long, th long, line int")
    return out.groupBy("id", "th").agg(F.collect_set("line").alias("lines"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, texts in text_chunks(batch, most_rows=5000):
            part = batch.slice(at, to - at)
            n, gone, kept = [], [], []
            for text, drop in zip(texts, part.column("lines").to_pylist()):
                lines = text.split(b"\n")
                n.append(len(lines))
                gone.append(len(drop or ()))
                if drop:
                    drop = set(drop)
                    text = b"\n".join([x for i, x in enumerate(lines) if i not in drop])
                kept.append(text)
            arrays = [part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_lines", "n_dropped", "kept_text"])


def dedupe_lines(docs: DataFrame, shortest: int = 10) -> DataFrame:
    """(id, text) to (id, n_lines, n_dropped, kept_text), a row for each row; other columns are not read.

    Lines end at \\n only; a null or empty text is one empty line. A line whose key has at least
    ``shortest`` characters and is held by two ids goes from all but the smallest; lines repeated in
    that one stay. Rows that repeat an id are one holder, whatever their texts. Rows with null id hold
    nothing and keep all lines. A text may lose all lines; then the kept text is empty.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), "text")
    gone = dropped_lines(docs, shortest)
    schema = T._parse_datatype_string("id long, n_lines long, n_dropped long, kept_text string")
    return docs.withColumn("th", F.xxhash64("text")).join(gone, ["id", "th"], "left").select("id", "text", "lines").mapInArrow(_cut, schema)
