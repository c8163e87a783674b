"""Token ids as Parquet list columns, for selective reads of tokens and of metadata.

A task range of ids becomes one file in ascending order. Ids are dictionary-encoded lists, numbers
delta-encoded; row groups and pages are small enough that the page indexes let a reader fetch a few
documents' tokens, or only their lengths. The writer is Spark's own; its commit makes a lost task's
file appear once.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fojas.llm.common import SPACE_WORDS, edges_of_words, hashes_of_pieces, text_chunks

ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2000
#: Distinct pieces whose ids a worker remembers before it starts anew.
REMEMBERED = 500_000
RECENT = 100_000
_ENCODERS: dict[tuple[str, int], Encoder] = {}
_PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?)"))
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def _appended(have: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``have`` with ``more`` after its first ``used`` values, of twice the length where it is full."""
    if used + len(more) > len(have):
        grown = np.empty(max(2 * len(have), used + len(more)), have.dtype)
        grown[:used] = have[:used]
        have = grown
    have[used : used + len(more)] = more
    return have


class Encoder:
    """Ids of texts by remembering the ids of their pieces.

    For a model that drops white space, lower-cases and splits words from punctuation, texts can be
    encoded piece by piece: ASCII white space ends every token, and so does the change from an ASCII
    letter or digit to a closing run of punctuation. Pieces are known by a hash of their lower-cased
    bytes; those with "<|", which may spell a special token, by all their bytes.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores out
        from tokenizers import Tokenizer

        self.model, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.model.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.direct = self._letters_reach_model(vocabulary)
        self.forget()

    def _letters_reach_model(self, vocabulary: dict[str, int]) -> bool:
        """Whether lower-case ASCII letters come to the model as they are, so that it can be asked without the steps
        before it: no added token is a word of letters, and 2,000 words of the vocabulary get the same ids both ways."""
        if any(t.content.isalpha() for t in self.model.get_added_tokens_decoder().values()):
            return False
        words = (t.removesuffix("</w>") for t in vocabulary)
        words = sorted({w for w in words if w.isascii() and w.isalpha() and w.islower()})
        words = words[:: max(1, len(words) // 2000)]
        each = self.model.encode_batch_fast(words, add_special_tokens=False)
        return all([t.id for t in self.model.model.tokenize(w)] == e.ids for w, e in zip(words, each))

    def forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.old, self.recent = none, none  # sorted hashes and their slots; recent ones are merged now and then
        self.known, self.filled = 1, 1  # slots and ids in use of arrays that grow by doubling
        self.size, self.begin = np.ones(1 << 10, np.int32), np.zeros(1 << 10, np.int64)
        self.ids = np.full(1 << 10, self.end_id, np.int32)  # slot 0 ends a text

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, slots in (self.old, self.recent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                same = keys[at] == hashes
                out[same] = slots[at[same]]
        return out

    def remember(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        keys, slots = np.concatenate((self.recent[0], hashes)), np.concatenate((self.recent[1], slots))
        merge = len(keys) > RECENT
        if merge:
            keys, slots = np.concatenate((self.old[0], keys)), np.concatenate((self.old[1], slots))
        sort = np.argsort(keys, kind="stable")
        if merge:
            self.old, self.recent = (keys[sort], slots[sort]), (keys[:0], slots[:0])
        else:
            self.recent = keys[sort], slots[sort]

    def learn(self, hashes: np.ndarray, pieces: list[bytes], plain: np.ndarray) -> np.ndarray:
        """Slots of new pieces. ``plain`` pieces are ASCII letters alone and go to the model itself. Other words of letters are one run of
        tokens, the last of which ends a word: such are encoded many at a time and told apart by that, the rest one by one."""
        kind = np.where(plain, 0, 2)
        for i in np.flatnonzero(~plain | (not self.direct)).tolist():
            kind[i] = 1 if pieces[i].decode().isalpha() else 2
        order = np.argsort(kind, kind="stable")
        plains, words, others = ([pieces[i] for i in np.flatnonzero(kind == k).tolist()] for k in range(3))
        direct, sizes, tokenize = [], [], self.model.model.tokenize
        for word in plains:
            got = tokenize(word.lower().decode())
            sizes.append(len(got))
            direct += [t.id for t in got]
        ids, sizes = [np.array(direct, np.int32)], [np.array(sizes, np.int64)]
        for a in range(0, len(words), 5000):
            some = words[a : a + 5000]
            got = np.array(self.model.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.word_end[got]) + 1
            if len(ends) != len(some):  # a model whose words end otherwise
                each = [e.ids for e in self.model.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
                got, ends = np.array([i for x in each for i in x], np.int32), np.cumsum([len(x) for x in each])
            ids.append(got)
            sizes.append(np.diff(np.concatenate(([0], ends))))
        each = [e.ids for e in self.model.encode_batch_fast([o.decode() for o in others], add_special_tokens=False)] if others else []
        ids.append(np.array([i for x in each for i in x], np.int32))
        sizes.append(np.array([len(x) for x in each], np.int64))
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        first, slots = self.known, np.empty(len(order), np.int64)
        slots[order] = np.arange(first, first + len(order))
        self.remember(hashes, slots)
        self.size = _appended(self.size, first, sizes)
        self.begin = _appended(self.begin, first, self.filled + np.cumsum(sizes) - sizes)
        self.ids = _appended(self.ids, self.filled, ids)
        self.known, self.filled = first + len(sizes), self.filled + len(ids)
        return slots

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's end id included, and how many each text has."""
        data, starts, ends, begins = edges_of_words(texts, SPACE_WORDS)
        raw = b" ".join(texts)
        stem = ends.copy()
        go = np.flatnonzero(_PUNCTUATION[data[stem - 1]])
        while len(go):
            stem[go] -= 1
            go = go[stem[go] > starts[go]]
            go = go[_PUNCTUATION[data[stem[go] - 1]]]
        cut = stem[(stem < ends) & (stem > starts) & _ALNUM[data[stem - 1]]]
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        hashes = hashes_of_pieces(data, starts, ends)
        at = raw.find(b"<|")
        while at >= 0:
            i = int(np.searchsorted(starts, at, "right")) - 1
            hashes[i] = int.from_bytes(hashlib.sha256(raw[starts[i] : ends[i]]).digest()[:8], "little")
            at = raw.find(b"<|", at + 2)
        inverse, distinct = pd.factorize(hashes)
        where = np.empty(len(distinct), np.int64)
        where[inverse] = np.arange(len(inverse))  # any place of equal pieces
        sort = np.argsort(distinct)  # sorted hashes are found faster
        distinct, where, place = distinct[sort], where[sort], np.empty(len(sort), np.int64)
        place[sort] = np.arange(len(sort))
        if self.known > REMEMBERED:
            self.forget()
        slots = self.find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
            x, y = starts[where[new]], ends[where[new]]
            slots[new] = self.learn(distinct[new], [raw[i:j] for i, j in zip(x.tolist(), y.tolist())], letters[y] - letters[x] == y - x)
        slots = slots[place][inverse]
        first = np.searchsorted(starts, begins)
        slots = np.insert(slots, first[1:], 0)
        size = self.size[slots].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.begin[slots] - upto[:-1], size) + np.arange(upto[-1])]
        stops = upto[first[1:] + np.arange(1, len(texts) + 1)]
        return ids, np.diff(np.concatenate(([0], stops)))


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end_id) not in _ENCODERS:
            _ENCODERS[(path, end_id)] = Encoder(path, end_id)
        encoder, place = _ENCODERS[(path, end_id)], 0
        for batch in batches:
            for at, to, texts in text_chunks(batch, most_rows=5000):
                ids, sizes = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids))
                numbers = pa.array(np.arange(place, place + to - at))
                place += to - at
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), batch.column("part").slice(at, to - at), numbers, pa.array(sizes), lists], names=["id", "part", "place", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """(id, text) to token files in ascending id order under ``path``.

    Null and empty texts have only the end id. Null ids come first; rows with one id follow the hash of
    their text, so a hot id is spread over files. Equal rows stay in one file. An empty table gives an
    empty dataset. Other columns are not written.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text").repartitionByRange(n, "id", "th")
    rows = rows.sortWithinPartitions("id", "th").select("id", "text", F.spark_partition_id().alias("part"))
    tokens = rows.mapInArrow(_encode(tokenizer, end_id), "id long, part int, place long, n_tokens long, ids array<int>")
    (
        tokens.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, part int, place long, n_tokens long, ids array<int>").parquet(path)


def with_starts(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rows`` (part, place, n_tokens and more) of ``tokens`` with start, the ids of all documents before each: sums by
    file, for which lengths alone are read, then within a file."""
    files = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    files = files.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "base")
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    return rows.withColumn("own", own).join(files, "part").withColumn("start", F.col("base") + F.col("own")).drop("own", "base")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "part", "place", "n_tokens")), pa.array(crc, pa.int64())], names=["id", "part", "place", "n_tokens", "ids_crc32"])


def listing(tokens: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, part, place) of written tokens, read back from the files."""
    sums = tokens.mapInArrow(_crc, "id long, part int, place long, n_tokens long, ids_crc32 long")
    return with_starts(sums, tokens)
