"""Helpers shared by the corpus operators: the shared folder, written tables, text as arrays of words."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on.
CHUNK_BYTES = 1 << 20
# A worker lives beside a JVM and should give back what it frees: Arrow's own allocators keep it, and so
# does the C library once its threshold for separate blocks has grown with the sizes freed.
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(_libc := ctypes.CDLL(None), "mallopt"):
    _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which also ends its growth
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests), one of this machine is set."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fojas-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_root(spark)}/llm-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(top)
    fs.deleteOnExit(top)
    return path


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once, so their workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_fojas_llm_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fojas-code-")), "fojas_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in [top / "__init__.py", *sorted((top / "llm").glob("*.py"))]:
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(path)
    context._fojas_llm_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later stages read it and need no lost executor's work."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(docs: DataFrame, least: int = 0) -> DataFrame:
    """``docs`` dealt over all cores when it comes in fewer splits than that; else as it is."""
    cores = least or docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


# --- texts as arrays of words -----------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Translation tables of bytes: separators to blank, A-Z to a-z.
SPACE_WORDS = bytes(32 if b in (32, 9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = -(-n >> 18) << 18  # a multiple of 2 ** 18
    if size not in _POWERS:
        up, down = np.full(size, _P), np.full(size, _P_INV)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


def _segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def edges_of_words(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, begins): the texts joined by one blank and translated, the bytes that words
    take in it, and where each text begins (n + 1 places)."""
    data = np.frombuffer(b" ".join(texts).translate(table) + b" ", np.uint8)
    begins = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))))
    blank = np.empty(len(data) + 1, bool)
    blank[0] = True
    np.equal(data, 32, out=blank[1:])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return data, edges[0::2], edges[1::2], begins


def hashes_of_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pieces of ``data``; long inputs are worked off in stretches."""
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        hashes[at:to] = _segment_hashes(data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base)
        at = to
    return hashes


def word_places(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): 64-bit hashes of all words of ``texts`` in order, the bytes they
    take in the texts joined by one blank, and where each text's words begin (n + 1 places).

    ``table`` turns a text's separators into blanks (SPACE_WORDS, ALNUM_WORDS).
    """
    data, starts, ends, begins = edges_of_words(texts, table)
    return hashes_of_pieces(data, starts, ends), starts, ends, np.searchsorted(starts, begins)


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, first = word_places(texts, table)
    return hashes, first


def text_chunks(batch: pa.RecordBatch, text: str = "text", most_rows: int = 2000, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts as UTF-8 bytes, null as empty) of pieces of a batch of about ``size`` bytes."""
    column = batch.column(text).cast(pa.binary())
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = upto[at] - lengths[at]
        to = min(max(at + 1, int(np.searchsorted(upto, before + size, "right"))), at + most_rows, len(lengths))
        yield at, to, [t or b"" for t in column.slice(at, to - at).to_pylist()]
        at = to


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.uint64).view(np.int64)
