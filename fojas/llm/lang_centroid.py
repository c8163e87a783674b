"""Language identification by the nearest of several centroids per language.

A text is the vector of its character 1- to 3-grams (lower-cased letters, every other character a
blank), hashed to ``DIM`` buckets, weighted by TF-IDF and scaled to length one. Document frequencies
count all training rows. Each language's centroids come from spherical k-means over a seeded sample of at
most ``sample`` of its different texts. A text gets the language of the centroid with the largest cosine, and is
rejected when it lies much farther from it than the sample's texts, and stretches of them, of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fojas.llm.common import text_chunks

DIM = 4096
BANDS = 24
#: Sampled texts of a length that are needed to say how near such texts lie.
ENOUGH = 20
#: Of those the share that may lie farther off than the bound: a few junk rows of a sample don't set it.
FARTHER = 0.02
#: Texts of fewer grams (some ten letters) are not rejected by distance.
FEWEST_GRAMS = 31
#: Code points whose grams are counted in one step.
STRETCH = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to its lower-case letter, 32 where it is none. Built once in a worker."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for block in range(0, 0x110000, 0x1000):
            for c in range(block, block + 0x1000):
                if not 0xD800 <= c <= 0xDFFF and (s := chr(c)).isalpha():
                    low = s.lower()
                    table[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts (texts, DIM) of hashed n-grams; grams of blanks only, or across texts, are not counted. Long texts are
    worked off in stretches."""
    short = [t if len(t) <= STRETCH else b"" for t in texts]
    codes = [_codes(t.decode("utf-8", "replace")) for t in short]
    blank = np.full(1, 32, np.uint32)
    flat = np.concatenate([x for c in codes for x in (blank, c, blank)]) if codes else blank[:0]
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) + 2 for c in codes])
    out = _counts(flat, rows, len(texts), len(flat))
    for i, text in enumerate(texts):
        if len(text) > STRETCH:
            whole = f" {text.decode('utf-8', 'replace')} "
            for at in range(0, len(whole), STRETCH):  # two more code points finish the grams that begin here
                some = _codes(whole[at : at + STRETCH + 2])
                out[i] += _counts(some, np.zeros(len(some), np.int32), 1, STRETCH)[0]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _counts(flat: np.ndarray, rows: np.ndarray, n_rows: int, starts: int) -> np.ndarray:
    """Counts of the grams that begin at the first ``starts`` places of ``flat``, by row."""
    flat = _letters()[np.minimum(flat, 0x10FFFF)].astype(np.uint32)
    letter = flat != 32
    out = np.zeros(n_rows * DIM, np.float32)
    a = flat * np.uint32(0x9E3779B1)
    for n in (1, 2, 3):
        m = min(len(flat) - n + 1, starts)
        if m <= 0:
            break
        if n == 1:
            h, keep = a[:m].copy(), letter[:m]
        elif n == 2:
            h, keep = a[:m] * np.uint32(31) + a[1 : m + 1], letter[:m] | letter[1 : m + 1]
        else:
            h, keep = a[:m] * np.uint32(961) + a[1 : m + 1] * np.uint32(31) + a[2 : m + 2], letter[1 : m + 1]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        keep = keep & (rows[:m] == rows[n - 1 : n - 1 + m])
        cell = rows[:m][keep].astype(np.int64) * DIM + (h[keep] >> np.uint32(20))
        out += np.bincount(cell, minlength=len(out)).astype(np.float32)
    return out.reshape(n_rows, DIM)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def band(counts: np.ndarray) -> np.ndarray:
    """Texts by the logarithm of their number of grams."""
    return np.minimum(np.log2(counts.sum(axis=1) + 1).astype(int), BANDS - 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts_seen = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for at, to, texts in text_chunks(batch, most_rows=500):
            total += (gram_counts(texts) > 0).sum(axis=0)
            texts_seen += to - at
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(total[full], texts_seen))], names=["bucket", "n"])


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart rows."""
    centre = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centre.append(x[np.argmin(np.max(x @ np.stack(centre).T, axis=1))])
    c = np.stack(centre)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _nearness(texts: list[bytes], idf: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length band of each text and its cosine with the nearest centroid."""
    bands, cosines = [np.zeros(0, int)], [np.zeros(0)]
    for i in range(0, len(texts), 100):
        counts = gram_counts(texts[i : i + 100])
        bands.append(band(counts))
        cosines.append((vectors(counts, idf) @ centroids.T).max(axis=1))
    return np.concatenate(bands), np.concatenate(cosines)


def _bounds(texts: list[str], idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """By length band the cosine that nearly all sampled texts of that length reach, those of longer texts by their
    middle; infinite where there are not enough."""
    near: list[list[np.ndarray]] = [[] for _ in range(BANDS)]
    longest = max(map(len, texts))
    for size in (longest, *(1 << j for j in range(3, longest.bit_length()))):
        now = texts if size == longest else [t[(len(t) - size) // 2 :][:size] for t in texts if len(t) > size]
        own, cosine = _nearness([t.encode("utf-8", "replace") for t in now], idf, centroids)
        for b in np.unique(own):
            near[b].append(cosine[own == b])
    together = [np.concatenate(x) if x else np.zeros(0) for x in near]
    return np.array([np.quantile(x, FARTHER) if len(x) >= ENOUGH else np.inf for x in together])


def _fit(idf: np.ndarray, k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.text.tolist()
        counts = np.concatenate([gram_counts([t.encode("utf-8", "replace") for t in texts[i : i + 100]]) for i in range(0, len(texts), 100)])
        c = _k_means(vectors(counts, idf), k)
        least = _bounds(texts, idf, c) if len(texts) >= ENOUGH else np.full(BANDS, np.inf)
        return pd.DataFrame({"lang": key[0], "centroid": [v.tolist() for v in c], "least": [least.tolist()] * len(c)})

    return run


class Model:
    """Weights, and for each centroid its language and the bound of cosines by length. Lengths of which the sample
    has too few have that of the nearest shorter ones, since longer texts come nearer; a language with too few
    texts has the lowest bound of all others."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centroids, self.least = idf, langs, centroids, least.copy()
        for b in range(1, BANDS):
            self.least[:, b] = np.where(np.isfinite(self.least[:, b]), self.least[:, b], self.least[:, b - 1])
        self.least = np.where(np.isfinite(self.least), self.least, self.least.min(axis=0, initial=np.inf))


def train(docs: DataFrame, seed: int = 1, per_language: int = 400, centroids: int = 4) -> Model:
    """Rows (text, lang) to a model. Rows with null or letterless text or null language teach nothing.

    Document frequencies are summed over all rows. The sample is the ``per_language`` of each
    language's different texts with the smallest seeded hash, so it doesn't depend on order, partitions or copies.
    The driver holds DIM counts and, for each language, ``centroids`` vectors.
    """
    docs = docs.filter(F.col("lang").isNotNull() & has_letter("text")).select("text", "lang")
    sums = docs.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = dict((r.bucket, r.n) for r in sums)
    total = seen.pop(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + seen.get(b, 0))) + 0.1 for b in range(DIM)], np.float32)
    sample = sampled(docs, seed, per_language)
    fitted = sample.select("lang", "text").groupBy("lang").applyInPandas(_fit(idf, centroids), "lang string, centroid array<float>, least array<double>").collect()
    if not fitted:
        return Model(idf, [], np.zeros((0, DIM), np.float32), np.zeros((0, BANDS)))
    fitted.sort(key=lambda r: (r.lang, r.centroid))
    return Model(idf, [r.lang for r in fitted], np.array([r.centroid for r in fitted], np.float32), np.array([r.least for r in fitted]))


def sampled(docs: DataFrame, seed: int, per_language: int) -> DataFrame:
    """(text, lang) to the ``per_language`` different texts of each language with the smallest seeded hash."""
    hashed = docs.select("text", "lang", F.xxhash64("text", F.lit(seed)).alias("h"))
    share = {r.lang: min(1.0, 3 * per_language / r["count"]) for r in hashed.select("lang", "h").distinct().groupBy("lang").count().collect()}
    if not share:
        return docs.select("lang", "text")
    limits = F.create_map(*[x for lang, s in share.items() for x in (F.lit(lang), F.lit(s))])
    near = hashed.filter(F.shiftrightunsigned("h", 1) / F.lit(float(2**63)) <= limits[F.col("lang")]).dropDuplicates(["lang", "h", "text"])
    order = Window.partitionBy("lang").orderBy("h", "text")
    return near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language).select("lang", "text")


def has_letter(text: str) -> Column:
    return F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")


def judge(model: Model, texts: list[bytes], margin: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    n = len(texts)
    counts = gram_counts(texts)
    known = counts.sum(axis=1) > 0
    if not model.langs:
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    cosine = vectors(counts, model.idf) @ model.centroids.T
    best = np.argmax(cosine, axis=1)
    score = np.where(known, np.clip(cosine[np.arange(n), best], 0, 1), 0).astype(float)
    lang = np.where(known, np.array(model.langs, object)[best], "und")
    bound = model.least[best, band(counts)]
    judged = np.isfinite(bound) & (counts.sum(axis=1) >= FEWEST_GRAMS)
    return lang.tolist(), score, ~known | (judged & (score < margin * np.where(judged, bound, 0)))


def _predict(model, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in text_chunks(batch, most_rows=500):
                lang, score, rejected = judge(model.value, texts, margin)
                part = batch.slice(at, to - at)
                arrays = [*(part.column(c) for c in batch.schema.names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return run


def predict_beside(docs: DataFrame, model: Model, margin: float = 0.3) -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score and rejected; see ``predict``."""
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema, *T._parse_datatype_string("lang_pred string, score double, rejected boolean")])
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(held, margin), schema)


def predict(docs: DataFrame, model: Model, margin: float = 0.3) -> DataFrame:
    """(id, text) to (id, lang_pred, score, rejected), a row for each row; other columns are not read.

    ``score`` is the cosine with the nearest centroid. ``rejected``: no letters, or a cosine under ``margin`` of
    what nearly all sampled texts of like length, and stretches of longer ones, have with their own centroids. Texts
    of less than some ten letters are not rejected by distance: a word or two prove nothing. Long texts are
    counted whole, in stretches. Null, empty and letterless texts are ``und`` with
    score 0; so are all texts for a model that saw no row. Ties go to the first language by name.
    """
    return predict_beside(docs.select(F.col("id").cast("long").alias("id"), "text"), model, margin).drop("text")


def held_out(id_column: str) -> Column:
    """One row in three, by the id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def fold_train(docs: DataFrame, **options) -> Model:
    """A model of the rows of (doc_id, text, lang) that are not held out. Rows without id teach nothing."""
    return train(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")), **options)
