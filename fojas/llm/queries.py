"""The registered queries of this package. Each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fojas.llm import ann_scan, decontaminate, lang_centroid, line_hash, merkle_manifest, mix_flow, near_hamming, pii_disclosure, secret_scan, shard_slots, token_store, url_links, whitening
from fojas.llm.common import new_folder, read, ship, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of documents, whatever other columns the table has."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query
def op1_link_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    return url_links.judge(read(spark, sf_dir, "pages"), rules)


@query
def op2_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return ann_scan.search(rows, F.col("id") % 100 == 0, k=10).withColumnRenamed("id", "vec_id")


@query
def op3_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", mix_flow.word_count("text").alias("size"))
    docs = written(docs, "sized")
    targets = mix_flow.source_targets(docs)
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    table = spark.createDataFrame([(s, n, t) for s, (n, t) in targets.items()], schema)
    mixed = mix_flow.mix(docs.withColumn("sources", F.array("source")), {s: t for s, (_, t) in targets.items()})
    mixed = mixed.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


@query
def op4_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), width=10)
    return decontaminate.digest(found).withColumnRenamed("id", "doc_id")


ORACLES["op4_fm_decontaminate"] = r"""
WITH lists AS (
  SELECT true AS item, item_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
  UNION ALL
  SELECT false, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM documents
), windows AS (
  SELECT id AS item_id, least(10, len(words)) AS width, array_to_string(words[i:i + 9], ' ') AS win
  FROM lists, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS t(i) WHERE item AND len(words) > 0
), widths AS (SELECT DISTINCT width FROM windows), places AS (
  SELECT id, i, width, array_to_string(words[i:i + width - 1], ' ') AS win
  FROM lists, widths, unnest(range(1, len(words) - width + 2)) AS t(i) WHERE NOT item
), found AS (
  SELECT p.id, p.i, p.width, w.item_id FROM places p JOIN windows w ON p.width = w.width AND p.win = w.win
), hits AS (
  SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT id, i, width FROM found), unnest(range(i, i + width)) AS t(j) GROUP BY id
), named AS (
  SELECT id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY id
)
SELECT l.id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lists l LEFT JOIN hits h ON l.id = h.id LEFT JOIN named n ON l.id = n.id WHERE NOT item
"""


@query
def op5_centroid_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lang_centroid.fold_train(docs)
    found = lang_centroid.predict(texts(spark, sf_dir), model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", lang_centroid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_line_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    found = line_hash.dedupe_lines(docs, shortest=10)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op6_line_hash"] = r"""
WITH lines AS (
  SELECT doc_id, i, s, translate(trim(s, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i), (SELECT 1), LATERAL (SELECT l[i] AS s)
), repeated AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first IS NOT NULL AND first <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN repeated USING (k) GROUP BY doc_id
"""


@query
def op7_near_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    found = near_hamming.near_duplicates(docs, k=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return pii_disclosure.listed(docs, pii_disclosure.find(docs)).withColumnRenamed("id", "doc_id")


@query
def op9_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    placed = shard_slots.shard_documents(docs, 40, new_folder(spark, "slot_map"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "v_slot",
    )


@query
def op10_parquet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "tokens")
    docs = texts(spark, sf_dir)
    token_store.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    found = token_store.listing(token_store.read_tokens(spark, path))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return merkle_manifest.verified(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END))) AS crc FROM documents
), bent AS (
  SELECT *, CASE WHEN crc % 7 = 0 THEN CAST(n_chars AS HUGEINT) + 1 ELSE n_chars END AS n2 FROM docs
), hashed AS (
  SELECT r, doc_id, lang, sha256(a || b) AS leaf, sha256(a2 || b) AS leaf2 FROM (
    SELECT *, head || coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-') AS a, head || coalesce(concat(strlen(CAST(n2 AS VARCHAR)), ':', n2), '-') AS a2,
      coalesce(strlen(text) || ':' || text, '-') AS b
    FROM (SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head FROM bent))
), leaves AS (
  SELECT *, coalesce('1' || lang, '0') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), nodes AS (
  SELECT 0 AS lvl, g, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lvl + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lvl, g, i // 2, n
), subroots AS (
  SELECT g, lvl AS depth, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, i, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 2, n
), root AS (SELECT h FROM tops WHERE n = 1
), steps AS (
  SELECT l.r, x.lvl AS lvl, x.i AS own, s.i AS other, s.h FROM leaves l JOIN nodes x ON x.g = l.g AND x.n > 1 AND x.i = l.i >> x.lvl
    LEFT JOIN nodes s ON s.g = x.g AND s.lvl = x.lvl AND s.i = xor(x.i, 1)
  UNION ALL
  SELECT l.r, 1000 + x.lvl, x.i, s.i, s.h FROM leaves l JOIN subroots b ON b.g = l.g JOIN tops x ON x.n > 1 AND x.i = b.i >> x.lvl
    LEFT JOIN tops s ON s.lvl = x.lvl AND s.i = xor(x.i, 1)
), proofs AS (
  SELECT r, sha256(string_agg(coalesce(h, ''), '' ORDER BY lvl)) AS proof_sha256,
    list(CASE WHEN other IS NULL THEN '-' WHEN other < own THEN '<' || h ELSE '>' || h END ORDER BY lvl) AS path FROM steps GROUP BY r
), folds AS (
  SELECT l.doc_id, l.leaf, b.h AS subroot, root.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_prepend(l.leaf2, coalesce(p.path, [])), lambda a, x: sha256(CASE x[1] WHEN '<' THEN x[2:] || a WHEN '>' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM leaves l JOIN subroots b ON b.g = l.g CROSS JOIN root LEFT JOIN proofs p ON p.r = l.r
)
SELECT *, folded_root = root AS verified FROM folds
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return whitening.whitened_components(rows, components=32).withColumnRenamed("id", "vec_id")


@query
def op13_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = secret_scan.scan(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return secret_scan.listed(found).withColumnRenamed("id", "doc_id")
