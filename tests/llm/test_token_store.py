import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fojas.llm import token_store as T
from tests.llm.helpers import DOCS, awkward, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a\x1cb c", "x\u00a0y\u2003z", "é \u0301a  o'll I'M 12 34.5!!", "Σας ΟΔΟΣ ΣΑΣ", "<|endoftext|>hi <|startoftext|>", "ﬁ Å İstanbul ǅ",
    'x".', "(hi). foo... bar?! é, z", "A,B.", "<|ENDOFTEXT|> <|endoftext|>, <|x", "it's. don't, 12,", "ª º x²", "a≠ ,\u0338 ", "\u1100\u1161 \ud55c",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_ids_of_whole_texts(plain):
    encoder = T.Encoder(PATH, 1)
    for text in ODD:
        assert encoder.encode([text.encode()])[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
    ids, sizes = encoder.encode([t.encode() for t in ODD])
    want = [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in ODD]
    assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]


def test_forgetting_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    encoder = T.Encoder(PATH, 1)
    for i in range(4):
        text = prose(i, 50)
        assert encoder.encode([text.encode()])[0].tolist()[:-1] == plain.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, plain, tmp_path):
    rows = awkward() + [(i, t, None, None, 0) for i, t in enumerate(ODD)] + [(500, prose(i, 20), None, None, 0) for i in range(20)]
    path = f"file://{tmp_path}/tokens"
    T.write_tokens(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS part", "2 AS place"), path, PATH, 1, partitions=5)
    tokens = T.read_tokens(spark, path)
    own = [(x.id, x.ids) for x in tokens.orderBy("part", "place").collect()]
    assert sorted(own, key=str) == sorted([(r[0], [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows], key=str)
    ids = [(-1 if i is None else i) for i, _ in own]
    assert ids == sorted(ids)
    at = 0
    for got, (i, ids) in zip(T.listing(tokens).orderBy("start").collect(), own):
        assert (got.id, got.start, got.n_tokens, got.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_files_have_the_encodings_and_page_indexes(spark, tmp_path):
    rows = [(i, prose(i, 30), None, None, 0) for i in range(300)]
    T.write_tokens(spark.createDataFrame(rows, DOCS), f"file://{tmp_path}/t", PATH, 1, partitions=2)
    for f in glob.glob(f"{tmp_path}/t/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(j).path_in_schema: group.column(j) for j in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
        assert columns["n_tokens"].has_offset_index and columns["n_tokens"].has_column_index
    plan = T.read_tokens(spark, f"file://{tmp_path}/t").select(F.sum("n_tokens"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<n_tokens:bigint>" in plan


def test_empty_table(spark, tmp_path):
    T.write_tokens(spark.createDataFrame([], DOCS), f"file://{tmp_path}/e", PATH, 1)
    assert T.listing(T.read_tokens(spark, f"file://{tmp_path}/e")).collect() == []
