import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from fojas import schemas
from fojas.operators import grounding as G
from fojas.operators import usage as U
from fojas.streaming import emit, metering
from test_grounding import SHELF, said, source

ITEMS = ("Mirá. Para retirar:\n- ", ("mostrar el carné", source(1)), ".\n- ", ("firmar la ficha", source(1)), ".")


def responses(spark):
    cases = {
        "steps": said(*ITEMS), "closed": said(*ITEMS, opening="COBERTURA: ninguna - nada\n\n"), "unopened": said(*ITEMS, opening=None),
        "backed": said("Se puede ", ("retirar", source(0)), ". Caben 33 libros. Y ", ("caben treinta y tres", source(1, "33 libros")), ". Listo."),
        "backed late": said("Se puede ", ("retirar", source(0)), ". Caben 33 libros. Y hay revistas. Y ", ("caben treinta y tres", source(1, "33 libros")), ". Listo."),
    }
    documents = spark.createDataFrame([(k, *d) for k in cases for d in SHELF], schemas.DOCUMENTS)
    return cases, documents


def test_replay_emits_complete_cited_sentences_only(spark):
    cases, documents = responses(spark)
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], schemas.RESPONSES)
    rows = emit.replay_sentences(G.parse_responses(df), documents).orderBy("answer_id", "end").collect()
    got = {k: [r["text"] for r in rows if r["answer_id"] == k] for k in cases}
    assert got["steps"] == ["Mirá.", "Para retirar:", "Mostrar el carné."]
    assert got["closed"] == [] and got["unopened"] == []
    assert got["backed"][0] == "Se puede retirar." and "Caben 33 libros." in got["backed"]
    # Backed only by text after a sentence already emitted: left to the final answer.
    assert "Caben 33 libros." not in got["backed late"] and "Y hay revistas." in got["backed late"]


def streamed(spark, tmp_path, name, files, documents):
    """Batches of event lines, two files to a batch, to the events emitted."""
    folder = tmp_path / f"{name}-in"
    folder.mkdir()
    for i, lines in enumerate(files):
        path = folder / f"{i:04d}.json"
        path.write_text("\n".join(json.dumps(x) for x in lines))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(emit.BLOCK_EVENTS).option("maxFilesPerTrigger", 2).json(str(folder))
    emit.start(spark, stream, documents, str(tmp_path / name)).awaitTermination()
    return emit.read_events(spark, str(tmp_path / name)).orderBy("answer_id", "seq").collect()


def test_disorder_and_redelivery_change_nothing(spark, tmp_path):
    cases, documents = responses(spark)
    lines = [{"answer_id": k, "seq": i, "event": "block", "block": b} for k, v in cases.items() for i, b in enumerate(v["content"])]
    lines += [{"answer_id": k, "seq": len(v["content"]), "event": "stop"} for k, v in cases.items()]
    want = streamed(spark, tmp_path, "plain", [lines[i::6] for i in range(6)], documents)
    mixed = random.Random(3).sample(lines, len(lines))
    twice = mixed[::2] + mixed[1::2] + mixed[::3]
    got = streamed(spark, tmp_path, "mixed", [twice[i : i + 9] for i in range(0, len(twice), 9)] + [lines[:7], lines[-3:]], documents)
    texts = lambda events, k: [json.loads(e.payload)["sentence"]["text"] for e in events if e.answer_id == k and e.type == "sentence"]
    for k in cases:
        assert [e.type for e in got if e.answer_id == k].count("answer") == 1
        assert [e.seq for e in got if e.answer_id == k] == list(range(len([e for e in got if e.answer_id == k])))
        assert texts(got, k) == texts(want, k)
        final = lambda events: [e.payload for e in events if e.answer_id == k and e.type == "answer"]  # noqa: B023, E731
        assert final(got) == final(want)


def test_stream_equals_replay(spark, tmp_path):
    cases, documents = responses(spark)
    n = max(len(v["content"]) for v in cases.values())
    files = [[{"answer_id": k, "seq": i, "event": "block", "block": v["content"][i]} for k, v in cases.items() if i < len(v["content"])] for i in range(n)]
    files.append([{"answer_id": k, "seq": len(v["content"]), "event": "stop"} for k, v in cases.items()] + [{"answer_id": "x", "seq": 0, "event": "error"}])
    events = streamed(spark, tmp_path, "out", files, documents)
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], schemas.RESPONSES)
    replay = emit.replay_sentences(G.parse_responses(df), documents).orderBy("answer_id", "end").collect()
    for k in cases:
        mine = [e for e in events if e["answer_id"] == k]
        assert [e["seq"] for e in mine] == list(range(len(mine)))
        assert [json.loads(e["payload"])["sentence"]["text"] for e in mine if e["type"] == "sentence"] == [r["text"] for r in replay if r["answer_id"] == k]
        assert mine[-1]["type"] == "answer"
    assert [e["type"] for e in events if e["answer_id"] == "x"] == ["error"]
    final = {e["answer_id"]: json.loads(e["payload"]) for e in events if e["type"] == "answer"}
    assert final["closed"]["refused"] and not final["steps"]["refused"]


PRICES = [("vega", 3.0, 3.75, 0.3, 15.0), ("lyra", 0.8, 1.0, 0.08, 6.0)]
# exchange, stage, number, model, requests, tokens (fresh, written to and read from a cache, out), metered
ATTEMPTS = [
    ("n7", "search", 1, "lyra", 1, 2310, 480, 7700, 95, True), ("n7", "search", 2, "vega-20260131", 1, 640, 0, 512, 33, True),
    ("n7", "routing", 3, "hub/vega", 1, 71, 0, 0, 8, True), ("n9", "routing", 4, "unlisted", 1, 205, 30, 0, 17, True),
    ("n9", "routing", 5, "vega", 1, 88, 0, 41, 3, True), ("n9", "search", 6, None, 1, 0, 0, 0, 0, False),
    ("n9", "answer", 7, "lyra", 0, 19, 7, 2, 400, True),
]


def by_hand(attempts):
    """(exchange, stage) to requests, fresh tokens, tokens out, cost (None where a price or a count is unknown), unmetered calls."""
    out = {}
    for exchange, stage, _, model, requests, fresh, wrote, read, gave, metered in attempts:
        name = (model or "").rsplit("/", 1)[-1]
        rate = next((p[1:] for p in PRICES if name == p[0] or name.startswith(p[0] + "-20")), None)
        cost = sum(n * x for n, x in zip((fresh, wrote, read, gave), rate)) / 1e6 if rate and metered else None
        old = out.get((exchange, stage), (0, 0, 0, 0.0, 0))
        total = None if cost is None or old[3] is None else old[3] + cost
        out[exchange, stage] = (old[0] + requests, old[1] + fresh, old[2] + gave, total, old[4] + (not metered))
    return out


def test_streamed_usage_equals_batch(spark, tmp_path):
    prices = spark.createDataFrame(PRICES, schemas.PRICES)
    attempts = spark.createDataFrame(ATTEMPTS, schemas.ATTEMPTS)
    batch = U.stage_usage(attempts, prices)
    src = str(tmp_path / "in")
    for row in ATTEMPTS:
        spark.createDataFrame([row], schemas.ATTEMPTS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schemas.ATTEMPTS).option("maxFilesPerTrigger", 2).parquet(src)
    root = str(tmp_path / "out")
    metering.start(stream, prices, root).awaitTermination()
    key = lambda df: sorted((r["exchange_id"], r["stage"], r["requests"], r["input_tokens"], r["cost_usd"] is None, tuple(r["models"]), tuple(r["unpriced_models"]), r["unmetered_requests"]) for r in df.collect())
    assert key(metering.read_usage(spark, root)) == key(batch)


def test_takes_cut_between_batches(spark, tmp_path):
    prices = spark.createDataFrame(PRICES, schemas.PRICES)
    src, root = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(rows):
        for row in rows:
            spark.createDataFrame([row], schemas.ATTEMPTS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schemas.ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(src)
        metering.start(stream, prices, root).awaitTermination()

    def rows_of(usage):
        return sorted((r.exchange_id, r.stage, r.requests, r.output_tokens, r.cost_usd and round(r.cost_usd, 9), tuple(r.models)) for r in usage.collect())

    whole = lambda rows: rows_of(U.stage_usage(spark.createDataFrame(rows, schemas.ATTEMPTS), prices))
    assert metering.take(spark, root, "none").count() == 0 and metering.fold(spark, root) == metering.NONE
    feed(ATTEMPTS[:2])
    assert rows_of(metering.read_usage(spark, root)) == whole(ATTEMPTS[:2])
    assert rows_of(metering.take(spark, root, "one")) == whole(ATTEMPTS[:2])
    assert metering.read_usage(spark, root).count() == 0
    feed(ATTEMPTS[2:4])
    # a batch and a fold that were cut short count for nothing
    half = spark.createDataFrame(ATTEMPTS[:1], schemas.ATTEMPTS)
    parts = U.usage_parts(U.priced(half, prices))
    parts.write.parquet(f"{root}/parts/batch=99")
    parts.write.parquet(f"{root}/folds/upto=3")
    assert rows_of(metering.read_usage(spark, root)) == whole(ATTEMPTS[2:4])
    assert metering.fold(spark, root) == 3 == metering.fold(spark, root)
    feed(ATTEMPTS[4:])
    assert rows_of(metering.read_usage(spark, root)) == whole(ATTEMPTS[2:])
    assert rows_of(metering.read_usage(spark, root, since_take=False)) == whole(ATTEMPTS)
    assert rows_of(metering.take(spark, root, "two")) == whole(ATTEMPTS[2:])
    assert rows_of(metering.take(spark, root, "one")) == whole(ATTEMPTS[:2])  # asked again: the same
    assert metering.take(spark, root, "three").count() == 0


def test_usage_rules(spark):
    prices = spark.createDataFrame(PRICES, schemas.PRICES)
    usage = U.stage_usage(spark.createDataFrame(ATTEMPTS, schemas.ATTEMPTS), prices)
    got = {(r.exchange_id, r.stage): r for r in usage.collect()}
    want = by_hand(ATTEMPTS)
    assert got.keys() == want.keys()
    for key, (requests, tokens_in, tokens_out, cost, unmetered) in want.items():
        r = got[key]
        assert (r.requests, r.input_tokens, r.output_tokens, r.unmetered_requests) == (requests, tokens_in, tokens_out, unmetered)
        assert r.cost_usd == (None if cost is None else pytest.approx(cost))
    assert [want[k][3] is None for k in (("n9", "routing"), ("n9", "search"), ("n9", "answer"))] == [True, True, False]
    assert got["n7", "search"].models == ["lyra", "vega-20260131"] and got["n9", "search"].models == []
    assert got["n9", "routing"].unpriced_models == ["unlisted"]
    exchanges = spark.createDataFrame([("n7",), ("n8",), ("n9",)], "exchange_id STRING")
    full = U.with_every_stage(usage, exchanges)
    assert full.count() == 9
    totals = {r.exchange_id: r.cost_usd for r in U.total_cost(full).collect()}
    assert totals == {"n7": pytest.approx(sum(want["n7", s][3] for s in ("search", "routing"))), "n8": 0.0, "n9": None}
    assert {r.stage: r.cost_usd is None for r in U.merged(full).collect()} == {"routing": True, "search": True, "answer": False}


def test_attempts(spark):
    steps = [("message", None, 420, 6), ("fallback_message", "lyra", 33, 2), ("fallback_message", "nova", 34, 71)]
    fell = {"input_tokens": 34, "output_tokens": 71, "iterations": [dict(zip(("type", "model", "input_tokens", "output_tokens"), x)) for x in steps]}
    calls = [("two", "vega", {"model": "nova", "usage": fell}), ("one", None, {"model": "lyra", "usage": {"input_tokens": 5, "output_tokens": 9, "iterations": []}})]
    r = G.parse_responses(spark.createDataFrame([(k, json.dumps(x)) for k, _, x in calls], "exchange_id STRING, raw STRING"))
    asked = F.create_map(*[F.lit(x) for k, m, _ in calls if m for x in (k, m)])
    r = r.withColumn("stage", F.lit("answer")).withColumn("seq", F.lit(1)).withColumn("requested_model", asked[F.col("exchange_id")])
    got = [(x.exchange_id, x.model, x.requests, x.input_tokens, x.output_tokens) for x in U.attempts_from_responses(r).orderBy("exchange_id", "seq").collect()]
    assert got == [("one", "lyra", 1, 5, 9), *(("two", model or "vega", int(i == 0), n, m) for i, (_, model, n, m) in enumerate(steps))]
    turns = spark.createDataFrame(
        [("x", "search", 1, "hub/vega", (31, 12, 9, 6)), ("x", "search", 2, "vega", None), ("x", "search", 3, "lyra", (5, 4, 3, 1))],
        "exchange_id STRING, stage STRING, seq BIGINT, model STRING, usage STRUCT<input_tokens: BIGINT, cached_tokens: BIGINT, cache_write_tokens: BIGINT, output_tokens: BIGINT>",
    )
    t = U.attempts_from_turns(turns).orderBy("seq").collect()
    assert [(x.metered, x.model, x.requests) for x in t] == [(True, "vega", 1), (False, None, 1), (True, "lyra", 1)]
    tokens = [(x.input_tokens, x.cache_creation_input_tokens, x.cache_read_input_tokens, x.output_tokens) for x in t]
    assert tokens == [(10, 9, 12, 6), (0, 0, 0, 0), (0, 3, 4, 1)]  # a count that would be negative is none


@pytest.mark.parametrize("files", [0, 3])
def test_a_table_is_streamed_as_one_file_or_a_folder_of_files(spark, tmp_path, files):
    from fojas.queries import registry

    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    if files:
        given.repartition(files).write.parquet(str(tmp_path / "conversations.parquet"))
    else:
        shutil.copy("/root/testdata/sf0.001/conversations.parquet", tmp_path)
    spark.range(3).write.parquet(str(tmp_path / "labels.parquet"))
    rows = registry.stream(spark, str(tmp_path), "conversations").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    rows.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == given.count() and got.exceptAll(given).isEmpty()
