import hashlib
import random
import re
import string

import public_tokenizers
import pytest

from fojas.llm import secret_scan as S
from tests.llm.helpers import DOCS, awkward, prose

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokens():
    with open(RANKS, "rb") as f:
        return S.Tokens(f.read(), PATTERN)


def drawn(alphabet, n, seed):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


def walked(text):
    """Base spans by the contract's words, character by character, without patterns of repetition."""
    out, value = [], set(string.ascii_letters + string.digits + "+/_.=-")
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    at = 0
    while at < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if lower.startswith(w, at)), None)
        end = None
        if word:
            i = at + len(word)
            for quoted in ((True, False) if text[i : i + 1] in ("'", '"') and text[i : i + 1] else (False,)):
                j = i + quoted
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "=") or j >= len(text):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"') and j < len(text)
                k = j
                while k < len(text) and text[k] in value:
                    k += 1
                if k > j:
                    end = k
                    if k - j >= 8:
                        out.append((at, 0, k))
                    break
        at = end or at + 1
    for place, first, allowed, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 16), (2, "", set("0123456789abcdef"), 32)):
        at = 0
        while at < len(text):
            k = at + len(first)
            if text.startswith(first, at):
                while k < len(text) and text[k] in allowed:
                    k += 1
            if k > at + len(first):
                if k - at >= least:
                    out.append((at, place, k))
                at = k
            else:
                at += 1
    return sorted(out)


def noisy(seed):
    r = random.Random(seed)
    bits = ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", "toKenK", "paſſword", ":", "=", "==", '"', "'", " ", "  ", "\n", ".", "AKIA", "AKIAAKIA", "é", "x", "-", "/"]
    return "".join(r.choice(bits) if r.random() < 0.7 else drawn(r.choice(["0123456789abcdef", string.ascii_letters, string.ascii_uppercase + "0123"]), r.randint(1, 40), r.random()) for _ in range(60))


@pytest.mark.parametrize("seed", range(60))
def test_known_forms(seed):
    assert S.base_spans(noisy(seed)) == walked(noisy(seed))


@pytest.mark.parametrize("alphabet", [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits])
def test_random_strings_are_found(tokens, alphabet):
    run = re.compile(r"[A-Za-z0-9+/_-]{18,}={0,2}")
    texts = [f"{prose(i, 4)} ( {drawn(alphabet, 20 + i % 40, i)} ) {prose(i + 1, 4)}" for i in range(300)]
    assert sum(any(k == 3 for _, k, _ in S.spans_of(t, run, tokens, 20, 2.0)) for t in texts) >= 294


@pytest.mark.parametrize("text", [
    "123e4567-e89b-12d3-a456-426614174000", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "sha256-uU0nuZNNPgilLlLX2n2r+sSE7+N6U4DukIj3rOLvzek=",
    "20240101120000123456789", "2024-01-01-00-00-00-0000", "usr/local/lib/python3/site-packages", "some_snake_case_identifier_name", "HTTP_STATUS_INTERNAL_SERVER_ERROR",
    "AbstractSingletonProxyFactoryBean", "internationalization", "Donaudampfschifffahrtsgesellschaft", "blob/2aeb8253858bf047bc9bb976166a40ef87db38b0/main",
])
def test_digests_and_identifiers_are_not(tokens, text):
    run = re.compile(r"[A-Za-z0-9+/_-]{18,}={0,2}")
    assert [s for s in S.spans_of(f"see {text} there", run, tokens, 20, 2.0) if s[1] == 3] == []


def test_scan_of_a_table(spark, tokens):
    key, token = drawn(string.ascii_letters + string.digits, 32, 5), drawn("0123456789abcdef", 40, 6)
    texts = [f'é {key} and token = "{token}"', f"AKIA{drawn(string.ascii_uppercase, 16, 1)}", f"a {key}{'=' * 2}. b", f"password: {key}\n{token}"]
    rows = awkward() + [(i, t, None, None, 0) for i, t in enumerate(texts)] + [(0, texts[0], None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS spans", "2 AS clean_text", "3 AS kind").repartition(3)
    found = S.scan(docs, RANKS, PATTERN)
    got = sorted(((r.id, [(s.start, S.KINDS.index(s.kind), s.stop) for s in r.spans], r.clean_text) for r in found.collect()), key=lambda g: str(g[:2]))
    run = re.compile(r"[A-Za-z0-9+/_-]{18,}={0,2}")
    want = []
    for i, t, *_ in rows:
        spans = walked(t or "")
        want.append((i, sorted(spans + [s for s in S.random_spans(t or "", run, tokens, 20, 2.0) if not any(b[0] < s[2] and s[0] < b[2] for b in spans)])))
    assert [g[:2] for g in got] == sorted(want, key=str)
    clean = {r.id: r.clean_text for r in found.collect() if r.id is not None and r.id < 4}
    assert clean == {0: 'é [RANDOM] and [ASSIGN]"', 1: "[ACCESS]", 2: "a [RANDOM]. b", 3: "[ASSIGN]\n[HEX]"}
    listed = {r.id: r for r in S.listed(found).collect() if r.id is not None}
    assert listed[0].n_random == 1 and listed[0].spans.split(",")[0] == "random:2:34" and listed[0].n_hex == 1
    base = f"assign:39:{39 + 9 + 40},hex:48:88"
    assert listed[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert listed[1000].base_sha256 == hashlib.sha256(b"").hexdigest() and listed[1000].spans == ""


def test_long_runs_take_time_in_proportion(tokens):
    run = re.compile(r"[A-Za-z0-9+/_-]{18,}={0,2}")
    text = drawn(string.ascii_letters + string.digits, 300_000, 1) + " " + "to" * 150_000
    assert [s[:2] for s in S.spans_of(text, run, tokens, 20, 2.0)] == [(0, 3)]


def test_empty_table(spark):
    assert S.listed(S.scan(spark.createDataFrame([], DOCS), RANKS, PATTERN)).collect() == []
