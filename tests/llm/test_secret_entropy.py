import hashlib
import math
import random
import re
from collections import Counter

import pytest

from ridelens.llm import secret_entropy as op

SCHEMA = "doc_id BIGINT, text STRING, secrets INT, row STRING, body STRING, m_hex STRING"


def brute(text):
    """Spans by Python's re and a full recount per window."""
    text = text or ""
    spans = []
    assign = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                        r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for kind, rank, found in (
            ("assign", 0, [m for m in assign.finditer(text) if len(m[1]) >= 6]),
            ("access", 1, [m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]),
            ("hex", 2, [m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])):
        spans += [(m.start(), rank, m.end(), kind) for m in found]
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        v, w = m[0], op.WINDOW
        if len(v) < w or not re.search("[0-9]", v) or any(re.search(p, v) for p in op.ALLOW):
            continue
        kind = ("hex" if re.fullmatch("[0-9A-Fa-f]+", v)
                else "alnum" if re.fullmatch("[0-9A-Za-z]+", v) else "base64")
        hot = [i for i in range(len(v) - w + 1)
               if -sum(c / w * math.log2(c / w) for c in Counter(v[i:i + w]).values())
               >= op.THRESHOLDS[kind] - 1e-7]
        if hot:
            spans.append((m.start() + hot[0], 3, m.start() + hot[-1] + w, "entropy"))
    return sorted(spans)


def random_text(rng):
    parts = []
    for _ in range(rng.randrange(12)):
        parts.append(rng.choice([
            "password", "TOKEN = ", "api_key:'", "passwd=token=", "é", "😀", "\n", " ", "xX0",
            "AKIA", "".join(rng.choices("0123456789abcdef", k=rng.randrange(40))),
            "".join(rng.choices("ABCDEFGHIJ0123", k=rng.randrange(30))),
            "".join(rng.choices(op.ALPHABET, k=rng.randrange(60))),
            "1234-5678-9012-3456-7890-1234", "123e4567-e89b-42d3-a456-426614174000",
            "example0aB3xK9q2LmZ8vT7rQ5w", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"]))
        parts.append(rng.choice(["", " ", "."]))
    return "".join(parts)


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "no secret", "secret=" + "a" * 5, "secret = abcdef"]
    texts += [random_text(rng) for _ in range(300)]
    rows = [(i, t, 1, "r", "b", "m") for i, t in enumerate(texts)] + [(4, texts[4], 1, "r", "b", "m")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = op.find_secrets(docs).collect()
    assert len(got) == len(rows)
    assert any(s.kind == "entropy" for r in got for s in r.secrets)
    for r in got:
        assert [tuple(s) for s in r.secrets] == brute(texts[r.doc_id]), texts[r.doc_id]
    assert got[0].row == "r" and got[0].m_hex == "m"      # clashing columns survive

    for r in op.secret_report(docs).collect():
        spans = brute(texts[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans if k != "entropy")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.n_hex == sum(k == "hex" for *_, k in spans)


def test_failing_match_hides_what_it_covers(spark):
    docs = spark.createDataFrame([(1, "password = token : abcdefgh")], "doc_id BIGINT, text STRING")
    assert op.find_secrets(docs).first().secrets == []


def test_very_long_and_empty_input(spark):
    noise = "lorem ipsum " * 40_000
    docs = spark.createDataFrame([(1, noise + "token=abc123def " + noise)], "doc_id BIGINT, text STRING")
    spans = op.find_secrets(docs).first().secrets
    assert [(s.start, s.stop, s.kind) for s in spans] == [(len(noise), len(noise) + 15, "assign")]
    assert op.secret_report(docs.limit(0)).collect() == []


@pytest.mark.parametrize("value", ["", "ab" * 30, "0" * 25])
def test_low_entropy_is_no_secret(spark, value):
    docs = spark.createDataFrame([(1, value)], "doc_id BIGINT, text STRING")
    assert all(s.kind != "entropy" for s in op.find_secrets(docs).first().secrets)
