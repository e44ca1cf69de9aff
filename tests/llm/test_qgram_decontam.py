import random

import numpy as np
import pytest

from ridelens.llm import qgram_decontam as op

SCHEMA = "doc_id BIGINT, text STRING, leaks INT, leaks_0 INT, item_id INT"


def plain(text):
    return "".join(map(chr, op.folded(text or "")))


def brute_distance(item, text):
    """Least edits between the item and any stretch of the text (full table)."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1:], text[:i] + rng.choice("xyz é") + text[i:],
                           text[:i] + rng.choice("xyz") + text[i + 1:]])
    return text


def sentence(rng, n):
    parts = ["the", "th", "ing", "of", "er", "and", "on", "é", "ß", "en", "re", "a", "st"]
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


def test_against_full_alignment(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randrange(6, 30))) for i in range(12)]
    items += [(50, "tiny"), (51, None), (52, ""), (53, " \n"), (None, sentence(rng, 12)), (12, items[3][1])]
    rows = [(0, None), (1, "")]
    for i in range(2, 90):
        item = rng.choice(items[:12] + items[16:17])[1]
        part = edited(rng, item, rng.randrange(0, 2 + len(item) // 7))
        if rng.random() < .2:
            part = part.upper().replace(" ", "\n")
        if rng.random() < .2:
            part = ""
        rows.append((i, f"{sentence(rng, rng.randrange(30))} {part} {sentence(rng, rng.randrange(30))}"))
    rows += [(200, "a Tiny thing, tiny"), rows[5]]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id BIGINT, text STRING, leaks STRING")
    seen = 0
    for block_chars in (op.BLOCK_CHARS, 150):
        got = op.find_leaks(docs, benchmark, block_chars=block_chars).collect()
        assert len(got) == len(rows)
        for r in got:
            text, hits = plain(r.text), {}
            for h in r.leaks:
                hits.setdefault(h.item_id, []).append(h)
            for i, item in items:
                if not plain(item).strip():
                    assert i not in hits
                    continue
                edits, least = op.budget(len(item))[0], brute_distance(plain(item), text)
                assert (i in hits) == (least <= edits), (r.doc_id, i, least, edits)
                if i in hits:
                    seen += 1
                    assert min(h.distance for h in hits[i]) == least
                    for h in hits[i]:
                        assert brute_distance(plain(item), text[h.start:h.stop]) <= h.distance
    assert seen > 60
    kept = op.drop_leaking(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.leaks for r in got)
    report = {r.doc_id: r for r in op.leak_report(docs, benchmark).collect()}
    assert report[200]["items"] == [50] and report[200].spans == "50:2:6:0,50:14:18:0"


def test_windows_of_a_long_text(monkeypatch):
    rng = random.Random(1)
    items = [sentence(rng, 20) for _ in range(3)]
    index = op.Index(list(range(3)), [op.folded(t) for t in items]).build()
    text = " ".join(sentence(rng, 40) + " " + edited(rng, items[k % 3], k % 4) for k in range(12))
    whole = op.leaks(text, index)
    assert len(whole) == 12
    monkeypatch.setattr(op, "WINDOW_CHARS", 64)
    assert op.leaks(text, index) == whole


@pytest.mark.parametrize("n", [1, 7, 8, 9, 20, 80, 400])
def test_bound_holds_for_random_edits(n):
    rng = random.Random(n)
    edits, bound = op.budget(n)
    item = "".join(rng.choices("abcdefgh", k=n))
    for _ in range(20):
        near = item
        for _ in range(edits):
            i = rng.randrange(len(near))
            near = near[:i] + "z" + near[i + 1:]
        shared = np.isin(op.gram_hashes(op.folded(item)), op.gram_hashes(op.folded(near))).sum()
        assert shared >= bound and (n < op.Q or bound >= 1)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id BIGINT, text STRING")
    none = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert op.find_leaks(docs, none).first().leaks == []
    assert op.leak_report(docs.limit(0), none).collect() == []
