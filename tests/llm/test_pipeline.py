import random
import zlib

import pytest

import corpus_pipeline
from tests.llm import test_curriculum_mix as mixing
from tests.llm import test_line_chunks as lines
from tests.llm import test_qgram_decontam as leaks
from tests.llm import test_simhash_gray as prints
from tests.llm import test_toxic_ssk as toxic

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, size STRING, gone_id INT, leaks INT"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A small corpus with insults, copies, near copies, leaks and odd rows, as tables."""
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("world")
    item = leaks.sentence(rng, 25)
    texts, labels = [], []
    for i, text, bad in toxic.corpus(rng, 300):
        text = text.replace(". ", ".\n")
        if i % 10 == 1:
            text += "\n" + leaks.edited(rng, item, 2)
        texts.append(text)
        labels.append((i, bad))
    texts += [texts[4], texts[4], texts[4] + " again", texts[5].upper(), "", "", " "]
    rows = [(i, t, "xx", f"s{zlib.crc32(t.encode()) % 4}", len(t), "z", 1, 2) for i, t in enumerate(texts)]
    rows += [(500, None, None, None, None, "z", 1, 2), rows[7], rows[7]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id BIGINT, text STRING").write.parquet(
        f"{folder}/benchmark.parquet")
    return str(folder), rows, dict(labels), item


def test_every_stage_against_brute_force(spark, world):
    folder, rows, labels, item = world
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination",
        "mixing sources to target weights"]

    docs = spark.createDataFrame(rows, SCHEMA)
    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    kept = [tuple(r) for r in kept.collect()]
    ids = [r[0] for r in kept]
    right = sum((i in ids) == (bad == 0) for i, bad in labels.items())
    assert right > .97 * len(labels) and 500 in ids
    assert ids.count(7) == sum(r[0] == 7 for r in rows) * (7 in ids)

    cut = stages["line dedup"](spark, spark.createDataFrame(kept, SCHEMA), folder)
    assert cut.columns == docs.columns
    want = lines.brute([(r[0], r[1]) for r in kept])
    after = [(r[0], want[r[0], r[1]][0], *r[2:4], None if r[1] is None else len(want[r[0], r[1]][0]), *r[5:])
             for r in kept]
    cut = [tuple(r) for r in cut.collect()]
    assert sorted(cut, key=str) == sorted(after, key=str)
    assert sum(a[1] != b[1] for a, b in zip(kept, after)) > 0

    one = stages["SimHash near-dedup"](spark, spark.createDataFrame(cut, SCHEMA), folder)
    assert one.columns == docs.columns
    roots = prints.brute_classes([prints.brute_print(r[1]) for r in cut], 2)
    least = {root: min(r[0] for r, x in zip(cut, roots) if x == root) for root in roots}
    one = [tuple(r) for r in one.collect()]
    assert sorted(r[0] for r in one) == sorted(least.values())

    clean = stages["benchmark decontamination"](spark, spark.createDataFrame(one, SCHEMA), folder)
    assert clean.columns == docs.columns
    most = leaks.op.budget(len(item))[0]
    want_clean = [r for r in one if leaks.brute_distance(leaks.plain(item), leaks.plain(r[1])) > most]
    clean = [tuple(r) for r in clean.collect()]
    assert sorted(clean, key=str) == sorted(want_clean, key=str) and len(clean) < len(one)

    last = stages["mixing sources to target weights"](spark, spark.createDataFrame(clean, SCHEMA), folder)
    mixed = last.collect()
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    sizes = {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    targets = mixing.brute_targets(sizes)
    for source in sizes:
        assert sum(r.words for r in mixed if r.source == source) == pytest.approx(targets[source], abs=1)
    text_of = {r[0]: r[1] for r in clean}
    assert all(r.text == text_of[r.doc_id] for r in mixed)


def test_run_chains_the_stages(spark, world):
    folder, *_ = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    # unwritten between the stages: the same rows (the order of ties in position is free)
    want = sorted((tuple(r) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).collect()), key=str) == want
    assert len(want) > 100


def test_empty_tables(spark, world, tmp_path):
    folder, *_ = world
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
