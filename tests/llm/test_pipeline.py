"""The corpus pipeline on planted documents, against brute force."""

import os
import random
import re
from pathlib import Path

import pytest

import corpus_pipeline
from tessera.llm import decontaminate, jaccard_join, segment
from tessera.llm import text as kernel

CLEAN = "the and of river stone walks slowly over grass towards evening light".split()


@pytest.fixture(scope="module")
def planted(tmp_path_factory, spark):
    rng = random.Random(9)
    fresh = lambda n: " ".join(rng.choice(CLEAN) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, fresh(80)) for i in range(200)]
    rows += [(i, " ".join(rng.choice(["CLICK!!", "buy***", "win###"]) for _ in range(80))) for i in range(200, 260)]
    item = fresh(30)
    copy, words = fresh(90), fresh(100).split()
    rows += [(300 + i, copy) for i in range(3)]
    rows += [(310 + i, " ".join(words[:-i] if i else words)) for i in range(4)]
    rows += [(320, f"{fresh(30)} {item} {fresh(30)}")]
    rows += [(330 + i, f"{fresh(40)}\n{'shared line of the footer'}") for i in range(12)]
    rows += [(350 + i, "only line that everyone has") for i in range(11)]
    rows += [(400, ""), (401, None)]
    folder = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, key int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 260, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), dict(rows)


def test_stages(spark, planted, tmp_path):
    folder, texts = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()} if name != "sentencepiece" else docs.collect()
        assert docs.columns == columns or name == "sentencepiece"
    quality, lines, joined, clean, encoded = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert not any(200 <= i < 260 for i in quality)
    assert all(i in quality for i in [*range(200), 300, 310, 320, 330])
    assert [lines[330 + i].text.count("\n") for i in range(12)] == [1] + [0] * 11
    assert all(lines[i].n_chars == len(lines[i].text or '') for i in lines)
    assert [i for i in lines if 350 <= i < 400] == [350]
    assert sorted(i for i in joined if 300 <= i < 320) == [300, 310]
    assert set(range(200)) <= set(joined)
    assert 320 in joined
    assert 320 not in clean
    assert set(range(200)) <= set(clean)
    vocab = segment.vocabulary(segment.MODEL_FILE, segment.Settings.alpha)
    assert {r.doc_id for r in encoded} == set(clean)
    assert all(segment.decode_ids(r.ids, vocab) == (clean[r.doc_id].text or "") for r in encoded)


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (3, text), (3, "x y"), (3, "x y"), (5, "other words"), (None, "other words"), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, cls int")
    kept = jaccard_join.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, text), (3, "x y"), (5, "other words"), (7, None), (7, None), (8, "")], key=str)


def test_only_the_contaminated_row_of_an_id_goes(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "z a b c"), (2, "q")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "z a")], "item_id long, text string")
    assert sorted(tuple(r) for r in decontaminate.clean(docs, items).collect()) == [(1, "a b c"), (2, "q")]


def test_run_equals_its_stages(spark, planted):
    folder, _ = planted
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "sample", "ids", "log_prob", "inclusion"]
    assert got.where("doc_id < 200").count() == 600
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, planted, tmp_path):
    folder, _ = planted
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


SF = "/root/testdata/sf0.1"


def own_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists("/proc/self/smaps_rollup")), reason="no test tables or no figures of memory")
def test_driver_gives_back_the_memory_of_the_fit(spark):
    corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    held = own_mb()
    kernel.give_back()
    assert held - own_mb() < 10
