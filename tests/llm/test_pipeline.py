"""The stages on a small corpus with known junk, copies and passages."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spendcurve.llm import common, minhash, substrings, tokens
from spendcurve.llm import queries as llm_queries


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    rows = [(i, sentence(rng, 120)) for i in range(40)]
    passage = sentence(rng, 80)
    rows += [(40 + k, sentence(rng, 60) + "\n" + passage) for k in range(3)]
    rows += [(50, rows[0][1]), (51, rows[1][1] + " tail."), (52, passage), (60, None), (61, "too short."), (None, sentence(rng, 100))]
    rows += [(70 + k, " ".join(w + "***" for w in sentence(rng, 90).split(" "))) for k in range(5)]
    documents = [(i, t, "en", "src", len(t or ""), 1.5) for i, t in rows]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, key double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i < 70 else 0, 0) for i in list(range(0, 40, 2)) + [70, 71, 72]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect_and_keep_the_rest(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = docs.persist()
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(40))
    assert clean <= set(seen["quality rules"]) and not {60, 61, *range(70, 75)} & set(seen["quality rules"])
    assert clean <= set(seen["quality classifier"])
    assert {40, 41, 42, 52} <= set(seen["MinHash near-dedup"]) and not {50, 51} & set(seen["MinHash near-dedup"])
    last = seen["substring dedup"]
    assert 52 not in last and None in last
    assert last[41].text.count(" ") < 70 and last[40].text.count(" ") > 100 and last[41].n_chars == len(last[41].text)


def test_different_texts_of_an_id_stay(spark):
    rng = random.Random(3)
    one, two, passage = sentence(rng, 90), sentence(rng, 90), sentence(rng, 70)
    rows = [(1, one, "a"), (1, two, "b"), (1, one, "c"), (2, one + " x", "d"), (3, passage, "e"), (4, sentence(rng, 60), "f"), (4, sentence(rng, 60) + " " + passage, "g"), (None, one, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").persist()
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(1, one), (1, two), (3, passage), (4, rows[5][1]), (4, rows[6][1]), (-1, one)])
    cut = {r.lang: r.text for r in corpus_pipeline.substring_dedup_stage(spark, docs, "").collect()}
    assert cut["f"] == rows[5][1] and cut["g"] == rows[6][1][: -len(passage) - 1] and cut["h"] == one and cut["e"] == passage
    assert corpus_pipeline.substring_dedup_stage(spark, docs.limit(0), "").count() == 0 == corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").count()


def test_near_dedup_takes_copies_at_082(spark):
    rng = random.Random(2)
    base = sentence(rng, 204).split(" ")
    other = list(base)
    for k in (20, 60, 100, 140):
        other[k] = "otherwise"
    shingles = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (base, other)]
    assert 0.81 < len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) < 0.83
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, sentence(rng, 200))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == {1, 3}


def test_run_packs_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} >= set(range(40))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, len(np.frombuffer(r.ids, dtype="<u4"))))
    assert all(sum(n for _, n in spans) <= corpus_pipeline.CAPACITY for spans in by.values())


def test_registry():
    assert sorted(q.split("_")[0] for q in llm_queries.queries() if q != "url_rules") == sorted(f"op{k}" for k in range(1, 11))
    assert set(llm_queries.oracle_sql()) <= set(llm_queries.queries())


def test_workers_are_small_again_after_a_task():
    class Table:
        def mapInArrow(self, work, schema):
            self.work = work
            return self

    def megabytes():
        return int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    rng = random.Random(4)
    text = sentence(rng, 400_000)
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": [text[k:] for k in range(8)], "hash": [0] * 8})
    for make in (lambda t: minhash.signatures(t, 5), lambda t: minhash.shingle_sets(t, 5), lambda t: substrings.windows(t, 50, 80)):
        make(table := Table())
        tokens.encoder(tokens.default_vocabulary())
        before = megabytes()
        assert sum(b.num_rows for b in table.work(iter([batch]))) > 0
        assert not common.held and megabytes() < before + 8


def test_near_dedup_makes_table_keys_in_slices(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, sentence(rng, 40)) for i in range(400)], "id long, text string").coalesce(1)
    minhash.signatures(docs, 5).write.parquet(f"file://{tmp_path}/classes")
    classes = spark.read.parquet(f"file://{tmp_path}/classes")
    monkeypatch.setattr(minhash, "SLICE", 50)
    keys = minhash.table_keys(classes).withColumn("task", F.spark_partition_id()).persist()
    by_task = [r["count"] for r in keys.groupBy("task").count().collect()]
    assert sum(by_task) == 400 * minhash.HALVES**2 and max(by_task) < 2 * 50 * minhash.HALVES**2
    assert keys.select("id", "key").distinct().count() == 400 * minhash.HALVES**2
    keys.unpersist()
