"""From raw documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendcurve.llm.common import Stash, bounded_batches, by_id, table, trimmed
from spendcurve.llm.importance import importance_resample
from spendcurve.llm.minhash import near_duplicates
from spendcurve.llm.packing import pack_documents
from spendcurve.llm.quality_rules import measure
from spendcurve.llm.substrings import removed, repeated_passages
from spendcurve.llm.textops import chunks
from spendcurve.llm.tokens import default_vocabulary

#: Share of its words that a document may lose to line rules, words that it must have, and the packing's length.
MAX_LOSS, MIN_WORDS, CAPACITY = 0.3, 50, 1024
#: Percent of their 5-word shingles that near-duplicates share.
NEAR = 80


def _with_text(docs: DataFrame, text) -> DataFrame:
    """Documents with another text, and its length where that is a column."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are taken out; documents that the rules reject go. All columns pass."""
    bounded_batches(spark)
    names = docs.columns
    at = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            kept: list[np.ndarray] = []
            for chunk in chunks(batch.column(at)):
                found = measure(chunk, MAX_LOSS, MIN_WORDS, with_text=True)
                texts += found["clean_text"]
                kept.append(found["kept"])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, dtype=bool)))

    return _with_text(docs.mapInArrow(trimmed(clean), docs.schema), F.col("text"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample does not hold go. The raw documents make the raw model and hold the labelled texts."""
    _, sampled = importance_resample(docs, table(spark, sf_dir, "labels"), raw=table(spark, sf_dir, "documents"))
    return docs.filter(sampled.kept("doc_id", "text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (Jaccard similarity 0.8 or more of 5-word shingles) the document with the smallest id stays.

    If that id has several rows, one of those with an equal text stays, that of the lowest hash of the other
    columns; its different texts all stay. Rows without an id all stay.
    """
    stash = Stash(spark, "near-dedup")
    kept = stash.keep(near_duplicates(docs, percent=NEAR).filter("kept").groupBy("doc_id").agg(F.count("*").alias("__rows")), "kept")
    stay = docs.filter("doc_id IS NOT NULL").join(by_id(kept), "doc_id")
    out = stay.filter("__rows = 1").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
    if kept.filter("__rows > 1").isEmpty():
        return out
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and kind != "variant"]
    order = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*others) if others else F.lit(0))
    once = stay.filter("__rows > 1").withColumn("__at", F.row_number().over(order)).filter("__at = 1")
    return out.unionByName(once.select(*docs.columns))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; a document of which nothing is left goes. Rows without an id stay as they are."""
    stash = Stash(spark, "substring-dedup")
    found = stash.keep(repeated_passages(docs).select("doc_id", "start", "end", "text_hash"), "passages")
    spans = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    named = docs.filter("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    cut = named.join(by_id(spans), ["doc_id", "text_hash"], "left")
    cut = cut.select(*[c for c in docs.columns if c != "text"], removed(F.col("__spans"), F.col("text")).alias("text"), F.col("__spans").isNotNull().alias("__cut"))
    left = _with_text(cut, F.col("text")).filter(~F.col("__cut") | (F.length(F.trim("text")) > 0)).select(*docs.columns)
    return left.unionByName(docs.filter("doc_id IS NULL"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most CAPACITY ids: one row per piece of a document, with its ids."""
    return pack_documents(docs, default_vocabulary(), capacity=CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: Hashing, sampling and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again for the next."""
    stash = Stash(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stash.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
