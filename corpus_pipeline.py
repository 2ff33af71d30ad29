"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, SentencePiece encoding.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever further
columns those have: names that an operator gives its own results are set apart
or put aside. Null texts are empty ones, which no stage drops but as copies of
one another; texts of any length are read whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontamination, segment_sampling, simhash, toxicity
from maskwright.llm.common import free_name, shared_path, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the network, learnt from all labels, scores under the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), held_out=None)
    score = free_name("toxicity", docs.columns)
    return toxicity.score_texts(docs, model, into=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group (five-word shingles, similarity 0.8 or more) the document with the smallest id, and every document without an id. Of rows with one id and text it keeps one; those with one id and other texts stand or go together."""
    named = docs.where("doc_id is not null")
    group, rows = (free_name(n, docs.columns) for n in ("group", "rows"))
    groups = simhash.similar_groups(named, "doc_id", "text").groupBy("doc_id").agg(F.min("component").alias(group), F.count("*").alias(rows))
    first = written(groups.where(F.col(group) == F.col("doc_id")).select("doc_id", rows), "first-of-groups")
    # Ids grow with the data: the same plan at every size, not a broadcast while they are few.
    kept = named.join(first.hint("merge"), "doc_id")
    # Texts are compared only where an id stands on several rows.
    if first.where(F.col(rows) > 1).isEmpty():
        kept = kept.select(docs.columns)
    else:
        kept = kept.where(F.col(rows) == 1).select(docs.columns).union(kept.where(F.col(rows) > 1).select(docs.columns).dropDuplicates(["doc_id", "text"]))
    return kept.union(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no window of a benchmark item occurs."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index('text')}"
    found = decontamination.find_contamination(plain, table(spark, sf_dir, "benchmark", "item_id", "text"), text=text)
    return found.where(F.size("hit_runs") == 0).select(plain.columns).toDF(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three sampled encodings of every document, distinct where it has as many: doc_id, sample, its scores, pieces."""
    return segment_sampling.sample_segmentations(docs, "doc_id", "text", segment_sampling.default_model(), k=3)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: A recurrent network's scores have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
