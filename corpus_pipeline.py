"""The corpus pipeline: documents to tokens, stage by stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame. Every stage works on all rows its predecessor kept,
and all but the last return the columns of ``docs``.

1. quality: documents that the classifier rejects (score under 0.3) go.
2. near duplicates: of each group of near copies the smallest id stays, of
   rows that share an id one; rows without id stay.
3. decontamination: documents that hold a benchmark item go.
4. secrets: values that few owners have are masked in the text.
5. tokens: ids of the SentencePiece pieces of every text.

A document's null text passes the stages as an empty one does; extra columns
are carried along, up to the last stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, minhash_dedup, quality_classifier, secret_scan, sentencepiece_codec
from tessera.llm.common import BROADCAST_IDS, free_name, materialize, prepare, table

MIN_QUALITY = 0.3
SIMILARITY = 80  # percent of five-word shingles


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs.select("doc_id", "text"), labels.where(~quality_classifier.held_out()))
    out = free_name(docs, "_score")
    return quality_classifier.score(docs, model, out=out).where(F.col(out) >= MIN_QUALITY).drop(out)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = minhash_dedup.near_duplicates(docs, percent=SIMILARITY)
    gone = materialize(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    n = gone.count()  # 8 bytes each: broadcast up to a bound, else shuffled, with the same result
    left = docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
                        .where("n > 1").select("doc_id"), "repeated")
    if not again.isEmpty():
        left = left.join(again, "doc_id", "left_anti").unionByName(
            left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_scan.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    encoded = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"),
                                         public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("secret scan", without_secrets),
    ("sentencepiece", tokens),
]

#: The classifier, the sketches, the alignment and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    def step(docs, stage):
        return materialize(stage[1](spark, docs, sf_dir), "stage")

    return reduce(step, STAGES[:-1], table(spark, sf_dir, "documents")).transform(lambda d: STAGES[-1][1](spark, d, sf_dir))
