"""From raw documents to token ids, in five stages; each stage's rows are written as Parquet and read by the next.

1. language_id: documents that language identification rejects go; lang becomes the predicted language.
2. near_duplicates: one document of each group of near copies stays (five-word shingles, similarity 0.8).
3. secret_scan: found secrets are replaced in the text.
4. mix_sources: documents are repeated or left out, so that sources come near their target weights.
5. bpe: texts are encoded, and decoded again to make sure of it.

Each stage reads the columns of documents by name; others don't matter, whatever they are called. Very long texts are treated whole;
an empty table gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import bpe, langid, minhash, mixing, secrets
from quillon.llm.common import bounded_batches, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; models are learned from a bounded sample of those with lang.

    Texts that are null, empty or without a letter have no language and go; repeated rows and rows without doc_id are each judged.
    """
    model = langid.learn(docs, F.lit(True))
    found = langid.identify(docs, model, keep=("text", "source", "n_chars"))
    return found.where(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group. Rows without doc_id stay; of rows of one doc_id one stays.

    Null and empty texts are like nothing, and stay. Whether rows repeat a doc_id is asked of all of them.
    """
    docs = docs.select(*COLUMNS)
    dropped = minhash.near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti")
    if kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept.select(*COLUMNS)
    known = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return known.select("doc_id", "row.*").unionByName(kept.where("doc_id is null")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are replaced, and n_chars follows the new text. Null texts stay null, and keep their n_chars."""
    docs = docs.select(*COLUMNS)
    return secrets.redact(docs, secrets.learn(docs)).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes its words, rounded. Rows without doc_id stay once; those without words go.

    A mix takes each document of a shard alike, but for one that it takes in part: so a source is off by half a document a shard at
    most, and a small source is one shard. Equal doc_ids are told apart by size and rank.
    """
    docs = docs.select(*COLUMNS)
    known = docs.where("doc_id is not null")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = mixing.mix_sources(known).where("size > 0").withColumn("copies", copies)
    on = ["doc_id"]
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        # rows of one doc_id and one size go together by rank: which of them is repeated doesn't matter to the mix
        on = ["doc_id", "size", "turn"]
        known = known.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).cast("long"))
        known = known.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "size").orderBy("text", "source")))
        taken = taken.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "size").orderBy(F.desc("copies"))))
    mixed = known.join(taken.where("copies > 0").select(*on, "copies"), on).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return mixed.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of each row: the ids of its text, and what they decode to.

    Null and empty texts have no ids and the digest of the empty text; repeated rows are each encoded.
    """
    bounded_batches(spark)
    path = bpe.default_vocabulary()

    def run(batches):
        coder = bpe.tokenizer(path)
        for batch in batches:
            ids = [coder.encode(t) for t in batch.column(3).to_pylist()]
            decoded = [coder.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "lang", "source", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "lang", "source", "text").mapInArrow(run, f"doc_id {kind}, lang string, source string, n_tokens long, ids array<int>, decoded string")
    return out.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("bpe", encode)]

#: SQL can't express the models of the first and third stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
