"""A corpus pipeline over `documents`: five stages, each over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of `documents`. `run` writes the result
of every stage as Parquet to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm.decontaminate import drop_leaks
from talkloom.llm.frames import packed, stored, table, unpacked
from talkloom.llm.jaccard import ngram_jaccard
from talkloom.llm.mixing import mixed_documents, word_count
from talkloom.llm.quality import keep_quality
from talkloom.llm.tokens import token_files
from talkloom.scratch import file_system, scratch_path, scratch_scope


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents the classifier scores below its threshold.

    Null and empty texts are judged as texts without words; rows without an id are judged too. Every column is kept as it is. No labels of
    both kinds: every score is the same share, so all or none stay. An empty table stays empty.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at a Jaccard similarity of 0.8: the smallest id.

    Rows with the id that stays all stay, as do documents without an id.
    """
    groups = ngram_jaccard(docs, words=5, num=8, den=10)
    gone = groups.filter("component_id != doc_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = packed(docs, doc_id=F.col("doc_id"))
    few = stored(gone, "gone")
    few = F.broadcast(few) if few.count() <= 1_000_000 else few
    return unpacked(rows.join(few, rows.doc_id == few.gone, "leftanti"), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold an item of the benchmark.

    Null and empty texts hold none; rows without an id are judged by their text; repeated rows go together. Every column is kept as it is. An empty
    benchmark drops nothing, an empty table stays empty.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and select documents until every source has its share of the words; by the labels' quality where one is taken in part.

    The weights are those of op3_mixing: 2 for good documents, 0.5 for bad ones, 1 without a label.
    """
    marks = table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = stored(marks.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("marked"), F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight")), "weights")
    marks = F.broadcast(marks) if marks.count() <= 1_000_000 else marks  # so that the texts are not moved
    rows = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text"))
    rows = rows.join(marks, rows.doc_id == marks.marked, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = rows.select(F.col("_row").alias("_document"), "doc_id", "source", "weight", word_count(F.col("text")).alias("size"))
    mixed = mixed_documents(rows, weight_col="weight", size_col="size")
    return mixed.select(*[F.col("_document").getField(c).alias(c) for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the documents as token ids and read the files back: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts are the end id alone; null ids come first; repeated rows are documents of their own. Other columns are ignored. An empty
    table gives no rows.
    """
    import public_tokenizers

    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]

# The classifier and the tokenizer are outside SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; what the stages before it wrote, and all their intermediate tables, are deleted on the way.

    Null and empty texts, null ids, repeated rows and extra columns pass as each stage states; an empty table stays empty.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.split()[0].lower())
        with scratch_scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            fs, of = file_system(spark, before)
            fs.delete(of(before), True)
        before = path
    return docs
