"""A training-data pipeline over ``documents`` in five stages, each one operator.

Quality classifier (rejected documents go), n-gram Jaccard join (the document
with the smallest id of each group stays), substring dedup (words of later
copies go; a document of which nothing is left goes too), mixing (documents
repeat as often as the mix takes them), packing (the result).  All but the last
return the columns of ``documents``; ``n_chars`` follows the text.

Defined results: a text that is null is rejected by the first stage; a null id is
in no group, gives and loses no words, and is mixed and packed as usual; rows
that repeat an id are judged one by one: of a group's rows with its smallest id
one stays, that of the least hash; a text at its language's threshold is kept;
of equal passages the one in the smallest id stays; very long texts go through
every stage whole and are cut by packing alone; an empty table of documents
gives an empty result, and without labels only null and empty texts are
rejected; columns beyond those that a stage reads go along, whatever they are
called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import blocks, jaccard_join, mixing, packing, quality_classifier, substring_dedup
from factorloom.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.quality_classifier(docs, labels).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; documents without an id."""
    named = docs.filter("doc_id is not null").groupBy("doc_id").count()
    if not named.filter("count > 1").isEmpty():
        return _near_duplicate_rows(docs)
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"), n=5, percent=75)
    gone = found.filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """The same where ids repeat: rows are numbered, and one row of each group stays."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at"))
    rows = blocks.written(rows, "numbered")  # the numbers hold for both uses
    named = rows.filter("row.doc_id is not null")
    found = jaccard_join.jaccard_components(named.select(F.col("at").alias("doc_id"), "row.text"), n=5, percent=75).select(F.col("doc_id").alias("at"), "component_id")
    order = F.struct(F.col("row.doc_id").cast("long"), F.xxhash64("row.text"), F.xxhash64("row"), "at")
    found = blocks.written(found.join(named.select("at", order.alias("order")), "at"), "numbered-groups")
    first = found.groupBy("component_id").agg(F.min("order").alias("first")).select("component_id", F.col("first.at").alias("first"))
    gone = found.join(first, "component_id").filter("at <> first").select("at")
    return rows.join(gone, "at", "left_anti").select("row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a document with a smaller id has."""
    out = substring_dedup.dedup_substrings(docs, window=13).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    out = out.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        cut = F.when(F.col("n_removed") > 0, F.length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        out = out.withColumn("row", F.col("row").withField("n_chars", cut))
    return out.select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    out = mixing.mix(docs, [5.0, 2.0, 1.0], share=1.5, epochs=2.0).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: one row for each piece."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_token=1, size=2048)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substrings), ("mixing", mixture), ("packing", packed)]

#: SQL can't express the stages; the tests compare them with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage has written for itself goes with it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), set()
    for number, (_, stage) in enumerate(STAGES):
        held = blocks.left()
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = blocks.keep(spark, f"{blocks.shared_folder(spark)}/factorloom/stage{number}-{uuid.uuid4().hex}")
        out.write.parquet(path)
        blocks.drop((blocks.left() - held - {path}) | before)
        docs, before = spark.read.schema(out.schema).parquet(path), {path}
    return docs
