"""A corpus pipeline of four operators: language ID, quality classifier, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
stage's docs. The first three return the columns of documents for the rows they keep; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrivo.llm import co_training, language_id, near_copies
from quadrivo.llm.packing import pack
from quadrivo.llm.queries import BYTE_BPE
from quadrivo.llm.shared import drop_path, new_path, scratch, table

#: A document whose likeliest language has less than this probability is rejected, as is one without a letter.
LANGUAGE_SCORE = 0.5


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., so that no name can clash with those that stages add; and the new names of those that they look at."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "lang", "source")}


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with an identified language. A null or empty text, or one without a letter, goes."""
    plain, names = numbered(docs)
    scored = language_id.identify(plain, language_id.train(docs), names["text"])
    return scored.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*plain.columns).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the co-trained classifier, fitted on the labels of its input's documents, calls good."""
    model = co_training.train(docs, table(spark, sf_dir, "labels"))
    plain, names = numbered(docs)
    scored = co_training.score(plain, model, plain.columns, names["text"], names["source"], names["lang"])
    return scored.filter("kept").select(*plain.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id (a null one last), and one of repeated rows.

    Near duplicates share 0.8 or more of their distinct five-word shingles (Jaccard), directly or over others.
    Rows are told apart by doc_id and a hash of the text, so rows that share an id, or have none, are not taken for one document.
    """
    plain, names = numbered(docs)
    id_, text = F.col(names["doc_id"]), F.col(names["text"])
    key = F.struct(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))
    keyed = plain.withColumn("key", key)
    stays = near_copies.near_copies(keyed, names["text"], "key").filter("key = component_id").groupBy("key").agg(F.count("*").alias("n"))
    kept = keyed.join(stays, "key")
    whole = F.struct(*plain.columns)
    repeated = kept.filter("n > 1").groupBy("key").agg(F.min_by(whole, F.to_json(whole)).alias("row"))  # as JSON, columns without an order have one too
    return kept.filter("n = 1").select(*plain.columns).unionByName(repeated.select("row.*")).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows that hold every source in proportion: a row for each piece of a document, with its token ids (little-endian, 2 bytes each).

    A null text is packed as the end id alone, rows that repeat are documents of their own, a null key or source is carried along, an empty table gives none.
    """
    return pack(docs, BYTE_BPE)


STAGES = [("language", language_stage), ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Learned classifiers, XXH64 fingerprints and BPE ids can't be expressed in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Each stage's intermediate tables, and the stage before it, are removed once it is written."""
    docs, was = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if was:
            drop_path(spark, was)
        docs, was = spark.read.schema(made.schema).parquet(path), path
    return docs
