"""The pN_ queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import leakage, packing, pii


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"), _table(spark, d, "pack_capacity"))


def p6_certificate(spark: SparkSession, d: str) -> DataFrame:
    docs, caps = _table(spark, d, "documents"), _table(spark, d, "pack_capacity")
    return packing.certificate(docs, caps, packing.pack(docs, caps))


def p6_partitions(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_and_report(_table(spark, d, "documents"), _table(spark, d, "pack_capacity"))[1]


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity, the texts that are in containers."""
    packed = packing.pack(_table(spark, d, "documents"), _table(spark, d, "pack_capacity"))
    return packed.where("piece = 0").groupBy("capacity_id").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("doc_id").cast("bigint").alias("sum_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_item"))


def p7_edited_copies(spark: SparkSession, d: str) -> DataFrame:
    return leakage.edited_copies(_table(spark, d, "documents"), _table(spark, d, "eval_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(_table(spark, d, "documents")).distinct()


def p8_redact(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_table(spark, d, "documents").select("doc_id", "lang", "text"))


QUERIES = {f.__name__: f for f in (p6_pack, p6_certificate, p6_partitions, p6_coverage, p7_found, p7_edited_copies, p8_found, p8_redact)}

#: Rendering, alignment, packing and tagging can't be said in SQL over whole tables; tests hold them against brute force, exact bounds and
#: held-out labels. That each text is packed once can.
ORACLE: dict[str, str] = {
    "p6_coverage": "select capacity_id, count(*) as n_texts, cast(sum(doc_id) as bigint) as sum_id from documents, pack_capacity where text <> '' and capacity_tokens > 0 group by 1",
}
