"""The queries of this subpackage over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import decontaminate, langid, license_scan, packing, passages, preference, simhash, topk, urlfilter, warc
from textloom.llm.common import read_table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read_table(spark, sf_dir, "documents"))


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.listed_pages(pages))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(read_table(spark, sf_dir, "documents"))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("detections")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.formatted_pairs(read_table(spark, sf_dir, "conversations"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(topk.vectors(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_langid, op2_urlfilter, op3_warc, op4_decontaminate, op5_simhash, op6_license, op7_passages, op8_preference, op9_packing, op10_topk)}
SQL = {"op2_urlfilter": urlfilter.SQL, "op3_warc": warc.SQL, "op4_decontaminate": decontaminate.SQL, "op6_license": license_scan.sql(), "op8_preference": preference.SQL, "op10_topk": topk.SQL}
