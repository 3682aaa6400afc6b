"""Documents from files and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.operators.sizing import concat_in_order

PAGE_SEPARATOR = "\n\n"
# Documents made of pages come first, then those from text files.
PAGED, TEXT_FILE = 0, 1


def split_valid_utf8(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) as documents (path, text) and rejects (path, reason).

    A file that is not UTF-8 is reported and left out; the others go on. Line ends are
    normalised to a single newline.
    """
    decoded = files.withColumn("_text", F.try_validate_utf8(F.col("content").cast("string")))
    good = decoded.filter(F.col("_text").isNotNull()).select(
        "path", F.regexp_replace("_text", "\r\n?", "\n").alias("text"))
    rejected = decoded.filter(F.col("_text").isNull()).select(
        "path", F.lit("not valid UTF-8").alias("reason"))
    return good, rejected


def read_text_files(spark: SparkSession, directory: str, pattern: str = "*.md") -> tuple[DataFrame, DataFrame]:
    """Every matching file directly inside a directory is one document; see split_valid_utf8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return split_valid_utf8(files.select("path", "content"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, text) of a file joined in order into one document."""
    return concat_in_order(pages, ["doc_id"], "page_no", "text", PAGE_SEPARATOR)


def union_documents(paged: DataFrame, text_files: DataFrame) -> DataFrame:
    """All documents, duplicates kept: (source_order, doc_key, text)."""
    return (
        paged.select(F.lit(PAGED).alias("source_order"), F.col("doc_key").cast("string"), "text")
        .unionByName(text_files.select(
            F.lit(TEXT_FILE).alias("source_order"), F.col("doc_key").cast("string"), "text"))
    )


def count_documents(docs: DataFrame) -> DataFrame:
    """Number of loaded documents per kind of source."""
    return docs.groupBy("source_order").agg(F.count("*").alias("n_documents"))
