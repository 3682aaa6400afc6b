"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.session import scratch_path

# A word of the contracts: no space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\u000b\f\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back.

    Cuts the lineage: what was read is fixed, whatever executor is lost later.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def whole_ids(docs: DataFrame) -> DataFrame:
    """doc_id (as long) and text; ids of another kind are refused, as a cast would make them null."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id has to be a whole number")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def rows_as_struct(df: DataFrame, out: str = "row") -> DataFrame:
    """The whole row as one column, so no name of the input can clash with a working column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(out))


def parts_for(df: DataFrame, bytes_each: int, size: Column | None = None) -> int:
    """Number of parts of about ``bytes_each`` for a frame, from one pass over its sizes."""
    size = F.octet_length(F.col("text")) if size is None else size
    total = df.agg(F.coalesce(F.sum(F.coalesce(size, F.lit(0)).cast("long") + 16), F.lit(0))).first()[0]
    return max(1, -(-int(total) // bytes_each))


def keep_rows(docs: DataFrame, decisions: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (doc_id, sha256 of text) stands in ``decisions`` (doc_id, sha).

    ``decisions`` has distinct rows with a column ``rows``: how many rows of ``docs`` share the
    pair. Rows that repeat a document are one document: one of them stays. Null ids and
    null texts match null and the empty text.
    """
    left = rows_as_struct(docs).withColumn("k", F.sha2(F.coalesce(F.col(f"row.{text}"), F.lit("")).cast("binary"), 256))
    on = [left["row.doc_id"].eqNullSafe(decisions["doc_id"]), left["k"] == decisions["sha"]]
    met = left.join(decisions, on, "inner").select("row", "k", "rows")
    single = met.filter(F.col("rows") == 1).select("row.*")
    several = met.filter(F.col("rows") > 1).groupBy(F.col("row.doc_id").alias("id"), "k").agg(F.first("row").alias("row"))
    return single.unionByName(several.select("row.*"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns; one the input lacks is null."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])
