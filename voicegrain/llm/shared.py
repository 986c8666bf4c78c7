"""What the operators of this subpackage share: the folder all executors see, and small column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import shared_dir

#: The separators of the contracts' words: space and \t \n \v \f \r.
SEPARATORS = "[\\x20\\x09-\\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns a reader of it.

    This cuts the lineage: losing an executor later costs no recomputation of df. The table stays until the folder is cleared, as what is
    returned reads it when it is used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, so that value is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and \\t \\n \\v \\f \\r; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != F.lit(""))


def pairwise(items: Column, gap: int, combine) -> Column:
    """combine(items[i], items[i + gap]) for each i that has both."""
    return let(
        items,
        lambda a: F.when(
            F.size(a) > gap,
            F.zip_with(F.slice(a, F.lit(1), F.size(a) - gap), F.slice(a, F.lit(gap + 1), F.size(a) - gap), combine),
        ).otherwise(F.slice(a, 1, 0)),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
