"""What the corpus operators share: words, safe inputs, the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.session import materialize as _materialize

# Fixed value: the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column | str) -> Column:
    """Words of a text: runs of anything but ASCII white space; null or blank gives an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def n_words(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: the optimizer may copy an expression into a lambda, but not a lambda's argument."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder every executor shares and read back: cuts lineage, survives lost executors."""
    return _materialize(df, name)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """The row as one struct, _row, beside the columns asked for, so that no name of the table's can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of _row again, some of them replaced."""
    return df.select(*[(replaced[c] if c in replaced else F.col("_row")[c]).alias(c) for c in columns])
