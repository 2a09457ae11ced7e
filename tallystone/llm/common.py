"""Small helpers the operators share: table access, the package for Python workers, text expressions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions.stages import cut

__all__ = ["BLANKS", "ascii_lower", "columns_of", "cut", "joined_spans", "sha256_hex", "ship", "table", "unused", "whole_text"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All characters of `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp(prefix="tallystone-")) / f"{package.name}.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(packed))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or what it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever signs are in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def joined_spans(spans: Column) -> Column:
    """`kind:start:end` of sorted structs (start, rank, end, kind), comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
