"""GeoJSON features one per line: newline-delimited files and text sequences, split like any text file.

A line may start with the record separator of a text sequence. Blank lines are skipped. Lines that
are no JSON object with a known shape go to a table of rejects instead of failing the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\x1e"
FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>,attributes:map<string,string>>"
_SHAPE = FEATURE[:-1].replace("struct<", "", 1)


def parse_feature_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` plus ``f`` (the feature, null where the line is none) and ``bad`` (the text of a line that is none)."""
    text = F.trim(F.regexp_replace(F.trim(F.col(value)), f"^{SEPARATOR}", ""))
    fields = _SHAPE.replace("properties:", "properties ").replace("geometry:struct", "geometry struct").replace("attributes:map", "attributes map")
    read = F.from_json(
        F.col("_text"), f"{fields}, _bad string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
    )
    known = lines.withColumn("_text", text).filter(F.length("_text") > 0).withColumn("_read", read)
    shapeless = F.col("_read.properties").isNull() & F.col("_read.geometry").isNull() & F.col("_read.attributes").isNull()
    bad = F.when(F.col("_read").isNull() | F.col("_read._bad").isNotNull() | shapeless, F.col("_text"))
    feature = F.struct(*[F.col(f"_read.{c}").alias(c) for c in ("properties", "geometry", "attributes")])
    marked = known.withColumn("bad", bad)
    return marked.withColumn("f", F.when(F.col("bad").isNull(), feature)).drop("_text", "_read")


def read_feature_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(features, rejects): ``file, line, f`` and ``file, line, bad``. ``line`` rises along each file."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")
    )
    parsed = parse_feature_lines(lines)
    good = parsed.filter(F.col("bad").isNull()).select("file", "line", "f")
    return good, parsed.filter(F.col("bad").isNotNull()).select("file", "line", "bad")
