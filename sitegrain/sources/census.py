"""Census tables: rent stress (long form), tenure (feature attributes), socio-economic index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions.numbers import sheet_integer

# Markers in the rent-stress file.
REGION_LEVEL = "SA2 2021"
INDICATOR = "RAID Rent Affordability Indicator"
STRESSED = "Households where rent payments are more than 30% of household income"
RENTING = "Total renting households"
RENT_COLUMNS = (
    "GEOGRAPHY_LEVEL", "GEOGRAPHY_CODE_2021", "GEOGRAPHY_NAME_2021", "Affordability_Indicator",
    "Affordability_Indicator_Category", "Total",
)

RENT_SCHEMA = (
    "sa2_code_2021 bigint, sa2_name_2021 string, rent_stress_households bigint, total_renting_households bigint"
)
TENURE_SCHEMA = (
    "sa2_code_2021 bigint, sa2_name_2021 string, renter_households_2021 bigint, total_households_2021 bigint"
)
SEIFA_SCHEMA = (
    "sa2_code_2021 bigint, sa2_name_2021 string, "
    "seifa_irsd_score double, seifa_irsd_decile bigint, seifa_irsad_score double, seifa_irsad_decile bigint, "
    "seifa_ier_score double, seifa_ier_decile bigint, seifa_ieo_score double, seifa_ieo_decile bigint, "
    "sa2_population bigint"
)


def read_noted_csv(spark: SparkSession, path: str | list[str], columns: tuple[str, ...] = RENT_COLUMNS) -> DataFrame:
    """CSV files whose header may follow note lines. The ``columns`` come back as text, by their heading.

    A line's place in its file is the start of its split and its number there, so files are still
    split. Per file the first line whose first cell is the first column is the header; all before it
    are notes, whatever they hold. Each file has its own header: cells are taken by the position of
    the heading in it, blank headings count, and a row may be of any width.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("at"),
    )
    first = F.trim(F.from_csv("value", F.lit("c string"))["c"])
    heads = lines.filter(F.col("value").contains(columns[0])).filter(first == F.lit(columns[0]))
    # One row per file.
    headers = heads.groupBy("file").agg(F.min(F.struct("at", "value")).alias("h")).select(
        "file", F.col("h.at").alias("header_at"), F.col("h.value").alias("header")
    )
    counts = headers.agg(F.count(F.lit(1)).alias("files"), F.max(F.size(F.split("header", ","))).alias("width")).first()
    files = lines.select("file").distinct().count()
    if counts.files < files or not files:
        raise ValueError(f"{files - counts.files} of {files} files of {path} have no header that starts with {columns[0]!r}")
    cells = F.lit(", ".join(f"c{i} string" for i in range(counts.width)))

    def parsed(value: str):
        return F.from_csv(value, cells)

    names = [F.trim(F.col("names")[f"c{i}"]) for i in range(counts.width)]
    placed = headers.withColumn("names", parsed("header")).select(
        "file", "header_at", *[F.array_position(F.array(*[F.coalesce(n, F.lit("")) for n in names]), c).alias(f"p{i}") for i, c in enumerate(columns)]
    )
    missing = placed.filter(F.least(*[f"p{i}" for i in range(len(columns))], F.lit(1)) == 0).limit(1).collect()
    if missing:
        raise ValueError(f"{missing[0].file} has no header with {columns}")
    rows = lines.join(placed, "file").filter(F.col("at") > F.col("header_at")).withColumn("row", parsed("value"))
    row = F.array(*[F.col("row")[f"c{i}"] for i in range(counts.width)])
    kept = rows.withColumn("cells", row).select(
        *[F.get("cells", (F.col(f"p{i}") - 1).cast("int")).alias(c) for i, c in enumerate(columns)]
    )
    return kept.filter(F.col(columns[1]).isNotNull())


def rent_stress_households(raw: DataFrame) -> DataFrame:
    """Long rent-stress rows to one row per region, in one aggregate.

    Regions appear when they have a total; a missing stress row counts as 0.
    """
    category = F.col("Affordability_Indicator_Category")
    total = sheet_integer(F.col("Total"))
    code = sheet_integer(F.col("GEOGRAPHY_CODE_2021"))
    name = F.col("GEOGRAPHY_NAME_2021")
    wide = (
        raw.filter(
            (F.col("GEOGRAPHY_LEVEL") == REGION_LEVEL)
            & (F.col("Affordability_Indicator") == INDICATOR)
            & category.isin(STRESSED, RENTING)
        )
        .groupBy(code.alias("sa2_code_2021"))
        .agg(
            F.max(F.when(category == RENTING, name)).alias("sa2_name_2021"),
            F.coalesce(F.max(F.when(category == STRESSED, total)), F.lit(0)).cast("bigint").alias(
                "rent_stress_households"
            ),
            F.max(F.when(category == RENTING, total)).alias("total_renting_households"),
            F.count_if(category == RENTING).alias("_totals"),
        )
    )
    return wide.filter(F.col("_totals") > 0).drop("_totals")


def tenure_from_features(df: DataFrame) -> DataFrame:
    """Exploded feature attributes to the tenure columns; unusable numbers become null."""
    a = "f.attributes"
    return df.select(F.explode("features").alias("f")).select(
        F.col(f"{a}.sa2_code_2021").try_cast("bigint").alias("sa2_code_2021"),
        F.col(f"{a}.sa2_name_2021").alias("sa2_name_2021"),
        F.col(f"{a}.r_tot_total").try_cast("bigint").alias("renter_households_2021"),
        F.col(f"{a}.total_total").try_cast("bigint").alias("total_households_2021"),
    )


def read_tenure_json(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "features array<struct<attributes:struct<sa2_code_2021:string,sa2_name_2021:string,"
        "r_tot_total:string,total_total:string>>>"
    )
    return tenure_from_features(spark.read.schema(schema).option("multiLine", "true").json(path))


def clean_seifa(sheet: DataFrame) -> DataFrame:
    """Text sheet of the index to typed columns; footer rows (no numeric code) drop out.

    Expects ``code, name, score, decile, score_1, decile_1, ..., population``: the repeated
    headings of the sheet with a running number.
    """
    # The order in which the sheet repeats its score and decile headings.
    order = ("irsd", "irsad", "ier", "ieo")
    indexes = []
    for i, index in enumerate(order):
        tail = f"_{i}" if i else ""
        indexes += [
            F.trim(F.col(f"score{tail}")).try_cast("double").alias(f"seifa_{index}_score"),
            sheet_integer(F.col(f"decile{tail}")).alias(f"seifa_{index}_decile"),
        ]
    rows = sheet.select(
        sheet_integer(F.col("code")).alias("sa2_code_2021"),
        F.trim("name").alias("sa2_name_2021"),
        *indexes,
        sheet_integer(F.col("population")).alias("sa2_population"),
    )
    return rows.filter(F.col("sa2_code_2021").isNotNull())


def empty_rent_stress(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RENT_SCHEMA)


def empty_tenure(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TENURE_SCHEMA)


def empty_seifa(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SEIFA_SCHEMA)
