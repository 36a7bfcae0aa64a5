"""Postcode sheets of the rental and sales market, read as text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions.numbers import sheet_integer, sheet_number

RENT_SCHEMA = "poa_code_2021 bigint, median_weekly_rent_total double, bonds_lodged_total bigint"
SALES_SCHEMA = "poa_code_2021 bigint, median_sale_price_total double, sales_total bigint"
KEY_HEADING = "postcode"


def header_names(sheet: DataFrame, marker: str = KEY_HEADING) -> list[str]:
    """Headings of a sheet with explanatory rows above them (columns ``_c0, _c1, ...``).

    The header row is the one whose first cell is the marker, else the first that holds it.
    Only that one row comes to the driver.
    """
    first = F.lower(F.trim(F.col(sheet.columns[0])))
    hits = sheet.filter(first.contains(marker)).orderBy((first != marker).cast("int"), F.length(first)).limit(1)
    row = hits.first()
    if row is None:
        raise ValueError(f"no header row with {marker!r}")
    return [(value or "").strip() for value in row]


def _find(names: list[str], wanted) -> int | None:
    return next((i for i, n in enumerate(names) if wanted(n)), None)


def _cell(sheet: DataFrame, index: int | None) -> Column:
    return F.col(sheet.columns[index]) if index is not None else F.lit(None).cast("string")


def _postcode_rows(sheet: DataFrame, names: list[str], rollups: list[int]) -> tuple[DataFrame, Column]:
    """Rows that hold a numeric postcode and, where the sheet splits by dwelling, the totals."""
    position = _find(names, lambda n: n.lower() == KEY_HEADING)
    code = sheet_integer(_cell(sheet, position if position is not None else 0))
    keep = code.isNotNull()
    for i in rollups:
        keep = keep & (F.lower(F.trim(_cell(sheet, i))) == "total")
    return sheet.filter(keep), code


def rent_by_postcode(sheet: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = names or header_names(sheet)
    dwelling = _find(names, lambda n: n == "Dwelling Types")
    bedrooms = _find(names, lambda n: n == "Number of Bedrooms")
    both = dwelling is not None and bedrooms is not None
    rows, code = _postcode_rows(sheet, names, [dwelling, bedrooms] if both else [])
    return rows.select(
        code.alias("poa_code_2021"),
        sheet_number(_cell(sheet, _find(names, lambda n: "Median Weekly Rent" in n))).alias(
            "median_weekly_rent_total"
        ),
        sheet_number(_cell(sheet, _find(names, lambda n: "New Bonds Lodged" in n))).try_cast("bigint").alias(
            "bonds_lodged_total"
        ),
    )


def sales_by_postcode(sheet: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Medians are published in thousands and come out in full units."""
    names = names or header_names(sheet)
    dwelling = _find(names, lambda n: n == "Dwelling Type")
    if dwelling is None:
        dwelling = _find(names, lambda n: n == "Dwelling Types")
    rows, code = _postcode_rows(sheet, names, [dwelling] if dwelling is not None else [])
    return rows.select(
        code.alias("poa_code_2021"),
        (sheet_number(_cell(sheet, _find(names, lambda n: "Median Sales Price" in n))) * F.lit(1000.0)).alias(
            "median_sale_price_total"
        ),
        sheet_number(_cell(sheet, _find(names, lambda n: n.lower().startswith("sales")))).try_cast(
            "bigint"
        ).alias("sales_total"),
    )


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV, without header, all cells as text."""
    return spark.read.option("header", "false").option("multiLine", "true").csv(path)


def empty_rent(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RENT_SCHEMA)


def empty_sales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SALES_SCHEMA)
