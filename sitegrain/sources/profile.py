"""Schema profile and row-count funnel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Place fields whose presence is always reported.
PLACE_FIELDS = (
    "latitude", "longitude", "country", "locality", "region", "postcode", "date_refreshed", "date_closed",
    "fsq_category_ids", "fsq_category_labels", "unresolved_flags", "geom", "bbox", "confidence",
    "confidence_score",
)


def schema_profile(df: DataFrame, fields: Sequence[str] = PLACE_FIELDS) -> DataFrame:
    """One row per column or checked field: type, presence, null count, filled share.

    All counts come from a single aggregate over the table.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = list(types) + [f for f in fields if f not in types]
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"filled_{c}") for c in types]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.lit(types.get(c)).cast("string").alias("dtype"),
                F.lit(c in types).alias("present"),
                F.lit(c in fields).alias("checked"),
                (F.col("rows") - F.col(f"filled_{c}") if c in types else F.lit(None).cast("bigint")).alias(
                    "null_count"
                ),
                (F.col(f"filled_{c}") / F.when(F.col("rows") > 0, F.col("rows")) if c in types
                 else F.lit(None).cast("double")).alias("filled_share"),
            )
            for c in names
        ]
    )
    return counts.select(F.inline(rows))


def profile_markdown(profile: DataFrame, title: str) -> str:
    """The profile as a short Markdown report (one row per schema field, so always small)."""
    lines = [f"# {title}", "", "| field | type | present | nulls |", "|---|---|---|---|"]
    for r in profile.orderBy("field").toLocalIterator():
        lines.append(f"| {r.field} | {r.dtype or '-'} | {'yes' if r.present else 'no'} | {r.null_count} |")
    return "\n".join(lines) + "\n"


class Funnel:
    """Counts rows after each filter while the final action runs: no extra scans."""

    def __init__(self) -> None:
        self._stages: list[tuple[str, Observation]] = []

    def mark(self, df: DataFrame, stage: str) -> DataFrame:
        watch = Observation(f"stage_{len(self._stages)}")
        self._stages.append((stage, watch))
        return df.observe(watch, F.count(F.lit(1)).alias("rows"))

    def through(self, df: DataFrame, *steps: tuple[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
        for stage, step in steps:
            df = self.mark(step(df), stage)
        return df

    def counts(self) -> list[tuple[str, int]]:
        """Stage names with counts; call it after an action on the result."""
        return [(stage, watch.get["rows"]) for stage, watch in self._stages]

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, stage, rows) after the action. Each count is what the one finished action saw."""
        return spark.createDataFrame([(i, *c) for i, c in enumerate(self.counts())], "step int, stage string, rows bigint")


def funnel_counts(df: DataFrame, *stages: tuple[str, "F.Column"]) -> DataFrame:
    """The same funnel as a table: rows that survive the first k conditions, in one scan."""
    kept = F.lit(True)
    sums = [F.count(F.lit(1)).alias("s0")]
    for i, (_, condition) in enumerate(stages, 1):
        kept = kept & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(kept).alias(f"s{i}"))
    labels = ["input", *[name for name, _ in stages]]
    return df.agg(*sums).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("rows"))
                    for i, name in enumerate(labels)
                ]
            )
        )
    )
