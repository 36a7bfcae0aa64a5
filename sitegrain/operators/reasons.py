"""Explanations: top reasons, score parts, metric tables, narratives, checklists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.config import CHECKLISTS
from sitegrain.functions.numbers import fixed_point
from sitegrain.operators.scoring import PARTS

# Wording of a reason per score part, in order of preference on ties.
REASON_TEXT: tuple[tuple[str, str], ...] = (
    ("score_complementarity", "Strong complements"),
    ("score_activity", "High commercial activity"),
    ("score_diversity", "High category diversity"),
    ("score_competition", "Low competition"),
    ("score_saturation", "Lower saturation"),
    ("score_quality", "Good data coverage"),
    ("score_transit_access", "Strong transit access"),
    ("score_market_fit", "Strong market fit"),
    ("score_rent_affordability", "Lower rental stress (proxy)"),
)


def top_reasons(columns: Sequence[str], k: int = 3, mode: str = "reference") -> Column:
    """The ``k`` strongest reasons as text, strongest first, earlier wording first on ties.

    Penalty parts count with their sign flipped, so in ``reference`` mode the two "low"
    reasons appear where the penalty is large; ``corrected`` mode counts what is left of the
    possible penalty instead.
    """
    if mode not in ("reference", "corrected"):
        raise ValueError("mode is reference or corrected")
    shape = {part: (n, sign) for part, n, _, sign in PARTS}
    entries = []
    for position, (part, text) in enumerate(REASON_TEXT):
        n, sign = shape[part]
        if part not in columns:
            strength = F.lit(0.0)
        elif sign > 0:
            strength = F.col(part)
        elif mode == "reference":
            strength = -F.col(part)
        else:
            strength = F.when(F.col(n) > 0, -F.col(part) / F.col(n) * (F.lit(1.0) - F.col(n))).otherwise(F.lit(1.0))
        weakness = F.coalesce(-strength, F.lit(0.0))
        entries.append(F.struct(weakness.alias("w"), F.lit(position).alias("i"), F.lit(text).alias("t")))
    best = F.slice(F.array_sort(F.array(*entries)), 1, k)
    return F.concat_ws("; ", F.transform(best, lambda e: e["t"]))


def with_reasons(df: DataFrame, k: int = 3, mode: str = "reference", out: str = "reasons_top3") -> DataFrame:
    return df.withColumn(out, top_reasons(df.columns, k, mode))


# Factor names of the score breakdown.
FACTORS: tuple[tuple[str, str], ...] = (
    ("Complements", "score_complementarity"),
    ("Activity", "score_activity"),
    ("Diversity", "score_diversity"),
    ("Transit access", "score_transit_access"),
    ("Market fit", "score_market_fit"),
    ("Rent affordability", "score_rent_affordability"),
    ("Data quality", "score_quality"),
    ("Competition (penalty)", "score_competition"),
    ("Saturation (penalty)", "score_saturation"),
)


def score_breakdown(df: DataFrame, ids: Sequence[str] = ("area_id",)) -> DataFrame:
    """(ids, factor, contribution) for the parts the table has; nulls count as 0."""
    parts = [(label, c) for label, c in FACTORS if c in df.columns]
    wide = df.select(*ids, *[F.coalesce(F.col(c), F.lit(0.0)).alias(label) for label, c in parts])
    return wide.unpivot(list(ids), [label for label, _ in parts], "factor", "contribution")


# Report metrics as (group, label, column, format).
METRICS: tuple[tuple[str, str, str, str], ...] = (
    ("Score", "Opportunity score", "opportunity_score", "float3"),
    ("Activity", "Active POIs", "poi_count", "int0"),
    ("Activity", "Competitors", "competitor_count", "int0"),
    ("Activity", "Complements", "complement_count", "int0"),
    ("Activity", "Data quality (mean)", "data_quality_score", "float2"),
    ("Structure", "Competitor density proxy", "competitor_density_proxy", "float4"),
    ("Structure", "Complementarity ratio", "complementarity_ratio", "float4"),
    ("Structure", "Commercial activity proxy", "commercial_activity_proxy", "float1"),
    ("Structure", "Saturation proxy", "saturation_proxy", "float4"),
    ("Structure", "Unique category count (sum)", "unique_category_count", "float1"),
    ("Structure", "Commercial other (count)", "commercial_other_count", "int0"),
    ("Transit", "Transit access score", "transit_access_score", "float2"),
    ("Transit", "Station entrances (nearby)", "station_entrance_count", "int0"),
    ("Transit", "PT facilities (nearby)", "pt_facility_count", "int0"),
    ("Transit", "Bus shelters (nearby)", "bus_shelter_count", "int0"),
    ("Market (SA2)", "Market fit score", "market_fit_score", "float2"),
    ("Market (SA2)", "SEIFA IRSAD decile", "seifa_irsad_decile", "int0"),
    ("Market (SA2)", "SA2 population", "sa2_population", "int0"),
    ("Market (SA2)", "SA2 code", "sa2_code_2021", "str"),
    ("Market (SA2)", "SA2 name", "sa2_name_2021", "str"),
    ("Rent (SA2)", "Rent affordability score", "rent_affordability_score", "float2"),
    ("Rent (SA2)", "Rental stress share", "rent_stress_share", "float2"),
    ("Labels", "Suburb (SAL)", "sal_name_2021", "str"),
    ("Labels", "SAL code", "sal_code_2021", "str"),
    ("Geo", "Latitude (centroid)", "lat_mean", "float4"),
    ("Geo", "Longitude (centroid)", "lon_mean", "float4"),
    ("Normalized inputs", "n complementarity", "n_complementarity", "float2"),
    ("Normalized inputs", "n activity", "n_activity", "float2"),
    ("Normalized inputs", "n diversity", "n_diversity", "float2"),
    ("Normalized inputs", "n competition", "n_competition", "float2"),
    ("Normalized inputs", "n saturation", "n_saturation", "float2"),
    ("Normalized inputs", "n quality", "n_quality", "float2"),
    ("Normalized inputs", "n transit", "n_transit", "float2"),
    ("Normalized inputs", "n market fit", "n_market_fit", "float2"),
    ("Normalized inputs", "n rent affordability", "n_rent_affordability", "float2"),
    ("Score parts", "Complements", "score_complementarity", "float3"),
    ("Score parts", "Activity", "score_activity", "float3"),
    ("Score parts", "Diversity", "score_diversity", "float3"),
    ("Score parts", "Competition (penalty)", "score_competition", "float3"),
    ("Score parts", "Saturation (penalty)", "score_saturation", "float3"),
    ("Score parts", "Data quality", "score_quality", "float3"),
    ("Score parts", "Transit access", "score_transit_access", "float3"),
    ("Score parts", "Market fit", "score_market_fit", "float3"),
    ("Score parts", "Rent affordability", "score_rent_affordability", "float3"),
)
NO_VALUE = "—"


def shown(column: Column, style: str) -> Column:
    """A value as report text; a dash for nulls and blanks."""
    if style == "str":
        text = F.nullif(F.trim(column.cast("string")), F.lit(""))
    elif style == "int0":
        text = fixed_point(column, 0, grouped=True)
    elif style == "float1":
        text = fixed_point(column, 1, grouped=True)
    elif style == "pct1":
        text = F.concat(fixed_point(column * 100, 1), F.lit("%"))
    else:
        text = fixed_point(column, int(style.removeprefix("float")))
    return F.coalesce(text, F.lit(NO_VALUE))


def metrics_table(df: DataFrame, ids: Sequence[str] = ("area_id",)) -> DataFrame:
    """One row per area and known metric: group, metric, value as text, field."""
    rows = F.array(
        *[
            F.struct(
                F.lit(group).alias("metric_group"),
                F.lit(label).alias("metric"),
                shown(F.col(field), style).alias("value"),
                F.lit(field).alias("field"),
            )
            for group, label, field, style in METRICS
            if field in df.columns
        ]
    )
    return df.select(*ids, F.inline(rows))


def report_columns(columns: Sequence[str]) -> list[str]:
    """Report order: names, metrics, reasons and id, then the rest; duplicate twins left out."""
    have = set(columns)
    # Raw columns dropped when their report twin is there.
    twins = {
        "complementary_count": "complement_count",
        "mean_data_quality_score": "data_quality_score",
        "active_poi_count": "poi_count",
    }
    hidden = {raw for raw, twin in twins.items() if twin in have} | {"area_id"}
    wanted = ["sal_name_2021", "sa2_name_2021", *[m[2] for m in METRICS], "reasons_top3", "h3"]
    front = [c for c in dict.fromkeys(wanted) if c in have and c not in hidden]
    return front + sorted(have - hidden - set(front))


# Metrics handed on as a payload, by type.
PAYLOAD_DOUBLES = (
    "opportunity_score", "commercial_activity_proxy", "saturation_proxy", "mean_data_quality_score",
    "data_quality_score", "transit_access_score", "market_fit_score", "rent_affordability_score",
    "rent_stress_share",
)
PAYLOAD_COUNTS = ("competitor_count", "complement_count", "complementary_count", "active_poi_count")


def payload_struct(columns: Sequence[str]) -> Column:
    """Typed and rounded subset of an area row."""
    have = set(columns)
    fields = [F.round(F.col(c).cast("double"), 6).alias(c) for c in PAYLOAD_DOUBLES if c in have]
    for c in PAYLOAD_COUNTS:
        source = c
        if c == "complement_count" and c not in have:
            source = "complementary_count"
        if source in have:
            fields.append(F.col(source).cast("bigint").alias(c))
    if "reasons_top3" in have:
        fields.append(F.col("reasons_top3"))
    return F.struct(*fields)


def metrics_payload(df: DataFrame, out: str = "payload") -> DataFrame:
    """The payload as JSON text; nulls are left out."""
    return df.withColumn(out, F.to_json(payload_struct(df.columns)))


def _joined_or_null(separator: str, parts: Sequence[Column], before: str, after: str) -> Column:
    text = F.nullif(F.concat_ws(separator, *parts), F.lit(""))
    return F.concat(F.lit(before), text, F.lit(after))


def narrative(columns: Sequence[str], city: str, business: str, id_col: str = "area_id") -> Column:
    """Plain-language summary of an area; clauses without a value are left out."""
    have = set(columns)

    def first(*names: str) -> Column:
        found = [F.col(n) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    def clause(before: str, value: Column, after: str) -> Column:
        return F.concat(F.lit(before), value, F.lit(after))

    def two(value: Column) -> Column:
        return fixed_point(value, 2)

    score = first("opportunity_score")
    area = F.col(id_col).cast("string")
    short = F.when(F.length(area) > 20, F.concat(F.substring(area, 1, 18), F.lit("…"))).otherwise(area)
    # The wording of the narrative.
    opening = F.when(
        score.isNotNull(),
        F.concat(
            F.lit(f"This **{business}** shortlist cell in **{city}** (area `"),
            short,
            F.lit("`) scores **"),
            fixed_point(score, 3),
            F.lit("** on the opportunity index, using POI-based proxies only—not revenue or foot traffic."),
        ),
    ).otherwise(
        F.concat(F.lit("Area `"), short, F.lit(f"` in **{city}** for **{business}** (scores from POI data only)."))
    )
    mix = _joined_or_null(
        ", ",
        [
            clause("**", first("competitor_count").cast("bigint").cast("string"), "** competitor-style POIs"),
            clause(
                "**",
                first("complement_count", "complementary_count").cast("bigint").cast("string"),
                "** complement POIs",
            ),
            clause(
                "**", first("active_poi_count").cast("bigint").cast("string"), "** active POIs (activity proxy)"
            ),
        ],
        "Surrounding mix: ",
        ".",
    )
    stress = F.coalesce(clause(" (rental stress share ≈ **", two(first("rent_stress_share")), "**)"), F.lit(""))
    context = _joined_or_null(
        "; ",
        [
            clause("data quality ≈ **", two(first("data_quality_score", "mean_data_quality_score")), "**"),
            clause("transit access proxy ≈ **", two(first("transit_access_score")), "**"),
            clause("market fit proxy ≈ **", two(first("market_fit_score")), "**"),
            F.concat(
                clause("rent affordability proxy ≈ **", two(first("rent_affordability_score")), "**"), stress
            ),
        ],
        "Context layers: ",
        ".",
    )
    drivers = F.concat(
        F.lit("**Top score drivers (auto):** "),
        F.nullif(F.col("reasons_top3"), F.lit("")) if "reasons_top3" in have else F.lit(None).cast("string"),
    )
    closing = F.lit(
        "**Validate on site:** (1) observe weekday/weekend traffic near candidate streets; "
        "(2) compare your offer vs. nearby competitors; "
        "(3) confirm lease, access, and planning constraints."
    )
    return F.concat_ws("\n\n", opening, mix, context, drivers, closing)


# Summary sentence per strategy, and the pros and risks of an explanation card.
STRATEGY_SUMMARY: dict[str, str] = {
    "balanced": (
        "This area scores highly because it shows strong surrounding commercial activity and a supportive "
        "wellness ecosystem, while competition remains moderate relative to activity."
    ),
    "low competition": (
        "This area stands out under a low-competition strategy because competitor intensity is lower than peers, "
        "while activity remains sufficient to support a new opening."
    ),
    "ecosystem-first": (
        "This area stands out under an ecosystem-first strategy because complements and commercial activity are "
        "both strong, improving the odds of sustained member acquisition."
    ),
}


def strategy_card(mode: str) -> dict[str, Column]:
    """Summary, pros and risks of an area under a strategy, as text columns."""

    def count(c: str) -> Column:
        return fixed_point(F.coalesce(F.col(c), F.lit(0)), 0, grouped=True)

    quality = fixed_point(F.coalesce("mean_data_quality_score", F.lit(0.0)), 2)
    saturation = fixed_point(F.coalesce("saturation_proxy", F.lit(0.0)), 3)
    pros = F.concat_ws(
        "\n",
        F.concat(F.lit("Strong activity proxy (≈ "), count("commercial_activity_proxy"), F.lit(" active POIs in-area).")),
        F.concat(F.lit("Supportive ecosystem ("), count("complementary_count"), F.lit(" complementary venues).")),
        F.concat(
            F.lit("Category diversity (≈ "),
            count("unique_category_count"),
            F.lit(" unique categories) suggests mixed-use catchment."),
        ),
        F.concat(F.lit("Data quality is solid (≈ "), quality, F.lit(").")),
    )
    risks = F.concat_ws(
        "\n",
        F.concat(F.lit("Direct competition exists ("), count("competitor_count"), F.lit(" competitors).")),
        F.concat(
            F.lit("Saturation proxy (≈ "), saturation, F.lit(") may indicate tighter share-of-wallet dynamics.")
        ),
        F.lit("Area-unit artifacts: boundaries may not match real neighborhoods or trade areas."),
    )
    return {
        "summary": F.lit(STRATEGY_SUMMARY.get(mode, STRATEGY_SUMMARY["balanced"])),
        "pros": pros,
        "risks": risks,
    }


def with_checklist(df: DataFrame, by: str = "template", lists: Mapping = CHECKLISTS) -> DataFrame:
    """(row, section, step, advice): the decision checklist of each row's template."""

    def items(checklist: Mapping[str, Sequence[str]]) -> Column:
        return F.array(
            *[
                F.struct(F.lit(section).alias("section"), F.lit(i).alias("step"), F.lit(text).alias("advice"))
                for section, texts in checklist.items()
                for i, text in enumerate(texts, 1)
            ]
        )

    chosen = items(lists["default"])
    for key, checklist in lists.items():
        if key != "default":
            chosen = F.when(F.col(by) == F.lit(key), items(checklist)).otherwise(chosen)
    return df.select("*", F.inline_outer(chosen))
