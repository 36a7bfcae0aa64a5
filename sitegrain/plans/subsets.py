"""From raw place shards to a market's place table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sitegrain.operators.subset import city_subset, country_filter, drop_flagged, open_only
from sitegrain.sources.places import canonical_places
from sitegrain.sources.profile import Funnel


def country_places(raw: DataFrame, code: str = "AU", funnel: Funnel | None = None) -> DataFrame:
    """Open, valid places of one country; the funnel counts survivors while the job runs."""
    funnel = funnel or Funnel()
    return funnel.through(
        canonical_places(raw),
        ("places_input", lambda d: d),
        (f"country_{code}", lambda d: country_filter(d, code)),
        ("open_only", open_only),
        ("unflagged", drop_flagged),
    )


def city_places(
    country: DataFrame,
    city: str = "Sydney",
    strategy: str = "auto",
    localities: Sequence[str] = (),
    funnel: Funnel | None = None,
) -> DataFrame:
    funnel = funnel or Funnel()
    return funnel.mark(city_subset(country, city, strategy, localities), f"city_{city}")
