"""Categories to business roles, and roles to places.

Role keywords are matched once per category, never per place. Each category id gets a bit mask
with one bit per template and role. The masks of the matching categories, part of a dimension with
a row per category, become one constant: an array of short lists, in which an id is found by its hash. A place
folds the masks of its ids into one, so flagging places needs no explode, no join and no shuffle,
whatever the number of templates; null and repeated place or category ids need no care.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.config import COMPLEMENT_GROUPS, GYM_BROAD, GYM_STRICT, Taxonomy
from sitegrain.functions.text import category_text, clean_keywords, mentions_any

FLAGS = ("is_competitor", "is_complementary", "is_excluded", "is_commercial_other")
#: Lists over which the masks are dealt; a list of the largest published category tables holds a few ids.
MASK_LISTS = 1 << 10
#: Bits of one mask; more flags take more masks.
MASK_BITS = 60


def explode_ids(df: DataFrame, column: str = "category_ids", out: str = "category_id") -> DataFrame:
    """One row per category id; places without ids keep one row with a null id."""
    if column not in df.columns:
        return df.withColumn(out, F.lit(None).cast("string"))
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode_outer(column).alias(out))


def with_categories(exploded: DataFrame, categories: DataFrame, how: str = "left") -> DataFrame:
    """Category attributes by id."""
    if "category_id" not in exploded.columns:
        raise ValueError("category_id is needed to look up categories")
    return exploded.join(categories, "category_id", how)


def with_names(df: DataFrame, categories: DataFrame) -> DataFrame:
    """``category_name`` by id, falling back to the id itself."""
    names = categories.select("category_id", F.col("category_name").alias("_name"))
    joined = df.join(names, "category_id", "left")
    return joined.withColumn("category_name", F.coalesce("_name", "category_id")).drop("_name")


def distinct_ids(column: Column) -> Column:
    """Number of different non-null ids in an id list; 0 for no list."""
    return F.coalesce(F.size(F.array_distinct(F.array_compact(column))), F.lit(0))


class CategoryMasks:
    """Named flags of categories as bit masks, looked up from the id lists of places."""

    def __init__(self, categories: DataFrame, flags: Mapping[str, Column]):
        """``flags`` are conditions on a row of ``categories``; rows that share an id add up."""
        self.place = {name: divmod(i, MASK_BITS) for i, name in enumerate(flags)}
        columns = list(flags.values())
        words = [
            sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(columns[at : at + MASK_BITS])), F.lit(0).cast("bigint"))
            for at in range(0, len(columns), MASK_BITS)
        ]
        self.words = len(words)
        names = [f"m{i}" for i in range(self.words)]
        masks = categories.select("category_id", *[w.alias(n) for n, w in zip(names, words)]).filter(
            F.col("category_id").isNotNull() & (F.greatest(*names, F.lit(0)) > 0)
        )
        lists: list[list[dict]] = [[] for _ in range(MASK_LISTS)]
        # A dimension: the matching categories, a few dozen bytes each.
        for row in masks.select(self._list_of(F.col("category_id")), "category_id", *names).collect():
            lists[row[0]].append({"i": row[1], **dict(zip(names, row[2:]))})
        # Text that the optimizer folds into one constant.
        fields = ", ".join(f"{n}: bigint" for n in names)
        self.table = F.from_json(F.lit(json.dumps(lists)), f"array<array<struct<i: string, {fields}>>>")

    @staticmethod
    def _list_of(category_id: Column) -> Column:
        return F.pmod(F.xxhash64(category_id), F.lit(MASK_LISTS)).cast("int")

    def _of_id(self, category_id: Column, word: int) -> Column:
        none = F.lit(0).cast("bigint")
        return F.aggregate(
            F.get(self.table, self._list_of(category_id)), none,
            lambda seen, e: seen.bitwiseOR(F.when(e["i"] == category_id, e[f"m{word}"]).otherwise(none)),
        )

    def folded(self, ids: str = "category_ids") -> list[Column]:
        """The masks of a place: those of all its ids together; 0 for no ids."""
        none = F.lit(0).cast("bigint")

        def fold(word: int) -> Column:
            return F.coalesce(F.aggregate(ids, none, lambda seen, i: seen.bitwiseOR(self._of_id(i, word))), none)

        return [fold(w) for w in range(self.words)]

    def each(self, ids: str = "category_ids") -> list[Column]:
        """The masks of every entry of the id list, repeated entries repeatedly."""
        listed = F.coalesce(F.col(ids), F.array().cast("array<string>"))

        def look_up(word: int) -> Column:
            return F.transform(listed, lambda i: self._of_id(i, word))

        return [look_up(w) for w in range(self.words)]

    def any_of(self, name: str, folded: list[Column]) -> Column:
        word, bit = self.place[name]
        return folded[word].bitwiseAND(F.lit(1 << bit)) != 0

    def count_of(self, name: str, each: list[Column]) -> Column:
        """How many entries of the id list have the flag."""
        word, bit = self.place[name]
        return F.size(F.filter(each[word], lambda m: m.bitwiseAND(F.lit(1 << bit)) != 0))


def role_masks(categories: DataFrame, taxonomies: Mapping[str, Taxonomy]) -> CategoryMasks:
    """One bit per template and role, named ``template.flag``."""
    text = category_text()
    return CategoryMasks(
        categories,
        {
            f"{key}.{flag}": mentions_any(text, words)
            for key, taxonomy in taxonomies.items()
            for flag, words in taxonomy.keywords().items()
        },
    )


def with_roles(places: DataFrame, categories: DataFrame, taxonomies: Mapping[str, Taxonomy]) -> DataFrame:
    """Places with ``roles array<struct<template, four flags>>`` and ``unique_category_count``.

    Roles overlap: a place may be competitor and complement at once. Places without a known
    category get all flags false; unknown ids still count as categories.
    """
    masks = role_masks(categories, taxonomies)
    names = [f"_mask{w}" for w in range(masks.words)]
    folded = places.withColumns(
        dict(zip(names, masks.folded())) | {"unique_category_count": distinct_ids(F.col("category_ids")).cast("bigint")}
    )
    own = [F.col(n) for n in names]
    roles = F.array(
        *[
            F.struct(F.lit(key).alias("template"), *[masks.any_of(f"{key}.{flag}", own).alias(flag) for flag in FLAGS])
            for key in taxonomies
        ]
    )
    return folded.withColumn("roles", roles).drop(*names)


def place_roles(places: DataFrame, categories: DataFrame, taxonomies: Mapping[str, Taxonomy]) -> DataFrame:
    """(place_id, template, four flags, unique_category_count)."""
    flagged = with_roles(places, categories, taxonomies)
    # Outer: the array is never empty, and a plain inline would make the optimizer push a
    # "not empty" filter below the projection and compute every flag twice.
    return flagged.select("place_id", "unique_category_count", F.inline_outer("roles")).select(
        "place_id", "template", *FLAGS, "unique_category_count"
    )


def search_categories(categories: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Categories whose name or label holds the query; nothing for a blank query."""
    needle = (query or "").strip().lower()
    found = categories.filter(F.lower(category_text()).contains(needle) if needle else F.lit(False))
    return found.select("category_id", "category_name", "category_label").orderBy("category_id").limit(limit)


def match_categories(
    categories: DataFrame,
    include: Iterable[str],
    exclude: Iterable[str] = (),
    name_only: bool = False,
) -> DataFrame:
    """Ids whose text mentions an included keyword and no excluded one."""
    text = F.coalesce(F.col("category_name"), F.lit("")) if name_only else category_text()
    hit = mentions_any(text, include)
    if clean_keywords(exclude):
        hit = hit & ~mentions_any(text, exclude)
    return categories.filter(hit).select("category_id").distinct()


def competitor_categories(categories: DataFrame, mode: str = "strict") -> DataFrame:
    """Gym competitors: the strict definition, or the broad one with adjacent studios."""
    words = GYM_STRICT if mode.strip().lower() == "strict" else GYM_BROAD
    return match_categories(categories, words, name_only=True)


def complement_groups(
    categories: DataFrame, groups: Mapping[str, tuple[str, ...]] = COMPLEMENT_GROUPS
) -> DataFrame:
    """(complement_group, category_id); a category can be in several groups."""
    name = F.coalesce(F.col("category_name"), F.lit(""))
    hits = F.array_compact(
        F.array(*[F.when(mentions_any(name, words), F.lit(group)) for group, words in groups.items()])
    )
    return categories.select(F.explode(hits).alias("complement_group"), "category_id").distinct()


def union_ids(*frames: DataFrame) -> DataFrame:
    """Set union of id tables."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.union(frame)
    return merged.distinct()


def minus_ids(ids: DataFrame, removed: DataFrame) -> DataFrame:
    """Set difference of id tables."""
    return ids.join(removed.select("category_id"), "category_id", "left_anti").distinct()
