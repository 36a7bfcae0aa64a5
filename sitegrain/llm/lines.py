"""Line dedup by site-relative frequency.

Per site the number of pages that hold a line is divided by the number of pages of the site;
lines above a boilerplate ratio are dropped from all pages of that site.

Lines travel as 128 hash bits, never as text, and are counted with partial sums in each task, so
a line that a third of all pages share is one row per task. A site can have at most (mean lines
per page / ratio) boilerplate lines, so its set is short. While all sets together are within
``BROADCAST_LINES`` they are sent to the tasks and no page text is shuffled; beyond it pages meet
their site's set in a plain join by site, which Spark splits, with the same result.

Nulls: a null text stays null and counts as a page without lines; a null site is a site of its
own. Blank lines are never boilerplate. Repeated rows are pages of their own. An empty table
gives an empty result. A text that loses every line becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import Shielded, group_key
from sitegrain.runtime import cut_lineage

MAX_RATIO = 0.1
MIN_PAGES = 10
#: Boilerplate lines (16 bytes each) up to which the sets are sent to every task; beyond it pages are joined by site.
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """128 bits of a line without its outer white space; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b")))


def boilerplate(pages: DataFrame, text: str = "text", site: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site key, set of line keys) of the lines on more than ``max_ratio`` of a site's pages and on ``min_pages`` at least."""
    own = pages.select(group_key(site).alias("_site"), F.col(text).alias("_text"))
    totals = own.groupBy("_site").agg(F.count(F.lit(1)).alias("_pages"))
    once = F.array_distinct(F.array_compact(F.transform(_lines(F.col("_text")), line_key)))
    counts = (
        own.select("_site", F.explode(once).alias("_line"))
        .select("_site", "_line.a", "_line.b")
        .groupBy("_site", "a", "b")
        .agg(F.count(F.lit(1)).alias("_on"))
        .filter(F.col("_on") >= min_pages)
    )
    often = counts.join(totals, "_site").filter(F.col("_on") > F.col("_pages") * max_ratio)
    return often.groupBy("_site").agg(F.collect_set(F.struct("a", "b")).alias("_drop"))


def drop_boilerplate(pages: DataFrame, text: str = "text", site: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with ``text`` cleaned, plus ``_l_lines`` and ``_l_dropped``."""
    shield = Shielded(pages)
    text, site = shield.of(text), shield.of(site)
    found = cut_lineage(boilerplate(shield.df, text, site, max_ratio, min_pages))
    size = found.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("_drop")), F.lit(0))).first()[0]
    if size <= BROADCAST_LINES:
        found = F.broadcast(found)
    joined = shield.df.withColumn("_site", group_key(site)).join(found, "_site", "left")
    lines = _lines(F.col(text))
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_drop"), line_key(x)), F.lit(False)))
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(left)
    own = [F.col(c) if c != text else F.array_join("_kept", "\n").alias(c) for c in shield.df.columns]
    out = joined.withColumn("_kept", F.when(F.col(text).isNotNull(), kept))
    n = F.when(F.col(text).isNotNull(), F.size(lines)).otherwise(0).cast("long")
    return shield.back(out.select(
        *own, n.alias("_l_lines"),
        F.when(F.col("_kept").isNotNull(), n - F.size("_kept")).otherwise(0).cast("long").alias("_l_dropped"),
    ))


def sql(table: str = "documents", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same result as plain SQL over texts: doc_id, n_lines, n_dropped, text_md5."""
    bare = "trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
    return f"""
with p as (select row_number() over () r, doc_id, source, text from {table}),
l as (select r, source, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos from p),
b as (select source, {bare} bare, count(distinct r) n from l group by all),
t as (select source, count(*) total from p group by all),
drops as (select b.source, bare from b join t on b.source is not distinct from t.source
  where bare <> '' and n >= {min_pages} and n > total * {max_ratio}::double),
m as (select l.r, l.pos, l.line, d.bare is not null gone from l left join drops d
  on l.source is not distinct from d.source and {bare} = d.bare),
k as (select r, count(*) n_lines, count(*) filter (gone) n_dropped,
  coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') rest from m group by r)
select doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped,
  case when text is not null then md5(coalesce(rest, '')) end text_md5
from p left join k using (r)"""
