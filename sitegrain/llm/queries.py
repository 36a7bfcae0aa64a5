"""One registered query per operator: production parameters on whole tables, results in the agreed columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import alignment, bpe, licenses, lines, packing, quality, sharding, simhash, spaced, suffixes, urls, whitening, windows
from sitegrain.llm.common import bounded_batches, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 1024
SHARDS = 40
URL_RULES = (
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        bounded_batches(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_mcd_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the MCD verdict of every document."""
    judged = quality.robust_outliers(read(spark, folder, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[F.col(f"_q_{c}").alias(c) for c in counts], F.col("_q_base_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"), F.col("_q_distance").alias("distance"),
        F.col("_q_level").alias("level"),
    )


@query
def op2_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    cleaned = lines.drop_boilerplate(read(spark, folder, "documents"))
    return cleaned.select(
        "doc_id", F.col("_l_lines").alias("n_lines"), F.col("_l_dropped").alias("n_dropped"), F.md5("text").alias("text_md5")
    )


CHECKS["op2_site_lines"] = lines.sql()


@query
def op3_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Copies, and near-duplicate passages of 50 words or more between class representatives."""
    return windows.near_duplicate_passages(read(spark, folder, "documents"))


@query
def op4_rendezvous(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of 40 shards, and where it goes with one shard more."""
    docs = read(spark, folder, "documents").select(
        "doc_id", sharding.size_of(F.col("text")).alias("size"), sharding.checksum_of(F.col("text")).alias("text_crc32")
    )
    placed = sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_s_shard").alias("shard"),
        F.col("_s_slot").alias("slot"), F.col("_s_grown").alias("grown_shard"),
    )


@query
def op5_sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(packing.pieces_of(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER)))


@query
def op6_vantage_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_blocked_bloom(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page; the list holds the URLs of the pages whose document is labelled toxic."""
    pages = read(spark, folder, "pages").select("page_id", "url")
    toxic = read(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    listed = urls.listed_urls(pages.join(toxic, "page_id", "left_semi"))
    judged = urls.judge(pages, listed, URL_RULES)
    return judged.select(
        "page_id", F.col("_u_host").alias("host"), F.col("_u_path").alias("path"), F.col("_u_rule").alias("rule"),
        F.col("_u_verdict").alias("verdict"), F.col("_u_listed").alias("listed"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CHECKS["op7_blocked_bloom"] = f"""
with p as (select page_id, case when contains(url, '://') then
    regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1) else '' end rest from pages),
u as (select page_id, coalesce({_LOWER.format("regexp_extract(rest, '^([^/]*)', 1)")}, '') host,
    coalesce(regexp_extract(rest, '^[^/]*(/.*)$', 1, 's'), '') path from p),
c as (select *, nullif(regexp_replace(host, '^www\\.', ''), '') || regexp_replace(path, '/+$', '') canon from u),
l as (select distinct canon from c where page_id in (select doc_id from labels where toxic = 1) and canon is not null),
r as (select *, canon in (select canon from l) and canon is not null listed,
  case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
       when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
       when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
       when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end rule from c)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when listed then 'block' else 'allow' end verdict, coalesce(listed, false) listed from r"""


@query
def op8_license_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in every document."""
    return licenses.scan(read(spark, folder, "documents"), licenses.NOTICES)


CHECKS["op8_license_bands"] = licenses.sql(licenses.NOTICES)


@query
def op9_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with every benchmark item that it overlaps."""
    return spaced.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op10_radix_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """What remains of every document without the bytes of repeated 200-byte strings."""
    return suffixes.repeated_windows(read(spark, folder, "documents"))


@query
def op11_jacobi_davidson(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whitened on the eight strongest components of all vectors."""
    return whitening.whiten(read(spark, folder, "embeddings"), "vec_id", "embedding", components=8)


@query
def op12_array_merging(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and whether they are over the limit."""
    counted = bpe.count_tokens(read(spark, folder, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op13_perfect_hash_links(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of every document under two tokenizers, with corpus-wide counts of the links."""
    paths = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)
    return alignment.align_counts(read(spark, folder, "documents"), *paths)
