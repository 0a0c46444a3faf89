"""The operators' queries over their whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import ctw, fingerprints, mixing, pieces, quality, repeats, secrets, sharding, simhash, warc
from shoebox.llm.common import durable


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.figures(_documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_documents(spark, sf_dir))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_documents(spark, sf_dir))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_documents(spark, sf_dir))


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(_documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = durable(warc.write_archives(pages), "warc")
    found = warc.read_archives(archives)
    page = F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    page = F.when(F.col("gap_reason").isNull(), page).otherwise(F.raise_error(F.concat(F.lit("damaged archive: "), "gap_reason")).cast("bigint"))
    refers = F.regexp_extract("refers_to", r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    return found.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_documents(spark, sf_dir), shards=8)


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_quality, op3_secrets, op4_repeats, op5_pieces, op6_fingerprints, op7_ctw, op8_simhash, op9_warc, op10_sharding)}


def _base32_sql() -> str:
    """The base32 digits of the hex digits h, five of them to four."""
    part = lambda k, shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 5 * k}, 5))::int >> {shift}) & 31) + 1, 1)"
    return " || ".join(part(k, shift) for k in range(8) for shift in (15, 10, 5, 0))


def _quality_sql() -> str:
    word, symbols = r"[^\x20\x09-\x0D]+", "[^#*$%&|<>]"
    count = lambda pattern: f"length(regexp_replace(line, '{pattern}', '', 'g'))"
    times = lambda text: f"(length(line) - length(replace(line, '{text}', ''))) / {len(text)}"
    separators = f"({times('|')} + {times('»')} + {times('·')} + {times('•')} + len(list_filter(list_slice(string_split(line, ' '), 2, -2), lambda x: x IN ('>', '/'))))"
    final = r"""[.!?:;…"''”’»)\]。！？][\x20\x09-\x0D]*$"""
    phrase = (
        r"(?i)all rights reserved|copyright (\(c\)|©|\d{4})|licensed under|released under the|privacy policy|terms of (use|service)|cookie policy|"
        r"accept (all )?cookies|enable javascript|click here|read more|sign (in|up) |log in|subscribe to|lorem ipsum|follow us on|share this"
    )
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS words FROM d),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT r, line, regexp_extract_all(line, '{word}') AS words FROM l),
j AS (SELECT r, line, len(words) AS n, len(list_filter(range(1, len(words)), lambda k: words[k] = words[k + 1])) AS same FROM m),
v AS (SELECT r, line, n, CASE WHEN n = 0 THEN NULL WHEN n >= {quality.STUTTER_WORDS} AND same > {quality.STUTTER_SHARE} * n THEN 'boilerplate'
 WHEN {separators} >= {quality.NAV_SEPARATORS} AND {separators} >= {quality.NAV_SHARE} * n THEN 'navigation'
 WHEN {count(symbols)} > {quality.SYMBOL_SHARE} * n OR {times('!!')} > {quality.SHOUT_SHARE} * n THEN 'punctuation'
 WHEN {count('[^A-Z]')} >= {quality.CAPITAL_LETTERS} AND {count('[^A-Z]')} > {quality.CAPITAL_SHARE} * {count('[^A-Za-z]')} THEN 'punctuation'
 WHEN n <= {quality.FRAGMENT_WORDS} AND length(line) <= {quality.FRAGMENT_CHARS} AND NOT regexp_matches(line, '{final}') THEN 'punctuation'
 WHEN n <= {quality.BOILERPLATE_WORDS} AND regexp_matches(line, '{phrase}') THEN 'boilerplate' END AS rule FROM j),
s AS (SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, coalesce(sum(n) FILTER (rule IS NOT NULL), 0) AS lost,
 count(*) FILTER (rule = 'punctuation') AS p, count(*) FILTER (rule = 'navigation') AS g, count(*) FILTER (rule = 'boilerplate') AS b FROM v GROUP BY r),
x AS (SELECT r, k, list_slice(words, k, k + {quality.REPEAT_WINDOW - 1}) AS win FROM (SELECT r, words, unnest(range(1, len(words) - {quality.REPEAT_WINDOW - 2})) AS k FROM w)),
y AS (SELECT r, list(k) AS ks FROM x GROUP BY r, win HAVING count(*) > 1),
z AS (SELECT r, count(DISTINCT k) AS repeated FROM (SELECT r, unnest(range(k, k + {quality.REPEAT_WINDOW})) AS k FROM (SELECT r, unnest(ks) AS k FROM y)) GROUP BY r),
o AS (SELECT w.doc_id, cast(len(words) AS bigint) AS n_words, cast(coalesce(list_sum(list_transform(words, lambda q: length(q))), 0) AS bigint) AS word_chars,
 cast(length(regexp_replace(t, '{symbols}', '', 'g')) AS bigint) AS n_symbols, cast(dup AS bigint) AS n_dup_lines, cast(coalesce(repeated, 0) AS bigint) AS n_repeat_words,
 cast(lost AS bigint) AS n_lost_words, cast(p AS bigint) AS n_punctuation_lines, cast(g AS bigint) AS n_navigation_lines, cast(b AS bigint) AS n_boilerplate_lines
 FROM w JOIN s ON s.r = w.r LEFT JOIN z ON z.r = w.r),
f AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND n_lost_words <= {quality.MOST_LOST} * n_words AS kept FROM f"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality": _quality_sql(),
        "op9_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT t, min(page_id) AS first FROM p GROUP BY t)
SELECT page_id, cast(strlen(p.t) AS bigint) AS payload_bytes, {_base32_sql()} AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f ON f.t = p.t""",
    }
