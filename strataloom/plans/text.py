"""Queries of the scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as fn
from strataloom.functions.times import utc
from strataloom.plans.registry import Registry
from strataloom.tables import load

query = Registry()


@query("""SELECT DISTINCT hash, CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END AS n_lines,
  array_to_string(list_slice(string_split(content, chr(10)), 2, 3), chr(10)) AS lines_2_3,
  CASE WHEN length(content) > 80 THEN left(content, 80) || '…' ELSE content END AS short FROM blobs WHERE content IS NOT NULL""")
def x01_line_functions(spark: SparkSession, sf: str) -> DataFrame:
    """X-01 to X-03: line count, line slice, truncation."""
    t = F.col("content")
    return load(spark, sf, "blobs").where("content is not null").select("hash", fn.count_lines(t).cast("long").alias("n_lines"), fn.slice_lines(t, 2, 3).alias("lines_2_3"), fn.truncate(t, 80).alias("short")).distinct()


_WORDS = "list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda w: length(w) >= 2)"


@query(f"SELECT DISTINCT id, array_to_string({_WORDS.format('title')}, ' ') AS words FROM findings WHERE title IS NOT NULL")
def x04_words(spark: SparkSession, sf: str) -> DataFrame:
    """X-04: identifiers and titles as words."""
    return load(spark, sf, "findings").where("title is not null").select("id", F.array_join(fn.words(F.col("title")), " ").alias("words")).distinct()


@query(f"""WITH w AS (SELECT DISTINCT id, list_filter({_WORDS.format('title')}, lambda x: NOT list_contains({list(fn.STOP_WORDS)!r}, x)) AS kept FROM findings WHERE title IS NOT NULL)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(kept, list_transform(kept, lambda x: CASE WHEN regexp_matches(x, '[a-z]{{3,}}(s|ing|ed)$') THEN regexp_replace(x, '(s|ing|ed)$', '') ELSE x END)))), ' ') AS terms FROM w""")
def x07_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    """X-07: search terms without stop words and endings."""
    return load(spark, sf, "findings").where("title is not null").select("id", F.array_join(F.array_sort(fn.query_terms(F.col("title"))), " ").alias("terms")).distinct()


@query(f"""WITH w AS (SELECT DISTINCT id, list_distinct({_WORDS.format('title')}) AS a, list_distinct({_WORDS.format('remediation')}) AS b FROM findings WHERE title IS NOT NULL AND remediation IS NOT NULL)
SELECT id, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 9) AS jaccard FROM w""")
def x09_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """X-09: similarity of two word sets."""
    rows = load(spark, sf, "findings").where("title is not null and remediation is not null")
    return rows.select("id", F.round(fn.jaccard(fn.words(F.col("title")), fn.words(F.col("remediation"))), 9).alias("jaccard")).distinct()


@query("""WITH f AS (SELECT DISTINCT id, trim(regexp_replace(what_happens, '\\s+', ' ', 'g')) AS flat FROM findings WHERE what_happens IS NOT NULL),
o AS (SELECT id, coalesce(nullif(regexp_extract(flat, '^(.*?[.!?])\\s', 1), ''), flat) AS one FROM f)
SELECT id, CASE WHEN length(one) <= 160 THEN one ELSE regexp_replace(left(one, 160), '\\s\\S*$', '') || '…' END AS sentence FROM o""")
def x10_first_sentence(spark: SparkSession, sf: str) -> DataFrame:
    """X-10: the first sentence, shortened at a word."""
    return load(spark, sf, "findings").where("what_happens is not null").select("id", fn.first_sentence(F.col("what_happens")).alias("sentence")).distinct()


_NAME = "list_extract(string_split(path, '/'), -1)"
_EXT = f"CASE WHEN contains({_NAME}, '.') THEN lower(list_extract(string_split({_NAME}, '.'), -1)) ELSE '' END"
_LANG = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fn.LANGUAGES.items()) + " ELSE 'Unknown' END"


@query(f"WITH e AS (SELECT DISTINCT id, path, {_EXT} AS ext FROM files) SELECT id, ext AS extension, {_LANG} AS language FROM e")
def x11_language(spark: SparkSession, sf: str) -> DataFrame:
    """X-11: extension and language of a path."""
    p = F.col("path")
    return load(spark, sf, "files").select("id", fn.extension_of(p).alias("extension"), fn.language_of(p).alias("language")).distinct()


@query("""WITH p AS (SELECT DISTINCT id, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM files)
SELECT id, array_to_string(list_concat(list_slice(parts, 1, greatest(len(parts) - 2, 0)), ['shared', 'index']), '/') AS target FROM p""")
def x13_resolve_path(spark: SparkSession, sf: str) -> DataFrame:
    """X-13: a relative reference from each file, two levels up."""
    up = F.concat(F.col("path"), F.lit("/./../../shared/index"))
    return load(spark, sf, "files").select("id", fn.resolve_path(up).alias("target")).distinct()


@query("""SELECT DISTINCT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS compact,
 CASE WHEN regexp_matches(lower(module), 'ies$') THEN regexp_replace(lower(module), 'ies$', 'y') WHEN regexp_matches(lower(module), '(s|x|ch|sh)es$') THEN regexp_replace(lower(module), 'es$', '')
 WHEN regexp_matches(lower(module), '[^s]s$') THEN regexp_replace(lower(module), 's$', '') ELSE lower(module) END AS singular,
 left(sha256(project_id || chr(31) || path), 16) AS short_id,
 CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', round(size / 1024, 1)) WHEN size IS NOT NULL THEN printf('%.1f MB', round(size / 1048576, 1)) END AS readable FROM files""")
def x15_names_and_ids(spark: SparkSession, sf: str) -> DataFrame:
    """X-05, X-15, X-16: readable sizes, compact and singular names, repeatable ids."""
    f = load(spark, sf, "files")
    return f.select("id", fn.compact(F.col("name")).alias("compact"), fn.singular(F.col("module")).alias("singular"), fn.short_hash(F.col("project_id"), F.col("path")).alias("short_id"), fn.format_bytes(F.col("size")).alias("readable")).distinct()


@query("""SELECT DISTINCT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
 regexp_replace(text, '([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\\.[A-Za-z]{2,})', '\\1***@\\2', 'g') AS masked FROM documents WHERE text IS NOT NULL""")
def x06_escape_and_mask(spark: SparkSession, sf: str) -> DataFrame:
    """X-06, X-21: HTML escaping and masked addresses."""
    t = F.col("text")
    return load(spark, sf, "documents").where("text is not null").select("doc_id", fn.escape_html(t).alias("html"), fn.mask_mail(t).alias("masked")).distinct()


@query("""SELECT DISTINCT id, created_at, CASE WHEN finished_at >= started_at THEN printf('%02d:%02d:%02d.%03d', (finished_at - started_at) // 3600000, (finished_at - started_at) // 60000 % 60, (finished_at - started_at) // 1000 % 60, (finished_at - started_at) % 1000) END AS took,
 json_extract_string(params, '$.voice') AS voice, strftime(make_timestamp(created_at * 1000), '%Y-%m-%d') AS day FROM video_jobs""")
def x28_stamps_and_json(spark: SparkSession, sf: str) -> DataFrame:
    """X-22, X-27, X-28: JSON fields, dates and stamps of jobs."""
    span = F.col("finished_at") - F.col("started_at")
    return load(spark, sf, "video_jobs").select("id", "created_at", F.when(span >= 0, fn.stamp(span)).alias("took"), F.get_json_object("params", "$.voice").alias("voice"), F.date_format(utc("created_at"), "yyyy-MM-dd").alias("day")).distinct()


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(4000000000000000 + l_orderkey * 10 + l_linenumber AS VARCHAR) AS digits FROM lineitem)
SELECT l_orderkey, l_linenumber, '**** ' || right(digits, 4) AS masked,
 (list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INT) WHEN CAST(digits[i] AS INT) * 2 > 9 THEN CAST(digits[i] AS INT) * 2 - 9 ELSE CAST(digits[i] AS INT) * 2 END)) % 10) = 0 AS valid FROM d""")
def x20_check_digits(spark: SparkSession, sf: str) -> DataFrame:
    """X-20, X-21: check digits and masked numbers."""
    digits = (F.lit(4000000000000000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.mask_card(digits).alias("masked"), fn.luhn(digits).alias("valid")).distinct()


QUERIES, ORACLES = query.queries, query.oracles
