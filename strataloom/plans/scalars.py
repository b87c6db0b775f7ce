"""Queries of scalar functions and of what source texts declare, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as fn
from strataloom.operators import symbols
from strataloom.plans.registry import Registry
from strataloom.tables import load

query = Registry()


def once(spark: SparkSession, sf: str, table: str = "files") -> DataFrame:
    """A table whose rows are delivered twice, each row once."""
    return load(spark, sf, table).dropDuplicates(["id"])


_FILES = "f AS (SELECT DISTINCT ON (id) * FROM files)"


@query(rf"""WITH {_FILES} SELECT id, replace(path, '|', '\|') AS cell, regexp_replace(path, '[^A-Za-z0-9_]', '_', 'g') AS node_id, replace(replace(name, '"', '#quot;'), chr(10), ' ') AS label,
CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(path, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT) AS hash31 FROM f WHERE path IS NOT NULL""")
def x18_escapes(spark: SparkSession, sf: str) -> DataFrame:
    """X-18: paths as table cells, diagram ids and labels, and their 32-bit string hash."""
    f = once(spark, sf).where("path is not null")
    label = F.replace(F.replace(F.col("name"), F.lit('"'), F.lit("#quot;")), F.lit("\n"), F.lit(" "))
    return f.select("id", fn.table_cell(F.col("path")).alias("cell"), fn.node_id(F.col("path")).alias("node_id"), label.alias("label"), fn.hash31(F.col("path")).alias("hash31"))


@query("SELECT c_custkey, '***-**-' || right(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 4) AS masked FROM customer")
def x21_mask_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """X-21: nine-digit numbers in groups with all but the last four digits masked."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    grouped = F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4))
    return load(spark, sf, "customer").select("c_custkey", fn.mask_grouped(grouped).alias("masked"))


@query("""SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS whole, round(ln(l_extendedprice + 1), 6) AS log, round(sqrt(l_quantity), 6) AS root, least(greatest(l_quantity, 10), 40) AS clamped, printf('%.2f', l_discount * 100) AS fixed FROM lineitem""")
def x23_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """X-23: floor, logarithm, root, clamp and fixed decimals."""
    c = F.col
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor("l_extendedprice").alias("whole"), F.round(F.log(c("l_extendedprice") + 1), 6).alias("log"), F.round(F.sqrt("l_quantity"), 6).alias("root"), fn.clamp(c("l_quantity"), 10.0, 40.0).alias("clamped"), F.format_string("%.2f", c("l_discount") * 100).alias("fixed")
    )


@query(f"""WITH {_FILES} SELECT id, array_to_string(list_slice(imports, 1, 2), ',') AS first_two, CAST(coalesce(list_position(imports, 'check/timer'), 0) AS BIGINT) AS at, list_contains(exports, 'applyProfileCue') AS has, CAST(len(list_distinct(list_transform(imports, lambda x: string_split(x, '/')[1]))) AS BIGINT) AS n_areas, array_to_string(list_sort(list_distinct(list_concat(imports, exports))), ',') AS all_names FROM f WHERE imports IS NOT NULL AND exports IS NOT NULL""")
def x24_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """X-24: slices, positions, membership, distinct and sorted elements of arrays."""
    f = once(spark, sf).where("imports is not null and exports is not null")
    areas = F.array_distinct(F.transform("imports", lambda x: F.split(x, "/")[0]))
    return f.select("id", F.array_join(F.slice("imports", 1, 2), ",").alias("first_two"), F.array_position("imports", "check/timer").alias("at"), F.array_contains("exports", "applyProfileCue").alias("has"), F.size(areas).cast("long").alias("n_areas"), F.array_join(F.array_sort(F.array_union("imports", "exports")), ",").alias("all_names"))


@query(f"""WITH {_FILES}, s AS (SELECT project_id, language, sum(size) AS bytes FROM f WHERE language IS NOT NULL AND size IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY bytes DESC, language) AS n FROM s)
SELECT project_id, string_agg(language || '=' || CAST(CAST(bytes AS BIGINT) AS VARCHAR), ', ' ORDER BY n) AS top FROM r WHERE n <= 4 GROUP BY project_id""")
def x25_top_entries(spark: SparkSession, sf: str) -> DataFrame:
    """X-25: the four largest entries of each project's map of bytes per language (the cut is the feature)."""
    summed = once(spark, sf).where("language is not null and size is not null").groupBy("project_id", "language").agg(F.sum("size").alias("bytes"))
    entries = F.map_entries(F.map_from_entries(F.collect_list(F.struct("language", "bytes"))))  # one entry per language
    ordered = F.array_sort(F.transform("e", lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("language"))))
    top = F.transform(F.slice(ordered, 1, 4), lambda e: F.concat_ws("=", e["language"], (-e["minus"]).cast("string")))
    return summed.groupBy("project_id").agg(entries.alias("e")).select("project_id", F.array_join(top, ", ").alias("top"))


@query(f"""WITH {_FILES} SELECT id, rpad(name, 24, '.') AS padded, lpad(extension, 6, ' ') AS right_bound, repeat('-', CAST(length(name) AS INTEGER)) AS rule, CAST(length(path) - length(regexp_extract(path, '[^/]*$')) AS BIGINT) AS last_slash, lower(regexp_replace(regexp_replace(regexp_extract(name, '^[^.]*'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g')) AS spoken FROM f WHERE name IS NOT NULL AND path IS NOT NULL""")
def x26_strings(spark: SparkSession, sf: str) -> DataFrame:
    """X-26: padding, rules, the last slash, names as words."""
    stem = F.regexp_extract("name", "^[^.]*", 0)
    return once(spark, sf).where("name is not null and path is not null").select(
        "id", F.rpad("name", 24, ".").alias("padded"), F.lpad("extension", 6, " ").alias("right_bound"), F.expr("repeat('-', length(name))").alias("rule"), (F.length("path") - F.length(F.regexp_extract("path", "[^/]*$", 0))).cast("long").alias("last_slash"), fn.spoken(stem).alias("spoken")
    )


@query("""SELECT DISTINCT id, strftime(make_timestamp(created_at * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(created_at * 1000), '%H:%M:%S') AS clock, CAST((coalesce(finished_at, created_at) - created_at) // 1000 AS BIGINT) AS seconds FROM video_jobs WHERE created_at IS NOT NULL""")
def x27_dates(spark: SparkSession, sf: str) -> DataFrame:
    """X-27: day and time of epoch milliseconds, and whole seconds between two."""
    at = F.timestamp_millis("created_at")
    return load(spark, sf, "video_jobs").where("created_at is not null").select("id", F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "HH:mm:ss").alias("clock"), F.floor((F.coalesce("finished_at", "created_at") - F.col("created_at")) / 1000).alias("seconds")).distinct()


@query(r"""WITH d AS (SELECT DISTINCT id, what_happens || ' ' || coalesce(file_path, '') || ':' || coalesce(CAST(start_line AS VARCHAR), '') || '-' || coalesce(CAST(end_line AS VARCHAR), '') AS t FROM findings WHERE what_happens IS NOT NULL), c AS (SELECT id, unnest(regexp_extract_all(t, '[\w./-]+\.[a-z]{1,4}:\d+(?:-\d+)?')) AS cite FROM d)
SELECT id, regexp_extract(cite, '^(.*):\d', 1) AS path, CAST(regexp_extract(cite, ':(\d+)', 1) AS BIGINT) AS line, CAST(coalesce(nullif(regexp_extract(cite, '-(\d+)$', 1), ''), regexp_extract(cite, ':(\d+)', 1)) AS BIGINT) AS last_line FROM c""")
def x36_citations(spark: SparkSession, sf: str) -> DataFrame:
    """X-36: citations path:line or path:line-line in texts."""
    places = F.concat(F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("")))
    texts = load(spark, sf, "findings").where("what_happens is not null").select("id", F.concat_ws(" ", "what_happens", places).alias("t")).distinct()
    cited = texts.select("id", F.explode(F.regexp_extract_all("t", F.lit(r"[\w./-]+\.[a-z]{1,4}:\d+(?:-\d+)?"), F.lit(0))).alias("cite"))
    return cited.select("id", fn.cited_path(F.col("cite")).alias("path"), fn.cited_lines(F.col("cite"))[0].alias("line"), fn.cited_lines(F.col("cite"))[1].alias("last_line"))


_ATOMS = r"\d+(?:\.\d+)?|[a-z]+(?:_[a-z]+)+|[a-z]+(?:[A-Z][a-z]+)+|`[^`]+`"


@query(rf"""WITH d AS (SELECT DISTINCT id, list_distinct(regexp_extract_all(coalesce(remediation, ''), '{_ATOMS}')) AS a, list_distinct(regexp_extract_all(concat_ws(' ', title, what_happens), '{_ATOMS}')) AS b FROM findings)
SELECT id, CAST(len(a) AS BIGINT) AS atoms, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS ungrounded FROM d""")
def x35_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """X-35: numbers, identifiers and quoted words of a remediation that the finding itself does not name."""
    atoms = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(_ATOMS), F.lit(0)))
    d = load(spark, sf, "findings").select("id", atoms(F.coalesce("remediation", F.lit(""))).alias("a"), atoms(F.concat_ws(" ", "title", "what_happens")).alias("b"))
    return d.select("id", F.size("a").cast("long").alias("atoms"), F.size(F.array_except("a", "b")).cast("long").alias("ungrounded")).distinct()


@query(f"""WITH {_FILES}, e AS (SELECT DISTINCT unnest(list_concat(imports, exports)) AS name FROM f) SELECT name, CASE WHEN regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') THEN '"' || name || '"' END AS quoted FROM e WHERE name IS NOT NULL""")
def x39_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """X-39: names that are plain identifiers, quoted; null for all others."""
    names = once(spark, sf).select(F.explode(F.concat("imports", "exports")).alias("name")).where("name is not null").distinct()
    return names.select("name", fn.identifier(F.col("name")).alias("quoted"))


@query("""WITH b AS (SELECT hash, content, instr(content, 'return ') AS place FROM blobs) SELECT hash, CAST(place AS BIGINT) AS place, CAST(length(left(content, place - 1)) - length(replace(left(content, place - 1), chr(10), '')) + 1 AS BIGINT) AS line_no FROM b WHERE place > 0""")
def x31_line_of(spark: SparkSession, sf: str) -> DataFrame:
    """X-31: the line of a character's place."""
    at = F.instr("content", "return ")
    return load(spark, sf, "blobs").withColumn("place", at.cast("long")).where("place > 0").select("hash", "place", fn.line_of(F.col("content"), F.col("place").cast("int")).alias("line_no"))


# --- what sources declare ------------------------------------------------------------------------------------------


def contents(spark: SparkSession, sf: str, *languages: str) -> DataFrame:
    """(id, language, content) of the different contents of some languages."""
    f = load(spark, sf, "files").where(F.col("language").isin(*languages) & F.col("hash").isNotNull()).select("hash", "language").distinct()
    return f.join(load(spark, sf, "blobs"), "hash").select(F.col("hash").alias("id"), "language", "content")


def _contents(*languages: str) -> str:
    names = ", ".join(f"'{x}'" for x in languages)
    return f"""c AS (SELECT DISTINCT f.hash AS id, f.language, b.content FROM files f JOIN blobs b USING (hash) WHERE f.language IN ({names})),
l AS (SELECT id, language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM c)"""


_SCRIPT = r"^(export )?(?:default )?(?:declare )?(?:abstract )?(?:async )?(function\*?|class|interface|type|enum|const|let|var) ([A-Za-z_$][A-Za-z0-9_$]*)"


@query(rf"""WITH {_contents("TypeScript", "JavaScript")} SELECT id, CAST(line_no AS BIGINT) AS line_no, rtrim(regexp_extract(line, '{_SCRIPT}', 2), '*') AS kind, regexp_extract(line, '{_SCRIPT}', 3) AS name, starts_with(line, 'export ') AS exported FROM l WHERE regexp_matches(line, '{_SCRIPT}')""")
def e02_script_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """E-02, E-10: top-level symbols of TypeScript and JavaScript contents (by their declarations' lines)."""
    found = symbols.declared(contents(spark, sf, "TypeScript", "JavaScript"), symbols.SCRIPT, kind=2, name=3)
    return found.withColumn("kind", F.rtrim(F.col("kind"), F.lit("*"))).withColumn("exported", F.startswith("line", F.lit("export "))).select("id", "line_no", "kind", "name", "exported")


_FROM = r"^(?:import|export) .*from [\"'']([^\"'']+)[\"'']|^import [\"'']([^\"'']+)[\"'']|require\([\"'']([^\"'']+)[\"'']\)"


@query(rf"""WITH {_contents("TypeScript", "JavaScript")} SELECT id, CAST(line_no AS BIGINT) AS line_no, coalesce(nullif(regexp_extract(line, '{_FROM}', 1), ''), nullif(regexp_extract(line, '{_FROM}', 2), ''), regexp_extract(line, '{_FROM}', 3)) AS specifier FROM l WHERE regexp_matches(line, '{_FROM}')""")
def e02_script_imports(spark: SparkSession, sf: str) -> DataFrame:
    """E-02: the module names that TypeScript and JavaScript contents import, re-export or require."""
    return symbols.imported(contents(spark, sf, "TypeScript", "JavaScript"))


_GO = r"^func (?:\([A-Za-z_]\w* \*?([A-Za-z_]\w*)\) )?([A-Za-z_]\w*)\("


@query(rf"""WITH {_contents("Go")} SELECT id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN regexp_extract(line, '{_GO}', 1) = '' THEN 'function' ELSE 'method' END AS kind, regexp_extract(line, '{_GO}', 2) AS name, nullif(regexp_extract(line, '{_GO}', 1), '') AS receiver FROM l WHERE regexp_matches(line, '{_GO}')
UNION ALL SELECT id, CAST(line_no AS BIGINT), regexp_extract(line, '^type (\w+) (\w+)', 2), regexp_extract(line, '^type (\w+) (\w+)', 1), NULL FROM l WHERE regexp_matches(line, '^type \w+ \w+')""")
def e04_go_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """E-04: functions, methods and types of Go contents."""
    return symbols.go_symbols(contents(spark, sf, "Go"))


@query(rf"""WITH {_contents("YAML", "Dotenv")} SELECT id, CAST(line_no AS BIGINT) AS line_no, regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_.-]*)\s*[:=]', 1) AS name FROM l WHERE regexp_matches(line, '^[A-Za-z_][A-Za-z0-9_.-]*\s*[:=]')""")
def e16_config_keys(spark: SparkSession, sf: str) -> DataFrame:
    """E-16: top-level keys of YAML and environment files."""
    return symbols.config_keys(contents(spark, sf, "YAML", "Dotenv"))


_GENERIC = r"^\s*(?:export |public |pub |static |async )*(class|struct|interface|trait|function|def|func|fn|sub) +([A-Za-z_]\w*)"


@query(rf"""WITH {_contents("TypeScript", "JavaScript", "Python", "Go")} SELECT id, language, CAST(line_no AS BIGINT) AS line_no, regexp_extract(line, '{_GENERIC}', 1) AS kind, regexp_extract(line, '{_GENERIC}', 2) AS name FROM l WHERE regexp_matches(line, '{_GENERIC}')""")
def e17_generic_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """E-17: what any language's usual words declare, for texts without an extractor of their own."""
    return symbols.declared(contents(spark, sf, "TypeScript", "JavaScript", "Python", "Go"), symbols.GENERIC, kind=1, name=2).select("id", "language", "line_no", "kind", "name")


_BRANCH = r"\b(?:if|for|while|case|catch|elif|except)\b|&&|\|\|"


@query(rf"""WITH {_contents("TypeScript", "JavaScript", "Go", "Python").split("l AS")[0].rstrip(", " + chr(10))} SELECT id, language, CAST(1 + len(regexp_extract_all(content, '{_BRANCH}')) AS BIGINT) AS complexity FROM c""")
def e11_complexity(spark: SparkSession, sf: str) -> DataFrame:
    """E-11: one plus the branches of each content, by its words (an approximation where no parser is at hand)."""
    return contents(spark, sf, "TypeScript", "JavaScript", "Go", "Python").select("id", "language", symbols.complexity(F.col("content")).alias("complexity"))


_FIELD = r"(?m)^\s+(\w+)(\??): ([\w<>\[\]]+);"


@query(rf"""WITH {_contents("TypeScript").split("l AS")[0].rstrip(", " + chr(10))}, m AS (SELECT id, unnest(regexp_extract_all(content, '{_FIELD}')) AS m FROM c), p AS (SELECT id, regexp_extract(m, '(\w+)\??: ', 1) AS field, contains(m, '?:') AS optional, regexp_extract(m, ': ([\w<>\[\]]+);', 1) AS type FROM m)
SELECT id, field, type, CASE WHEN type LIKE '%[]' OR type LIKE 'Array<%' THEN 'many' WHEN optional THEN 'optional' ELSE 'one' END AS cardinality, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL""")
def x37_typed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """X-37: typed fields of TypeScript contents and how many values they hold."""
    found = symbols.typed_fields(contents(spark, sf, "TypeScript"))
    return found.groupBy("id", "field", "type", "cardinality").agg(F.count("*").alias("n"))


@query(r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '\]\(([^)\s]+)\)', 1)) AS target FROM documents) SELECT doc_id, target, CAST(count(*) AS BIGINT) AS n FROM d WHERE NOT regexp_matches(target, '^(https?:|mailto:|#)') GROUP BY ALL
UNION ALL SELECT doc_id, p AS target, CAST(count(*) AS BIGINT) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\w-]+/[\w./-]+\.(?:ts|js|py|go|md|yml|sql)')) AS p FROM documents) GROUP BY ALL""")
def e15_links(spark: SparkSession, sf: str) -> DataFrame:
    """E-15: relative links and paths that documents name."""
    docs = load(spark, sf, "documents")
    links = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))).alias("target")).where(~F.col("target").rlike("^(https?:|mailto:|#)"))
    paths = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\w-]+/[\w./-]+\.(?:ts|js|py|go|md|yml|sql)"), F.lit(0))).alias("target"))
    counted = lambda d: d.groupBy("doc_id", "target").agg(F.count("*").alias("n"))
    return counted(links).unionByName(counted(paths))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#+) ', 1)) AS level FROM l WHERE regexp_matches(line, '^#{1,6} '))
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST((SELECT max(p.line_no) FROM h p WHERE p.doc_id = h.doc_id AND p.line_no < h.line_no AND p.level < h.level AND NOT EXISTS (SELECT 1 FROM h q WHERE q.doc_id = h.doc_id AND q.line_no > p.line_no AND q.line_no < h.line_no AND q.level <= p.level)) AS BIGINT) AS parent_line FROM h""")
def e15_nesting(spark: SparkSession, sf: str) -> DataFrame:
    """E-15: the heading that each heading of a document stands under."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return symbols.nested(docs).withColumnRenamed("id", "doc_id")


QUERIES, ORACLES = query.queries, query.oracles
