"""Queries of filters, joins, aggregations, windows, sorts and set operations, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.times import micros
from strataloom.operators import relational as op
from strataloom.plans.registry import Registry
from strataloom.sources import sinks
from strataloom.tables import load

query = Registry()
SEVERITIES = ("Critical", "High", "Medium", "Low", "Informational")


def severity(c: str = "severity") -> F.Column:
    """One spelling of a severity."""
    return F.initcap(F.lower(F.trim(F.col(c))))


def rank_of(c: str = "severity") -> F.Column:
    """0 for Critical to 4; -1 for anything else."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(c)), F.lit(0)) - 1


def live(spark: SparkSession, sf: str) -> DataFrame:
    """Findings once each, severities spelled one way, rejected ones hidden."""
    return load(spark, sf, "findings").dropDuplicates(["id"]).where("verification is null or verification <> 'rejected'").withColumn("severity", severity())


_SEV = "upper(left(trim(severity), 1)) || lower(substr(trim(severity), 2))"
_RANK = "coalesce(list_position(['Critical','High','Medium','Low','Informational'], severity), 0) - 1"
_LIVE = f"live AS (SELECT DISTINCT ON (id) * REPLACE ({_SEV} AS severity) FROM findings WHERE verification IS NULL OR verification <> 'rejected')"
_FILES = "f AS (SELECT DISTINCT ON (id) * FROM files)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "files").dropDuplicates(["id"])


# --- filters and sorts ---------------------------------------------------------------------------------------------


@query(f"""WITH {_LIVE} SELECT id, severity, category, file_path FROM live
WHERE severity IN ('Critical', 'High') AND contains(lower(coalesce(title, '') || ' ' || coalesce(file_path, '')), 'cache')""")
def f02_find(spark: SparkSession, sf: str) -> DataFrame:
    """F-01 to F-04: IN lists, inequality and a case-insensitive search over several columns."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("file_path", F.lit(""))))
    return live(spark, sf).where(F.col("severity").isin("Critical", "High") & F.contains(hay, F.lit("cache"))).select("id", "severity", "category", "file_path")


@query(f"WITH {_LIVE} SELECT id, severity, code FROM live ORDER BY {_RANK}, code, id LIMIT 200 OFFSET 100")
def o01_page(spark: SparkSession, sf: str) -> DataFrame:
    """O-01: a page of findings by severity and code (the limit is the feature)."""
    return live(spark, sf).orderBy(rank_of(), "code", "id").offset(100).limit(200).select("id", "severity", "code")


_CLASSES = [(r"(^|/)(node_modules|vendor|third[_-]?party|bower_components)/", "vendor"), (r"(^|/)(tests?|__tests__|e2e)/|[._](test|spec)\.[a-z]+$|_test\.(go|py)$|(^|/)test_[^/]+\.py$", "test"), (r"\.(min|generated|gen|pb)\.[a-z]+$|_pb2(_grpc)?\.py$", "generated"), (r"\.(md|mdx|rst|txt)$", "docs"), (r"\.(json|ya?ml|toml|ini|env)$|(^|/)\.env$", "config"), (r"\.sql$", "schema"), (r"\.(png|svg|pdf|jpg|gif|ico)$", "asset"), (r"\.(ts|tsx|mts|js|jsx|mjs|py|go)$", "source")]


@query("SELECT DISTINCT id, CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{c}'" for p, c in _CLASSES) + " ELSE 'other' END AS class FROM files")
def f09_classify_paths(spark: SparkSession, sf: str) -> DataFrame:
    """F-08, F-09: the first matching pattern classifies a path."""
    from strataloom.functions.text import cascade

    return load(spark, sf, "files").select("id", cascade(F.col("path"), _CLASSES, "other").alias("class")).distinct()


# --- aggregations --------------------------------------------------------------------------------------------------


@query(f"WITH {_FILES} SELECT project_id, language, CAST(count(*) AS BIGINT) AS n, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM f GROUP BY ALL")
def a01_languages(spark: SparkSession, sf: str) -> DataFrame:
    """A-01: files and bytes per project and language."""
    return files(spark, sf).groupBy("project_id", "language").agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


_FACETS = ["severity", "category", "confidence", "origin", "verification", "area"]


@query(f"WITH {_LIVE} " + " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM live WHERE {c} IS NOT NULL GROUP BY {c}" for c in _FACETS))
def a02_facets(spark: SparkSession, sf: str) -> DataFrame:
    """A-02: counts of six columns in one pass."""
    return op.facets(live(spark, sf), _FACETS)


@query(f"""WITH {_LIVE}, {_FILES}, a AS (SELECT project_id, area, role, count(*) AS n FROM f WHERE area IS NOT NULL AND role IS NOT NULL GROUP BY ALL)
SELECT project_id, area, role, n FROM a QUALIFY row_number() OVER (PARTITION BY project_id, area ORDER BY n DESC, role) = 1""")
def a05_area_role(spark: SparkSession, sf: str) -> DataFrame:
    """A-05: the most common role of each area, ties by name."""
    return op.mode_by(files(spark, sf).where("area is not null and role is not null"), ["project_id", "area"], "role")


@query(f"WITH {_LIVE} SELECT project_id, file_path, CAST(min({_RANK}) AS BIGINT) AS worst, CAST(count(*) AS BIGINT) AS n FROM live WHERE file_path IS NOT NULL GROUP BY ALL")
def a06_worst_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """A-06: the worst severity of each file."""
    return live(spark, sf).where("file_path is not null").groupBy("project_id", "file_path").agg(F.min(rank_of()).cast("long").alias("worst"), F.count("*").alias("n"))


@query(f"""WITH {_FILES}, e AS (SELECT project_id, role, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) AS dir FROM f),
c AS (SELECT project_id, dir, role, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY project_id, dir) AS total FROM c)
SELECT project_id, dir, CAST(any_value(total) AS BIGINT) AS n_files, max(CASE WHEN n >= 0.7 * total THEN role END) AS dominant FROM r GROUP BY project_id, dir""")
def a09_directories(spark: SparkSession, sf: str) -> DataFrame:
    """A-09: every directory counts the files below it; a role of 70 % or more dominates."""
    e = files(spark, sf).select("project_id", "role", F.explode(op.ancestors(F.col("path"))).alias("dir"))
    r = e.groupBy("project_id", "dir", "role").agg(F.count("*").alias("n"))
    r = r.withColumn("total", F.sum("n").over(Window.partitionBy("project_id", "dir")))  # at most as many rows as roles
    return r.groupBy("project_id", "dir").agg(F.max("total").alias("n_files"), F.max(F.when(F.col("n") >= 0.7 * F.col("total"), F.col("role"))).alias("dominant"))


@query(f"""WITH {_FILES}, {_LIVE} SELECT f.project_id, f.area, CAST(count(*) AS BIGINT) AS n_files, CAST(count(*) FILTER (WHERE is_test) AS BIGINT) AS n_tests,
 CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM live l WHERE l.project_id = f.project_id AND l.file_path = f.path)) AS BIGINT) AS n_flagged FROM f WHERE area IS NOT NULL GROUP BY ALL""")
def a10_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A-10, J-11: tests and flagged files per area (semi-join membership)."""
    flagged = live(spark, sf).where("file_path is not null").select("project_id", F.col("file_path").alias("path")).distinct().withColumn("hit", F.lit(1))
    f = files(spark, sf).where("area is not null").join(flagged, ["project_id", "path"], "left")
    return f.groupBy("project_id", "area").agg(F.count("*").alias("n_files"), F.count_if("is_test").alias("n_tests"), F.count("hit").alias("n_flagged"))


@query(f"""WITH {_FILES} SELECT project_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE is_test) AS BIGINT) AS tests, CAST(count(*) FILTER (WHERE is_binary) AS BIGINT) AS binaries,
 CAST(count(*) FILTER (WHERE is_vendor) AS BIGINT) AS vendored, CAST(count(*) FILTER (WHERE is_generated) AS BIGINT) AS generated, CAST(count(*) FILTER (WHERE is_excluded) AS BIGINT) AS excluded,
 CAST(count(*) FILTER (WHERE is_large) AS BIGINT) AS large, CAST(count(*) FILTER (WHERE has_content) AS BIGINT) AS readable FROM f GROUP BY ALL""")
def a16_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """A-16: eight conditional counts per project."""
    flags = {"tests": "is_test", "binaries": "is_binary", "vendored": "is_vendor", "generated": "is_generated", "excluded": "is_excluded", "large": "is_large", "readable": "has_content"}
    return files(spark, sf).groupBy("project_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in flags.items()])


@query(f"WITH {_FILES} SELECT project_id, sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path || ':' || hash)) AS source_hash FROM f WHERE hash IS NOT NULL GROUP BY project_id")
def a19_source_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A-19: one hash of a project's paths and contents in order (its own paths come together, as the hash demands)."""
    f = files(spark, sf).where("hash is not null")
    return f.groupBy("project_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "hash"))), "\n"), 256).alias("source_hash"))


@query(f"""WITH {_LIVE}, g AS (SELECT project_id, coalesce(analyzer, title) AS k, severity, code FROM live)
SELECT project_id, k AS group_key, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE severity WHEN 'Critical' THEN 10 WHEN 'High' THEN 5 WHEN 'Medium' THEN 2 ELSE 1 END) AS BIGINT) AS weight, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes FROM g GROUP BY ALL""")
def a22_plan_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A-21, A-22: weighted groups with their codes."""
    weight = F.when(F.col("severity") == "Critical", 10).when(F.col("severity") == "High", 5).when(F.col("severity") == "Medium", 2).otherwise(1)
    g = live(spark, sf).groupBy("project_id", F.coalesce("analyzer", "title").alias("group_key"))
    return g.agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


@query(f"""WITH {_FILES}, t AS (SELECT project_id, language, sum(coalesce(size, 0)) AS bytes FROM f WHERE language IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY bytes DESC, language) AS n, sum(bytes) OVER (PARTITION BY project_id) AS total FROM t)
SELECT project_id, language, round(CAST(bytes AS DOUBLE) / total, 6) AS share FROM r WHERE n <= 5 AND total > 0 UNION ALL SELECT project_id, 'Other', round(CAST(sum(bytes) AS DOUBLE) / any_value(total), 6) FROM r WHERE n > 5 AND total > 0 GROUP BY project_id HAVING sum(bytes) > 0.005 * any_value(total)""")
def b20_language_share(spark: SparkSession, sf: str) -> DataFrame:
    """B-20: the five largest languages of a project and the rest."""
    t = files(spark, sf).where("language is not null").groupBy("project_id", "language").agg(F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    own = Window.partitionBy("project_id")
    r = t.select("*", F.row_number().over(own.orderBy(F.desc("bytes"), "language")).alias("n"), F.sum("bytes").over(own).alias("total")).where("total > 0")
    rest = r.where("n > 5").groupBy("project_id").agg(F.sum("bytes").alias("bytes"), F.max("total").alias("total")).where("bytes > 0.005 * total").withColumn("language", F.lit("Other"))
    return r.where("n <= 5").select("project_id", "language", "bytes", "total").unionByName(rest).select("project_id", "language", F.round(F.col("bytes") / F.col("total"), 6).alias("share"))


@query(f"""WITH {_LIVE}, a AS (SELECT project_id, path, any_value(area) AS area FROM files GROUP BY ALL)
SELECT coalesce(a.area, 'Across the system') AS area, severity, CAST(count(*) AS BIGINT) AS n FROM live l LEFT JOIN (SELECT project_id, path, min(area) AS area FROM files GROUP BY ALL) a ON a.project_id = l.project_id AND a.path = l.file_path GROUP BY 1, 2""")
def b17_severity_by_area(spark: SparkSession, sf: str) -> DataFrame:
    """B-17: severities per area; findings without a mapped file count for the whole."""
    area = load(spark, sf, "files").groupBy("project_id", F.col("path").alias("file_path")).agg(F.min("area").alias("own_area"))
    joined = live(spark, sf).join(area, ["project_id", "file_path"], "left")
    return joined.groupBy(F.coalesce("own_area", F.lit("Across the system")).alias("area"), "severity").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(l_returnflag, '') AS l_returnflag, coalesce(l_linestatus, '') AS l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def a25_cube(spark: SparkSession, sf: str) -> DataFrame:
    """An addition: CUBE over two columns."""
    c = load(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return c.na.fill("", ["l_returnflag", "l_linestatus"])


# --- joins ---------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT 'file' AS kind, id, path AS label FROM files UNION SELECT 'finding', id, title FROM findings UNION SELECT 'job', id, kind FROM video_jobs),
r AS (SELECT DISTINCT 'job' AS kind, id, 'explanation' AS to_kind, explanation_id AS to_id FROM video_jobs UNION ALL SELECT DISTINCT 'finding', id, 'file', project_id || '/' || file_path FROM findings WHERE file_path IS NOT NULL),
n AS (SELECT 'file' AS to_kind, project_id || '/' || path AS to_id, min(area) AS place FROM files GROUP BY 1, 2 UNION ALL SELECT 'explanation', id, min(title) FROM explanations GROUP BY 1, 2)
SELECT r.kind, r.id, r.to_kind, r.to_id, n.place FROM r LEFT JOIN n USING (to_kind, to_id)""")
def j02_typed_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """J-01, J-02: references to records of several kinds, resolved against one table of typed nodes."""
    key = F.concat_ws("/", "project_id", "file_path")
    refs = load(spark, sf, "video_jobs").select(F.lit("job").alias("kind"), "id", F.lit("explanation").alias("to_kind"), F.col("explanation_id").alias("to_id")).distinct()
    refs = refs.unionByName(load(spark, sf, "findings").where("file_path is not null").select(F.lit("finding").alias("kind"), "id", F.lit("file").alias("to_kind"), key.alias("to_id")).distinct())
    nodes = load(spark, sf, "files").groupBy(F.lit("file").alias("to_kind"), F.concat_ws("/", "project_id", "path").alias("to_id")).agg(F.min("area").alias("place"))
    nodes = nodes.unionByName(load(spark, sf, "explanations").groupBy(F.lit("explanation").alias("to_kind"), F.col("id").alias("to_id")).agg(F.min("title").alias("place")))
    return refs.join(nodes, ["to_kind", "to_id"], "left").select("kind", "id", "to_kind", "to_id", "place")


@query("""WITH p AS (SELECT DISTINCT id, project_id, file_path, start_line, end_line FROM findings WHERE file_path IS NOT NULL AND start_line IS NOT NULL),
s AS (SELECT DISTINCT id AS span_id, project_id, file_path, start_line AS span_start, end_line AS span_end FROM findings WHERE file_path IS NOT NULL AND end_line > start_line)
SELECT p.id, (SELECT s.span_id FROM s WHERE s.project_id = p.project_id AND s.file_path = p.file_path AND s.span_start <= p.start_line AND s.span_end >= p.end_line AND s.span_id <> p.id ORDER BY span_end - span_start, span_start, span_id LIMIT 1) AS span_id FROM p""")
def j05_smallest_enclosing(spark: SparkSession, sf: str) -> DataFrame:
    """J-05: the innermost other span around each finding's lines."""
    base = load(spark, sf, "findings").where("file_path is not null and start_line is not null").select("id", "project_id", "file_path", "start_line", "end_line").distinct()
    spans = base.where("end_line > start_line").select("project_id", "file_path", F.col("id").alias("span_id"), F.col("start_line").alias("span_start"), F.col("end_line").alias("span_end"))
    met = op.smallest_enclosing(base, spans, ["project_id", "file_path"], "id", own="span_id")
    return met.select("id", "span_id")


@query("""WITH p AS (SELECT DISTINCT id, project_id, file_path, start_line, end_line FROM findings WHERE file_path IS NOT NULL AND start_line IS NOT NULL)
SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.project_id = b.project_id AND a.file_path = b.file_path AND a.id < b.id AND a.start_line <= b.end_line + 5 AND a.end_line >= b.start_line - 5""")
def j13_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """J-13: findings of one file whose lines overlap or nearly do.

    Met on blocks of lines, so a file of very many findings is not paired with itself as a whole.
    """
    p = load(spark, sf, "findings").where("file_path is not null and start_line is not null").select("id", "project_id", "file_path", "start_line", "end_line").distinct()
    blocks = p.withColumn("block", F.explode(F.sequence(F.floor((F.col("start_line") - 5) / 64), F.floor((F.col("end_line") + 5) / 64))))
    a, b = blocks.alias("a"), blocks.alias("b")
    on = (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.file_path") == F.col("b.file_path")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id"))
    near = (F.col("a.start_line") <= F.col("b.end_line") + 5) & (F.col("a.end_line") >= F.col("b.start_line") - 5)
    return a.join(b, on & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


@query("""WITH e AS (SELECT DISTINCT project_id, path, project_id || '/' || path AS own, unnest(exports) AS name FROM files WHERE path IS NOT NULL AND project_id IS NOT NULL), m AS (SELECT u.own, u.name, t.own AS target, CASE WHEN t.project_id = u.project_id THEN 1 WHEN t.path = u.path THEN 2 ELSE 3 END AS tier FROM e u JOIN e t ON t.name = u.name AND t.own <> u.own)
SELECT own, name, arg_min(target, struct_pack(a := tier, b := target)) AS target, CAST(min(tier) AS BIGINT) AS tier FROM m GROUP BY own, name""")
def j06_resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    """J-03, J-06, J-15: the other file that also has a name: of the same project, else of the same path, else any."""
    e = load(spark, sf, "files").where("path is not null and project_id is not null").select("project_id", "path", F.concat_ws("/", "project_id", "path").alias("own"), F.explode("exports").alias("name")).distinct()
    return op.resolved(e, "own", [["project_id", "name"], ["path", "name"], ["name"]]).select("own", "name", "target", F.col("tier").cast("long").alias("tier"))


@query("""WITH f AS (SELECT project_id, path, max(lines) AS lines FROM files GROUP BY ALL), c AS (SELECT DISTINCT id, project_id, file_path, start_line, end_line FROM findings)
SELECT c.id, f.path IS NOT NULL AS file_exists, coalesce(start_line BETWEEN 1 AND f.lines, FALSE) AS line_exists, least(end_line, f.lines) AS end_clamped FROM c LEFT JOIN f ON f.project_id = c.project_id AND f.path = c.file_path""")
def j18_check_citations(spark: SparkSession, sf: str) -> DataFrame:
    """J-18: whether a cited file and line exist, the end clamped to the file."""
    f = load(spark, sf, "files").groupBy("project_id", F.col("path").alias("file_path")).agg(F.max("lines").alias("lines"), F.lit(True).alias("there"))
    c = load(spark, sf, "findings").select("id", "project_id", "file_path", "start_line", "end_line").distinct()
    end = F.when(F.col("end_line").isNull() | F.col("lines").isNull(), F.coalesce("end_line", "lines").cast("long")).otherwise(F.least(F.col("end_line").cast("long"), "lines"))
    return c.join(f, ["project_id", "file_path"], "left").select("id", F.coalesce("there", F.lit(False)).alias("file_exists"), F.coalesce(F.col("start_line").between(1, F.col("lines")), F.lit(False)).alias("line_exists"), end.alias("end_clamped"))


@query("""WITH a AS (SELECT project_id, path, min(area) AS area FROM files WHERE area IS NOT NULL GROUP BY ALL), c AS (SELECT DISTINCT project_id, path, duplicate_of FROM files WHERE duplicate_of <> '')
SELECT s.area AS from_area, t.area AS to_area, CAST(count(*) AS BIGINT) AS weight FROM c JOIN a s ON s.project_id = c.project_id AND s.path = c.path JOIN a t ON t.project_id = c.project_id AND t.path = c.duplicate_of GROUP BY ALL""")
def j19_area_links(spark: SparkSession, sf: str) -> DataFrame:
    """J-19, A-07, G-08: links between areas through files, both ends looked up."""
    a = load(spark, sf, "files").where("area is not null").groupBy("project_id", "path").agg(F.min("area").alias("area"))
    c = load(spark, sf, "files").where("duplicate_of <> ''").select("project_id", "path", "duplicate_of").distinct()
    j = c.join(a.withColumnRenamed("area", "from_area"), ["project_id", "path"]).join(a.select("project_id", F.col("path").alias("duplicate_of"), F.col("area").alias("to_area")), ["project_id", "duplicate_of"])
    return j.groupBy("from_area", "to_area").agg(F.count("*").alias("weight"))


# --- windows -------------------------------------------------------------------------------------------------------


@query(f"""WITH {_LIVE} SELECT id, upper(left(category, 3)) || '-' || lpad(CAST(row_number() OVER (PARTITION BY project_id, category ORDER BY {_RANK}, file_path NULLS FIRST, start_line NULLS FIRST, id) AS VARCHAR), 4, '0') AS code FROM live""")
def w03_codes(spark: SparkSession, sf: str) -> DataFrame:
    """W-03: codes numbered within project and category."""
    w = Window.partitionBy("project_id", "category").orderBy(rank_of(), F.asc_nulls_first("file_path"), F.asc_nulls_first("start_line"), "id")
    return live(spark, sf).select("id", F.concat(F.upper(F.left("category", F.lit(3))), F.lit("-"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")).alias("code"))


@query(f"WITH {_LIVE} SELECT project_id, id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {_RANK}, id) AS BIGINT) AS rank FROM live QUALIFY rank <= 5")
def w04_top_per_project(spark: SparkSession, sf: str) -> DataFrame:
    """W-01, W-02, W-04: the five worst findings of each project (top-k is the feature)."""
    return op.top_k(live(spark, sf), ["project_id"], [rank_of(), "id"], 5).select("project_id", "id", F.col("rank").cast("long").alias("rank"))


@query("""WITH l AS (SELECT hash, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM (SELECT DISTINCT hash, content FROM blobs WHERE content IS NOT NULL)),
w AS (SELECT hash, n, line, lag(line) OVER (PARTITION BY hash ORDER BY n) AS before, lead(line) OVER (PARTITION BY hash ORDER BY n) AS after FROM l)
SELECT hash, n AS line_no, concat_ws(chr(10), before, line, after) AS evidence FROM w WHERE regexp_matches(line, 'console\\.warn\\(|except \\w+:')""")
def w05_line_context(spark: SparkSession, sf: str) -> DataFrame:
    """W-05, W-06: matching lines with the line before and after, without exploding other texts."""
    b = load(spark, sf, "blobs").where("content is not null").where(F.col("content").rlike(r"console\.warn\(|except \w+:")).select("hash", F.split("content", "\n", -1).alias("ls")).dropDuplicates(["hash"])
    x = b.select("hash", "ls", F.posexplode("ls").alias("pos", "line")).where(F.col("line").rlike(r"console\.warn\(|except \w+:"))
    return x.select("hash", (F.col("pos") + 1).cast("long").alias("line_no"), F.concat_ws("\n", F.get("ls", F.col("pos") - 1), "line", F.get("ls", F.col("pos") + 1)).alias("evidence"))


@query(f"""WITH {_LIVE}, d AS (SELECT project_id, severity, dense_rank() OVER (PARTITION BY project_id ORDER BY {_RANK}) AS tier FROM (SELECT DISTINCT project_id, severity FROM live))
SELECT project_id, severity, CASE tier WHEN 1 THEN 'Now' WHEN 2 THEN 'Next' ELSE 'Later' END AS horizon FROM d""")
def w07_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """W-07: severities of a project as dense tiers."""
    d = live(spark, sf).select("project_id", "severity").distinct()
    tier = F.dense_rank().over(Window.partitionBy("project_id").orderBy(rank_of()))
    return d.select("project_id", "severity", F.when(tier == 1, "Now").when(tier == 2, "Next").otherwise("Later").alias("horizon"))


@query("""WITH e AS (SELECT DISTINCT module AS src, unnest(imports) AS dst FROM files WHERE module IS NOT NULL), c AS (SELECT src, dst, count(*) AS w FROM (SELECT module AS src, unnest(imports) AS dst FROM files WHERE module IS NOT NULL) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS by_src, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS by_dst FROM c) SELECT src, dst, CAST(w AS BIGINT) AS weight FROM r WHERE by_src <= 20 AND by_dst <= 2""")
def w08_link_budget(spark: SparkSession, sf: str) -> DataFrame:
    """W-08: links within the budget of both their ends."""
    c = load(spark, sf, "files").where("module is not null").select(F.col("module").alias("src"), F.explode("imports").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("weight"))
    r = c.select("*", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst")).alias("a"), F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("weight"), "src")).alias("b"))
    return r.where("a <= 20 and b <= 2").select("src", "dst", "weight")


@query(f"""WITH RECURSIVE {_LIVE}, s AS (SELECT project_id, id, CAST(length(concat_ws('', title, what_happens, remediation)) AS BIGINT) AS size, row_number() OVER (PARTITION BY project_id ORDER BY id) AS n FROM live),
w AS (SELECT project_id, id, n, size AS used, CAST(0 AS BIGINT) AS batch FROM s WHERE n = 1 UNION ALL SELECT s.project_id, s.id, s.n, CASE WHEN w.used > 0 AND w.used + s.size > 20000 THEN s.size ELSE w.used + s.size END, w.batch + CASE WHEN w.used > 0 AND w.used + s.size > 20000 THEN 1 ELSE 0 END FROM w JOIN s ON s.project_id IS NOT DISTINCT FROM w.project_id AND s.n = w.n + 1)
SELECT project_id, id, batch FROM w""")
def w09_batches(spark: SparkSession, sf: str) -> DataFrame:
    """W-09: findings of a project packed into batches of at most 20,000 characters."""
    f = live(spark, sf).select("project_id", "id", F.length(F.concat_ws("", "title", "what_happens", "remediation")).alias("size"))
    return op.pack(f, ["project_id"], "id", "size", 20_000).withColumn("batch", F.col("batch").cast("long"))


@query("""WITH s AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n, min(ts) AS began, max(ts) AS ended FROM g GROUP BY user_id, session""")
def w13_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """W-13: runs of a user's events without a gap of more than six hours (group id by running sum)."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf, "events")
    gap = micros("ts") - F.lag(micros("ts")).over(own)
    s = e.withColumn("fresh", F.when(gap <= 6 * 3_600_000_000, 0).otherwise(1))
    g = s.withColumn("session", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query("""WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS known FROM events), g AS (SELECT *, last_value(known IGNORE NULLS) OVER w AS before, last_value(CASE WHEN known IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER w AS t0,
 first_value(known IGNORE NULLS) OVER x AS after, first_value(CASE WHEN known IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER x AS t1 FROM v
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(known, CASE WHEN t1 > t0 THEN before + (after - before) * (epoch_us(ts) - t0) / (t1 - t0) END, before, after), 6) AS value FROM g""")
def w10_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    """W-10: gaps filled between the measured neighbours of a user, by time."""
    us = micros("ts")
    v = load(spark, sf, "events").select("event_id", "user_id", "ts", us.alias("t"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("known"))
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.when(F.col("known").isNotNull(), F.col("t"))
    back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    g = v.select("event_id", "known", "t", F.last("known", True).over(back).alias("before"), F.last(at, True).over(back).alias("t0"), F.first("known", True).over(ahead).alias("after"), F.first(at, True).over(ahead).alias("t1"))
    mid = F.when(F.col("t1") > F.col("t0"), F.col("before") + (F.col("after") - F.col("before")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return g.select("event_id", F.round(F.coalesce("known", mid, "before", "after"), 6).alias("value"))


# --- sets and diffs ------------------------------------------------------------------------------------------------


@query(f"""WITH {_FILES} SELECT id, nullif(first_value(path) OVER (PARTITION BY project_id, hash ORDER BY path), path) AS first_path FROM f WHERE hash IS NOT NULL AND size > 64 AND NOT coalesce(is_excluded, FALSE)""")
def u04_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """U-04: files of equal content point at the first path (an aggregation and a join, no group in one task)."""
    f = files(spark, sf).where("hash is not null and size > 64 and not coalesce(is_excluded, false)")
    first = f.groupBy("project_id", "hash").agg(F.min("path").alias("low"))
    return f.join(first, ["project_id", "hash"]).select("id", F.nullif("low", F.col("path")).alias("first_path"))


@query(f"""WITH {_FILES}, c AS (SELECT project_id || '/' || path AS key, max(hash) AS h FROM f WHERE NOT coalesce(is_excluded, FALSE) GROUP BY ALL), p AS (SELECT project_id || '/' || path AS key, min(hash) AS h FROM f GROUP BY ALL)
SELECT coalesce(c.key, p.key) AS key, CASE WHEN p.key IS NULL THEN 'added' WHEN c.key IS NULL THEN 'removed' WHEN c.h IS NOT DISTINCT FROM p.h THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT * FROM c WHERE key IS NOT NULL) c FULL JOIN (SELECT * FROM p WHERE key IS NOT NULL) p ON c.key = p.key""")
def u05_diff(spark: SparkSession, sf: str) -> DataFrame:
    """U-05: what was added, removed or changed between two states: files that are not excluded, against all files."""
    f = files(spark, sf).where("project_id is not null and path is not null").select(F.concat_ws("/", "project_id", "path").alias("key"), "hash", F.coalesce("is_excluded", F.lit(False)).alias("out"))
    new = f.where("not out").groupBy("key").agg(F.max("hash").alias("h"))
    return op.diff(new, f.groupBy("key").agg(F.min("hash").alias("h")), "key", "h")


@query("SELECT id, max_by(spec, struct_pack(a := version, b := updated_at)) AS spec, CAST(max(version) AS BIGINT) AS version FROM explanations GROUP BY id")
def k03_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """K-02, K-03: first versions updated by later ones, which also add the records that are new."""
    e = load(spark, sf, "explanations").withColumn("version", F.col("version").cast("long"))
    latest = lambda df: op.first_per(df, ["id"], [F.desc("version"), F.desc("updated_at")]).select("id", "spec", "version")
    return sinks.merged(latest(e.where("version = 1")), latest(e.where("version > 1")), ["id"])


@query("""SELECT DISTINCT a.id FROM findings a WHERE a.area IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.project_id = a.project_id AND f.path = a.file_path AND f.area = a.area)""")
def u09_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """U-09: findings whose file is not in the area they name."""
    f = load(spark, sf, "files").select("project_id", F.col("path").alias("file_path"), "area")
    return load(spark, sf, "findings").where("area is not null").join(f, ["project_id", "file_path", "area"], "left_anti").select("id").distinct()


@query("""WITH p AS (SELECT DISTINCT id, project_id, file_path, start_line FROM findings WHERE file_path IS NOT NULL AND start_line IS NOT NULL)
SELECT project_id, file_path, start_line // 20 AS bucket, min(id) AS id FROM p GROUP BY ALL""")
def u11_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """U-11: one excerpt per file and block of 20 lines."""
    p = load(spark, sf, "findings").where("file_path is not null and start_line is not null")
    return p.groupBy("project_id", "file_path", F.floor(F.col("start_line") / 20).alias("bucket")).agg(F.min("id").alias("id"))


QUERIES, ORACLES = query.queries, query.oracles
