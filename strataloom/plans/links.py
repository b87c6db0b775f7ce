"""Queries of links, rankings and states over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import text as fn
from strataloom.operators import graph, links
from strataloom.operators import relational as op
from strataloom.plans.registry import Registry
from strataloom.plans.relational import _LIVE, _RANK, live, rank_of
from strataloom.plans.structure import _EDGES, edges
from strataloom.tables import load

query = Registry()
_FILES = "f AS (SELECT DISTINCT ON (id) * FROM files)"
_W = "weighted AS (SELECT module AS src, string_split(i, '/')[1] AS dst, classification AS kind, CAST(count(*) AS BIGINT) AS weight FROM (SELECT module, classification, unnest(imports) AS i FROM f) WHERE module IS NOT NULL GROUP BY ALL)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "files").dropDuplicates(["id"])


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Imports counted by module, imported area and classification of the file."""
    f = files(spark, sf).where("module is not null").select(F.col("module").alias("src"), F.col("classification").alias("kind"), F.explode("imports").alias("i"))
    return f.groupBy("src", F.split("i", "/")[0].alias("dst"), "kind").agg(F.count("*").alias("weight"))


# --- joins ---------------------------------------------------------------------------------------------------------


@query("SELECT a.id, CAST(count(*) - 1 AS BIGINT) AS others FROM projects a JOIN projects b ON a.source_type IS NOT DISTINCT FROM b.source_type AND a.source_url IS NOT DISTINCT FROM b.source_url GROUP BY a.id")
def f05_same_origin(spark: SparkSession, sf: str) -> DataFrame:
    """F-05: how many other projects have the same type and address, null being equal to null."""
    p = load(spark, sf, "projects")
    counted = p.groupBy("source_type", "source_url").agg((F.count("*") - 1).alias("others"))
    match = F.col("x.source_type").eqNullSafe(F.col("y.source_type")) & F.col("x.source_url").eqNullSafe(F.col("y.source_url"))
    return p.alias("x").join(counted.alias("y"), match).select("x.id", "y.others")


@query(f"WITH {_FILES} SELECT id, path FROM f WHERE language IN ('TypeScript', 'Go') AND extension = 'ts' AND area IS NOT NULL AND role IN ('api', 'service')")
def f07_entries(spark: SparkSession, sf: str) -> DataFrame:
    """F-07: entries by optional conditions, an extension with or without its dot."""
    return op.entries(files(spark, sf), language=["TypeScript", "Go"], extension=".ts", role=["api", "service"], area=None).where("area is not null").select("id", "path")


@query(f"WITH {_FILES}, {_W} SELECT src, dst, weight FROM weighted WHERE src <> dst AND kind IN ('source', 'test') AND weight >= 2")
def f14_edge_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """F-14: edges of allowed kinds, without self-links and light ones."""
    return weighted(spark, sf).where((F.col("src") != F.col("dst")) & F.col("kind").isin("source", "test") & (F.col("weight") >= 2)).select("src", "dst", "weight")


@query(f"WITH {_FILES} SELECT id AS file_id, CAST(len(exports) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(exports)), ',') AS names FROM f WHERE exports IS NOT NULL")
def j04_names_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """J-04: each file with its names, files without any too."""
    f = files(spark, sf).where("exports is not null")
    names = f.select(F.col("id").alias("file_id"), F.explode("exports").alias("name")).groupBy("file_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return f.select(F.col("id").alias("file_id")).join(names, "file_id", "left").na.fill({"n": 0, "names": ""})


_CATALOGUE = ("check", "bundle/budget", "control", "result/window", "shard", "page", "narration/node", "ledger")


@query(f"""WITH {_FILES}, k AS (SELECT unnest({list(_CATALOGUE)!r}) AS entry), i AS (SELECT DISTINCT unnest(imports) AS name FROM f)
SELECT name, max_by(entry, length(entry)) AS entry FROM i JOIN k ON lower(name) = entry OR starts_with(lower(name), entry || '/') GROUP BY name""")
def j08_catalogued(spark: SparkSession, sf: str) -> DataFrame:
    """J-08: imports that a catalogue names, by entry or by prefix, the longest entry."""
    names = files(spark, sf).select(F.explode("imports").alias("name")).distinct()
    return links.catalogued(names, "name", spark.createDataFrame([(c,) for c in _CATALOGUE], "entry string"))


@query(f"""WITH {_FILES}, t AS (SELECT DISTINCT project_id, id, regexp_replace(regexp_replace(name, '^test_', ''), '([._-](test|spec))?\\.[a-z]+$', '') AS stem, imports FROM f WHERE is_test), s AS (SELECT DISTINCT project_id, path, regexp_replace(name, '\\.[a-z]+$', '') AS stem, area FROM f WHERE NOT is_test AND path IS NOT NULL),
i AS (SELECT DISTINCT t.id, s.path, 'import' AS via FROM (SELECT project_id, id, unnest(imports) AS spec FROM t) t JOIN s ON s.project_id = t.project_id AND s.stem = replace(string_split(spec, '/')[-1], '_', '-')),
n AS (SELECT DISTINCT t.id, s.path, 'name' AS via FROM t JOIN s ON s.project_id = t.project_id AND s.stem = t.stem WHERE t.id NOT IN (SELECT id FROM i)) SELECT * FROM i UNION ALL SELECT * FROM n""")
def j10_tested_files(spark: SparkSession, sf: str) -> DataFrame:
    """J-10: what tests test: what they import, else the file of the same name."""
    f = files(spark, sf)
    tests = f.where("is_test").select("project_id", "id", F.regexp_replace(F.regexp_replace("name", "^test_", ""), r"([._-](test|spec))?\.[a-z]+$", "").alias("stem"), "imports")
    sources = f.where("not is_test and path is not null").select("project_id", "path", F.regexp_replace("name", r"\.[a-z]+$", "").alias("stem")).distinct()
    by_import = tests.select("project_id", "id", F.explode("imports").alias("spec")).withColumn("stem", F.replace(F.element_at(F.split("spec", "/"), -1), F.lit("_"), F.lit("-"))).join(sources, ["project_id", "stem"]).select("id", "path", F.lit("import").alias("via")).distinct()
    by_name = tests.join(sources, ["project_id", "stem"]).join(by_import.select("id"), "id", "left_anti").select("id", "path", F.lit("name").alias("via")).distinct()
    return by_import.unionByName(by_name)


_SINGULAR = "CASE WHEN {0} LIKE '%ies' THEN regexp_replace({0}, 'ies$', 'y') WHEN regexp_matches({0}, '(s|x|ch|sh)es$') THEN regexp_replace({0}, 'es$', '') WHEN regexp_matches({0}, '[^s]s$') THEN regexp_replace({0}, 's$', '') ELSE {0} END"


@query(f"""WITH {_FILES}, t AS (SELECT DISTINCT f.hash, unnest(regexp_extract_all(b.content, 'CREATE TABLE ([a-z_]+)', 1)) AS name FROM f JOIN blobs b USING (hash) WHERE f.language = 'SQL'), tk AS (SELECT {_SINGULAR.format("string_split(name, '_')[-1]")} AS key, CAST(count(DISTINCT name) AS BIGINT) AS tables FROM t GROUP BY ALL),
e AS (SELECT DISTINCT unnest(exports) AS name FROM f), ek AS (SELECT {_SINGULAR.format("lower(regexp_extract(name, '([A-Z][a-z]+)$', 1))")} AS key, CAST(count(*) AS BIGINT) AS models FROM e GROUP BY ALL) SELECT key, tables, models FROM tk JOIN ek USING (key) WHERE key <> ''""")
def j14_models_and_tables(spark: SparkSession, sf: str) -> DataFrame:
    """J-14: tables and exported names that meet on the singular of their last word."""
    f = files(spark, sf)
    sql = f.where("language = 'SQL'").join(load(spark, sf, "blobs"), "hash").select(F.explode(F.regexp_extract_all("content", F.lit("CREATE TABLE ([a-z_]+)"), F.lit(1))).alias("name"))
    tables = sql.groupBy(fn.singular(F.element_at(F.split("name", "_"), -1)).alias("key")).agg(F.count_distinct("name").alias("tables"))
    names = f.select(F.explode("exports").alias("name")).distinct()
    models = names.groupBy(fn.singular(F.regexp_extract("name", "([A-Z][a-z]+)$", 1)).alias("key")).agg(F.count("*").alias("models"))
    return tables.join(models, "key").where("key <> ''").select("key", "tables", "models")


@query(f"""WITH {_FILES}, u AS (SELECT unnest(imports) AS spec FROM f), n AS (SELECT DISTINCT area AS name FROM f WHERE area IS NOT NULL)
SELECT name, CAST(coalesce((SELECT nullif(count(*), 0) FROM u WHERE spec = name), (SELECT count(*) FROM u WHERE starts_with(spec, name || '/'))) AS BIGINT) AS uses FROM n""")
def j16_usage(spark: SparkSession, sf: str) -> DataFrame:
    """J-16: how often each area is imported as such, or else anything below it."""
    f = files(spark, sf)
    return links.usage(f.where("area is not null").select(F.col("area").alias("name")), f.select(F.explode("imports").alias("spec")))


@query(f"""WITH {_FILES}, a AS (SELECT DISTINCT area AS name FROM f WHERE area IS NOT NULL), k AS (SELECT DISTINCT name, unnest([lower(name), {_SINGULAR.format("lower(name)")}, lower(name) || 's']) AS word FROM a),
w AS (SELECT DISTINCT id, list_transform(regexp_extract_all(regexp_replace(evidence, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]+'), lambda x: lower(x)) AS w FROM findings WHERE evidence IS NOT NULL), p AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM w), m AS (SELECT id, place, name, row_number() OVER (PARTITION BY id ORDER BY place, name) AS n FROM p JOIN k USING (word))
SELECT id, CAST(place AS BIGINT) AS place, name FROM m WHERE n = 1""")
def j17_named_data(spark: SparkSession, sf: str) -> DataFrame:
    """J-17: the first word of an expression that names an area, in singular or plural."""
    rows = load(spark, sf, "findings").where("evidence is not null").dropDuplicates(["id"])
    apart = F.regexp_replace("evidence", "([a-z0-9])([A-Z])", "$1 $2")
    words = F.transform(F.regexp_extract_all(apart, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    areas = files(spark, sf).where("area is not null").select(F.col("area").alias("name")).distinct()
    return links.first_named(rows, "id", words, areas)


# --- aggregates ----------------------------------------------------------------------------------------------------


@query(f"""WITH {_FILES}, {_W}, p AS (SELECT *, CASE kind WHEN 'source' THEN 3 WHEN 'test' THEN 2 WHEN 'config' THEN 1 ELSE 0 END AS pr FROM weighted) SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight, arg_min(kind, struct_pack(a := -pr, b := kind)) AS kind FROM p GROUP BY src, dst""")
def a08_merged_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A-08: edges of several kinds as one, weights added, the kind of the highest priority."""
    priority = F.when(F.col("kind") == "source", 3).when(F.col("kind") == "test", 2).when(F.col("kind") == "config", 1).otherwise(0)
    return links.merged_edges(weighted(spark, sf), ["src", "dst"], "kind", priority).select("src", "dst", "weight", "kind")


@query(f"""WITH {_FILES}, b AS (SELECT project_id, language, sum(coalesce(size, 0)) AS bytes FROM f WHERE language IS NOT NULL GROUP BY ALL), t AS (SELECT project_id, sum(bytes) AS total FROM b GROUP BY ALL), s AS (SELECT project_id, string_agg(language, ',' ORDER BY language) AS stack FROM b JOIN t USING (project_id) WHERE bytes >= 0.05 * total AND bytes > 0 GROUP BY project_id),
y AS (SELECT project_id, CAST(count_if(role = 'ui') AS BIGINT) AS front, CAST(count_if(role IN ('api', 'service')) AS BIGINT) AS back, CAST(count_if(role = 'data') AS BIGINT) AS store FROM f GROUP BY ALL) SELECT project_id, stack, front, back, store FROM y LEFT JOIN s USING (project_id)""")
def a15_stack(spark: SparkSession, sf: str) -> DataFrame:
    """A-15: the languages that make up a twentieth of a project, and its files by layer."""
    f = files(spark, sf)
    sized = f.where("language is not null").groupBy("project_id", "language").agg(F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    shares = sized.withColumn("total", F.sum("bytes").over(Window.partitionBy("project_id"))).where("bytes >= 0.05 * total and bytes > 0")
    stack = shares.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list("language")), ",").alias("stack"))
    layers = f.groupBy("project_id").agg(F.count_if(F.col("role") == "ui").alias("front"), F.count_if(F.col("role").isin("api", "service")).alias("back"), F.count_if(F.col("role") == "data").alias("store"))
    return layers.join(stack, "project_id", "left").select("project_id", "stack", "front", "back", "store")


@query(f"""WITH {_LIVE} SELECT area, category, CAST(count(*) AS BIGINT) AS n, arg_min(severity, struct_pack(a := CASE WHEN {_RANK} < 0 THEN 9 ELSE {_RANK} END, b := severity)) AS worst FROM live WHERE area IS NOT NULL GROUP BY area, category""")
def a18_worst_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """A-18: findings of each area and category with the most severe label."""
    rank = F.when(rank_of() < 0, 9).otherwise(rank_of())
    return live(spark, sf).where("area is not null").groupBy("area", "category").agg(F.count("*").alias("n"), F.min(F.struct(rank.alias("a"), F.col("severity").alias("b")))["b"].alias("worst"))


@query(f"""WITH {_FILES}, m AS (SELECT project_id, module, sum(coalesce(importance, 0)) AS s, count(*) AS n FROM f WHERE module IS NOT NULL GROUP BY ALL) SELECT project_id, module, round(s / greatest(max(s) OVER (PARTITION BY project_id), 1e-9) + 0.05 * n, 6) AS score FROM m""")
def a23_module_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A-23: importance of a module's files over the project's highest, plus a twentieth for each file."""
    m = files(spark, sf).where("module is not null").groupBy("project_id", "module").agg(F.sum(F.coalesce("importance", F.lit(0.0))).alias("s"), F.count("*").alias("n"))
    top = F.max("s").over(Window.partitionBy("project_id"))
    return m.select("project_id", "module", F.round(F.col("s") / F.greatest(top, F.lit(1e-9)) + F.col("n") * 0.05, 6).alias("score"))


@query(f"""WITH {_FILES}, {_W}, i AS (SELECT kind, dst AS node, sum(weight) AS n FROM weighted GROUP BY ALL), o AS (SELECT kind, src AS node, sum(weight) AS n FROM weighted GROUP BY ALL)
SELECT kind, (SELECT node FROM i WHERE i.kind = k.kind ORDER BY n DESC, node LIMIT 1) AS hub, (SELECT node FROM o WHERE o.kind = k.kind ORDER BY n DESC, node LIMIT 1) AS orchestrator FROM (SELECT DISTINCT kind FROM weighted WHERE kind IS NOT NULL) k""")
def a24_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """A-24: the most used and the most using node of each kind, the first name of equals."""
    w = weighted(spark, sf).where("kind is not null")
    top = lambda side, name: op.first_per(w.groupBy("kind", F.col(side).alias("node")).agg(F.sum("weight").alias("n")), ["kind"], [F.desc("n"), "node"]).select("kind", F.col("node").alias(name))
    return top("dst", "hub").join(top("src", "orchestrator"), "kind")


# --- windows and rankings ------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), s AS (SELECT *, max(ms) OVER (PARTITION BY user_id ORDER BY k) AS start_ms FROM e)
SELECT event_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(least(start_ms + 60000, coalesce(lead(start_ms) OVER (PARTITION BY user_id ORDER BY k), start_ms + 60000)) AS BIGINT) AS end_ms FROM s""")
def w11_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """W-11: starts that never go back, ends that never pass the next start."""
    e = load(spark, sf, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return op.clamped(e, ["user_id"], "event_id", F.col("ms"), F.col("ms") + 60000).select("event_id", "start_ms", "end_ms")


@query("""WITH l AS (SELECT hash AS id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM blobs), p AS (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY n) AS before FROM l)
SELECT id, CAST(n AS BIGINT) AS line_no FROM p WHERE contains(line, 'return ') AND (contains(line, 'if ') OR contains(coalesce(before, ''), 'if '))""")
def w06_marked_lines(spark: SparkSession, sf: str) -> DataFrame:
    """W-06: lines with a mark of their own or on the line before."""
    lines = load(spark, sf, "blobs").where("contains(content, 'return ')").select(F.col("hash").alias("id"), F.split("content", "\n", -1).alias("ls"))
    pairs = F.arrays_zip(F.col("ls").alias("line"), F.concat(F.array(F.lit("")), F.slice("ls", 1, F.size("ls") - 1)).alias("before"))
    flat = lines.select("id", F.posexplode(pairs).alias("n", "p")).select("id", (F.col("n") + 1).cast("long").alias("line_no"), F.col("p.line").alias("line"), F.col("p.before").alias("before"))
    return flat.where("contains(line, 'return ') and (contains(line, 'if ') or contains(before, 'if '))").select("id", "line_no")


@query("""WITH j AS (SELECT id, any_value(project_id) AS project_id, min(created_at) AS created_at FROM video_jobs GROUP BY id), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS n FROM j WHERE created_at IS NOT NULL)
SELECT project_id, id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at, id DESC) AS BIGINT) AS position FROM r WHERE n <= 3""")
def o02_latest(spark: SparkSession, sf: str) -> DataFrame:
    """O-02: the three latest jobs of each project, oldest first (the cut is the feature)."""
    j = load(spark, sf, "video_jobs").groupBy("id").agg(F.first("project_id").alias("project_id"), F.min("created_at").alias("created_at")).where("created_at is not null")
    latest = op.top_k(j, ["project_id"], [F.desc("created_at"), "id"], 3)
    return latest.select("project_id", "id", F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", F.desc("id"))).cast("long").alias("position"))


@query(f"""WITH {_LIVE}, {_FILES}, r AS (SELECT project_id, file_path AS path, max(4 - CASE WHEN {_RANK} < 0 THEN 4 ELSE {_RANK} END) AS risk FROM live WHERE file_path IS NOT NULL GROUP BY ALL), p AS (SELECT DISTINCT project_id, path, max(coalesce(importance, 0)) AS importance, max(coalesce(lines, 0)) AS lines FROM f WHERE path IS NOT NULL GROUP BY ALL)
SELECT project_id, path, round(coalesce(risk, 0) + 10 * importance + least(lines, 1000) / 1000, 6) AS score FROM p LEFT JOIN r USING (project_id, path) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY score DESC, path) <= 60""")
def o05_review_order(spark: SparkSession, sf: str) -> DataFrame:
    """O-05: the 60 files of each project that risk, importance and size put first (the cut is the feature)."""
    risk = live(spark, sf).where("file_path is not null").groupBy("project_id", F.col("file_path").alias("path")).agg(F.max(4 - F.when(rank_of() < 0, 4).otherwise(rank_of())).alias("risk"))
    paths = files(spark, sf).where("path is not null").groupBy("project_id", "path").agg(F.max(F.coalesce("importance", F.lit(0.0))).alias("importance"), F.max(F.coalesce("lines", F.lit(0))).alias("lines"))
    score = F.round(F.coalesce("risk", F.lit(0)) + 10 * F.col("importance") + F.least("lines", F.lit(1000)) / 1000, 6)
    return op.top_k(paths.join(risk, ["project_id", "path"], "left").withColumn("score", score), ["project_id"], [F.desc("score"), "path"], 60).select("project_id", "path", "score")


_FOCUS = ("cache", "ledger", "retry", "token", "worker")


@query(f"""WITH d AS (SELECT DISTINCT ON (id) * FROM findings), o AS (SELECT project_id, id, len(list_filter({list(_FOCUS)!r}, lambda w: contains(lower(concat_ws(' ', title, remediation)), w))) AS overlap FROM d) SELECT project_id, id, CAST(overlap AS BIGINT) AS overlap, CAST(row_number() OVER (PARTITION BY project_id ORDER BY overlap DESC, id) AS BIGINT) AS position FROM o""")
def o07_focus_order(spark: SparkSession, sf: str) -> DataFrame:
    """O-07: findings by the number of asked words they name, ties in their own order."""
    d = load(spark, sf, "findings").dropDuplicates(["id"])
    hay = F.lower(F.concat_ws(" ", "title", "remediation"))
    overlap = F.size(F.filter(F.array(*[F.lit(w) for w in _FOCUS]), lambda w: F.contains(hay, w))).cast("long")
    o = d.select("project_id", "id", overlap.alias("overlap"))
    return o.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("overlap"), "id")).cast("long"))


@query(f"""WITH {_LIVE}, g AS (SELECT project_id, category, min({_RANK}) AS worst, count(*) AS n, min(code) AS code FROM live GROUP BY ALL) SELECT project_id, category, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY project_id ORDER BY worst, n DESC, code, category) AS BIGINT) AS position FROM g""")
def o08_group_order(spark: SparkSession, sf: str) -> DataFrame:
    """O-08, B-18: groups by severity, then size, then code."""
    g = live(spark, sf).groupBy("project_id", "category").agg(F.min(rank_of()).alias("worst"), F.count("*").alias("n"), F.min("code").alias("code"))
    order = Window.partitionBy("project_id").orderBy("worst", F.desc("n"), "code", "category")
    return g.select("project_id", "category", "n", F.row_number().over(order).cast("long").alias("position"))


# --- sets ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_FILES} SELECT 'large' AS origin, id AS subject, NULL AS severity FROM f WHERE lines > 1000 UNION ALL SELECT 'copy', id, NULL FROM f WHERE duplicate_of <> '' UNION ALL SELECT DISTINCT 'finding', id, trim(severity) FROM findings""")
def u01_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """U-01: drafts of several origins in one table, missing columns null."""
    f = files(spark, sf)
    drafts = [("large", f.where("lines > 1000").select(F.col("id").alias("subject"))), ("copy", f.where("duplicate_of <> ''").select(F.col("id").alias("subject"))), ("finding", load(spark, sf, "findings").select(F.col("id").alias("subject"), F.trim("severity").alias("severity")).distinct())]
    return op.stacked(drafts).select("origin", "subject", "severity")


@query(f"""WITH {_FILES}, e AS (SELECT classification AS kind, module AS src, unnest(imports) AS dst, path FROM f WHERE module IS NOT NULL AND path IS NOT NULL) SELECT kind, src, dst, min(path) AS path FROM e WHERE kind IS NOT NULL GROUP BY ALL""")
def u02_first_edges(spark: SparkSession, sf: str) -> DataFrame:
    """U-02: edges once per kind, source and target, the first path's."""
    e = files(spark, sf).where("module is not null and path is not null and classification is not null").select(F.col("classification").alias("kind"), F.col("module").alias("src"), F.explode("imports").alias("dst"), "path")
    return op.first_per(e, ["kind", "src", "dst"], ["path"])


@query("""WITH v AS (SELECT id, previous_project_id AS named, status = 'ready' AS ready, source_type, source_url, name, created_at FROM projects)
SELECT id, coalesce((SELECT n.id FROM v n WHERE n.id = v.named AND n.ready), (SELECT p.id FROM v p WHERE p.ready AND p.id <> v.id AND p.source_type IS NOT DISTINCT FROM v.source_type AND p.source_url IS NOT DISTINCT FROM v.source_url AND p.name IS NOT DISTINCT FROM v.name AND p.created_at < v.created_at ORDER BY p.created_at DESC, p.id LIMIT 1)) AS previous FROM v""")
def u06_previous(spark: SparkSession, sf: str) -> DataFrame:
    """U-06: the version before: the named one if ready, else the latest ready one of the same origin."""
    p = load(spark, sf, "projects")
    return links.previous_version(p.select("id", F.col("previous_project_id").alias("named"), (F.col("status") == "ready").alias("ready"), "source_type", "source_url", "name", "created_at"))


@query(f"""WITH RECURSIVE {_LIVE}, k AS (SELECT project_id, category, area, id FROM live WHERE area IS NOT NULL AND file_path IS NOT NULL), g AS (SELECT project_id, category, area, min(id) AS low FROM k GROUP BY ALL), h AS (SELECT project_id, file_path, min(id) AS low FROM live WHERE file_path IS NOT NULL AND area IS NOT NULL GROUP BY ALL),
p AS (SELECT id AS a, low AS b FROM k JOIN g USING (project_id, category, area) UNION SELECT id, low FROM live JOIN h USING (project_id, file_path) WHERE area IS NOT NULL), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id, min(root) AS cluster FROM r GROUP BY id""")
def u08_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """U-08, G-06: findings of one area and category, or of one file, as clusters through any number of links."""
    f = live(spark, sf).where("area is not null and file_path is not null")
    pairs = links.star_pairs(f, ["project_id", "category", "area"], "id").unionByName(links.star_pairs(f, ["project_id", "file_path"], "id"))
    return links.clusters(f, "id", pairs)


@query("""WITH d AS (SELECT DISTINCT id, project_id, file_path, start_line, end_line FROM findings WHERE start_line <= end_line AND file_path IS NOT NULL) SELECT id FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.project_id = d.project_id AND o.file_path = d.file_path AND o.id < d.id AND o.start_line <= d.start_line AND o.end_line >= d.end_line)""")
def u10_uncontained(spark: SparkSession, sf: str) -> DataFrame:
    """U-10: places that no earlier one holds whole."""
    d = load(spark, sf, "findings").where("start_line <= end_line and file_path is not null").dropDuplicates(["id"])
    return links.uncontained(d, ["project_id", "file_path"], "start_line", "end_line", "id").select("id")


@query("""WITH m AS (SELECT DISTINCT id AS old, 'exp_' || left(sha256('copy' || chr(31) || id), 20) AS new FROM explanations), j AS (SELECT DISTINCT id, explanation_id FROM video_jobs) SELECT id, coalesce(new, explanation_id) AS explanation_id FROM j LEFT JOIN m ON m.old = j.explanation_id""")
def u12_remapped(spark: SparkSession, sf: str) -> DataFrame:
    """U-12: references of jobs after their targets got new ids; unknown ones stay."""
    ids = load(spark, sf, "explanations").select(F.col("id").alias("old")).distinct().withColumn("new", F.concat(F.lit("exp_"), F.left(F.sha2(F.concat_ws("\x1f", F.lit("copy"), "old"), 256), F.lit(20))))
    return links.remapped(load(spark, sf, "video_jobs").select("id", "explanation_id").distinct(), "explanation_id", ids).select("id", "explanation_id")


# --- graph ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {_FILES}, {_W} SELECT node, class, CAST(count(*) AS BIGINT) AS n, string_agg(other, ',' ORDER BY other) AS others FROM (SELECT DISTINCT src AS node, kind AS class, dst AS other FROM weighted WHERE kind IS NOT NULL UNION SELECT DISTINCT dst, kind || 'By', src FROM weighted WHERE kind IS NOT NULL) GROUP BY ALL""")
def g05_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """G-05: direct neighbours of each node by relation and direction."""
    return links.classified(weighted(spark, sf).where("kind is not null"))


@query(f"""WITH {_FILES}, t AS (SELECT project_id, path, module, area, importance FROM f WHERE path IS NOT NULL AND module IS NOT NULL AND area IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY coalesce(importance, 0) DESC, path, id) <= 60),
x AS (SELECT DISTINCT t.project_id, t.module AS src, string_split(i, '/')[1] AS dst FROM (SELECT project_id, path, unnest(imports) AS i FROM f WHERE path IS NOT NULL) e JOIN t ON t.project_id = e.project_id AND t.path = e.path) SELECT x.project_id, src, dst FROM x WHERE EXISTS (SELECT 1 FROM t WHERE t.project_id = x.project_id AND t.area = x.dst)""")
def g09_module_graph(spark: SparkSession, sf: str) -> DataFrame:
    """G-09: links among the 60 most important files of each project (the cut is the feature)."""
    f = files(spark, sf).where("path is not null")
    top = op.top_k(f.where("module is not null and area is not null"), ["project_id"], [F.desc(F.coalesce("importance", F.lit(0.0))), "path", "id"], 60)
    used = f.select("project_id", "path", F.explode("imports").alias("i")).join(top.select("project_id", "path", F.col("module").alias("src")), ["project_id", "path"])
    ends = top.select("project_id", F.col("area").alias("dst")).distinct()
    return used.select("project_id", "src", F.split("i", "/")[0].alias("dst")).distinct().join(ends, ["project_id", "dst"], "left_semi").select("project_id", "src", "dst")


_LINKS = "lk AS (SELECT x AS src, y AS dst, CAST(count(*) AS BIGINT) AS weight FROM (SELECT string_split(i, '/')[1] AS x, string_split(i, '/')[2] AS y FROM (SELECT unnest(imports) AS i FROM f)) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)"


def named_links(spark: SparkSession, sf: str) -> DataFrame:
    """How often the two parts of an imported name go together."""
    parts = F.split("i", "/")
    return files(spark, sf).select(F.explode("imports").alias("i")).select(F.get(parts, 0).alias("src"), F.get(parts, 1).alias("dst")).where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query(f"""WITH {_FILES}, {_LINKS} SELECT src, dst, weight FROM lk a WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM lk b WHERE b.src = a.dst AND b.dst = a.src AND (b.weight > a.weight OR b.weight = a.weight AND b.src < a.src))""")
def g11_dominant(spark: SparkSession, sf: str) -> DataFrame:
    """G-11: of two opposite links the heavier one."""
    return links.dominant(named_links(spark, sf))


@query(f"""WITH RECURSIVE {_EDGES}, d AS (SELECT 'check' AS node, 0 AS steps UNION SELECT e.dst, d.steps + 1 FROM d JOIN e ON e.src = d.node WHERE d.steps < 3), u AS (SELECT 'check' AS node, 0 AS steps UNION SELECT e.src, u.steps + 1 FROM u JOIN e ON e.dst = u.node WHERE u.steps < 3), a AS (SELECT node, min(steps) AS s FROM d GROUP BY ALL), b AS (SELECT node, min(steps) AS s FROM u GROUP BY ALL)
SELECT coalesce(a.node, b.node) AS node, CAST(CASE WHEN a.s IS NULL OR b.s < a.s THEN -b.s ELSE a.s END AS BIGINT) AS layer FROM a FULL JOIN b ON a.node = b.node""")
def g12_layers(spark: SparkSession, sf: str) -> DataFrame:
    """G-03, G-12: layers around a focus, downwards positive and upwards negative, the nearer way first."""
    return graph.layers(edges(spark, sf), "check", 3).withColumn("layer", F.col("layer").cast("long"))


@query(f"""WITH {_FILES}, {_LINKS}, s AS (SELECT src, dst, weight, weight / max(weight) OVER (PARTITION BY src) AS share FROM lk) SELECT src, dst, weight, round(share, 6) AS share, CASE WHEN share >= 0.6 THEN 'strong' WHEN share >= 0.25 THEN 'medium' ELSE 'weak' END AS band FROM s""")
def g13_bands(spark: SparkSession, sf: str) -> DataFrame:
    """G-13: links of each node in bands of strength."""
    return links.bands(named_links(spark, sf), ["src"])


@query(f"""WITH {_FILES}, d AS (SELECT DISTINCT project_id, directory FROM f WHERE language = 'Markdown' AND directory <> '') SELECT DISTINCT f.project_id, f.path, (SELECT d.directory FROM d WHERE d.project_id = f.project_id AND starts_with(f.path, d.directory || '/') ORDER BY length(d.directory) DESC LIMIT 1) AS anchor FROM f WHERE path IS NOT NULL AND project_id IS NOT NULL""")
def g14_documented_above(spark: SparkSession, sf: str) -> DataFrame:
    """G-14: the nearest directory above each file that holds documentation."""
    f = files(spark, sf).where("project_id is not null")
    return links.nearest_ancestor(f.where("path is not null"), ["project_id"], "path", f.where("language = 'Markdown' and directory <> ''"))


@query(f"""WITH {_FILES}, {_LINKS}, m AS (SELECT src, dst, weight, left(src, 1) AS a, left(dst, 1) AS b FROM lk) SELECT g, CAST(coalesce(sum(weight) FILTER (a = b), 0) AS BIGINT) AS internal, CAST(count(DISTINCT src) FILTER (a <> b AND b = g) AS BIGINT) AS users, CAST(count(DISTINCT dst) FILTER (a <> b AND a = g) AS BIGINT) AS used FROM (SELECT *, unnest(list_distinct([a, b])) AS g FROM m) GROUP BY g""")
def g15_collections(spark: SparkSession, sf: str) -> DataFrame:
    """G-15: links inside each collection of names, and who outside uses it or is used."""
    return graph.collections(named_links(spark, sf), F.left("src", F.lit(1)), F.left("dst", F.lit(1)))


# --- states --------------------------------------------------------------------------------------------------------

_ALLOWED = [("queued", "running"), ("running", "ready"), ("running", "failed"), ("queued", "cancelled"), ("running", "cancelled")]


@query(f"""WITH s AS (SELECT DISTINCT id, status, coalesce(heartbeat_at, started_at, created_at) AS since FROM video_jobs), p AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY since, status) AS before FROM s)
SELECT id, before, status, concat(before, '>', status) IN ({", ".join(f"'{a}>{b}'" for a, b in _ALLOWED)}) AS allowed FROM p WHERE before IS NOT NULL AND before <> status""")
def st03_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """ST-03: changes of a job's state, and whether the state machine has them."""
    s = load(spark, sf, "video_jobs").select("id", "status", F.coalesce("heartbeat_at", "started_at", "created_at").alias("at")).distinct()
    return op.transitions(s, "id", "status", ["at", "status"], _ALLOWED)


@query("""WITH p AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS piece, CAST(1 + event_id % 7 AS BIGINT) AS size, event_id FROM events), o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY session ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p), k AS (SELECT * FROM o WHERE event_id % 11 <> 0), g AS (SELECT *, lag(start + size) OVER (PARTITION BY session ORDER BY start) AS reached FROM k)
SELECT session, CAST(sum(size) AS BIGINT) AS received, CAST(max(start + size) AS BIGINT) AS length, CAST(count_if(start > coalesce(reached, 0)) AS BIGINT) AS gaps FROM g GROUP BY session""")
def st06_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """ST-06, S-05: pieces of an upload put together by offset, repeated ones once, gaps counted."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    p = load(spark, sf, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 7 + 1).alias("size"), "event_id", "user_id")
    pieces = p.withColumn("start", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("event_id % 11 <> 0")  # pieces that never arrived
    return op.reassembled(pieces.select("session", "start", "size").union(pieces.select("session", "start", "size").where("size = 3")), "session", "start", "size")


@query("SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS slot, min(event_id) AS event_id FROM events GROUP BY ALL")
def st07_throttled(spark: SparkSession, sf: str) -> DataFrame:
    """ST-07: at most one snapshot per user and slot of time, its first event."""
    return op.throttled(load(spark, sf, "events"), ["user_id"], "ts", 3_600_000, "event_id").select("user_id", "slot", "event_id")


@query("""WITH r AS (SELECT 'files' AS table_name, project_id FROM f UNION ALL SELECT 'findings', project_id FROM (SELECT DISTINCT id, project_id FROM findings) UNION ALL SELECT 'video_jobs', project_id FROM (SELECT DISTINCT id, project_id FROM video_jobs)), dead AS (SELECT id FROM projects WHERE status = 'failed')
SELECT table_name, CAST(count(*) AS BIGINT) AS kept FROM r WHERE project_id NOT IN (SELECT id FROM dead) GROUP BY table_name""".replace("WITH r AS", f"WITH {_FILES}, r AS"))
def k05_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """K-05: what is left of each table when the failed projects go with all that belongs to them."""
    dead = load(spark, sf, "projects").where("status = 'failed'").select(F.col("id").alias("project_id"))
    tables = {"files": files(spark, sf), "findings": load(spark, sf, "findings").select("id", "project_id").distinct(), "video_jobs": load(spark, sf, "video_jobs").select("id", "project_id").distinct()}
    parts = [(n, kept.select("project_id")) for n, kept in op.without(tables, dead, "project_id").items()]
    return op.stacked(parts, "table_name").where("project_id is not null").groupBy("table_name").agg(F.count("*").alias("kept"))


# --- intake, structure, checks -------------------------------------------------------------------------------------


@query(f"""WITH {_FILES}, n AS (SELECT id, project_id, name, row_number() OVER (PARTITION BY project_id, name ORDER BY path, id) AS n FROM f WHERE name IS NOT NULL)
SELECT id, CASE WHEN n = 1 THEN name WHEN contains(name, '.') THEN regexp_replace(name, '\\.[^.]*$', '') || '-' || n || regexp_extract(name, '\\.[^.]*$') ELSE name || '-' || n END AS stored FROM n""")
def s04_stored_names(spark: SparkSession, sf: str) -> DataFrame:
    """S-04: names of a flat upload, later ones of a name numbered from 2."""
    return op.numbered(files(spark, sf).where("name is not null"), ["project_id"], "name", ["path", "id"]).select("id", "stored")


@query("""SELECT id, regexp_extract(source_url, '[/:]([^/:]+)/([^/]+?)(?:\\.git)?/?$', 1) AS owner_name, regexp_extract(source_url, '[/:]([^/:]+)/([^/]+?)(?:\\.git)?/?$', 2) AS repository FROM projects WHERE source_url IS NOT NULL""")
def s06_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """S-06: owner and repository of addresses with a scheme, of user@host:owner/name and with or without .git."""
    p = load(spark, sf, "projects").where("source_url is not null")
    return p.select("id", fn.repository(F.col("source_url"), 1).alias("owner_name"), fn.repository(F.col("source_url"), 2).alias("repository"))


@query(f"WITH {_FILES} SELECT id, EXISTS (SELECT 1 FROM blobs b WHERE b.hash = f.hash) AS known FROM f WHERE hash IS NOT NULL")
def s10_known_contents(spark: SparkSession, sf: str) -> DataFrame:
    """S-10: whether a file's content is stored, by key only."""
    keys = load(spark, sf, "blobs").select("hash").distinct().withColumn("known", F.lit(True))
    return files(spark, sf).where("hash is not null").join(keys, "hash", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"""WITH {_FILES}, r AS (SELECT project_id, count(DISTINCT string_split(path, '/')[1]) AS roots FROM f WHERE path IS NOT NULL GROUP BY ALL) SELECT f.id, CASE WHEN r.roots = 1 AND contains(f.path, '/') THEN regexp_replace(f.path, '^[^/]*/', '') ELSE f.path END AS path, NOT regexp_matches(f.path, '(^/|(^|/)\\.\\.(/|$)|^[A-Za-z]:)') AS safe FROM f JOIN r ON r.project_id = f.project_id WHERE f.path IS NOT NULL""")
def x12_upload_paths(spark: SparkSession, sf: str) -> DataFrame:
    """X-12: paths without the one directory that a whole upload shares, and whether they stay inside it."""
    f = files(spark, sf).where("path is not null")
    roots = f.groupBy("project_id").agg(F.count_distinct(F.split("path", "/")[0]).alias("roots"))
    shared = (F.col("roots") == 1) & F.contains("path", F.lit("/"))
    return f.join(roots, "project_id").select("id", F.when(shared, F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.col("path")).alias("path"), (~F.col("path").rlike(r"(^/|(^|/)\.\.(/|$)|^[A-Za-z]:)")).alias("safe"))


@query("""SELECT hash, contains(content, chr(0)) OR contains(content, chr(65533)) AS looks_binary, CAST(octet_length(encode(content)) AS BIGINT) AS bytes, octet_length(encode(content)) > 6000 AS large, contains(content, chr(13)) AS carriage_returns FROM blobs""")
def e19_content_flags(spark: SparkSession, sf: str) -> DataFrame:
    """E-19: size in bytes, size flag, signs of binary content and of other line ends."""
    c = F.col("content")
    return load(spark, sf, "blobs").select("hash", (F.contains(c, F.lit("\0")) | F.contains(c, F.lit("\ufffd"))).alias("looks_binary"), F.octet_length(c).cast("long").alias("bytes"), (F.octet_length(c) > 6000).alias("large"), F.contains(c, F.lit("\r")).alias("carriage_returns"))


@query(f"""WITH {_FILES}, c AS (SELECT project_id, count_if(classification = 'source') AS sources, count_if(is_test) AS tests, bool_or(regexp_matches(lower(coalesce(name, '')), '^readme')) AS readme, count_if(lines > 1000) AS large, count_if(duplicate_of <> '' AND classification = 'source') AS copies FROM f GROUP BY project_id)
SELECT project_id, unnest(list_filter([CASE WHEN sources >= 5 AND tests = 0 THEN 'no tests' END, CASE WHEN sources >= 10 AND tests > 0 AND tests < 0.1 * sources THEN 'few tests' END, CASE WHEN NOT readme THEN 'no readme' END, CASE WHEN large > 0 THEN 'large files' END, CASE WHEN copies > 0 THEN 'copied sources' END], lambda x: x IS NOT NULL)) AS finding FROM c""")
def r02_structure(spark: SparkSession, sf: str) -> DataFrame:
    """R-02, in part: what a project's files as a whole lack or have too much of."""
    c = files(spark, sf).groupBy("project_id").agg(
        F.count_if(F.col("classification") == "source").alias("sources"), F.count_if(F.col("is_test")).alias("tests"), F.coalesce(F.bool_or(F.lower(F.coalesce("name", F.lit(""))).rlike("^readme")), F.lit(False)).alias("readme"),
        F.count_if(F.col("lines") > 1000).alias("large"), F.count_if((F.col("duplicate_of") != "") & (F.col("classification") == "source")).alias("copies"),
    )
    checks = {"no tests": "sources >= 5 and tests = 0", "few tests": "sources >= 10 and tests > 0 and tests < 0.1 * sources", "no readme": "not readme", "large files": "large > 0", "copied sources": "copies > 0"}
    return c.select("project_id", F.explode(F.array_compact(F.array(*[F.when(F.expr(e), F.lit(n)) for n, e in checks.items()]))).alias("finding"))


@query(f"""WITH {_LIVE}, c AS (SELECT project_id, CAST(count_if(severity = 'Critical') AS BIGINT) AS critical, CAST(count_if(severity = 'High') AS BIGINT) AS high, CAST(count_if(severity = 'Medium') AS BIGINT) AS medium, CAST(count(*) AS BIGINT) AS total FROM live GROUP BY project_id) SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 2 THEN 'high' WHEN high > 0 OR medium > 4 THEN 'medium' ELSE 'low' END AS rating FROM c""")
def a17_rating(spark: SparkSession, sf: str) -> DataFrame:
    """A-17: findings of a project by severity, and a label from the counts."""
    c = live(spark, sf).groupBy("project_id").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "High", "Medium")], F.count("*").alias("total"))
    return c.withColumn("rating", F.when(F.col("critical") > 0, "critical").when(F.col("high") > 2, "high").when((F.col("high") > 0) | (F.col("medium") > 4), "medium").otherwise("low"))


@query("""WITH l AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, last_seen FROM l, n WHERE last_seen < now - INTERVAL 6 HOUR""")
def st08_idle(spark: SparkSession, sf: str) -> DataFrame:
    """ST-08: users without an event in the last six hours of the stream."""
    e = load(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return last.crossJoin(F.broadcast(now)).where(F.col("last_seen") < F.col("now") - F.expr("interval 6 hours")).select("user_id", "last_seen")  # one row


@query(f"""WITH {_FILES} SELECT id, round(least(1.0, coalesce(importance, 0) + CASE WHEN len(exports) > 0 THEN 0.05 ELSE 0 END + CASE WHEN role IN ('api', 'service', 'data') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(name, '^(main|index|app|server)\\.') THEN 0.3 ELSE 0 END), 6) AS importance FROM f""")
def g02_blended_importance(spark: SparkSession, sf: str) -> DataFrame:
    """G-02: importance with what exports, roles and entry points add, 1 at most."""
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    total = F.coalesce("importance", F.lit(0.0)) + plus(F.size("exports") > 0, 0.05) + plus(F.col("role").isin("api", "service", "data"), 0.1) + plus(F.col("name").rlike(r"^(main|index|app|server)\."), 0.3)
    return files(spark, sf).select("id", F.round(F.least(F.lit(1.0), total), 6).alias("importance"))


@query(f"""WITH {_FILES} SELECT project_id, module, arg_min(path, struct_pack(a := CASE role WHEN 'api' THEN 0 WHEN 'service' THEN 1 WHEN 'ui' THEN 2 ELSE 3 END, b := path)) AS path FROM f WHERE module IS NOT NULL AND path IS NOT NULL GROUP BY ALL""")
def u03_most_specific(spark: SparkSession, sf: str) -> DataFrame:
    """U-03: one entry per project and module, of the most specific role, then of the first path."""
    rank = F.when(F.col("role") == "api", 0).when(F.col("role") == "service", 1).when(F.col("role") == "ui", 2).otherwise(3)
    return files(spark, sf).where("module is not null and path is not null").groupBy("project_id", "module").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


@query(f"""WITH {_FILES}, {_W}, r AS (SELECT a.area AS area, a.role FROM (SELECT area, role, count(*) AS n FROM f WHERE area IS NOT NULL AND role IS NOT NULL GROUP BY ALL) a QUALIFY row_number() OVER (PARTITION BY area ORDER BY n DESC, role) = 1), e AS (SELECT f.role AS src, string_split(i, '/')[1] AS area FROM (SELECT role, unnest(imports) AS i FROM f WHERE role IS NOT NULL) f)
SELECT e.src AS from_lane, r.role AS to_lane, CAST(count(*) AS BIGINT) AS weight FROM e JOIN r USING (area) GROUP BY ALL""")
def b19_lane_links(spark: SparkSession, sf: str) -> DataFrame:
    """B-19: how often files of one role import areas of another."""
    f = files(spark, sf)
    lanes = op.mode_by(f.where("area is not null and role is not null"), ["area"], "role").select("area", F.col("role").alias("to_lane"))
    used = f.where("role is not null").select(F.col("role").alias("from_lane"), F.explode("imports").alias("i")).select("from_lane", F.split("i", "/")[0].alias("area"))
    return used.join(lanes, "area").groupBy("from_lane", "to_lane").agg(F.count("*").alias("weight"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS at_us, value, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, CAST(count_if(value < 0) AS BIGINT) AS negative, CAST(count_if(at_us < before) AS BIGINT) AS backwards, CAST(count_if(at_us = before) AS BIGINT) AS repeated, CAST(max(at_us - before) AS BIGINT) AS longest_gap FROM e GROUP BY user_id""")
def b31_timeline_checks(spark: SparkSession, sf: str) -> DataFrame:
    """B-14, B-31: what breaks a timeline's order, by user."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = load(spark, sf, "events").withColumn("at_us", at).withColumn("before", F.lag(at).over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.groupBy("user_id").agg(F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.col("at_us") < F.col("before")).alias("backwards"), F.count_if(F.col("at_us") == F.col("before")).alias("repeated"), F.max(F.col("at_us") - F.col("before")).alias("longest_gap"))


@query(f"""WITH {_FILES}, {_W} SELECT DISTINCT regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || '["' || src || '"] --> ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') || '["' || dst || '"]' AS line FROM weighted WHERE src IS NOT NULL AND dst IS NOT NULL""")
def k11_diagram(spark: SparkSession, sf: str) -> DataFrame:
    """K-11, in part: a diagram's lines, one per link."""
    node = lambda c: F.concat(fn.node_id(F.col(c)), F.lit('["'), F.col(c), F.lit('"]'))
    return weighted(spark, sf).where("src is not null and dst is not null").select(F.concat_ws(" --> ", node("src"), node("dst")).alias("line")).distinct()



QUERIES, ORACLES = query.queries, query.oracles
