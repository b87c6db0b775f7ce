"""Queries of graphs, retrieval, source analysis, streams and exports, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as fn
from strataloom.operators import captions, extract, graph, retrieval, review, rules
from strataloom.operators.components import connected_components
from strataloom.operators.relational import top_k
from strataloom.plans.registry import Registry
from strataloom.plans.relational import _LIVE, _RANK, live, rank_of
from strataloom.plans.text import _WORDS
from strataloom.sources import sinks
from strataloom.streaming import jobs
from strataloom.tables import load

query = Registry()

# --- graph ---------------------------------------------------------------------------------------------------------


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Module to imported area, area to imported name."""
    f = load(spark, sf, "files").where("module is not null").select("module", F.explode("imports").alias("i"))
    a, b = F.split("i", "/")[0], F.split("i", "/")[1]
    return f.select(F.explode(F.array(F.struct(F.col("module").alias("src"), a.alias("dst")), F.struct(a.alias("src"), b.alias("dst")))).alias("e")).select("e.*").where("dst is not null").distinct()


_EDGES = """e AS (SELECT DISTINCT src, dst FROM (SELECT module AS src, string_split(i, '/')[1] AS dst FROM (SELECT module, unnest(imports) AS i FROM files WHERE module IS NOT NULL)
 UNION ALL SELECT string_split(i, '/')[1], string_split(i, '/')[2] FROM (SELECT unnest(imports) AS i FROM files WHERE module IS NOT NULL)) WHERE dst IS NOT NULL)"""
_NODES = "v AS (SELECT DISTINCT src AS node FROM e UNION SELECT dst FROM e)"


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


_RANKS = "".join(f", r{i + 1} AS MATERIALIZED (SELECT v.node, 0.15 / (SELECT count(*) FROM v) + 0.85 * coalesce(sum(r.rank / d.deg), 0) AS rank FROM v LEFT JOIN e ON e.dst = v.node LEFT JOIN d ON d.src = e.src LEFT JOIN r{i} r ON r.node = e.src GROUP BY v.node)" for i in range(20))


@query(f"WITH {_EDGES}, {_NODES}, d AS (SELECT src, count(*) AS deg FROM e GROUP BY src), r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM v) AS rank FROM v){_RANKS} SELECT node, round(rank / (SELECT max(rank) FROM r20), 9) AS rank FROM r20")
def g01_importance(spark: SparkSession, sf: str) -> DataFrame:
    """G-01: importance of modules and names after 20 rounds."""
    e = edges(spark, sf)
    return graph.importance(nodes(e), e).select("node", F.round("rank", 9).alias("rank"))


@query(f"WITH {_EDGES}, {_NODES} SELECT node, CAST((SELECT count(*) FROM e WHERE dst = node) AS BIGINT) AS inbound, CAST((SELECT count(*) FROM e WHERE src = node) AS BIGINT) AS outbound FROM v")
def a04_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """A-04: in- and outbound links of every node."""
    e = edges(spark, sf)
    return graph.degrees(nodes(e), e)


@query(f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT module AS start FROM files WHERE module IS NOT NULL), w AS (SELECT start, start AS node, 0 AS steps FROM s UNION SELECT w.start, e.dst, w.steps + 1 FROM w JOIN e ON e.src = w.node WHERE w.steps < 2)
SELECT start, node, CAST(min(steps) AS BIGINT) AS steps FROM w GROUP BY ALL""")
def g03_reach(spark: SparkSession, sf: str) -> DataFrame:
    """G-03, G-12: what each module reaches within two steps."""
    starts = load(spark, sf, "files").where("module is not null").select(F.col("module").alias("start")).distinct()
    return graph.reach(edges(spark, sf), starts, 2).withColumn("steps", F.col("steps").cast("long"))


@query(f"""WITH {_EDGES}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM e), b AS (SELECT src, dst FROM k WHERE n <= 20)
SELECT DISTINCT x.src AS start, y.dst AS node FROM b x JOIN b y ON x.dst = y.src WHERE x.src <> y.dst""")
def g04_two_hops(spark: SparkSession, sf: str) -> DataFrame:
    """G-04: two hops along the first 20 links of each node."""
    b = top_k(edges(spark, sf), ["src"], ["dst"], 20).select("src", "dst")
    far = b.select("src", F.col("dst").alias("mid")).join(b.select(F.col("src").alias("mid"), "dst"), "mid")
    return far.where("src <> dst").select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct()


@query("""WITH RECURSIVE l AS (SELECT DISTINCT project_id || '/' || path AS a, hash AS b FROM files WHERE hash IS NOT NULL), m AS (SELECT b, min(a) AS low FROM l GROUP BY b)
SELECT DISTINCT l.a AS node, m.low AS component FROM l JOIN m USING (b)""")
def g06_components(spark: SparkSession, sf: str) -> DataFrame:
    """G-06: files linked by equal content, with the smallest of each group."""
    f = load(spark, sf, "files").where("hash is not null").select(F.concat_ws("/", "project_id", "path").alias("a"), "hash").distinct()
    low = f.groupBy("hash").agg(F.min("a").alias("b"))
    pairs = f.join(low, "hash")
    linked = connected_components(pairs.where("a <> b").select("a", "b"))
    alone = f.select(F.col("a").alias("node")).distinct().join(linked, "node", "left")
    return alone.select("node", F.coalesce("component", "node").alias("component"))


@query(f"WITH {_EDGES}, {_NODES}, u AS (SELECT dst AS node, count(DISTINCT src) AS users FROM e GROUP BY dst) SELECT node, CAST(users AS BIGINT) AS users FROM u WHERE users >= 0.05 * (SELECT count(*) FROM v)")
def g10_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """G-10: nodes that a twentieth of all others use."""
    e = edges(spark, sf)
    total = nodes(e).agg(F.count("*").alias("n"))
    return e.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("users")).crossJoin(F.broadcast(total)).where("users >= 0.05 * n").select("node", "users")  # one row


# --- retrieval -----------------------------------------------------------------------------------------------------

_ASKED = f"q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter({_WORDS.format('question')}, lambda x: NOT list_contains({list(fn.STOP_WORDS)!r}, x))) AS term FROM eval_items)"


@query(f"""WITH {_ASKED}, d AS (SELECT doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), t AS (SELECT count(*) AS n, avg(len(w)) AS avg_length FROM d),
p AS (SELECT id, len(w) AS length, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT q.query_id, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.6 + 0.6 * length / avg_length))) AS score, count(*) AS matched FROM p JOIN f USING (term) JOIN q USING (term), t GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, CAST(matched AS BIGINT) AS matched, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS BIGINT) AS rank FROM s QUALIFY rank <= 10""")
def t02_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """T-01, T-02, A-13: the ten best documents of every evaluation question (top-k is the feature)."""
    kept = F.array_except(fn.words(F.col("question")), F.array(*[F.lit(w) for w in fn.STOP_WORDS]))
    asked = load(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(kept).alias("term"))
    best = retrieval.bm25(load(spark, sf, "documents"), "doc_id", "text", asked)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), "matched", F.col("rank").cast("long").alias("rank"))


_BM25 = f"""{_ASKED}, d AS (SELECT doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), t AS (SELECT count(*) AS n, avg(len(w)) AS avg_length FROM d),
p AS (SELECT id, len(w) AS length, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT q.query_id, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.6 + 0.6 * length / avg_length))) AS score, count(*) AS matched FROM p JOIN f USING (term) JOIN q USING (term), t GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 50)"""


@query(f"""WITH {_BM25}, a AS (SELECT query_id, list(DISTINCT term) AS terms FROM q GROUP BY ALL), x AS (SELECT b.query_id, b.id, b.score, b.matched, a.terms, lower(coalesce(d.title, '')) AS hay, lower(i.answer) AS phrase FROM b JOIN a USING (query_id) JOIN documents d ON d.doc_id = b.id JOIN eval_items i ON i.item_id = b.query_id),
y AS (SELECT *, len(list_filter(terms, lambda t: contains(hay, t))) AS inside FROM x), z AS (SELECT query_id, id, least(matched + inside, len(terms)) AS matched, (score + 1.2 * inside + CASE WHEN length(phrase) >= 2 AND contains(hay, phrase) THEN 4 ELSE 0 END) * (0.5 + 0.5 * least(matched + inside, len(terms)) / len(terms)) AS score FROM y)
SELECT query_id, id, round(score, 6) AS score, CAST(matched AS BIGINT) AS matched, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS BIGINT) AS rank FROM z QUALIFY rank <= 10""")
def t04_boosted(spark: SparkSession, sf: str) -> DataFrame:
    """T-03, T-04: the 50 best documents of a question re-ranked by terms in their titles and by coverage (top-k is the feature)."""
    items, docs = load(spark, sf, "eval_items"), load(spark, sf, "documents")
    kept = F.array_except(fn.words(F.col("question")), F.array(*[F.lit(w) for w in fn.STOP_WORDS]))
    asked = items.select(F.col("item_id").alias("query_id"), F.explode(kept).alias("term"), F.col("answer").alias("phrase"))
    best = retrieval.bm25(docs, "doc_id", "text", asked, 50)
    out = retrieval.boosted(best, docs, "doc_id", "title", asked)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("matched").cast("long").alias("matched"), F.col("rank").cast("long").alias("rank"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), l AS (SELECT q.vec_id AS query_id, v.vec_id AS id, CAST(1 + v.vec_id % 7 AS DOUBLE) AS score FROM v q JOIN v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
n AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0), k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 20), m AS (SELECT * FROM k WHERE similarity >= 0.2), x AS (SELECT query_id, id, score / greatest(max(score) OVER (PARTITION BY query_id), 1e-9) AS lex FROM l)
SELECT coalesce(x.query_id, m.query_id) AS query_id, coalesce(x.id, m.id) AS id, round(coalesce(lex, 0) + 0.8 * coalesce(similarity, 0) + 0.25 * (coalesce(x.id, m.id) % 10) / 10.0, 6) AS score FROM x FULL JOIN m ON x.query_id = m.query_id AND x.id = m.id""")
def t05_blended(spark: SparkSession, sf: str) -> DataFrame:
    """T-05: lexical scores, cosines above a cut and importance in one score, for every fiftieth vector against all."""
    v = load(spark, sf, "embeddings")
    asked = v.where("vec_id % 50 = 0")
    same = asked.select(F.col("vec_id").alias("query_id"), "label").join(v.select(F.col("vec_id").alias("id"), "label"), "label").where("id <> query_id")
    lexical = same.select("query_id", "id", (F.col("id") % 7 + 1).cast("double").alias("score"))
    near = retrieval.nearest(v, "vec_id", "embedding", asked, 20)
    weights = v.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10 / 10).alias("importance"))
    return retrieval.blended(lexical, near, weights, 0.2).select("query_id", "id", F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT DISTINCT ON (id) * FROM files), n AS (SELECT DISTINCT path AS id, unnest(exports) AS name, importance FROM f WHERE path IS NOT NULL), q AS (SELECT DISTINCT name AS query_id, CASE WHEN length(name) % 2 = 0 THEN upper(name) ELSE name END AS name FROM n)
SELECT q.query_id, arg_min(n.id, struct_pack(a := n.name <> q.name, b := -coalesce(n.importance, 0), c := n.id)) AS id, NOT bool_and(n.name <> q.name) AS exact FROM q JOIN n ON lower(n.name) = lower(q.name) GROUP BY q.query_id""")
def t11_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """T-11: names to files, spelled alike or but for case, the most important first."""
    f = load(spark, sf, "files").dropDuplicates(["id"]).where("path is not null")
    names = f.select(F.col("path").alias("id"), F.explode("exports").alias("name"), "importance").distinct()
    asked = names.select(F.col("name").alias("query_id"), F.when(F.length("name") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("name")).distinct()
    return retrieval.looked_up(names, asked)


@query(f"""WITH {_LIVE}, h AS (SELECT project_id AS query_id, file_path AS path, CAST(start_line AS BIGINT) AS line, max(CAST(4 - ({_RANK}) AS BIGINT)) AS score FROM live WHERE file_path IS NOT NULL AND start_line IS NOT NULL GROUP BY ALL), p AS (SELECT *, greatest(line - 10, 1) AS first_line, line + 10 AS last_line FROM h),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, path, first_line // 20 ORDER BY score DESC, line) = 1) SELECT query_id, path, first_line, last_line, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, line) AS BIGINT) AS position FROM b QUALIFY position <= 14""")
def t08_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """T-08: the 14 places of each project to show first (the cut is the feature), one per file and 20 lines."""
    f = live(spark, sf).where("file_path is not null and start_line is not null")
    hits = f.groupBy(F.col("project_id").alias("query_id"), F.col("file_path").alias("path"), F.col("start_line").cast("long").alias("line")).agg(F.max((4 - rank_of()).cast("long")).alias("score"))
    return retrieval.excerpts(hits).withColumn("position", F.col("position").cast("long"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS BIGINT) AS rank FROM s QUALIFY rank <= 5""")
def t05_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """X-08, T-05: the five nearest vectors of every fiftieth vector, against all."""
    v = load(spark, sf, "embeddings")
    return retrieval.nearest(v, "vec_id", "embedding", v.where("vec_id % 50 = 0")).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH l AS (SELECT hash AS id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM blobs WHERE contains(lower(content), 'return') AND contains(lower(content), 'ledger'))
SELECT id, line_no, line FROM l WHERE contains(lower(line), 'return') AND contains(lower(line), 'ledger') QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no) <= 3""")
def t07_code_lines(spark: SparkSession, sf: str) -> DataFrame:
    """T-07: lines that hold all words, three per text (the cut is the feature)."""
    return retrieval.code_lines(load(spark, sf, "blobs"), "hash", "content", ["return", "ledger"]).withColumn("line_no", F.col("line_no").cast("long"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct({_WORDS.format("coalesce(text, '')")}) AS w FROM documents), e AS (SELECT unnest(w) AS term FROM t) SELECT term, CAST(count(*) AS BIGINT) AS df FROM e GROUP BY term""")
def a13_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """A-13: in how many documents each word stands."""
    w = load(spark, sf, "documents").select(F.explode(F.array_distinct(fn.words(F.coalesce("text", F.lit(""))))).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("df"))


# --- source analysis -----------------------------------------------------------------------------------------------


def sources(spark: SparkSession, sf: str, languages: tuple[str, ...]) -> DataFrame:
    """(id, language, content) of the different contents of some languages; a content is read once per language."""
    f = load(spark, sf, "files").where(F.col("language").isin(*languages) & F.col("hash").isNotNull()).select("hash", "language").distinct()
    return f.join(load(spark, sf, "blobs"), "hash").select(F.col("hash").alias("id"), "language", "content")


# The rules that SQL can express (no blanked literals, no look-around, no surroundings), typed again to check the table.
_PLAIN = {
    "sql-concat": r"(?i)[\x22\x27`]\s*(select|insert\s+into|update|delete\s+from)\s[^\x22\x27`]*[\x22\x27`]\s*(\+|%|\.format)|`\s*(select|insert|update|delete)\s[^`]*\$\{",
    "tls-verify-off": r"rejectUnauthorized\s*:\s*false|\bverify\s*=\s*False\b|InsecureSkipVerify\s*:\s*true|NODE_TLS_REJECT_UNAUTHORIZED",
    "weak-hash": r"(?i)\b(md5|sha1)\s*\(|createHash\(\s*[\x22\x27](md5|sha1)[\x22\x27]|getInstance\(\s*\x22(md5|sha-?1)\x22",
    "todo-fixme": r"\b(TODO|FIXME|HACK|XXX)\b",
    "console-log": r"\bconsole\.(log|debug|info)\s*\(",
    "select-star": r"(?i)\bselect\s+\*\s+from\s",
    "float-money": r"(?i)\b(price|amount|balance|invoice_?total)\w*\s*(:\s*(float|double)\b|=\s*(float\(|parseFloat\())",
}
_ONCE = ("todo-fixme", "console-log", "select-star", "float-money")


def _plain_sql() -> str:
    parts = []
    for name, pattern in _PLAIN.items():
        where = [f"regexp_matches(line, '{pattern}')"] + (["language IN ('TypeScript', 'JavaScript')"] if name == "console-log" else []) + ([] if name == "todo-fixme" else ["NOT regexp_matches(line, '^\\s*(//|#|\\*|/\\*|<!--)')"])
        parts.append(f"SELECT id, '{name}' AS rule, {str(name in _ONCE).upper()} AS once, line_no FROM l WHERE {' AND '.join(where)}")
    return " UNION ALL ".join(parts)


_SCANNED = ("TypeScript", "JavaScript", "Python", "Go", "SQL")


@query(f"""WITH c AS (SELECT DISTINCT f.hash AS id, f.language, b.content FROM files f JOIN blobs b USING (hash) WHERE f.language IN {_SCANNED!r}), l AS (SELECT id, language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM c), h AS (SELECT DISTINCT * FROM ({_plain_sql()})),
r AS (SELECT *, row_number() OVER (PARTITION BY id, rule ORDER BY line_no) AS n, count(*) OVER (PARTITION BY id, rule) AS total FROM h) SELECT id, rule, CAST(line_no AS BIGINT) AS line_no, CAST(CASE WHEN once THEN total - 1 ELSE 0 END AS BIGINT) AS more FROM r WHERE NOT once OR n = 1""")
def r01_plain_rules(spark: SparkSession, sf: str) -> DataFrame:
    """R-01, without its limits: the rules over plain lines, of every length and number."""
    some = [r for r in rules.RULES if r.name in _PLAIN]
    found = rules.scan(sources(spark, sf, _SCANNED), some, per_file=None, longest=None, most_lines=None)
    return found.select("id", "rule", F.col("line_no").cast("long").alias("line_no"), F.col("more").cast("long").alias("more"))


@query()
def r01_rules(spark: SparkSession, sf: str) -> DataFrame:
    """R-01, A-20: all rules over all source contents that are not only tests', with the scan's usual limits."""
    f = load(spark, sf, "files").where(F.col("language").isin(*_SCANNED) & F.col("hash").isNotNull()).groupBy("hash", "language").agg(F.min("path").alias("path"), F.min(F.coalesce("is_test", F.lit(False))).alias("is_test"))
    texts = f.join(load(spark, sf, "blobs").select("hash", "content"), "hash").withColumnRenamed("hash", "id")
    return rules.scan(texts)


@query()
def e03_python_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """E-01, E-03, E-11, E-18: classes and functions of all Python contents, with complexity."""
    return extract.python_symbols(sources(spark, sf, ("Python",)))


@query("""WITH c AS (SELECT DISTINCT f.hash AS id, b.content FROM files f JOIN blobs b USING (hash) WHERE f.language = 'SQL'), s AS (SELECT id, unnest(regexp_extract_all(content, 'CREATE TABLE (\\w+ \\([^;]*)\\);', 1)) AS s FROM c)
SELECT id, string_split(s, ' ')[1] AS table_name, CAST(len(regexp_extract_all(s, '\\n\\s+\\w+ [A-Z]')) AS BIGINT) AS n_columns FROM s""")
def e12_sql_tables(spark: SparkSession, sf: str) -> DataFrame:
    """E-12: tables that SQL contents create."""
    return extract.sql_tables(sources(spark, sf, ("SQL",))).withColumn("n_columns", F.col("n_columns").cast("long"))


@query("""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT id, line_no, CAST(length(regexp_extract(line, '^(#+)', 1)) AS BIGINT) AS level, trim(regexp_extract(line, '^#+ ([^\\r]*)', 1)) AS title FROM l WHERE regexp_matches(line, '^#{1,6} ')""")
def e15_headings(spark: SparkSession, sf: str) -> DataFrame:
    """E-15: headings of all documents."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return extract.headings(docs).withColumn("level", F.col("level").cast("long")).withColumn("line_no", F.col("line_no").cast("long"))


_SETTINGS = [r"process\.env\.([A-Z][A-Z0-9_]+)", r'os\.environ\["([A-Z][A-Z0-9_]+)"\]', r'os\.Getenv\("([A-Z][A-Z0-9_]+)"\)', r"\$\{([A-Z][A-Z0-9_]+)\}", r"(?m)^(?:export )?([A-Z][A-Z0-9_]+)="]


@query("WITH n AS (" + " UNION ALL ".join(f"SELECT hash AS id, unnest(regexp_extract_all(content, '{p}', 1)) AS name FROM blobs" for p in _SETTINGS) + ") SELECT name, CAST(count(DISTINCT id) AS BIGINT) AS n_files FROM n GROUP BY name")
def d03_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Environment variables in five forms (see the README) and the number of contents that name them."""
    found = extract.settings(load(spark, sf, "blobs").where("content is not null").select(F.col("hash").alias("id"), "content"))
    return found.groupBy("name").agg(F.count_distinct("id").alias("n_files"))


@query("""WITH d AS (SELECT hash, unnest(regexp_extract_all(content, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS value FROM blobs) SELECT hash, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT value) AS BIGINT) AS n_distinct FROM d GROUP BY hash""")
def pii02_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """P-02: e-mail addresses in contents."""
    found = load(spark, sf, "blobs").select("hash", F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))).alias("value"))
    return found.groupBy("hash").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"))


@query()
def u07_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """U-07, V-03: findings of a file that overlap and read alike, the worst stays."""
    f = live(spark, sf).where("file_path is not null").withColumn("rank", rank_of())
    return review.deduped(f.select("id", "project_id", "file_path", "title", "start_line", "end_line", "rank"), ["project_id", "file_path"])


@query("""WITH c AS (SELECT DISTINCT ON (f.id) f.id AS claim_id, f.start_line, trim(f.evidence) AS q, b.content FROM findings f JOIN (SELECT project_id, path, min(hash) AS hash FROM files WHERE hash IS NOT NULL GROUP BY ALL) x ON x.project_id = f.project_id AND x.path = f.file_path JOIN blobs b USING (hash)),
l AS (SELECT claim_id, start_line, q, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM c WHERE q <> '' AND contains(content, q))
SELECT c.claim_id, CAST((SELECT n FROM l WHERE l.claim_id = c.claim_id AND contains(line, l.q) ORDER BY abs(n - l.start_line), n LIMIT 1) AS BIGINT) AS line_no FROM c""")
def x33_reanchor(spark: SparkSession, sf: str) -> DataFrame:
    """X-33, V-02: the line of a finding's file that holds its evidence."""
    paths = load(spark, sf, "files").where("hash is not null").groupBy("project_id", F.col("path").alias("file_path")).agg(F.min("hash").alias("hash"))
    claims = load(spark, sf, "findings").dropDuplicates(["id"]).join(paths, ["project_id", "file_path"]).join(load(spark, sf, "blobs").select("hash"), "hash", "left_semi")
    claims = claims.select(F.col("id").alias("claim_id"), "hash", "start_line", F.coalesce("evidence", F.lit("")).alias("quote"))
    return review.reanchored(claims, load(spark, sf, "blobs").select("hash", "content"), ["hash"]).select("claim_id", F.col("line_no").cast("long").alias("line_no"))


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    ms = F.col("event_id") * 400
    return e.select(F.col("user_id").alias("track"), F.col("event_type").alias("section"), F.col("event_id").cast("int").alias("idx"), "event_type", ms.alias("start_ms"), (ms + 300).alias("end_ms")).withColumnRenamed("event_type", "text")


@query()
def w12_cues(spark: SparkSession, sf: str) -> DataFrame:
    """W-12, B-12: timed words folded into cues."""
    return captions.cues(_timed(spark, sf))


@query()
def k12_vtt(spark: SparkSession, sf: str) -> DataFrame:
    """K-12, S-14: a caption file per track."""
    return captions.vtt(captions.cues(_timed(spark, sf)))


# --- jobs and streams ----------------------------------------------------------------------------------------------


@query("""WITH j AS (SELECT id, max_by(status, struct_pack(t := coalesce(heartbeat_at, started_at, created_at), s := status)) AS status, any_value(project_id) AS project_id, min(created_at) AS created_at FROM video_jobs GROUP BY id) SELECT project_id, min_by(id, struct_pack(a := created_at, b := id)) AS next_job FROM j WHERE status = 'queued' GROUP BY project_id""")
def st01_next_job(spark: SparkSession, sf: str) -> DataFrame:
    """ST-01, ST-04: the oldest queued job of each project, a job's last state counting."""
    j = load(spark, sf, "video_jobs").groupBy("id").agg(F.max_by("status", F.struct(F.coalesce("heartbeat_at", "started_at", "created_at"), "status")).alias("status"), F.first("project_id").alias("project_id"), F.min("created_at").alias("created_at"))
    return j.where("status = 'queued'").groupBy("project_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("next_job"))


@query("""WITH j AS (SELECT id, max_by(status, struct_pack(t := coalesce(heartbeat_at, started_at, created_at), s := status)) AS status, max(heartbeat_at) AS heartbeat_at FROM video_jobs GROUP BY id) SELECT id, heartbeat_at FROM j WHERE status = 'running' AND heartbeat_at < 1767225600000 - 90000""")
def st02_stale(spark: SparkSession, sf: str) -> DataFrame:
    """ST-02: running jobs without a heartbeat for 90 seconds."""
    return jobs.stale(load(spark, sf, "video_jobs"), 1_767_225_600_000)


_CHANGES = "WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, event_type, before FROM e WHERE before IS NULL OR before <> event_type"


@query(_CHANGES)
def st05_changes(spark: SparkSession, sf: str) -> DataFrame:
    """ST-05: a change feed in batch."""
    return jobs.changes(load(spark, sf, "events"))


@query(_CHANGES)
def st05_change_stream(spark: SparkSession, sf: str) -> DataFrame:
    """ST-05: the same feed from a stream with state."""
    load(spark, sf, "events")
    return jobs.run_to_end(jobs.change_stream(jobs.read_stream(spark, sf, "events")))


_TUMBLING = "SELECT time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') AS began, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"


@query(_TUMBLING)
def st07_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """An addition: hourly windows in batch."""
    return jobs.tumbling(load(spark, sf, "events"), 60)


@query(_TUMBLING)
def st07_tumbling_stream(spark: SparkSession, sf: str) -> DataFrame:
    """ST-07: the same windows from a stream, written as snapshots."""
    load(spark, sf, "events")
    return jobs.run_to_end(jobs.tumbling(jobs.read_stream(spark, sf, "events"), 60), "complete")


@query("WITH s AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTE]) AS began FROM events) SELECT began, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY began")
def st07_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """An addition: hourly windows every half hour."""
    return jobs.sliding(load(spark, sf, "events"), 60, 30)


# --- exports -------------------------------------------------------------------------------------------------------


@query(f"""WITH {_LIVE} SELECT id, to_json(struct_pack(id := id, project_id := project_id, severity := severity, title := title, file_path := file_path, start_line := start_line)) AS json FROM live""")
def k06_json(spark: SparkSession, sf: str) -> DataFrame:
    """K-06: every finding as a JSON document."""
    return sinks.json_rows(live(spark, sf).select("id", "project_id", "severity", "title", "file_path", "start_line"), "id")


@query(f"""WITH {_LIVE}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {_RANK}, code, id) AS n FROM live)
SELECT project_id, '| severity | code | title |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || replace(coalesce(severity, ''), '|', '\\|') || ' | ' || replace(coalesce(code, ''), '|', '\\|') || ' | ' || replace(coalesce(title, ''), '|', '\\|') || ' |', chr(10) ORDER BY n) AS markdown FROM r WHERE n <= 40 GROUP BY project_id""")
def k07_report(spark: SparkSession, sf: str) -> DataFrame:
    """K-07, B-26, B-27: a Markdown table of the 40 worst findings of each project (the cut is the report's)."""
    return sinks.markdown_table(live(spark, sf), "project_id", ["severity", "code", "title"], [rank_of(), "code", "id"], 40)


QUERIES, ORACLES = query.queries, query.oracles
