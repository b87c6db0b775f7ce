"""Queries of the text operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import credentials, handwritten, leakage, mixing, near_duplicates, sentences, shared_spans, splitting, syntax
from strataloom.operators.components import connected_components
from strataloom.tables import load


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file that is not hand-written, with what speaks against it."""
    found = handwritten.machine_written(load(spark, sf_dir, "files"), load(spark, sf_dir, "blobs"))
    return found.withColumnRenamed("id", "file_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_evidence(spark, sf_dir).select("file_id").distinct()


def p3_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file whose content is not valid in its language, with the first fault."""
    found = syntax.unparsable(load(spark, sf_dir, "files"), load(spark, sf_dir, "blobs"))
    return found.withColumnRenamed("id", "file_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_faults(spark, sf_dir).select("file_id").distinct()


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid files of all files with content, per project and language."""
    bad = p3_found(spark, sf_dir).withColumn("bad", F.lit(1))
    blobs = load(spark, sf_dir, "blobs").where("content is not null").select("hash").distinct()
    files = load(spark, sf_dir, "files").where(F.col("language").isin(*syntax.LANGUAGES)).select(F.col("id").alias("file_id"), "project_id", "language", "hash").distinct()
    counted = files.join(blobs, "hash", "left_semi").join(bad, "file_id", "left").groupBy("project_id", "language").agg(F.count("*").alias("n_files"), F.sum(F.coalesce("bad", F.lit(0))).alias("n_invalid"))
    return counted.withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(load(spark, sf_dir, "blobs"), "hash", "content").withColumnRenamed("id", "hash")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = p4_pieces(spark, sf_dir).where("piece_no = 1").select("hash")
    return load(spark, sf_dir, "files").where("id is not null").join(cut, "hash", "left_semi").select(F.col("id").alias("file_id")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.sharing_ids(load(spark, sf_dir, "blobs"), "hash", "content").select(F.col("id").alias("hash"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each blob also stands in another."""
    return shared_spans.shared_spans(load(spark, sf_dir, "blobs"), "hash", "content").withColumnRenamed("id", "hash")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs linked by shared stretches, with the smallest hash of each group."""
    return shared_spans.sharing_groups(load(spark, sf_dir, "blobs"), "hash", "content").select(F.col("id").alias("hash"), F.col("group").alias("group_hash"))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of blobs that near-copies exist of, by cluster, and which of them are to be removed."""
    return shared_spans.paragraph_clusters(load(spark, sf_dir, "blobs"), "hash", "content").withColumnRenamed("id", "hash")


FINDING_TEXTS = ["title", "what_happens", "remediation"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pairs = near_duplicates.near_duplicates(load(spark, sf_dir, "findings"), "id", FINDING_TEXTS)
    return near_duplicates.record_pairs(members, pairs).select(F.col("a").alias("finding_a"), F.col("b").alias("finding_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding with its group (linked directly or through others) and the number of near classes."""
    members, pairs = near_duplicates.near_duplicates(load(spark, sf_dir, "findings"), "id", FINDING_TEXTS)
    classes = members.groupBy("rep").agg(F.min("id").alias("class_id"))
    groups = connected_components(pairs).withColumnRenamed("node", "rep")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = classes.join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = out.join(out.groupBy("component").agg(F.min("class_id").alias("group_id")), "component").join(links, "rep", "left")
    return members.join(named, "rep").select(F.col("id").alias("finding_id"), "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place of a credential in a blob."""
    return credentials.credentials(load(spark, sf_dir, "blobs"), "hash", "content").withColumnRenamed("id", "hash")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_places(spark, sf_dir).select("hash", "line_no").distinct()


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blobs that hold credentials, with the values masked."""
    blobs = load(spark, sf_dir, "blobs")
    places = credentials.credentials(blobs, "hash", "content")
    return credentials.redacted(blobs, "hash", "content", places).withColumnRenamed("id", "hash")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked item by document, whether word for word (``exact``) or with replaced units between equal ones."""
    found = leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))
    return leakage.leaked(found)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("exact").select("doc_id", "item_id").distinct()


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents with their repeat counts, in order of their virtual finish time."""
    drawn, _ = mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))
    return drawn.withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual token share of each source."""
    _, shares = mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))
    return shares


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(load(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_sentences(spark, sf_dir).select("doc_id", "start_char").distinct()


QUERIES = {
    "p1_found": p1_found, "p1_evidence": p1_evidence, "p3_found": p3_found, "p3_faults": p3_faults, "p3_rates": p3_rates, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_shares": p5_shares, "p5_groups": p5_groups, "p5_paragraphs": p5_paragraphs, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p7_places": p7_places, "p7_redacted": p7_redacted, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_sentences": p10_sentences}
_WINDOWS = """w AS (SELECT DISTINCT b.hash, i, hash(substr(b.content, i, 240)) AS h FROM (SELECT DISTINCT hash, content FROM blobs WHERE content IS NOT NULL) b, LATERAL (SELECT unnest(range(1, length(b.content) - 238)) AS i)),
t AS (SELECT h FROM w GROUP BY h HAVING min(hash) <> max(hash)), s AS (SELECT hash, i FROM w WHERE h IN (SELECT h FROM t))"""

ORACLES: dict[str, str] = {
    "p4_found": "SELECT DISTINCT f.id AS file_id FROM files f JOIN blobs b ON b.hash = f.hash WHERE f.id IS NOT NULL AND length(b.content) > 6000",
    "p5_found": f"WITH {_WINDOWS} SELECT DISTINCT hash FROM s",
    "p5_shares": f"""WITH {_WINDOWS}, c AS (SELECT hash, least(240, coalesce(lead(i) OVER (PARTITION BY hash ORDER BY i) - i, 240)) AS n FROM s)
SELECT b.hash, b.n_chars, coalesce((SELECT sum(n) FROM c WHERE c.hash = b.hash), 0) AS shared_chars FROM (SELECT hash, max(coalesce(length(content), 0)) AS n_chars FROM blobs GROUP BY hash) b""",
    "p6_found": r"""WITH t AS (SELECT DISTINCT id, regexp_extract_all(lower(concat_ws(chr(10), title, what_happens, remediation)), '[\p{L}\p{N}]+') AS w FROM findings),
e AS (SELECT id, n, word, row_number() OVER (PARTITION BY id, word) AS k FROM (SELECT id, len(w) AS n, unnest(w) AS word FROM t))
SELECT a.id AS finding_a, b.id AS finding_b FROM e a JOIN e b ON a.word = b.word AND a.k = b.k AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 10 >= greatest(a.n, b.n) * 8""",
    "p8_found": r"""WITH i AS (SELECT item_id, coalesce(lang IN ('zh', 'ja'), FALSE) AS cjk, lower(text) AS t FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w FROM i WHERE NOT cjk), dw AS (SELECT doc_id, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w FROM d),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM iw)), dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM dw)),
ic AS (SELECT item_id, regexp_replace(t, '[^\p{L}\p{N}]', '', 'g') AS s FROM i WHERE cjk), dc AS (SELECT doc_id, regexp_replace(t, '[^\p{L}\p{N}]', '', 'g') AS s FROM d),
ih AS (SELECT DISTINCT item_id, substr(s, k, 30) AS g FROM (SELECT *, unnest(range(1, length(s) - 28)) AS k FROM ic)), dh AS (SELECT DISTINCT doc_id, substr(s, k, 30) AS g FROM (SELECT *, unnest(range(1, length(s) - 28)) AS k FROM dc))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g) UNION SELECT DISTINCT doc_id, item_id FROM dh JOIN ih USING (g)""",
}
