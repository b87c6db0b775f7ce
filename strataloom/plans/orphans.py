"""Queries of problem 2: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import orphans as op
from strataloom.tables import load


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    jobs, explanations = load(spark, sf_dir, "video_jobs"), load(spark, sf_dir, "explanations")
    files = load(spark, sf_dir, "files").select("id", "project_id", "path", "duplicate_of")
    began = load(spark, sf_dir, "projects").groupBy(F.col("id").alias("project_id")).agg(F.min("created_at").alias("project_created_at"))
    copies = files.where(F.col("duplicate_of") != "").join(began, "project_id", "left")
    refs = (
        op.references(jobs, "video_jobs", "explanation_id")
        .unionByName(op.references(jobs, "video_jobs", "parent_job_id"))
        .unionByName(op.references(copies, "files", "duplicate_of", scope=["project_id"], created=None, report="project_created_at"))
    )
    targets = (
        op.parents(explanations, ("video_jobs", "explanation_id"), "id")
        .unionByName(op.parents(jobs, ("video_jobs", "parent_job_id"), "id"))
        .unionByName(op.parents(files, ("files", "duplicate_of"), "path", scope=["project_id"], created=None))
    )
    return refs, targets


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, targets = _inputs(spark, sf_dir)
    return op.orphan_references(refs, targets).select("table_name", "field_name", "record_id").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, targets = _inputs(spark, sf_dir)
    return op.orphan_report(refs, op.orphan_references(refs, targets))


_REFS = """
refs AS (
  SELECT DISTINCT 'video_jobs' AS table_name, 'explanation_id' AS field_name, id AS record_id, explanation_id AS k, created_at AS report_at,
         coalesce((SELECT bool_and(t.created_at > j.created_at) FROM explanations t WHERE t.id = j.explanation_id), TRUE) AS orphan
  FROM video_jobs j WHERE explanation_id <> ''
  UNION ALL
  SELECT DISTINCT 'video_jobs', 'parent_job_id', id, parent_job_id, created_at,
         coalesce((SELECT bool_and(t.created_at > j.created_at) FROM video_jobs t WHERE t.id = j.parent_job_id), TRUE)
  FROM video_jobs j WHERE parent_job_id <> ''
  UNION ALL
  SELECT DISTINCT 'files', 'duplicate_of', f.id, f.project_id || '/' || f.duplicate_of, p.created_at,
         NOT EXISTS (SELECT 1 FROM files t WHERE t.project_id = f.project_id AND t.path = f.duplicate_of)
  FROM files f LEFT JOIN (SELECT id, min(created_at) AS created_at FROM projects GROUP BY id) p ON p.id = f.project_id
  WHERE duplicate_of <> ''
)"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLES = {
    "p2_found": f"WITH {_REFS} SELECT DISTINCT table_name, field_name, record_id FROM refs WHERE orphan",
    "p2_report": f"""WITH {_REFS}
SELECT table_name, field_name, strftime(make_timestamp(report_at * 1000), '%Y-%m') AS month,
       CAST(count(*) AS BIGINT) AS n_references, CAST(count(*) FILTER (WHERE orphan) AS BIGINT) AS n_orphans
FROM refs GROUP BY ALL""",
}
