"""Lexical and vector search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import words
from strataloom.operators.relational import top_k
from strataloom.session import written

K1, B = 1.4, 0.6
#: Query vectors per block; a block goes to every task.
BLOCK = 4096


def postings(entries: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, term, tf, length) of each entry's words."""
    w = entries.select(F.col(id_column).alias("id"), words(F.coalesce(text, F.lit(""))).alias("w"))
    return w.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def worded(entries: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, w) of each entry's words."""
    return entries.select(F.col(id_column).alias("id"), words(F.coalesce(text, F.lit(""))).alias("w"))


def bm25(entries: DataFrame, id_column: str, text: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, matched, rank): the best ``k`` entries of each query.

    ``queries`` has query_id and term, one row per different term. Only postings of asked terms are kept before
    anything is grouped; corpus figures (entries, mean length) are one row.
    """
    totals = entries.agg(F.count("*").alias("n"), F.avg(F.size(words(F.coalesce(text, F.lit(""))))).alias("avg_length"))
    asked = queries.select("query_id", "term").distinct()
    found = worded(entries, id_column, text).select("id", F.size("w").alias("length"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    hits = written(found.groupBy("id", "length", "term").agg(F.count("*").alias("tf")))
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(frequency, "term").join(asked, "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    summed = scored.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    return top_k(summed, ["query_id"], [F.desc(F.round("score", 9)), "id"], k)


def nearest(vectors: DataFrame, id_column: str, vector: str, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` vectors of highest cosine for each query vector, itself excluded.

    Exact: blocks of ``block`` query vectors go over all vectors; each task keeps its own best ``k`` per query before
    the shuffle, by the rounded cosine and then by id as in the result. Vectors of another length than the query's, and null ones, are skipped; all-zero ones have cosine 0.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(id_column).alias("q"), F.col(vector).alias("v")).where("v is not null")
    count = asked.count()
    blocks = max(1, -(-count // block))
    kind = vectors.schema[id_column].dataType.simpleString()
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()  # about ``block`` rows
        shared = spark.sparkContext.broadcast((rows["q"].to_numpy(), np.array(rows["v"].tolist(), dtype=np.float64)))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            if not len(ids):
                return
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for frame in frames:
                frame = frame[frame["v"].map(lambda v: v is not None and len(v) == q.shape[1])]
                if not len(frame):
                    continue
                frame = frame.sort_values("id", kind="stable", na_position="first")
                x = np.array(frame["v"].tolist(), dtype=np.float64)
                s = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                names = frame["id"].to_numpy()
                s[ids[:, None] == names[None, :]] = -np.inf
                keep = np.argsort(-np.round(s, 6), axis=1, kind="stable")[:, : k]
                row = np.repeat(np.arange(len(ids)), keep.shape[1])
                yield pd.DataFrame({"query_id": ids[row], "id": names[keep.ravel()], "similarity": s[row, keep.ravel()]})

        hits = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).mapInPandas(run, f"query_id {kind}, id {kind}, similarity double")
        out = hits if out is None else out.unionByName(hits)
    return top_k(out.where("similarity > double('-Infinity')").withColumn("similarity", F.round("similarity", 6)), ["query_id"], [F.desc("similarity"), "id"], k)


def code_lines(texts: DataFrame, id_column: str, text: str, terms: Sequence[str], per_text: int = 3) -> DataFrame:
    """(id, line_no, line): up to ``per_text`` lines of each text that hold all terms, regardless of case."""
    low = F.lower(F.col(text))
    near = texts.where(" and ".join(["true"])).where(F.forall(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t)))
    lines = near.select(F.col(id_column).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select("id", (F.col("pos") + 1).alias("line_no"), "line")
    for t in terms:
        lines = lines.where(F.contains(F.lower("line"), F.lit(t.lower())))
    return top_k(lines, ["id"], ["line_no"], per_text).drop("rank")


def boosted(best: DataFrame, entries: DataFrame, id_column: str, title: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, matched, rank): lexical scores with boosts for terms that stand in the entry's title.

    ``best`` is the result of ``bm25`` with as many entries as are to be re-ranked, ``queries`` has query_id, term and
    phrase. Each term of the title adds 1.2 and counts as matched, the whole phrase (two characters or more) adds 4, and
    the sum is weighted by half plus half the share of matched terms.
    """
    asked = queries.groupBy("query_id").agg(F.collect_set("term").alias("terms"), F.max("phrase").alias("phrase"))  # of one query
    named = entries.select(F.col(id_column).alias("id"), F.lower(F.coalesce(title, F.lit(""))).alias("hay"))
    both = best.select("query_id", "id", "score", "matched").join(asked, "query_id").join(named, "id")
    inside = F.size(F.filter("terms", lambda t: F.contains(F.col("hay"), t)))
    phrase = F.when((F.length("phrase") >= 2) & F.contains("hay", F.lower("phrase")), 4.0).otherwise(0.0)
    matched = F.least(F.col("matched") + inside, F.size("terms"))
    score = (F.col("score") + inside * 1.2 + phrase) * (F.lit(0.5) + F.lit(0.5) * matched / F.size("terms"))
    scored = both.select("query_id", "id", score.alias("score"), matched.alias("matched"))
    return top_k(scored, ["query_id"], [F.desc(F.round("score", 9)), "id"], k)


def blended(lexical: DataFrame, similar: DataFrame, weights: DataFrame, least: float = 0.35) -> DataFrame:
    """(query_id, id, score): lexical score over the query's highest, plus 0.8 times the cosine from ``least`` on, plus a quarter of the entry's importance.

    ``lexical`` has query_id, id, score; ``similar`` query_id, id, similarity; ``weights`` id, importance. An entry that
    only one side finds is kept.
    """
    top = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-9))
    lex = lexical.select("query_id", "id", (F.col("score") / top).alias("lex"))
    near = similar.where(F.col("similarity") >= least).select("query_id", "id", "similarity")
    both = lex.join(near, ["query_id", "id"], "full_outer").join(weights.select("id", "importance"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("query_id", "id", (zero("lex") + zero("similarity") * 0.8 + zero("importance") * 0.25).alias("score"))


def looked_up(names: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, exact): the entry of an asked name: spelled alike, else but for case; the most important, then the smallest id.

    ``names`` has id, name, importance; ``asked`` query_id, name.
    """
    low = asked.select("query_id", F.col("name").alias("wanted"), F.lower("name").alias("key"))
    met = names.withColumn("key", F.lower("name")).join(low, "key")
    order = F.struct((F.col("name") != F.col("wanted")).alias("other"), (-F.coalesce("importance", F.lit(0.0))).alias("minus"), "id")
    return met.groupBy("query_id").agg(F.min(order).alias("m")).select("query_id", "m.id", (~F.col("m.other")).alias("exact"))


def excerpts(hits: DataFrame, spread: int = 10, bucket: int = 20, most: int = 14) -> DataFrame:
    """(query_id, path, first_line, last_line, position): the places to show around hits, one per file and bucket of lines.

    ``hits`` has query_id, path, line, score. The best hit of a bucket stays; ``most`` places per query.
    """
    placed = hits.withColumn("first_line", F.greatest(F.col("line") - spread, F.lit(1))).withColumn("last_line", F.col("line") + spread)
    own = Window.partitionBy("query_id", "path", F.floor(F.col("first_line") / bucket)).orderBy(F.desc("score"), "line")
    kept = placed.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    return top_k(kept, ["query_id"], [F.desc("score"), "path", "line"], most, "position").select("query_id", "path", "first_line", "last_line", "position")
