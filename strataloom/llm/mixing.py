"""Mixing sources to target shares (weighted fair queueing).

The documents of a source form a queue in shuffled order, one pass after the other up to the source's cap. A draw's
virtual finish time is the tokens of its queue up to and including it over the source's target share. Sorted by that
time over all sources and cut at the total, the draws hold each source at its share until its queue is used up.

The running totals are made in two levels (buckets of the shuffle hash, then within a bucket), so no task holds a
source. Only one row per target reaches the driver.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Word pattern of the byte-level tokenizer: a fixed value published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096


@functools.cache
def _encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_column: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) with the source's name in lower case, trimmed and with underscores."""
    name = F.regexp_replace(F.lower(F.trim(F.col(source))), r"[\s-]+", "_")
    kind = df.schema[id_column].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "source": frame["source"], "tokens": [len(encoder.encode_ordinary(t)) for t in frame["text"]]})

    known = df.where(F.col(id_column).isNotNull() & F.col(source).isNotNull())
    return known.select(F.col(id_column).alias("id"), name.alias("source"), F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, f"id {kind}, source string, tokens long").distinct()


def largest_total(caps: dict[str, float], shares: dict[str, float]) -> float:
    """The largest total at which the shares miss their targets no more than they must.

    Sources without tokens miss theirs at any total; up to this total every other one reaches its own.
    """
    full = sum(shares[s] for s in shares if caps.get(s, 0) > 0)
    return min((caps[s] / shares[s] * full for s in shares if caps.get(s, 0) > 0 and shares[s] > 0), default=0.0)


def finish_of(total: float, caps: dict[str, float], shares: dict[str, float]) -> float:
    """The virtual time at which ``total`` tokens are drawn: sum of min(cap, share x time) = total."""
    left, weight, time = total, sum(shares[s] for s in shares if caps.get(s, 0) > 0), 0.0
    for s in sorted((s for s in shares if caps.get(s, 0) > 0 and shares[s] > 0), key=lambda s: caps[s] / shares[s]):
        end = caps[s] / shares[s]
        if (end - time) * weight >= left:
            return time + left / weight
        left -= (end - time) * weight
        time, weight = end, weight - shares[s]
    return time


def mix(documents: DataFrame, targets: DataFrame, *, id_column: str = "doc_id", source: str = "source", text: str = "text", total: float | None = None, tokenizer: str = TOKENIZER, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares).

    drawn: id, source, tokens, repeats (1 to max_repeats), finish (virtual time of its first draw), in that order.
    shares: source, target_share, actual_share, available_tokens, drawn_tokens, documents of each target.
    ``total`` is the wanted number of tokens; without it, the largest at which no share misses its target that could
    reach it. Documents without id, source or target are not drawn, null texts have no tokens; targets without a share
    above 0 get nothing, a null max_repeats counts as 1; repeated rows count once.
    """
    wanted = targets.where("source is not null").groupBy(F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_").alias("source")).agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    counted = written(token_counts(documents, id_column, source, text, tokenizer).join(F.broadcast(wanted), "source"))  # one row per target
    sums = wanted.join(counted.groupBy("source").agg(F.sum("tokens").alias("have")), "source", "left").collect()
    share = {r.source: r.share for r in sums}
    caps = {r.source: float((r.have or 0) * max(r.cap, 0)) for r in sums}
    until = finish_of(largest_total(caps, share) if total is None else total, caps, share)
    order = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    keyed = counted.withColumn("h", order).withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS)))
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    before = buckets.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("pass_tokens"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(before, ["source", "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(within))
    passes = F.floor((F.col("share") * F.lit(until) - F.col("upto") + F.lit(0.5)) / F.greatest(F.col("pass_tokens"), F.lit(1))) + 1
    drawn = placed.withColumn("repeats", F.least(F.greatest(passes, F.lit(0)), F.col("cap")).cast("int")).where("repeats > 0 and share > 0")
    drawn = drawn.select("id", "source", "tokens", "repeats", (F.col("upto") / F.col("share")).alias("finish")).orderBy("finish", "id")
    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("*").alias("documents"))
    have = counted.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    table = wanted.join(used, "source", "left").join(have, "source", "left").select("source", F.col("share").alias("target_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("available_tokens", "drawn_tokens", "documents")])
    everything = F.sum("drawn_tokens").over(Window.partitionBy())  # one row per target
    shares = table.withColumn("actual_share", F.when(everything > 0, F.col("drawn_tokens") / everything).otherwise(F.lit(0.0)))
    return drawn, shares
