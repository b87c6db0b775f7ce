"""Edges, names and their resolution: merging, direction, layers, anchors, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import singular
from strataloom.operators.components import connected_components
from strataloom.operators.relational import ancestors, first_per


def merged_edges(edges: DataFrame, keys: Sequence[str], kind: str, priority: Column, weight: str = "weight") -> DataFrame:
    """One edge per key: weights add up, the kind of the highest priority wins, the smaller name of equals.

    Null weights count as 0; a combination map-side, so hot edges are a row per task.
    """
    rank = F.struct((-priority).alias("p"), F.col(kind).alias("kind"))
    return edges.groupBy(*keys).agg(F.sum(F.coalesce(weight, F.lit(0))).alias(weight), F.min(rank)["kind"].alias(kind))


def dominant(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """The heavier of two opposite edges; of equal ones that from the smaller name. Self-links go."""
    e = edges.where(F.col(src) != F.col(dst)).select(src, dst, weight)
    back = e.select(F.col(src).alias(dst), F.col(dst).alias(src), F.col(weight).alias("_back"))
    both = e.join(back, [src, dst], "left")
    return both.where(F.col("_back").isNull() | (F.col(weight) > F.col("_back")) | ((F.col(weight) == F.col("_back")) & (F.col(src) < F.col(dst)))).drop("_back")


def bands(edges: DataFrame, keys: Sequence[str], weight: str = "weight") -> DataFrame:
    """``share`` of the key's heaviest edge and its ``band``: strong from 0.6, medium from 0.25, else weak."""
    share = F.col(weight) / F.max(weight).over(Window.partitionBy(*keys))
    return edges.withColumn("share", F.round(share, 6)).withColumn("band", F.when(share >= 0.6, "strong").when(share >= 0.25, "medium").otherwise("weak"))


def classified(edges: DataFrame) -> DataFrame:
    """(node, class, n, others): the direct neighbours of each node by relation, incoming and outgoing.

    ``edges`` has src, dst, kind; others are the different neighbours' names in order.
    """
    sides = F.array(F.struct(F.col("src").alias("node"), F.col("kind").alias("class"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.concat(F.col("kind"), F.lit("By")).alias("class"), F.col("src").alias("other")))
    flat = edges.select(F.explode(sides).alias("s")).select("s.*").distinct()
    return flat.groupBy("node", "class").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("other")), ",").alias("others"))


def catalogued(items: DataFrame, name: str, catalogue: DataFrame) -> DataFrame:
    """Items whose name is an entry of the catalogue or lies below it (entry/...), with the longest such entry.

    Items meet the catalogue on each of their own prefixes, so it is an equi-join; ``catalogue`` has entry. A name has
    at most as many prefixes as parts.
    """
    parts = F.split(F.lower(name), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = items.withColumn("entry", F.explode(prefixes)).join(catalogue.select("entry").distinct(), "entry")
    return met.groupBy(*items.columns).agg(F.max_by("entry", F.length("entry")).alias("entry"))


def usage(names: DataFrame, used: DataFrame) -> DataFrame:
    """(name, uses): how often each name is used as such or, if never, anything below it (name/...). ``used`` has spec."""
    counts = used.groupBy("spec").agg(F.count("*").alias("n"))
    parts = F.split("spec", "/")
    below = counts.withColumn("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).where("size(split(spec, '/')) > 1")
    below = below.groupBy("name").agg(F.sum("n").alias("below"))
    exact = counts.select(F.col("spec").alias("name"), F.col("n").alias("exact"))
    return names.select("name").distinct().join(exact, "name", "left").join(below, "name", "left").select("name", F.coalesce("exact", "below", F.lit(0)).alias("uses"))


def first_named(rows: DataFrame, row_id: str, words: Column, names: DataFrame) -> DataFrame:
    """(row_id, place, name): the first word that equals a name, its singular or its plural. ``names`` has name."""
    keys = names.select("name", F.explode(F.array_distinct(F.array(F.lower("name"), singular(F.col("name")), F.concat(F.lower("name"), F.lit("s"))))).alias("word"))
    met = rows.select(row_id, F.posexplode(words).alias("place", "word")).join(keys, "word")
    return met.groupBy(row_id).agg(F.min(F.struct("place", "name")).alias("m")).select(row_id, (F.col("m.place") + 1).cast("long").alias("place"), F.col("m.name").alias("name"))


def nearest_ancestor(paths: DataFrame, keys: Sequence[str], path: str, marked: DataFrame) -> DataFrame:
    """Each path with the deepest directory above it that is among ``marked`` (keys, directory); null where none is."""
    above = paths.select(*keys, path, F.explode(ancestors(F.col(path))).alias("directory")).join(marked.select(*keys, "directory").distinct(), [*keys, "directory"], "left_semi")
    deepest = above.groupBy(*keys, path).agg(F.max_by("directory", F.length("directory")).alias("anchor"))
    return paths.select(*keys, path).distinct().join(deepest, [*keys, path], "left")


def uncontained(spans: DataFrame, keys: Sequence[str], start: str, end: str, order: str) -> DataFrame:
    """The spans that no earlier one (by ``order``) of the same keys holds whole.

    Earlier spans meet on each block of lines the later one begins in, so no key meets itself as a whole.
    """
    width = 512
    block = F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width)))
    outer = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(order).alias("_o")).where("_s <= _e").withColumn("_b", block)
    own = spans.withColumn("_b", F.floor(F.col(start) / width))
    held = own.join(outer, [*keys, "_b"]).where((F.col("_o") < F.col(order)) & (F.col("_s") <= F.col(start)) & (F.col("_e") >= F.col(end)))
    return spans.join(held.select(order).distinct(), order, "left_anti")


def clusters(items: DataFrame, item_id: str, pairs: DataFrame) -> DataFrame:
    """(item_id, cluster): the smallest id of what is linked by the pairs (a, b); items alone are their own cluster."""
    found = connected_components(pairs).withColumnRenamed("node", item_id)
    return items.select(item_id).distinct().join(found, item_id, "left").select(item_id, F.coalesce("component", item_id).alias("cluster"))


def star_pairs(items: DataFrame, keys: Sequence[str], item_id: str) -> DataFrame:
    """(a, b) from each item to the first of its key: links of n items by n - 1 pairs."""
    first = items.groupBy(*keys).agg(F.min(item_id).alias("b"))
    return items.join(first, list(keys)).where(F.col(item_id) != F.col("b")).select(F.col(item_id).alias("a"), "b").distinct()


def remapped(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``column`` with old ids replaced by new ones; ids that the map (old, new) lacks stay."""
    return df.join(ids.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")


def previous_version(versions: DataFrame) -> DataFrame:
    """(id, previous): the named earlier version if it is ready, else the latest ready one of the same origin.

    ``versions`` has id, named, ready, origin columns source_type, source_url (null equals null) and name, created_at.
    """
    ready = versions.where("ready").select(F.col("id").alias("p_id"), *[F.col(c).alias(f"p_{c}") for c in ("source_type", "source_url", "name", "created_at")])
    named = versions.join(ready.select(F.col("p_id").alias("named")), "named", "left_semi").select("id", F.col("named").alias("chosen"))
    same = F.col("source_type").eqNullSafe(F.col("p_source_type")) & F.col("source_url").eqNullSafe(F.col("p_source_url")) & F.col("name").eqNullSafe(F.col("p_name"))
    other = versions.join(ready, same & (F.col("p_created_at") < F.col("created_at")) & (F.col("id") != F.col("p_id")))
    latest = first_per(other, ["id"], [F.desc("p_created_at"), "p_id"]).select("id", F.col("p_id").alias("latest"))
    return versions.select("id").join(named, "id", "left").join(latest, "id", "left").select("id", F.coalesce("chosen", "latest").alias("previous"))
