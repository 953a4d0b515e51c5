"""Sources: chat messages in batch and stream, dictionaries, settings in rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.config import clean_list, dictionary, load_yaml, lookup


def spread(df: DataFrame) -> DataFrame:
    """Deals rows over all cores where a scan gives fewer parts than there are cores, as a file of one row group does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """msg_id, ts, user_id, text of a table of messages."""
    return spark.read.format(fmt).load(path).select(F.col("msg_id").cast("long"), F.col("ts").cast("timestamp_ntz"), F.col("user_id").cast("long"), F.col("text").cast("string"))


def message_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    schema = "msg_id long, ts timestamp_ntz, user_id long, text string"
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def plain(rich: Column, fallback: Column) -> Column:
    """Plain text of rich text without formatting codes; where nothing is left, the fallback."""
    bare = F.regexp_replace(F.coalesce(rich, F.lit("")), "(?s)§.|<[^>]*>", "")
    return F.when(F.trim(bare) == "", F.coalesce(fallback, F.lit(""))).otherwise(bare)


def dictionary_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """word, ord of a list in a YAML file."""
    return values_table(spark, dictionary(lookup(load_yaml(path), key, [])), "word")


def values_table(spark: SparkSession, values: Iterable[str], name: str = "value") -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(clean_list(values))], f"{name} string, ord int")


def settings_merge(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """path, value: the user's value where there is one."""
    d, u = defaults.select("path", F.col("value").alias("d")), user.select("path", F.col("value").alias("u"))
    return d.join(u, "path", "full_outer").select("path", F.coalesce("u", "d").alias("value"))


def list_union(user: DataFrame, defaults: DataFrame) -> DataFrame:
    """value: both lists (value, ord) without repeats in another case; the user's entries come first and win."""
    both = user.select("value", "ord", F.lit(0).alias("side")).union(defaults.select("value", "ord", F.lit(1)))
    keyed = both.withColumn("k", F.lower(F.trim("value"))).filter("k <> ''")
    first = keyed.groupBy("k").agg(F.min_by(F.struct("value", "side", "ord"), F.struct("side", "ord")).alias("x"))
    return first.select("x.value", "x.side", "x.ord")


def moved_settings(settings: DataFrame, moves: dict[str, str], rewrites: dict[str, str]) -> DataFrame:
    """path, value with key prefixes moved and strings in values rewritten."""
    path, value = F.col("path"), F.col("value")
    for old, new in moves.items():
        path = F.regexp_replace(path, rf"^{old.replace('.', chr(92) + '.')}(?=\.|$)", new)
    for old, new in rewrites.items():
        value = F.replace(value, F.lit(old), F.lit(new))
    return settings.select(path.alias("path"), value.alias("value"))


def remaining_placeholder(c: Column) -> Column:
    """Old minutes-and-seconds placeholders become the one placeholder."""
    out = F.regexp_replace(c, r"\{remaining-min\}\s*м\.?\s*\{remaining-sec\}\s*с\.?", "{remaining}")
    return F.regexp_replace(out, r"\{remaining-(?:min|sec)\}(?:\s*[мс]\.?)?", "{remaining}")


def migrated_nodes(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """New permission nodes for holders of old ones (holder, node, value, context, expiry), unless they have an equal one.

    renames: old, new.
    """
    due = nodes.join(renames, nodes["node"] == renames["old"]).select("holder", F.col("new").alias("node"), "value", "context", "expiry")
    return due.join(nodes.select("holder", "node", "value", "context"), ["holder", "node", "value", "context"], "left_anti").select("holder", "node", "value", "context", "expiry")
