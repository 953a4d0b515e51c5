"""How Python reads the fixed patterns, which are in the dialect of java.util.regex."""

from __future__ import annotations

from functools import cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASCII = {r"\s": r"[ \t\n\x0b\f\r]", r"\d": "[0-9]", r"\w": "[a-zA-Z_0-9]"}


@cache
def java(pattern: str, unicode: bool = False) -> regex.Pattern:
    """Java's \\s, \\d and \\w are ASCII unless asked otherwise, inside classes too; \\b is not."""
    if not unicode:
        out, inside, i = [], False, 0
        while i < len(pattern):
            two = pattern[i : i + 2]
            if two in _ASCII:
                out.append(_ASCII[two][1:-1] if inside else _ASCII[two])
                i += 2
                continue
            if two[0] == "\\":
                out.append(two)
                i += 2
                continue
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            i += 1
        pattern = "".join(out)
    flags = regex.V0
    if pattern.startswith("(?i)"):
        pattern, flags = pattern[4:], flags | regex.I
    return regex.compile(pattern, flags)


def without_overlaps(spans: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end) that overlap no region (key, start, end) of the same key; empty and null spans and regions overlap nothing.

    A key is a message, whose regions are merged into a short array of disjoint ones; a span meets one row of its key.
    """
    one = regions.select(key, F.col("start").alias("_a"), F.col("end").alias("_b")).filter("_b > _a")
    kinds = F.array_sort(F.collect_set(F.struct("_a", "_b")))
    join = F.aggregate(
        kinds,
        F.array().cast("array<struct<_a:long,_b:long>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["_b"] >= x["_a"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["_a"].alias("_a"), F.greatest(F.element_at(acc, -1)["_b"], x["_b"]).alias("_b"))))
        ).otherwise(F.concat(acc, F.array(x))),
    )
    merged = one.select(key, F.col("_a").cast("long").alias("_a"), F.col("_b").cast("long").alias("_b")).groupBy(key).agg(join.alias("_regions"))
    hit = F.exists("_regions", lambda r: (r["_a"] < F.col("end")) & (F.col("start") < r["_b"])) & (F.col("end") > F.col("start"))
    return spans.join(merged, key, "left").filter(~F.coalesce(hit, F.lit(False))).drop("_regions")
