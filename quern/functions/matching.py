"""Wildcards, field references and dotted paths."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=4096)
def _valid(expression: str) -> bool:
    """Whether the engine that will run it, the JVM's, accepts the expression."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("patterns are compiled by the session's JVM")
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(expression)
    except IllegalArgumentException:  # what PySpark makes of a syntax error
        return False
    return True


def wildcard(value: Column, pattern: str) -> Column:
    """True where value is pattern, with ``*`` for any run of characters but newlines.

    Other regular-expression characters are live; a pattern that is no valid expression
    matches its own text. Null stays null."""
    if pattern == "*":
        return value.isNotNull()
    if "*" not in pattern:
        return value == F.lit(pattern)
    if re.fullmatch(r"[\w \-/:@#=,;<>~!%&']*\*", pattern):
        body = pattern[:-1]
        return value.startswith(body) & ~F.substring(value, len(body) + 1, 2**31 - 1).contains("\n")
    expression = "(?d)\\A" + pattern.replace("*", ".*") + "\\z"
    if not _valid(expression):
        return value == F.lit(pattern)
    return (value == F.lit(pattern)) | value.rlike(expression)


def map_path(attributes: Column, name: str) -> Column:
    """A map<string,string>'s value: the flat key first, then JSON values along the dots."""
    flat = F.try_element_at(attributes, F.lit(name))
    if "." not in name:
        return flat
    head, _, rest = name.partition(".")
    return F.coalesce(flat, F.get_json_object(F.try_element_at(attributes, F.lit(head)), "$." + rest))


def field(name: str, body: Column, attributes: Column, resource: Column | None = None) -> Column:
    """``message`` and ``body`` are the body, ``resource.x`` a resource's, else an attribute."""
    if name in ("message", "body"):
        return body
    if name.startswith("resource."):
        return map_path(resource, name.removeprefix("resource.")) if resource is not None else F.lit(None).cast("string")
    return map_path(attributes, name)
