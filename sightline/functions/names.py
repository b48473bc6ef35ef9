"""File and recording names: anchored patterns with named groups, renaming, matching keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_pattern(pattern: str) -> str:
    """A Python pattern with its named groups written the way the JVM reads them."""
    return re.sub(r"\(\?P<", "(?<", pattern)


def group_of(name: Column, pattern: str, group: str) -> Column:
    """The named group of a match at the start of ``name``; null without a match."""
    index = re.compile(pattern).groupindex[group]
    java = f"^(?:{java_pattern(pattern)})"
    return F.when(F.regexp_like(name, F.lit(java)), F.regexp_extract(name, java, index))


def matches(name: Column, pattern: str) -> Column:
    return F.regexp_like(name, F.lit(f"^(?:{java_pattern(pattern)})"))


def first_source(name: Column, patterns: list[tuple[str, str]], other: str = "other") -> Column:
    """The first (name, pattern) found anywhere in ``name``, in list order."""
    out = F.lit(other)
    for label, pattern in reversed(patterns):
        out = F.when(F.regexp_like(name, F.lit(java_pattern(pattern))), label).otherwise(out)
    return out


def merged_name(dataset: Column, file_name: Column) -> Column:
    return F.concat(dataset, F.lit("__"), F.replace(file_name, F.lit(".rf."), F.lit("_rf_")))


def match_key(name: Column) -> Column:
    """What of a name survives an upload: without export hashes, image extension and leftover tag, in that order."""
    bare = F.regexp_replace(name, r"\.rf\.[0-9a-f]{32}", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)\.(?:jpe?g|png)$", ""), r"(?i)_jpe?g$", "")
