"""Text helpers: tokens, attributes, read names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, delimiter: str = r"\s+") -> Column:
    """Split on a regular expression and drop empty tokens."""
    return F.filter(F.split(text, delimiter), lambda t: t != "")


def gtf_attribute(attributes: Column, name: str) -> Column:
    """Value of ``name "value";`` with the quotes removed, '' when absent."""
    return F.regexp_extract(attributes, rf'(?:^|;\s*){name} "?([^";]*)"?', 1)


def canonical_read_name(name: Column) -> Column:
    """Names that differ only in the last character after / : _ become one key."""
    return F.regexp_replace(name, r"([/:_]).$", "$1*")
