"""Attribute lists: arrays of (key, value) in which keys may repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first(attributes: Column, key: str) -> Column:
    """Value of the first entry with this key, else null."""
    return F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]


def as_map(attributes: Column) -> Column:
    """A map in which the first of equal keys wins."""
    names = F.array_distinct(F.transform(attributes, lambda a: a["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.get(F.filter(attributes, lambda a: a["key"] == k), F.lit(0))["value"]))


def flattened(parts: Sequence[Column]) -> Column:
    """Attribute lists by falling precedence as one map; dots in keys become underscores and the first writer wins."""
    return as_map(F.transform(F.concat(*parts), lambda a: F.struct(F.replace(a["key"], F.lit("."), F.lit("_")).alias("key"), a["value"].alias("value"))))


def sorted_json(attributes: Column) -> Column:
    """The map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(as_map(attributes)))))


#: First parts of standard attribute keys.
STANDARD = "service telemetry host os process container k8s cloud deployment device faas enduser server client http url network net rpc db messaging exception code thread gen_ai browser user_agent aws gcp azure vcs".split()


def is_standard(key: Column) -> Column:
    """Whether an attribute key begins with one of the standard namespaces and a dot."""
    return key.rlike(rf"^({'|'.join(STANDARD)})\.")
