"""Digest keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_key(text: Column) -> Column:
    return F.sha2(text, 256)


def criteria_fingerprint(**fields: Column) -> Column:
    """Digest of named fields, independent of the order they are given in; nulls are kept."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def group_id(members: Column) -> Column:
    """Identity of a group: digest of its sorted member ids."""
    return F.sha2(F.array_join(F.transform(F.array_sort(members), lambda m: m.cast("string")), ","), 256)
