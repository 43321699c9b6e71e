"""Canonical listing URLs. Host and path rules are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def absolute(url: Column, base: str) -> Column:
    """Resolve site-relative references against ``base``."""
    return (
        F.when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(F.lit(base), url))
        .otherwise(url)
    )


def canonical_url(url: Column, host: str, path: str, build: str | None = None, base: str | None = None) -> Column:
    """struct(id, url) of an HTTPS listing URL; null when host, path or credentials do not fit.

    ``host`` and ``path`` are patterns; group 1 of ``path`` is the listing id. ``build`` is a
    template with ``{id}``; without it the host and path are kept. Query and fragment always go.
    """
    full = absolute(url, base) if base else url
    name, where = _part(full, "HOST"), _part(full, "PATH")
    ident = F.regexp_extract(where, path, 1)
    ok = (
        (_part(full, "PROTOCOL") == "https")
        & F.lower(name).rlike(host)
        & where.rlike(path)
        & _part(full, "USERINFO").isNull()
        & ~_part(full, "AUTHORITY").rlike(r":[0-9]+$")
    )
    target = (
        F.concat(F.lit("https://"), F.lower(name), where)
        if build is None
        else F.replace(F.lit(build), F.lit("{id}"), ident)
    )
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(ident.alias("id"), target.alias("url")))


def safe_image_url(url: Column, host: str, maximum: int | None = None) -> Column:
    """HTTPS image URL on an allowed host, without query and fragment."""
    name, where = _part(url, "HOST"), _part(url, "PATH")
    ok = (
        (_part(url, "PROTOCOL") == "https")
        & F.lower(name).rlike(host)
        & _part(url, "USERINFO").isNull()
        & ~_part(url, "AUTHORITY").rlike(r":[0-9]+$")
    )
    if maximum is not None:
        ok = ok & (F.length(url) <= maximum)
    return F.when(F.coalesce(ok, F.lit(False)), F.concat(F.lit("https://"), F.lower(name), where))


def safe_page_path(url: Column) -> Column:
    """Path with every segment outside the allowed list replaced by a mark."""
    # Path segments that carry no private data.
    safe = ["login", "checkpoint", "marketplace", "category", "vehicles", "item", "privacy", "consent"]
    keep = F.array(*[F.lit(s) for s in safe])
    where = _part(url, "PATH")
    parts = F.filter(F.split(where, "/"), lambda p: p != "")
    shown = F.transform(parts, lambda p: F.when(F.array_contains(keep, F.lower(p)), p).otherwise(F.lit(":redacted")))
    joined = F.concat(F.lit("/"), F.array_join(shown, "/"), F.when(F.size(shown) > 0, F.lit("/")).otherwise(F.lit("")))
    return F.coalesce(joined, F.lit("unknown"))
