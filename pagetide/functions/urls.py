"""Resolving and normalising link targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.once import let

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
ABSOLUTE = r"^(https?)://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def squash_dots(path: Column) -> Column:
    """Path with '.' and '..' segments resolved, evaluated only where one occurs."""
    def step(done: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(seg == ".", done)
            .otherwise(F.concat(done, F.array(seg)))
        )

    def squash(path: Column) -> Column:
        segments = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        trailing = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
        joined = F.concat(F.lit("/"), F.array_join(kept, "/"), trailing)
        return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.regexp_replace(joined, "//$", "/")).otherwise(path)

    return let(path, squash)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of `href` as seen on the page at `base`."""
    href = F.trim(href)
    scheme = F.lower(F.regexp_extract(base, SCHEME, 1))
    origin = F.concat(scheme, F.lit("://"), host(base))
    base_path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    own_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    no_fragment = F.regexp_replace(base, "#.*$", "")
    no_query = F.regexp_replace(base, "[?#].*$", "")
    return (
        F.when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("/"), F.concat(origin, squash_dots(own_path), tail))
        .otherwise(F.concat(origin, squash_dots(F.concat(folder, own_path)), tail))
    )


def normalise(url: Column) -> Column:
    """Scheme, host and path of an http(s) url; '' for any other scheme."""
    scheme = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1))
    kept = F.concat(
        scheme, F.lit("://"),
        F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1),
        F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1),
    )
    return F.when(scheme == "", F.lit("")).otherwise(F.regexp_replace(kept, "/$", ""))
