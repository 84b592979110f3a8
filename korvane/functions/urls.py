"""Addresses: canonical forms, and a page's own canonical link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(url: Column) -> Column:
    """https, the host in lower case, no fragment, no slash at the end of a path but the root's; path case and query stay. What is no web address stays as it is."""
    part = lambda n: F.regexp_extract(url, "^(?i:https?)://([^/?#]*)([^?#]*)(\\?[^#]*)?", n)
    path = F.regexp_replace(part(2), "/+$", "")
    bare = F.when((path == "") & (part(2) != ""), "/").otherwise(path)
    return F.when(F.rlike(url, F.lit("^(?i:https?)://[^/?#]")), F.concat(F.lit("https://"), F.lower(part(1)), bare, part(3))).otherwise(url)


def canonical_link(html: Column, domain: str) -> Column:
    """The address that a page names as its canonical one, if it is on ``domain``; else null."""
    tag = F.regexp_extract(html, "(?i)(<link\\b[^>]*\\brel=[\"']canonical[\"'][^>]*>)", 1)
    href = F.regexp_extract(tag, "(?i)\\bhref=[\"']([^\"']*)[\"']", 1)
    host = F.lower(F.regexp_extract(href, "^(?i:https?)://([^/?#:]*)", 1))
    return F.when((host == domain) | F.endswith(host, F.lit(f".{domain}")), canonical(href))
