"""Which addresses may be fetched: public hosts only, and what a host's robots file allows.

Defined results: null, empty and malformed addresses are not safe; hosts that are names are safe unless they are known to
stay inside (:data:`INSIDE`): whom they resolve to is for the fetcher to check with ``public_address``; a page whose host has
no rules is allowed; a robots file without rules for the agent falls back to those for ``*``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: IPv4 networks that are not globally reachable (the public registry of special-purpose addresses).
NOT_PUBLIC = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
#: Names, and ends of names, of hosts inside a network.
INSIDE = ("localhost", "local", "internal", "lan", "home", "intranet", "localdomain")


def _range(network: str) -> tuple[int, int]:
    address, bits = network.split("/")
    low = sum(int(x) << s for x, s in zip(address.split("."), (24, 16, 8, 0), strict=True))
    return low, low + (1 << 32 - int(bits)) - 1


def ipv4(host: Column) -> Column:
    """The number of a dotted quad; null if a host is none. Quads with leading zeros are none: readers differ on them."""
    part = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    found = F.regexp_extract_all(host, F.lit(part), F.lit(1))
    value = F.aggregate(F.slice(found, 1, 4), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return F.when(F.rlike(host, F.lit(f"^{part}([.]{part}){{3}}$")), value)


def public_address(host: Column) -> Column:
    """Whether an address literal is globally reachable: IPv4 by its intervals, IPv6 by its first groups; null for names."""
    n = ipv4(host)
    inside = F.lit(False)
    for low, high in sorted(map(_range, NOT_PUBLIC)):
        inside = inside | n.between(low, high)
    six = F.lower(F.regexp_replace(host, "^[\\[]|[\\]]$", ""))
    first = F.conv(F.regexp_extract(six, "^([0-9a-f]{1,4}):", 1), 16, 10).cast("long")
    second = F.conv(F.nullif(F.regexp_extract(six, "^[0-9a-f]{1,4}:([0-9a-f]{1,4}):", 1), F.lit("")), 16, 10).cast("long")
    reserved = (first == 0x2002) | ((first == 0x2001) & (F.coalesce(second, F.lit(0)) < 0x0200)) | ((first == 0x2001) & (second == 0x0DB8)) | ((first == 0x3FFF) & (F.coalesce(second, F.lit(0)) < 0x1000))
    open_six = F.coalesce(first.between(0x2000, 0x3FFF), F.lit(False)) & ~F.coalesce(reserved, F.lit(False))
    return F.when(n.isNotNull(), ~inside).when(F.contains(six, F.lit(":")), open_six)


def host_of(url: Column) -> Column:
    """The host of an http address, without user, port or brackets, in small letters; null for anything else."""
    authority = F.regexp_extract(F.trim(url), "(?i)^https?://([^/?#\\\\\\s]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    host = F.regexp_replace(F.lower(F.regexp_replace(bare, "^[\\[]|[\\]]$", "")), "[.]$", "")
    return F.nullif(host, F.lit(""))


def safe_url(url: Column) -> Column:
    """Whether an address may be asked for at all. Numbers that are hosts only to some readers (``0x7f.1``, ``2130706433``) are refused."""
    host = host_of(url)
    name = F.rlike(host, F.lit("^[a-z0-9_-]+([.][a-z0-9_-]+)+$")) & ~F.rlike(host, F.lit("(^|[.])(0x[0-9a-f]*|[0-9]+)$"))
    inside = F.element_at(F.split(host, "[.]"), -1).isin(*INSIDE)
    return F.coalesce(public_address(host), name & ~inside, F.lit(False))


RULES = T.StructType([T.StructField("host", T.StringType()), T.StructField("agent", T.StringType()), T.StructField("allow", T.BooleanType()), T.StructField("path", T.StringType())])


def rules_of(text: str | None) -> list[tuple[str, bool, str]]:
    """(agent, allow, path) of a robots file: agents one after another share the rules behind them; an empty path says nothing."""
    agents: list[str] = []
    out, open_ = [], False
    for line in (text or "").splitlines():
        field, _, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            agents = [*(agents if open_ else []), value.lower()]
            open_ = True
        elif field in ("allow", "disallow"):
            open_ = False
            out += [(a, field == "allow", value) for a in agents if value]
    return out


def robots_rules(files: DataFrame) -> DataFrame:
    """host, agent, allow, path of robots files (host, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(h.lower(), *r) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if h for r in rules_of(t)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 2 else pa.string()) for i, c in enumerate(cols)], names=RULES.names)

    return files.select("host", "text").mapInArrow(run, RULES)


def robots_allowed(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """The rows of pages (url, ...) with ``allowed``: of the rules that a page's path begins with the longest counts, an allowing one on a tie.

    A host's rules travel as one row (a robots file is small by its standard), so pages times rules are never rows. ``*`` in a
    rule stands for anything, ``$`` for the end.
    """
    name = agent.lower()
    mine = rules.withColumn("own", F.contains(F.lit(name), F.col("agent")) & (F.col("agent") != "*") & (F.col("agent") != "")).where((F.col("agent") == "*") | F.col("own"))
    escaped = F.regexp_replace("path", "([.+?^{}()|\\[\\]\\\\])", "\\\\$1")
    end = F.when(F.endswith("path", F.lit("$")), F.concat(F.substring(escaped, F.lit(1), F.length(escaped) - 1), F.lit("$"))).otherwise(escaped)
    pattern = F.concat(F.lit("^"), F.regexp_replace(end, "[*]", ".*"))
    grouped = mine.groupBy(F.col("host").alias("_host")).agg(
        F.collect_set(F.when(F.col("own"), F.struct(F.length("path").alias("size"), "allow", pattern.alias("pattern")))).alias("_own"),
        F.collect_set(F.when(~F.col("own"), F.struct(F.length("path").alias("size"), "allow", pattern.alias("pattern")))).alias("_any"),
    )
    path = F.regexp_extract("url", "(?i)^https?://[^/?#]+([^#]*)", 1)
    told = pages.withColumn("_host", host_of(F.col("url"))).withColumn("_path", F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))
    held = told.join(grouped, "_host", "left")
    rules_for = F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.coalesce("_any", F.array().cast("array<struct<size: int, allow: boolean, pattern: string>>")))
    met = F.filter(rules_for, lambda r: F.regexp_like(F.col("_path"), r["pattern"]))
    best = F.array_max(F.transform(met, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))
    return held.select(*pages.columns, F.coalesce(best["allow"], F.lit(True)).alias("allowed"))
