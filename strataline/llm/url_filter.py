"""URL filters: host-suffix and path-prefix expressions against hashed rules.

A rule is ``host/path/``: it fits its host and all subdomains where the URL's path
starts with the rule's path. Only the last labels of a host and the first
segments of a path can matter, as many as the longest rule has; so pages share
few distinct sites (that tail and head), and the sites, not the pages, are expanded
into expressions. Expressions meet rules on the first 32 bits of their SHA-256;
the full digest confirms; the longest rule wins, block before allow at equal length.
The sites that a rule fits, a written table, join back to the pages: broadcast if they are counted to
be few, else by a shuffle that splits a site with many pages. All of it is built-in expressions.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits
no rule and gets the default; repeated rows get equal rows; no rules or no pages work;
other columns of the pages are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import beside, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased): after the first ``://`` up to ``/``, ``?``, ``#``; path: from there up to ``?`` or ``#``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) pairs; a rule needs a host and a path that starts and ends with ``/``."""
    rows = [(r, v) for r, v in rules]
    for r, v in rows:
        if r.find("/") < 1 or not r.endswith("/") or v not in ("allow", "block"):
            raise ValueError(f"not a rule: {r!r} {v!r}")
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rows])
    return spark.range(1).select(F.inline(pairs.cast("array<struct<rule:string,verdict:string>>")))


def _tail(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null without one), verdict."""
    site = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    digest = F.sha2(F.concat(site, F.expr("substr(rule, instr(rule, '/'))")).cast("binary"), 256)
    hashed = rules.select("rule", "verdict", digest.alias("digest"), F.substring(digest, 1, 8).alias("short"))
    depth = rules.agg(F.max(F.size(F.split(site, r"\."))), F.max(F.length("rule") - F.length(F.translate("rule", "/", "")))).first()
    labels, slashes = F.lit(depth[0] or 1), F.lit(depth[1] or 1)

    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    parts = F.split("path", "/")
    head = F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, slashes)), "/")
    head = F.when(F.size(parts) > 1, F.concat(head, F.lit("/"))).otherwise("")
    split = split.withColumn("tail", _tail(F.split("host", r"\."), labels)).withColumn("head", head)

    sites = split.where("head != '' and tail != ''").select("tail", "head").distinct()
    own = F.split("tail", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(own)), lambda k: _tail(own, k))
    segments = F.split("head", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments) - 1), lambda k: F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/")))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    keyed = sites.select("tail", "head", F.explode(expressions).alias("expression"))
    full = F.sha2(F.col("expression").cast("binary"), 256)
    keyed = keyed.select("tail", "head", full.alias("full"), F.substring(full, 1, 8).alias("short"))
    fits = keyed.join(hashed, "short").where("full = digest")
    rank = F.struct(F.length("rule"), F.col("verdict") == "block", "rule")
    best = fits.groupBy("tail", "head").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    # sites that a rule fits are few, pages of one site can be many: the sites go to the pages
    joined = split.join(beside(staged(best, "url_filter_sites")), ["tail", "head"], "left")
    return joined.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
