"""URL filter: host suffixes and path prefixes of each URL, looked up by hash prefix in a rule table.

Only column functions are used. A URL is expanded into the (host suffix, path prefix) expressions whose shape, that
is number of host labels and length of the path prefix, occurs among the rules; so a URL of a thousand labels makes
no more expressions than there are shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest in the join key: 32 bits, as in hash-prefix block lists.
PREFIX_DIGITS = 8


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules by expression. Of two rules for the same expression with different verdicts, block holds.

    Rules with a NULL host, path or verdict, or an empty host, fit nothing.
    """
    known = rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    return (
        known.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
        .select(
            F.concat("host", "path").alias("rule"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("path_length"),
            "verdict",
            _digest(F.concat("host", "path")).alias("rule_digest"),
        )
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row (columns of those names are replaced).

    ``rules`` has host, path and verdict ('allow' or 'block'). A rule fits its host and every subdomain when the path
    starts with the rule's path; the longest rule (host and path together, then more host labels) decides. Without a
    fitting rule, ``rule`` is NULL and ``verdict`` is ``default``. A NULL URL, or one without ``://``, has an empty
    host and path and gets the default. Every row is kept, also repeated ones; a URL is looked up once however many
    rows hold it. An empty rule table gives the default everywhere.
    """
    table = rule_table(rules)
    shapes = table.agg(F.collect_set(F.struct("labels", "path_length"))).scalar()
    urls = pages.select(F.col(url).alias("address")).where("address IS NOT NULL").distinct()
    parsed = urls.select("address", url_host(F.col("address")).alias("h"), url_path(F.col("address")).alias("p")).where("h <> ''")
    parts = parsed.withColumn("n", F.size(F.split("h", r"\."))).withColumn("shape", F.explode(shapes))
    expressions = parts.where("n >= shape.labels AND length(p) >= shape.path_length").select(
        "address", F.sha2(F.expr("concat(substring_index(h, '.', -shape.labels), substring(p, 1, shape.path_length))"), 256).alias("digest")
    )
    hits = expressions.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).join(table, "prefix").where("digest = rule_digest")
    best = hits.groupBy("address").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "labels", "verdict")).alias("best")
    )
    plain = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url])
    joined = plain.join(best.withColumnRenamed("address", "__address").withColumnRenamed("best", "__best"), F.col(url) == F.col("__address"), "left")
    given = F.col(url)
    return joined.withColumns(
        {
            "host": url_host(given),
            "path": url_path(given),
            "rule": F.col("__best.rule"),
            "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default)),
        }
    ).drop("__address", "__best")
