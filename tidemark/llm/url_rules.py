"""Allow and block rules for URLs, matched by expressions.

Each URL is expanded into expressions: every host suffix at a label's start with every prefix of the path that
is as long as some rule's path. Expressions meet rules in an equi-join on the first 32 bits of their SHA-256
digests; whole digests confirm a match, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "host string, path string, verdict string"
#: Hex digits of a digest that are joined on.
SHORT = 8


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of pages with host, path, rule and verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the URL's path starts with the
    rule's; the longest host and path wins, and of equal ones with different verdicts `block`. rule is host
    and path of the one that decided, null without one; then the verdict is `default`. Null URLs and those
    without `://` have an empty host and path. Null hosts or paths of rules count as empty, rules without a
    verdict and repeated rules are ignored. Without rules all rows get the default. Columns of pages named like the four
    results are replaced; repeated rows stay.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rules = rules.where(F.col("verdict").isNotNull()).select(_lower(text("host")).alias("rule_host"), text("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    # of one expression's rules the least verdict, "allow" < "block" being turned round
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    digest = lambda host, path: F.sha2(F.concat(host.cast("binary"), F.lit(b"\x00"), path.cast("binary")), 256)
    keyed = rules.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_digest", 1, SHORT))
    # the different lengths of rules' paths: no more than the longest path has characters
    lengths = sorted(n for (n,) in rules.select(F.length("rule_path")).distinct().collect())
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    seen = pages.select(F.col("host").alias("h"), F.col("path").alias("p")).where("h <> '' or p <> ''").distinct()
    seen = seen.unionAll(pages.sparkSession.createDataFrame([("", "")], "h string, p string"))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("p"))
    expressions = seen.select("h", "p", F.explode(_host_suffixes(F.col("h"))).alias("suffix")).select("h", "p", "suffix", F.explode(cuts).alias("n"))
    expressions = expressions.withColumn("digest", digest(F.col("suffix"), F.expr("left(p, n)"))).withColumn("short", F.substring("digest", 1, SHORT))
    size = F.length("rule_host") + F.length("rule_path")
    fit = (
        expressions.join(keyed, "short").where(F.col("digest") == F.col("rule_digest"))
        .groupBy("h", "p").agg(F.max(F.struct(size.alias("size"), F.length("rule_host").alias("host_size"), "rule_host", "rule_path", "rule_verdict")).alias("best"))
        .select("h", "p", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    )
    # pages without host and path, which may be many, all have one answer, and aren't shuffled for it
    void = (F.col("host") == "") & (F.col("path") == "")
    none = fit.where("h = '' and p = ''").select("rule", "verdict").limit(1)
    answer = none.first() or (None, None)
    empty = pages.where(void).withColumns({"rule": F.lit(answer[0]).cast("string"), "verdict": F.lit(answer[1]).cast("string")})
    some = pages.where(~void)
    judged = some.join(fit, (some["host"] == fit["h"]) & (some["path"] == fit["p"]), "left").drop(fit["h"], fit["p"]).unionByName(empty)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
