"""URL filter: fixed rules first, mined association rules for the rest.

A fixed rule names a host (with all its subdomains) and the beginning of a path; the
longest rule that fits decides.  Its verdicts label the URLs it covers.  Over those,
Spark's FP-growth mines combinations of URL tokens (host labels, host suffixes, path
segments, query names, scheme) that go with a verdict.  Rules below the least support or
confidence are pruned, and so is a rule that a part of it makes as sure.  A URL without a
fixed rule gets the verdict of the surest mined rule whose tokens it all has; without
any, the default.

FP-growth lists every frequent combination, so tokens that say the same are folded first:
those that stand in exactly the same labelled URLs (the segments of one long path) are one
item, which any of them brings; and a token that always goes with one verdict is a rule by
itself, of which no combination can be surer.  Rules have no bound on their length.

Mined rules are found by an inverted index on each rule's least frequent token: a URL
meets only rules whose rarest token it has, then the whole rule is checked.  Equal token
sets are matched once, so a hot host costs as much as a rare one.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import freeze

# The contract's rules, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"

MIN_SUPPORT = 0.002  # of the labelled URLs
MIN_CONFIDENCE = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_HOST = ""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to / ? # (A-Z lower-cased); path from there up to ? or #."""
    url = url.cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), after


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule's name, verdict) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    name = verdict = F.lit(None).cast("string")
    for decided, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, decided).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The sorted set of tokens of a URL; none for an empty host."""
    labels = F.split(host, r"\.")
    suffix = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    # Numbers in a path are ids: the shape tells more than the value.
    shaped = F.transform(parts, lambda s: F.when(s.rlike(r"^\d+$"), F.lit("#")).otherwise(s))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(
        F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.substring_index(q, "=", 1)
    )
    tokens = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("label:"), x)),
        F.array(F.concat(F.lit("suffix:"), suffix)),
        F.transform(shaped, lambda s: F.concat(F.lit("path:"), s)),
        F.transform(
            F.slice(shaped, 1, 1), lambda s: F.concat(F.lit("first:"), s)
        ),
        F.transform(names, lambda q: F.concat(F.lit("query:"), q)),
        F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))),
    )
    return F.when(host != NO_HOST, F.sort_array(F.array_distinct(tokens)))


def fold_tokens(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(token, item, sure, verdict, support) of tokens that may be in a rule, from rows (tokens, verdict).

    Such a token has ``min_support`` of all rows with one verdict, so there are at most the
    tokens of a mean row divided by ``min_support`` of them.  ``item`` is the least token of
    those in exactly the same token sets (compared by two 64-bit sums and the count of rows);
    ``sure`` tells that all its rows have the same verdict.
    """
    total = labelled.count()
    least = math.ceil(min_support * total)
    sets = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    wide = "decimal(20,0)"  # sums of 64-bit numbers don't overflow
    marks = [F.xxhash64("verdict", "tokens").cast(wide), F.xxhash64(F.lit(1), "tokens", "verdict").cast(wide)]
    tokens = sets.select("verdict", "n", *(m.alias(f"m{k}") for k, m in enumerate(marks)), F.explode("tokens").alias("token"))
    tokens = tokens.groupBy("token", "verdict").agg(
        F.sum("n").alias("n"), F.sum("m0").alias("m0"), F.sum("m1").alias("m1")
    )
    tokens = tokens.groupBy("token").agg(
        F.sum("n").alias("all"),
        F.max(F.struct("n", "verdict")).alias("most"),
        F.sum("m0").alias("m0"),
        F.sum("m1").alias("m1"),
    )
    # A group holds tokens of one URL, as all of them stand in the same ones.
    alike = Window.partitionBy("m0", "m1", "all")
    return tokens.where(F.col("most.n") >= least).select(
        "token",
        F.min("token").over(alike).alias("item"),
        (F.col("most.n") == F.col("all")).alias("sure"),
        F.col("most.verdict").alias("verdict"),
        (F.col("most.n") / F.lit(float(total))).alias("support"),
    )


def as_items(token_sets: DataFrame, folded: DataFrame) -> DataFrame:
    """(tokens, items) of distinct token sets: the sorted items its tokens bring; none without any."""
    found = token_sets.select("tokens", F.explode("tokens").alias("token")).join(
        folded.select("token", "item"), "token"
    )
    return found.groupBy("tokens").agg(F.sort_array(F.collect_set("item")).alias("items"))


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    folded: DataFrame | None = None,
) -> DataFrame:
    """(tokens, verdict, confidence, support) from rows (tokens, verdict).

    FP-growth runs over all rows.  Rules are pruned by support and confidence; a rule
    that has a part with the same verdict and no less confidence is dropped.  ``tokens``
    are items of ``fold_tokens``; rules of the other tokens of an item are the same.
    """
    folded = freeze(fold_tokens(labelled, min_support), "url-items") if folded is None else folded
    sure = folded.where("sure AND token = item").select(
        F.array("item").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), "support"
    )
    items = as_items(labelled.select("tokens").distinct(), folded.where("NOT sure"))
    verdict = F.array(F.concat(F.lit("verdict:"), F.col("verdict")))
    marked = labelled.join(items.withColumnRenamed("tokens", "own"), F.col("tokens") == F.col("own"), "left")
    marked = freeze(marked.select(F.concat(F.coalesce("items", F.array()), verdict).alias("items")), "marked-urls")
    tasks = labelled.sparkSession.sparkContext.defaultParallelism
    model = FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=tasks
    ).fit(marked)
    rules = model.associationRules.select(
        F.sort_array("antecedent").alias("tokens"),
        F.col("consequent")[0].alias("item"),
        "confidence",
        "support",
    )
    rules = rules.where(
        F.col("item").startswith("verdict:")
        & ~F.exists("tokens", lambda t: t.startswith("verdict:"))
    ).select("tokens", F.expr(f"substring(item, {len('verdict:') + 1})").alias("verdict"), "confidence", "support")
    rules = freeze(rules.unionByName(sure), "mined-rules")
    # Parts of a rule with one token less; shorter ones follow step by step.
    parts = rules.select(
        F.col("tokens").alias("whole"), "verdict", F.col("confidence").alias("own"),
        F.explode(F.transform("tokens", lambda t: F.array_except("tokens", F.array(t)))).alias("tokens"),
    )
    weaker = parts.join(rules, ["tokens", "verdict"]).where("confidence >= own")
    weaker = weaker.select(F.col("whole").alias("tokens"), "verdict").distinct()
    return rules.join(weaker, ["tokens", "verdict"], "left_anti")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined, mined_rule, confidence) for distinct sets that some rule covers.

    The surest rule decides, then the one with more support, then by its tokens.
    """
    frequency = token_sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n")
    )
    numbered = rules.withColumn("rule", F.xxhash64("tokens", "verdict"))
    rarest = (
        numbered.select("rule", F.explode("tokens").alias("token"))
        .join(frequency, "token")
        .groupBy("rule")
        .agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    )
    index = numbered.join(rarest, "rule").select(
        "token", F.col("tokens").alias("needed"), "verdict", "confidence", "support"
    )
    hits = (
        token_sets.select("tokens", F.explode("tokens").alias("token"))
        .join(freeze(index, "rule-index"), "token")
        .where(F.size(F.array_except("needed", "tokens")) == 0)
    )
    best = F.max(
        F.struct("confidence", "support", F.col("verdict").alias("mined"), F.col("needed").alias("mined_rule"))
    )
    return hits.groupBy("tokens").agg(best.alias("b")).select(
        "tokens", "b.mined", "b.mined_rule", "b.confidence"
    )


def judge_urls(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    rules=RULES,
    default: str = DEFAULT,
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``method``, ``confidence``.

    ``rule`` names the fixed rule that fits, else null; ``method`` is rule, mined or
    default.  A null URL, or one without ``://``, has empty host and path, and gets the
    default; so do all URLs that no rule covers, and all if the fixed rules label
    nothing to learn from.  Repeated rows and null ids are judged row by row.  No rows
    give none.  Other columns of ``pages``, whatever their names, are not read.
    """
    own = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"))
    own = own.select("id", "url", *(c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"))))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    own = own.select("id", "host", "path", name.alias("rule"), verdict.alias("fixed"), tokens.alias("tokens"))
    own = freeze(own, "urls")
    labelled = own.where("fixed IS NOT NULL AND tokens IS NOT NULL")
    labelled = labelled.select("tokens", F.col("fixed").alias("verdict"))
    open_ = own.where("fixed IS NULL AND tokens IS NOT NULL").select("tokens").distinct()
    if labelled.isEmpty():
        nothing = "tokens array<string>, mined string, mined_rule array<string>, confidence double"
        found = pages.sparkSession.createDataFrame([], nothing)
    else:
        folded = freeze(fold_tokens(labelled), "url-items")
        brought = freeze(as_items(open_, folded), "open-urls")
        found = match_rules(
            brought.select(F.col("items").alias("tokens")).distinct(), mine_rules(labelled, folded=folded)
        )
        # Written, so that the join is not bound to one task per item set and a hot one is split.
        found = freeze(found, "item-verdicts")
        found = brought.join(found.withColumnRenamed("tokens", "items"), "items").drop("items")
    found = found.select(F.col("tokens").alias("own_tokens"), "mined", "mined_rule", "confidence")
    alike = F.col("fixed").isNull() & (F.col("tokens") == F.col("own_tokens"))
    return own.join(found, alike, "left").select(
        F.col("id").alias(id_column),
        "host",
        "path",
        "rule",
        F.coalesce("fixed", "mined", F.lit(default)).alias("verdict"),
        F.when(F.col("fixed").isNotNull(), "rule")
        .when(F.col("mined").isNotNull(), "mined")
        .otherwise("default")
        .alias("method"),
        "confidence",
    )
