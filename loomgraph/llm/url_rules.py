"""URL filters by association rules.

URL tokens (host labels, registered suffix, path words, query keys; digits count as `#`) of labelled pages form
transactions; FP-growth mines combinations that come with the label `bad`. Rules under the confidence, support or lift
thresholds are pruned, and rules that a shorter one implies at the same confidence or better. An inverted index finds
the rules of a URL: each rule is listed under its rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the judged host/path rules: verdict, host, path.
HOST_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like `example.net/en/`, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda entry: len(entry[1] + entry[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, f"{rule_host}{rule_path}").otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted; none for a null or a URL without `://`."""
    host, path = host_of(url), F.lower(path_of(url))
    query = F.lower(F.regexp_extract(url, r"(?s)\?([^#]*)", 1))

    def tagged(tag: str, values: Column) -> Column:
        clean = F.transform(values, lambda value: F.regexp_replace(value, r"[0-9]+", "#"))
        return F.transform(F.filter(clean, lambda value: value != ""), lambda value: F.concat(F.lit(tag), value))

    tokens = F.concat(
        tagged("host=", F.split(host, r"\.")),
        tagged("path=", F.split(path, r"[^\p{L}\p{N}]+")),
        tagged("query=", F.transform(F.split(query, "&"), lambda pair: F.regexp_extract(pair, "^[^=]*", 0))),
    )
    return F.coalesce(F.array_sort(F.array_distinct(tokens)), F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 1.5,
               max_tokens: int | None = None, min_rows: int = 20) -> DataFrame:
    """antecedent (tokens), confidence, lift, support of the rules for `bad`; `labelled`: tokens, bad (boolean).

    All labelled rows are mined. A rule needs a share of `min_support` of the rows and `min_rows` rows at least. Rules have any length
    unless `max_tokens` is given. An empty table, or one without bad rows, has no rules.
    """
    baskets = labelled.select(
        F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")
    ).filter(F.size("items") > 0)
    empty = labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, lift double, support double")
    counts = baskets.agg(F.count("*").alias("all"), F.count_if(F.array_contains("items", BAD)).alias("bad")).first()
    if counts["bad"] < min_rows:
        return empty
    support = max(min_support, min_rows / counts["all"])
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets).associationRules
    kept = rules.filter(
        (F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift)
        & (F.lit(max_tokens is None) | (F.size("antecedent") <= (max_tokens or 0)))
    ).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support")
    # a rule is implied by a shorter one with a subset of its tokens; both list that one's first token
    shorter = kept.select(F.col("antecedent").alias("_short"), F.col("confidence").alias("_confidence"), F.col("antecedent")[0].alias("_token"))
    longer = kept.withColumn("_token", F.explode("antecedent"))
    implied = (
        longer.join(shorter, "_token")
        .filter((F.size("_short") < F.size("antecedent")) & (F.size(F.array_except("_short", "antecedent")) == 0))
        .filter(F.col("_confidence") >= F.col("confidence"))
    )
    return kept.join(implied.select("antecedent").distinct(), "antecedent", "left_anti")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """`pages` (with tokens) with blocked_by: the confidence of its best rule, null if none.

    Equal token sets are matched once, so a host with a third of the pages is a few rows here.
    """
    listed = rules.select(F.explode("antecedent").alias("token"), "antecedent", "confidence")
    frequency = listed.groupBy("token").agg(F.count("*").alias("_uses"))
    index = (
        listed.join(frequency, "token")
        .groupBy("antecedent", "confidence")
        .agg(F.min_by("token", F.struct("_uses", "token")).alias("token"))
    )
    sets = pages.select("tokens").distinct()
    matched = (
        sets.withColumn("token", F.explode("tokens"))
        .join(index, "token")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max("confidence").alias("blocked_by"))
    )
    return pages.join(matched, "tokens", "left")


def judge_urls(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url",
               label_id_col: str = "doc_id", **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, blocked_by of every page.

    The longest fixed rule decides; else mined rules: block where one fits, allow otherwise. A labelled row is bad if
    its quality is 0 or it is toxic; null labels count as good, and a page with several labels is bad if one says so.
    Null URLs have empty host and path, no tokens and are allowed. Repeated pages are judged alike; other columns are
    left behind. Without labels nothing is mined.
    """
    bad = labels.groupBy(F.col(label_id_col).alias("_label_id")).agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad")
    )
    rows = pages.select(F.col(page_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("tokens", url_tokens(F.col("url")))
    labelled = rows.join(bad, rows["page_id"] == bad["_label_id"]).select("tokens", "bad")
    rules = mine_rules(labelled, **mining)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = match_rules(rows.withColumns({"host": host, "path": path}), rules)
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    mined = F.when(F.col("blocked_by").isNotNull(), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "blocked_by"
    )
