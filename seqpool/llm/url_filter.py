"""URL filters: explicit host/path rules, and association rules mined from labelled URLs.

FP-growth mines token combinations (host labels, path segments, file endings, parameter names) that go
with a label, ``block`` or ``allow``; rules below the support or the confidence are pruned.  The labels are given per
page; without any, the verdicts of the explicit rules serve.  A mined rule stands in an inverted index under its rarest token, so a URL
meets only the rules that share that token, and the full antecedent is compared after the join.
URLs with equal tokens are judged once.

Defined results: a null URL, or one without ``://``, has an empty host and path, meets no rule and
gets the default verdict; repeated rows each get their row; an empty table gives an empty result;
other columns of the input are ignored.  Ties between explicit rules of one length go to the first
listed; ties between mined rules go to confidence, support, the shorter antecedent, then its text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqpool.llm.common import written

Rule = tuple[str, str, str]  # verdict, host, path

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
DEFAULT_VERDICT = "allow"
LABELS = ("block", "allow")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest matching rule, null where none matches."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the last wrapped is tried first
        hit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(hit, F.lit(h + p)).otherwise(rule)
        verdict = F.when(hit, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct sorted tokens of a URL; digit runs are one sign, so that page numbers share a token."""
    def tagged(tag: str, parts: Column) -> Column:
        kept = F.filter(parts, lambda x: x != "")
        return F.transform(kept, lambda x: F.concat(F.lit(tag), F.regexp_replace(x, "[0-9]+", "#")))

    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "(?s)^[^=]*", 0))
    ending = F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))
    scheme = F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    parts = [("h:", F.split(host, r"\.")), ("p:", F.split(path, "/")), ("q:", names), ("e:", ending), ("s:", scheme)]
    return F.array_sort(F.array_distinct(F.concat(*[tagged(t, x) for t, x in parts])))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support, token) from rows (tokens, verdict).

    ``token`` is the antecedent's rarest token, the key of the inverted index.  The number of
    rules does not depend on the number of URLs, but doubles with each token that a frequent signature has."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    sets = written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    total = items.agg(F.count(F.lit(1)).alias("n"))
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("token_freq"))
    found = None
    for label in LABELS:
        tag = f"={label}"
        with_label = sets.where(F.array_contains("items", tag) & (F.size("items") > 1))
        side = with_label.select(F.array_remove("items", tag).alias("items"), F.col("freq").alias("both"))
        one = side.join(sets, "items").select(
            F.col("items").alias("antecedent"), F.lit(label).alias("verdict"),
            (F.col("both") / F.col("freq")).alias("confidence"), F.col("both").alias("n_both"))
        found = one if found is None else found.unionByName(one)
    found = found.where(F.col("confidence") >= min_confidence)
    by_token = found.withColumn("token", F.explode("antecedent")).join(single, "token")
    rarest = by_token.groupBy("antecedent", "verdict", "confidence", "n_both").agg(
        F.min(F.struct("token_freq", "token")).alias("key"))
    n = total.scalar()
    return rarest.select("antecedent", "verdict", "confidence", (F.col("n_both") / n).alias("support"),
                         F.col("key.token").alias("token"))


def match_rules(signatures: DataFrame, rules: DataFrame) -> DataFrame:
    """(signature, verdict, confidence, mined_rule) for the signatures (signature, tokens) that meet a mined rule."""
    hits = signatures.withColumn("token", F.explode("tokens")).join(rules, "token")
    hits = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", (-F.size("antecedent")).alias("shorter"),
                          F.array_join("antecedent", " ").alias("mined_rule"), "verdict"))
    return hits.groupBy("signature").agg(best.alias("b")).select(
        "signature", F.col("b.verdict").alias("mined_verdict"), "b.confidence", "b.mined_rule")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], labels: DataFrame | None = None, min_support: float = MIN_SUPPORT,
                min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for every row of ``pages`` (page_id, url).

    ``labels``: page_id, label (block or allow); of several labels of a page, block counts."""
    x = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    tokens = F.coalesce(url_tokens(F.col("url"), F.col("host"), F.col("path")), F.array().cast("array<string>"))
    x = x.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens.alias("tokens"))
    x = x.withColumn("signature", F.array_join("tokens", " "))
    labelled = x.where(F.col("verdict").isNotNull()).select("tokens", "verdict")
    if labels is not None:
        one = labels.where(F.col("label").isin(*LABELS)).groupBy("page_id").agg(F.max("label").alias("label"))
        labelled = x.join(one, "page_id").select("tokens", F.col("label").alias("verdict"))
    mined = mine_rules(labelled, min_support, min_confidence)
    unknown = x.where(F.col("verdict").isNull()).groupBy("signature").agg(F.first("tokens").alias("tokens"))
    judged = match_rules(unknown, mined)
    y = x.join(judged, "signature", "left")
    by_rule = F.col("rule").isNotNull()
    return y.select("page_id", "host", "path", "rule",
                    F.coalesce("verdict", "mined_verdict", F.lit(default)).alias("verdict"),
                    F.when(~by_rule, F.col("mined_rule")).alias("mined_rule"),
                    F.when(~by_rule, F.col("confidence")).alias("confidence"))
