"""URL filters: given rules first, then association rules mined from labelled URLs.

A URL is a set of tokens: its scheme, the labels of its host and their parts between hyphens, its path segments with numbers as
`#`, and the keys of its query. Spark's FP-growth mines the token combinations of labelled URLs, the label being one more
item; a rule is a combination of at most MOST_TOKENS tokens with a label, of MIN_SUPPORT of the labelled URLs and MIN_CONFIDENCE.
A rule is pruned if a part of it alone says the same as surely, or if the more frequent label does so without any token.

Matching goes by an inverted index: each rule is posted under its rarest token, token sets (each different one once) meet the
postings of their tokens, and the rest of the rule is then compared. The surest rule decides, then the one of larger support, then `block`, then
the first by its tokens; where none matches, the more frequent label does (`allow` if both are as frequent or there are none).

Cases: a null url, or one without `://`, has an empty host and path and no tokens. Very long URLs are handled whole. Repeated URLs
count each time as labels and get the same verdict. Null ids and repeated rows are returned row by row. An empty table gives an empty
table. Columns other than the id, the url (and the label) are not read, whatever their names. A token that a third of all URLs share is spread over SALTS
tasks on its way to the index, as are token sets on their way back.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Host, path and verdict of each given rule.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE, MOST_TOKENS = 0.01, 0.8, 3
LABELS = ("allow", "block")
SALTS = 16
#: Stands before a label among the items; no token starts with it.
_LABEL = "="


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """array<string>: the different tokens of a URL, sorted; none without `://`."""
    rest, host = _after_scheme(url), host_of(url)
    some = lambda parts, kind: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + " "), x))
    query = F.transform(F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    path = F.transform(F.split(path_of(url), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    scheme = F.array(_ascii_lower(F.substring_index(url, "://", 1)))
    every = F.concat(some(scheme, "scheme"), some(F.split(host, r"\."), "host"), some(F.split(host, "[.-]"), "host"), some(path, "path"), some(query, "query"))
    return F.when(rest.isNotNull(), F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict>: the longest rule whose host, or a subdomain of it, and whose path's beginning fit; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def default_label(labelled: DataFrame) -> tuple[str, float, int]:
    """The more frequent label, its share, and the number of labelled URLs."""
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # one for each label
    total = sum(n.values())
    label = "block" if n.get("block", 0) > n.get("allow", 0) else "allow"
    return label, n.get(label, 0) / total if total else 1.0, total


def mine(labelled: DataFrame, default: str, prior: float, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """(tokens, label, confidence, support, anchor): the pruned rules of (tokens, label) rows; the anchor is a rule's rarest token."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    said = F.col("consequent")[0]
    rules = model.associationRules.filter(said.startswith(_LABEL) & (F.size("antecedent") <= most_tokens) & ~F.exists("antecedent", lambda x: x.startswith(_LABEL))).select(
        F.array_sort("antecedent").alias("tokens"), F.substr(said, F.lit(2)).alias("label"), "confidence", "support"
    )
    rules = rules.filter((F.col("label") != default) | (F.col("confidence") > prior))
    # parts of a rule of n tokens: the non-empty subsets that the bits of 1 to 2^n - 2 pick
    picked = lambda bits: F.filter("tokens", lambda x, i: F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1)) == 1)
    parts = F.when(F.size("tokens") > 1, F.transform(F.sequence(F.lit(1), F.expr("cast(power(2, size(tokens)) as int) - 2")), picked))
    general = rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("as_sure"))
    beaten = rules.select("tokens", "label", "confidence", F.explode(parts).alias("part")).join(general, ["part", "label"]).filter(F.col("as_sure") >= F.col("confidence")).select("tokens", "label").distinct()
    kept = rules.join(beaten, ["tokens", "label"], "left_anti")
    alone = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = kept.select("tokens", "label", F.explode("tokens").alias("token")).join(alone, "token").groupBy("tokens", "label").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    return kept.join(rarest, ["tokens", "label"])


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, best) of the token sets that some rule matches; best is a struct of order, label and rule."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    index = rules.select("anchor", F.col("tokens").alias("wanted"), "label", "confidence", "support", salts)
    asked = sets.select("tokens", F.explode("tokens").alias("anchor"), F.pmod(F.xxhash64("tokens"), F.lit(SALTS)).cast("int").alias("salt"))
    order = F.struct(
        (-F.col("confidence")).alias("unsure"), (-F.col("support")).alias("rare"), (F.col("label") != "block").alias("allows"), F.array_join("wanted", " + ").alias("because"), F.col("label").alias("label")
    )
    met = asked.join(index, ["anchor", "salt"]).filter(F.size(F.array_except("wanted", "tokens")) == 0)
    return met.groupBy("tokens").agg(F.min(order).alias("best"))


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, because: the given rule's verdict, else that of the mined rules (`because` names the tokens).

    labels has (url, label), label being allow or block; without it the URLs that a given rule fits teach the rest.
    """
    url = F.col("url")
    known = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    known = known.withColumns({"given": given_rule(F.col("host"), F.col("path"), rules), "tokens": tokens_of(url)})
    if labels is None:
        labelled = known.filter("given is not null").select("tokens", F.col("given.verdict").alias("label"))
    else:
        labelled = labels.select(tokens_of(F.col("url")).alias("tokens"), "label").filter(F.col("label").isin(*LABELS))
    default, prior, n = default_label(labelled)
    empty = pages.sparkSession.createDataFrame([], T.StructType.fromDDL("tokens array<string>, label string, confidence double, support double, anchor string"))
    mined = mine(labelled, default, prior) if n else empty
    best = match(known.filter("given is null").select("tokens").distinct(), mined)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.when(F.col("given").isNull(), F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))  # rows of a given rule ask nothing
    said = known.withColumn("salt", salt).join(best.select("tokens", "best", salts), ["tokens", "salt"], "left")
    return said.select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "best.label", F.lit(default)).alias("verdict"), F.col("best.because").alias("because")
    )
