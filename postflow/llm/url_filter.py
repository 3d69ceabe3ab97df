"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits.

Everything on the way of the rows is DataFrame functions. A rule fits its host and all subdomains if the path starts with the rule's;
the longest rule wins. URLs that a rule judges are the labelled ones: the trees (pyspark.ml, fitted to `max_rows` of them at most, those
whose hash is lowest) learn to tell blocked from allowed by length, depth, digit ratio, entropy, parameter counts and what the URLs of the same suffix are
like on average. No feature looks at labels or rules. The fitted trees are written out as nested conditions, so that scoring needs no model object.

Defined cases: a null url or one without "://" has an empty host and path, fits no rule, and is scored like any other; if the rules label
no URL, or all alike, the verdict where none fits is allow (or the one label); repeated URLs are judged alike; null page ids are kept; URLs of any length are read
whole; ties of the sample's order go by page id; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.operators.storage import saved

#: The rules that the registered query is asked to use: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "n_params", "query_length", "has_fragment", "path_entropy", "host_entropy", "vowel_ratio", "suffix_log_count", "suffix_length", "suffix_digit_ratio", "suffix_entropy", "suffix_params", "suffix_depth")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judged(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path, rule and its verdict (both null where none fits)."""
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in longest]
    rule = F.coalesce(*[F.when(fit, F.lit(h + p)) for fit, (_, h, p) in zip(fits, longest, strict=True)]) if longest else F.lit(None).cast("string")
    verdict = F.coalesce(*[F.when(fit, F.lit(v)) for fit, (v, _, _) in zip(fits, longest, strict=True)]) if longest else F.lit(None).cast("string")
    return df.withColumns({"rule": rule, "ruled": verdict})


def lexical(df: DataFrame) -> DataFrame:
    """The features of a URL that need only the URL."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"

    def entropy(text: Column, alphabet: str) -> Column:
        low = F.lower(text)
        size = F.greatest(F.length(low), F.lit(1)).cast("double")
        counts = [F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in alphabet]
        return reduce(lambda a, b: a + b, [F.when(k > 0, -(k / size) * F.log2(k / size)).otherwise(0.0) for k in counts])

    return df.withColumns(
        {
            "length": n,
            "host_length": F.length("host").cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "labels": (F.regexp_count("host", F.lit(r"\."))).cast("double"),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n,
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "entropy": entropy(url, letters + "-._/:?=&#%"),
            "path_entropy": entropy(F.col("path"), letters),
            "host_entropy": entropy(F.col("host"), letters),
            "vowel_ratio": F.regexp_count(F.lower(url), F.lit("[aeiou]")) / n,
            "n_params": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
            "query_length": F.length(query).cast("double"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "suffix": F.substring_index("host", ".", -2),
        }
    )


def suffix_table(table: DataFrame) -> DataFrame:
    """What the URLs of a suffix (the last two labels of the host) are like: how many there are, and their means. No label is looked at; sums are of whole numbers, so that they do not depend on their order."""
    n = F.count("*")
    mean = lambda c: F.sum(c) / n
    return table.groupBy("suffix").agg(
        F.log1p(n).alias("suffix_log_count"),
        mean(F.col("length").cast("bigint")).alias("suffix_length"),
        (F.sum((F.col("digit_ratio") * F.col("length")).cast("bigint")) / F.sum(F.col("length").cast("bigint"))).alias("suffix_digit_ratio"),
        mean((F.col("entropy") * 1_000_000).cast("bigint")).alias("suffix_entropy"),
        mean(F.col("n_params").cast("bigint")).alias("suffix_params"),
        mean(F.col("depth").cast("bigint")).alias("suffix_depth"),
    )


def featured(ruled: DataFrame) -> DataFrame:
    """All features. The table of suffixes is written first: then it is broadcast if it is small, and else the join alone shuffles, so that a suffix that most URLs share can be split."""
    df = lexical(ruled)
    return df.join(saved(suffix_table(df)), "suffix", "left")


def as_condition(tree: str) -> Column:
    """A tree's debug string as nested conditions over the feature columns."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in tree.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
    place = 0

    def node() -> Column:
        nonlocal place
        _, line = lines[place]
        place += 1
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        feature, cut = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line).groups()
        low = node()
        place += 1  # its Else
        high = node()
        return F.when(F.col(FEATURES[int(feature)]) <= float(cut), low).otherwise(high)

    return node()


def fit(table: DataFrame, max_rows: int = 20000, rounds: int = 8, depth: int = 4) -> GBTClassificationModel | float:
    """Trees fitted to the URLs that rules judge; if these are all alike (or none), the constant margin of their label."""
    told = table.where("ruled is not null").orderBy(F.xxhash64("url"), "page_id").limit(max_rows)
    told = told.select((F.col("ruled") == "block").cast("double").alias("label"), *FEATURES)
    kinds = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return 1.0 if kinds.get(1.0) else -1.0
    rows = assembled(told).select("label", "features")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.3, seed=1, cacheNodeIds=False).fit(rows.cache())
    rows.unpersist()
    return model


def assembled(table: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)


def margin_of(model: GBTClassificationModel | float) -> Column:
    """The trees' margin as a Column: above 0 means block."""
    if isinstance(model, float):
        return F.lit(model)
    return reduce(lambda a, b: a + b, [as_condition(t.toDebugString) * F.lit(float(w)) for t, w in zip(model.trees, model.treeWeights, strict=True)])


def url_filter(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", max_rows: int = 20000) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict and the trees' margin."""
    table = featured(judged(pages, rules, page_id, url))
    margin = margin_of(fit(table, max_rows))
    learnt = F.when(F.col("margin") > 0, "block").otherwise("allow")
    return table.withColumn("margin", margin).select("page_id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"), "margin")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("margin")
