"""URL filters: longest-prefix rules, and boosted trees on lexical features for what no rule covers
(operator 5).  DataFrame functions and Spark ML only.

Training labels are the verdicts of the rules on the URLs that they cover: at most ``most`` URLs of
each verdict, those with the least hash.  Features: lengths, depth, digit ratios, character entropy (over all
characters), parameter counts, and for the last one and two host labels and the first path part, the share of
blocked URLs among the sample's, drawn to the mean where there are few; values that the sample doesn't have
get the mean.

These shares come from labels, so no URL may see its own: the sample is dealt into ``parts`` by a hash of its host,
and a URL in training has the shares of the other parts (cross-fitting), while URLs to be judged have those
of the whole sample.  ``accuracy`` says how a model that never saw a fifth of the hosts judges their URLs.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and the model's
verdict like any other; with labels of one verdict only, that is the verdict of all uncovered URLs, and
without labels it is allow; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymesh.llm.frames import written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FEATURES = ["n_url", "n_host", "n_path", "n_query", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "params", "secure", "fragment"]
KEYS = ["last", "last_two", "first_part"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, after the first ``://``, and the path up to ``?`` or ``#``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path) that fits, and its verdict; of equal ones a block."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def lexical(df: DataFrame) -> DataFrame:
    """``df`` (u, host, path) with the features that need no statistics, and their keys."""
    n = F.greatest(F.length("u"), F.lit(1))
    # characters in order: the runs of equal ones are their counts, so one pass sums k log k, whatever the alphabet
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))
    k_log_k = lambda k: F.when(k > 0, k * F.log2(k)).otherwise(F.lit(0.0))

    def step(a, c):
        same = a["last"] == c
        return F.struct(c.alias("last"), F.when(same, a["k"] + 1).otherwise(F.lit(1.0)).alias("k"), F.when(same, a["sum"]).otherwise(a["sum"] + k_log_k(a["k"])).alias("sum"))

    entropy = F.log2(n.cast("double")) - F.aggregate(F.array_sort(F.split(F.lower("u"), "")), start, step, lambda a: a["sum"] + k_log_k(a["k"])) / n
    query = F.regexp_extract("u", r"(?s)\?([^#]*)", 1)
    label = F.split("host", r"\.")
    digits = lambda c: F.length(F.regexp_replace(c, r"[^0-9]", ""))
    return df.select(
        "*",
        F.length("u").cast("double").alias("n_url"),
        F.length("host").cast("double").alias("n_host"),
        F.length("path").cast("double").alias("n_path"),
        F.length(query).cast("double").alias("n_query"),
        F.size(F.split("path", "/")).cast("double").alias("depth"),
        F.size(label).cast("double").alias("labels"),
        (digits("u") / n).alias("digits"),
        (digits("host") / F.greatest(F.length("host"), F.lit(1))).alias("host_digits"),
        (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        entropy.alias("entropy"),
        F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0).cast("double").alias("params"),
        F.col("u").startswith("https").cast("double").alias("secure"),
        F.col("u").contains("#").cast("double").alias("fragment"),
        F.substring_index("host", ".", -1).alias("last"),
        F.substring_index("host", ".", -2).alias("last_two"),
        F.regexp_extract("path", r"(?s)^/([^/]*)", 1).alias("first_part"),
    )


def shares(sample: DataFrame, mean: float) -> dict[str, DataFrame]:
    """For each key, its values in ``sample`` with their share of blocked URLs: at most as many as the sample has rows."""
    by = lambda k: sample.groupBy(k).agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
    return {k: by(k).select(k, ((F.col("b") + 20 * mean) / (F.col("n") + 20)).alias(f"{k}_share")) for k in KEYS}


def with_statistics(df: DataFrame, tables: dict[str, DataFrame], mean: float) -> DataFrame:
    for key, table in tables.items():
        df = df.join(F.broadcast(table), key, "left").withColumn(f"{key}_share", F.coalesce(f"{key}_share", F.lit(mean)))
    return df


def cross_fitted(sample: DataFrame, mean: float) -> DataFrame:
    """``sample`` (with its ``part``), each row with the shares of the other parts: the sums of all less those of its own."""
    for key in KEYS:
        own = sample.groupBy(key, "part").agg(F.sum("label").alias("__b"), F.count(F.lit(1)).alias("__n"))
        every = own.groupBy(key).agg(F.sum("__b").alias("__b_all"), F.sum("__n").alias("__n_all"))
        value = (F.col("__b_all") - F.col("__b") + 20 * mean) / (F.col("__n_all") - F.col("__n") + 20)
        rest = own.join(every, key).select(key, "part", value.alias(f"{key}_share"))
        sample = sample.join(F.broadcast(rest), [key, "part"])
    return sample


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES + [f"{k}_share" for k in KEYS], outputCol="features").transform(df)


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, u, host, path, rule, by_rule) of ``pages`` (page_id, url)."""
    base = pages.select(F.col("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("u"))
    host, path = host_and_path(F.col("u"))
    base = base.select("page_id", "u", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return base.select("*", rule.alias("rule"), verdict.alias("by_rule"))


def labelled(base: DataFrame, most: int, parts: int) -> DataFrame:
    picked = [base.filter(F.col("by_rule") == v).select("u", "host", "path", "by_rule").orderBy(F.xxhash64("u"), "u").limit(most) for v in ("allow", "block")]
    own = lexical(picked[0].unionByName(picked[1])).withColumn("part", F.pmod(F.xxhash64("host", F.lit(17)), F.lit(parts)))
    return written(own.withColumn("label", (F.col("by_rule") == "block").cast("double")), "url-sample")


def boosted(train: DataFrame, trees: int, depth: int):
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=5, featuresCol="features", labelCol="label").fit(train)


def accuracy(pages: DataFrame, rules=RULES, most: int = 10_000, trees: int = 12, depth: int = 4, parts: int = 5) -> DataFrame:
    """One row: over the labelled URLs of the hosts in the last part, which neither shares nor trees have seen, their
    number, the share judged as their rule does, and the share of the commoner verdict."""
    sample = labelled(judged(pages, rules), most, parts)
    seen = sample.filter(F.col("part") < parts - 1)
    mean = seen.agg(F.avg("label")).first()[0]
    train = written(assembled(cross_fitted(seen, mean)).select("features", "label"), "url-features")
    held = assembled(with_statistics(sample.filter(F.col("part") == parts - 1), shares(seen, mean), mean))
    got = boosted(train, trees, depth).transform(held)
    p = F.avg("label")
    return got.agg(F.count(F.lit(1)).alias("urls"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.greatest(p, 1 - p).alias("commoner"))


def filtered(pages: DataFrame, rules=RULES, most: int = 10_000, trees: int = 12, depth: int = 4, parts: int = 5) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url): host, path, rule, verdict and, where the model
    decides, its probability of block."""
    base = judged(pages, rules)
    sample = labelled(base, most, parts)
    count = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = ["page_id", "host", "path", "rule"]
    if len(count) < 2:
        only = "block" if count.get(1.0) else "allow"
        return base.select(*out, F.coalesce("by_rule", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    mean = count[1.0] / sum(count.values())
    tables = {k: written(t, "url-suffixes") for k, t in shares(sample, mean).items()}
    model = boosted(written(assembled(cross_fitted(sample, mean)).select("features", "label"), "url-features"), trees, depth)
    scored = model.transform(assembled(with_statistics(lexical(base), tables, mean)))
    p = vector_to_array("probability")[1]
    return scored.select(*out, F.coalesce("by_rule", F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), F.when(F.col("by_rule").isNull(), p).alias("p_block"))
