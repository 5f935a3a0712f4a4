"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

DataFrame operations and MLlib only. A rule fits its host and all subdomains if the path of the URL starts with the
path of the rule; the longest fitting rule decides. URLs that a rule decides are the labelled ones: the trees are
fitted on at most about ``TRAIN_ROWS`` of the distinct labelled URLs, chosen by a hash (all of them, if they are
fewer), and judge every other URL. Features: length, path depth, digit ratio, character entropy, number of parameters,
labels, hyphens, and suffix statistics: the smoothed share of blocked URLs under the last label, the last two labels and
the first path segment, counted over all labelled URLs; for a URL that the trees are fitted on, over those of other folds, since
its own label would tell the trees what to say.

Cases: a null URL or one without ``://`` has empty host and path, no rule, and is judged by the trees. Without labelled
URLs, all are allowed; with one class alone, all get that class. Repeated rows get equal results. Other columns stay; columns
with the names of the results are replaced. URLs of any length are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.sources.workspace import store

#: (verdict, host, path); fixed values.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
MAX_RULES = 500
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 10, 4, 7
PRIOR = 5.0
#: Parts of the labelled URLs, by hash; the suffix shares of a training row come from the other parts.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(urls: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` of ``url``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return urls.withColumn("_rest", rest).withColumn("_host", host).withColumn(
        "path", F.regexp_extract(F.substr("_rest", F.length("_host") + 1), r"^[^?#]*", 0)).withColumn(
        "host", F.translate("_host", UPPER, LOWER)).drop("_rest", "_host")


def rule_of(rules) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name = verdict = None
    for what, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name.otherwise(none), verdict.otherwise(none))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


LEXICAL = ["f_length", "f_depth", "f_digits", "f_entropy", "f_parameters", "f_labels", "f_hyphens"]
SUFFIXES = ["tail_1", "tail_2", "segment"]


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the suffixes that have statistics."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    labels = F.split("host", r"\.")
    return urls.withColumns({
        "f_length": F.length(url).cast("double"),
        "f_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "f_digits": F.regexp_count(url, F.lit("[0-9]")) / n,
        "f_entropy": _entropy(url),
        "f_parameters": F.regexp_count(url, F.lit("[?&][^=&#]*=")).cast("double"),
        "f_labels": F.size(labels).cast("double"),
        "f_hyphens": F.regexp_count(url, F.lit("-")).cast("double"),
        "tail_1": F.substring_index("host", ".", -1),
        "tail_2": F.substring_index("host", ".", -2),
        "segment": F.regexp_extract("path", r"^/([^/]*)/", 1),
    })


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int")


def _share(blocked: Column, rows: Column) -> Column:
    return (blocked + PRIOR / 2) / (rows + PRIOR)


def _with_statistics(urls: DataFrame, labelled: DataFrame, out_of_fold: bool = False) -> DataFrame:
    """Adds the smoothed share of blocked labelled URLs per suffix.

    With ``out_of_fold``, for training rows, the URLs of the row's own fold do not count, so a row never meets its own label.
    """
    urls, labelled = urls.withColumn("_fold", _fold()), labelled.withColumn("_fold", _fold())
    for suffix in SUFFIXES:
        name = f"s_{suffix}"
        folds = store(labelled.groupBy(F.col(suffix).alias("_suffix"), F.col("_fold").alias("_other")).agg(
            F.sum("label").alias("_blocked"), F.count("*").alias("_rows")), "suffix-folds")
        whole = folds.groupBy("_suffix").agg(F.sum("_blocked").alias("_all_blocked"), F.sum("_rows").alias("_all_rows"))
        if out_of_fold:
            parts = folds.join(whole, "_suffix").select("_suffix", "_other", _share(
                F.col("_all_blocked") - F.col("_blocked"), F.col("_all_rows") - F.col("_rows")).alias(name))
            joined = urls.join(parts, (F.col(suffix) == F.col("_suffix")) & (F.col("_fold") == F.col("_other")), "left")
        else:
            joined = urls.join(whole.select("_suffix", _share(F.col("_all_blocked"), F.col("_all_rows")).alias(name)), F.col(suffix) == F.col("_suffix"), "left")
        urls = joined.drop("_suffix", "_other").fillna({name: 0.5})
    return urls.drop("_fold")


INPUTS = [*LEXICAL, *[f"s_{s}" for s in SUFFIXES]]


def fit(labelled: DataFrame, statistics_of: DataFrame, train_rows: int = TRAIN_ROWS):
    """Trees for ``labelled`` rows with features and ``label`` (1: block); a bounded sample by hash."""
    total = labelled.count()
    share = min(1.0, train_rows / max(total, 1))
    chosen = labelled.filter(F.pmod(F.xxhash64("url", F.lit("train")), F.lit(1_000_000)) < int(share * 1_000_000))
    data = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(_with_statistics(chosen, statistics_of, out_of_fold=True))
    data = store(data.select("features", "label"), "url-training")
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(data)


def judge_urls(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` and ``block_score`` (of the trees; null where a rule decides)."""
    pages = pages.drop("host", "path", "rule", "verdict", "block_score")
    name, verdict = rule_of(rules)
    urls = with_host_path(pages.select("url").distinct()).withColumns({"rule": name, "ruled": verdict})
    urls = store(lexical(urls), "urls")
    labelled = urls.filter(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == "block").cast("double"))
    classes = {r["label"] for r in labelled.select("label").distinct().collect()}
    if len(classes) == 2:
        model = fit(labelled, labelled, train_rows)
        data = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(_with_statistics(urls, labelled))
        scored = model.transform(data).withColumn("_score", vector_to_array("probability")[1])
    else:
        scored = urls.withColumn("_score", F.lit(1.0 if classes == {1.0} else 0.0))
    judged = store(scored.select(
        F.col("url").alias("_url"), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("_score") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("_score")).alias("block_score")), "judged-urls")
    return pages.join(judged, F.col("url").eqNullSafe(F.col("_url"))).drop("_url")
