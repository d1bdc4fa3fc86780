"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, by_place, lower_ascii, named_again
from tidemark.session import checkpointed

#: Lexical features of a URL; those that begin with ``suffix_`` are statistics of all URLs under one host suffix.
FEATURES = (
    "url_length host_length path_length query_length host_depth path_depth url_digits host_digits hyphens host_hyphens "
    "host_entropy path_entropy n_params n_empty_params longest_label suffix_share suffix_hosts suffix_length suffix_digits suffix_params"
).split()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; '' if there is none."""
    return F.when(_located(url), lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.when(_located(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _located(url: Column) -> Column:
    return F.coalesce(F.instr(url, "://") > 0, F.lit(False))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def _entropy(text: Column) -> Column:
    """Bits per character over the letters, digits and signs that URLs are made of."""
    signs = [F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789-._~%"]
    n = F.greatest(F.length(text), F.lit(1))
    share = F.transform(F.array(*signs), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1))


def lexical(urls: DataFrame, url_col: str) -> DataFrame:
    """``urls`` with host, path, suffix (last two labels of the host) and the features of one URL, all as columns ``_*``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    base = urls.withColumns({"_host": host_of(F.col(url_col)), "_path": path_of(F.col(url_col)), "_query": query, "_url": lower_ascii(url)})
    params = F.filter(F.split("_query", "&"), lambda p: p != "")
    hyphens = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("-"), F.lit("")))
    labels = F.split("_host", r"\.")
    return base.withColumns(
        {
            "_suffix": F.substring_index("_host", ".", -2),
            "_url_length": F.length("_url"),
            "_host_length": F.length("_host"),
            "_path_length": F.length("_path"),
            "_query_length": F.length("_query"),
            "_host_depth": F.size(labels),
            "_path_depth": F.size(F.filter(F.split("_path", "/"), lambda p: p != "")),
            "_url_digits": _digits(F.col("_url")),
            "_host_digits": _digits(F.col("_host")),
            "_hyphens": hyphens("_url"),
            "_host_hyphens": hyphens("_host"),
            "_host_entropy": _entropy(F.col("_host")),
            "_path_entropy": _entropy(lower_ascii(F.col("_path"))),
            "_n_params": F.size(params),
            "_n_empty_params": F.size(F.filter(params, lambda p: ~F.contains(p, F.lit("=")) | F.endswith(p, F.lit("=")))),
            "_longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
        }
    )


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """Per suffix over all rows of :func:`lexical`: share of URLs, distinct hosts per URL, mean length, digits and parameters."""
    hosts = rows.groupBy("_suffix", "_host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"_{c}").alias(c) for c in ("url_length", "url_digits", "n_params")))
    per = hosts.groupBy("_suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), *(F.sum(c).alias(c) for c in ("url_length", "url_digits", "n_params")))
    total = per.agg(F.sum("n").alias("all"))
    return per.crossJoin(F.broadcast(total)).select(  # one row on the right
        "_suffix",
        (F.col("n") / F.col("all")).alias("_suffix_share"),
        (F.col("hosts") / F.col("n")).alias("_suffix_hosts"),
        (F.col("url_length") / F.col("n")).alias("_suffix_length"),
        (F.col("url_digits") / F.col("n")).alias("_suffix_digits"),
        (F.col("n_params") / F.col("n")).alias("_suffix_params"),
    )


def apply_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` of :func:`lexical` with _rule (as ``host/path``; null if none fits) and _rule_verdict of the longest fitting rule.

    ``rules``: host, path, verdict. A rule fits its host and all its subdomains if the path starts with its path; of
    rules of one length the last by name wins. Hosts are distinct before they meet the rules, each host with
    its parents, so a frequent host is one row there.
    """
    labels = F.split("_host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = rules.select(F.col("host").alias("parent"), F.struct(F.length(F.concat("host", "path")).alias("n"), F.concat("host", "path").alias("rule"), F.col("path").alias("path"), "verdict").alias("r"))
    hosts = rows.select("_host").distinct().filter("_host <> ''").select("_host", F.explode(parents).alias("parent"))
    ruled = hosts.join(broadcast_if_small(checkpointed(named)), "parent").groupBy("_host").agg(F.collect_set("r").alias("_rules"))
    fit = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path"])))
    joined = rows.join(broadcast_if_small(checkpointed(ruled)), "_host", "left").withColumn("_fit", fit)
    return joined.withColumns({"_rule": F.col("_fit.rule"), "_rule_verdict": F.col("_fit.verdict")}).drop("_rules", "_fit")


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", labelled: DataFrame | None = None, max_train: int = 20_000) -> DataFrame:
    """``urls`` with host, path, rule, score and verdict (block or allow): the longest fitting rule's, else the method's.

    The method is gradient-boosted trees on lexical features (``FEATURES``), trained on ``labelled`` (``url_col``, label:
    1 block, 0 allow, anything else ignored). Without it the URLs that a rule decides are the labelled ones: the rule's
    verdict is the label. A fit takes ``max_train`` labelled rows at most, those with the least hash of the URL, which
    bounds the model, not the rows judged. With labels of one class or none there is no model and the method
    allows, with score 0. Suffix statistics are counted over all of ``urls``. score: the share of blocking.

    A null URL or one without ``://`` has an empty host and path and no rule; the method judges it like any
    other. Repeated rows are kept; columns of ``urls`` with the names of the results are replaced.
    """
    made = ("host", "path", "rule", "score", "verdict")
    given, names = by_place(urls, made)
    url = names[url_col]
    rows = lexical(given, url)
    suffixes = broadcast_if_small(checkpointed(suffix_statistics(rows)))
    judged = apply_rules(rows, rules).join(suffixes, "_suffix", "left")
    if labelled is None:
        train = judged.withColumn("_label", F.when(F.col("_rule_verdict") == "block", 1.0).when(F.col("_rule_verdict") == "allow", 0.0))
    else:
        train = lexical(labelled.select(F.col(url_col).alias(url), F.col("label").alias("_given")), url).join(suffixes, "_suffix", "left")
        train = train.withColumn("_label", F.when(F.col("_given").isin(0, 1), F.col("_given").cast("double")))
    numbers = [F.coalesce(F.col(f"_{c}").cast("double"), F.lit(0.0)).alias(f"_{c}") for c in FEATURES]
    bounded = train.filter("_label is not null").select("_label", F.xxhash64("_url").alias("_order"), *numbers).orderBy("_order", "_label").limit(max_train)
    train = checkpointed(bounded)
    vector = VectorAssembler(inputCols=[f"_{c}" for c in FEATURES], outputCol="_features")
    if train.select("_label").distinct().count() == 2:
        model = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=12, maxDepth=4, maxBins=32, stepSize=0.2, seed=1).fit(vector.transform(train))
        model = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_chance")
        judged = judged.withColumns({f"_{c}": n for c, n in zip(FEATURES, numbers)})
        judged = model.transform(vector.transform(judged)).withColumn("score", vector_to_array("_chance")[1])
    else:
        judged = judged.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("_rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select(*named_again(names), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), "score", verdict.alias("verdict"))
