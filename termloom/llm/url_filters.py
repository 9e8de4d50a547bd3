"""Host reputation from labelled pages, shrunk from host to domain to suffix.

Pages are good or bad. The rate of good pages of a suffix is drawn from a beta
distribution around the overall rate, that of a registered domain from one
around its suffix, that of a host from one around its domain. The weight of each
prior is estimated from the spread of the rates one level below it, by the
method of moments. A host is blocked if even the upper bound of its posterior
rate is low, so hosts with few labels follow their domain and suffix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import materialize

#: A host is blocked if its posterior mean plus Z deviations is below MIN_GOOD.
MIN_GOOD = 0.5
Z = 1.645
#: Bounds of a prior's weight in pages.
MIN_WEIGHT, MAX_WEIGHT = 1.0, 1000.0

# Second labels that belong to the suffix under a two-letter top level.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    whole = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(whole, "://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(whole, "://[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, by label counts.

    The suffix is the last label, or the last two if the last has two letters
    and the one before is a usual second level. Hosts without a further label,
    and addresses of digits, are their own domain.
    """
    name = F.regexp_replace(host, r":\d*$", "")
    labels = F.split(name, r"\.")
    count = F.size(labels)
    last, second = F.element_at(labels, -1), F.get(labels, count - 2)
    two = (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    size = F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1)
    address = name.rlike(r"^[\d.]+$|^\[")
    tail = lambda n: F.array_join(F.slice(labels, count - n + 1, n), ".")
    suffix = F.when(address | (count <= size), name).otherwise(tail(size))
    domain = F.when(address | (count <= size), name).otherwise(tail(size + 1))
    return domain, suffix


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (host/path prefix, verdict) that fits, as a struct, or null.

    Of rules as long that fit, the last of `rules` wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda pair: len(pair[0])):
        of, slash, prefix = rule.partition("/")
        fits = (host == of) | host.endswith(f".{of}")
        fits &= path.startswith(slash + prefix)
        chosen = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, chosen).otherwise(found)
    return found


def prior_weight(children: DataFrame) -> float:
    """How many pages the parents' rates count for, from rows (good, n, parent_rate).

    For n pages with prior weight w, the squared distance of a rate from its
    parent's is q * (1 + (n - 1) / (w + 1)) / n on average, q = p * (1 - p).
    Without spread beyond that of chance the weight is MAX_WEIGHT. A job of its
    own that returns this one number.
    """
    q = F.col("parent_rate") * (1 - F.col("parent_rate"))
    distance = F.pow(F.col("good") / F.col("n") - F.col("parent_rate"), 2)
    chance, more = F.sum(q), F.sum(q * (F.col("n") - 1))
    excess = F.sum(F.col("n") * distance) - chance
    weight = F.when((more > 0) & (excess > 0), more / excess - 1)
    bounded = F.greatest(F.lit(MIN_WEIGHT), F.least(F.lit(MAX_WEIGHT), weight))
    return children.where("n > 0").agg(F.coalesce(bounded, F.lit(MAX_WEIGHT))).first()[0]


def _rates(children: DataFrame, name: str) -> DataFrame:
    """`children` (good, n, parent_rate), written, with their posterior `rate` and its `weight`."""
    children = materialize(children, name)
    weight = F.lit(prior_weight(children))
    return children.withColumn("weight", F.col("n") + weight).withColumn(
        "rate", (F.col("good") + weight * F.col("parent_rate")) / F.col("weight")
    )


def labelled_hosts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, good) of every host of `pages` (page_id, url).

    A label (doc_id, quality, toxic) belongs to the page of that number. It is
    good with quality 1 and no toxic mark; without a quality it says nothing.
    Repeated labels of a page, and repeated pages, count each.
    """
    host, _ = host_and_path(F.col("url"))
    hosts = pages.select("page_id", host.alias("host"))
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    outcomes = labels.where(F.col("quality").isNotNull()).select(
        F.col("doc_id").alias("page_id"), good.cast("bigint").alias("good")
    )
    counted = hosts.join(outcomes, "page_id").groupBy("host").agg(
        F.count("*").alias("n"), F.sum("good").alias("good")
    )
    seen = hosts.groupBy("host").agg(F.lit(0).cast("bigint").alias("n"))
    both = seen.withColumn("good", F.lit(0).cast("bigint")).unionByName(counted)
    domain, suffix = domain_and_suffix(F.col("host"))
    return (
        both.groupBy("host")
        .agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good")
    )


def host_reputation(hosts: DataFrame) -> DataFrame:
    """(host, n, rate, upper): posterior rate of good pages and its upper bound.

    `hosts` comes from `labelled_hosts`, written. Without any label at all every
    rate is 1: nothing speaks against a host.
    """
    sums = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = hosts.agg(
        F.coalesce(F.try_divide(F.sum("good"), F.sum("n")), F.lit(1.0))
    ).first()[0]
    of_all = hosts.groupBy("suffix").agg(*sums).withColumn("parent_rate", F.lit(overall))
    suffixes = _rates(of_all, "suffix_counts")
    of_suffix = suffixes.select("suffix", F.col("rate").alias("parent_rate"))
    counted = hosts.groupBy("suffix", "domain").agg(*sums)
    domains = _rates(counted.join(of_suffix, "suffix"), "domain_counts")
    of_domain = domains.select("suffix", "domain", F.col("rate").alias("parent_rate"))
    rated = _rates(hosts.join(of_domain, ["suffix", "domain"]), "host_counts")
    variance = F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1)
    return rated.select(
        "host", "n", "rate", (F.col("rate") + Z * F.sqrt(variance)).alias("upper")
    )


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    min_good: float = MIN_GOOD,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, upper) of every row of `pages`.

    The longest fitting rule decides, else the host's posterior bound. Repeated
    rows are judged each; a null url has an empty host with a reputation of its
    own; without pages no row is returned. Hosts meet their pages by a join that Spark plans by the written size
    of the host table, and whose large hosts adaptive execution splits.
    """
    hosts = materialize(labelled_hosts(pages, labels), "labelled_hosts")
    verdict = F.when(F.col("upper") < min_good, "block").otherwise("allow")
    judged = host_reputation(hosts).select("host", "rate", "upper", verdict.alias("by_host"))
    judged = materialize(judged, "host_verdicts")
    host, path = host_and_path(F.col("url"))
    located = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = located.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    return ruled.join(judged, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("match.rule").alias("rule"),
        F.coalesce("match.verdict", "by_host").alias("verdict"),
        "rate",
        "upper",
    )
