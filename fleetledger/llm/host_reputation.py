"""URL filter by rules and by empirical-Bayes reputation of hosts.

Labelled pages give each host a number of bad ones among all.  Rates are shrunk from the
top down: the rate of all pages is the prior of a suffix, a suffix's posterior mean that of
its registered domains, a domain's that of its hosts.  The prior's weight at each level is
fitted to the data: a beta-binomial's variance gives the correlation within the groups of
that level (method of moments), kept between ``CORRELATION``'s bounds, and a correlation r
is worth 1 / r - 1 observations.  A host is blocked if the lower bound of its bad
rate, the posterior mean less ``Z`` standard deviations, exceeds the bar: the rate with ``ODDS`` times the odds of all
labelled pages, ``BAD`` at most.  An absolute bar alone would say nothing where few pages are bad.

The lower bound of the correlation makes a prior worth 49 pages at most: hosts are run one by one, so a host with
50 labelled pages counts as much as its domain, however alike the hosts of the domain have been.

Counts are combined before every shuffle and levels hold one row per group, so a host of
any share of the pages costs one row a task.  The counts of hosts are stored once; the
fitted numbers of each level are scalar subqueries.

Defined cases: a null URL or one without ``://`` has an empty host and path, which fit no
rule; an empty host has its own reputation like any other; hosts without labelled pages get
their domain's; no labelled page at all: everything is allowed; repeated rows count as often
as they occur; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.session import settle

#: Bounds of the fitted correlation within groups, standard deviations of the bound, odds of the bar over those of all pages, highest bar.
CORRELATION, Z, ODDS, BAD = (0.02, 0.5), 1.645, 2.0, 0.5
#: Kinds of registration that countries have under their own label: ``co.uk``, ``com.au`` and so on.
KINDS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "or", "org")
#: Most rules that a call takes; they become one expression.
MOST_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host (A-Z in lower case) and path."""
    after = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    found = pages.withColumn("_rest", F.coalesce(after, F.lit("")))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(_rest, length(host) + 1)"), r"^[^?#]*", 0)
    return found.withColumn("host", host).withColumn("path", path).withColumn("host", F.translate("host", _UPPER, _LOWER)).drop("_rest")


def matching_rule(rules: dict[str, str]) -> Column:
    """The longest rule (host, then path) that fits host and path; of equal lengths the first in order."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is tested first
        host, path = rule.split("/", 1)
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def registered_domain(host: Column) -> Column:
    """The suffix and one label more; the host itself if it has no more."""
    labels = F.split(host, r"\.")
    # Suffixes of two labels: a kind of registration below a country's label of two letters.
    country = F.char_length(F.element_at(labels, -1)) == 2
    long_suffix = F.when(F.size(labels) > 2, country & F.element_at(labels, -2).isin(*KINDS)).otherwise(False)
    keep = F.least(F.when(long_suffix, 3).otherwise(2), F.size(labels))
    return F.array_join(F.slice(labels, -keep, keep), ".")


def suffix(domain: Column) -> Column:
    """What follows the first dot of a registered domain; without a dot, all of it."""
    return F.regexp_replace(domain, r"^[^.]*\.", "")


def _shrunk(level: DataFrame, above: DataFrame | None, key: str) -> DataFrame:
    """``level`` (n, bad and keys) with prior mean m, and with the posterior's a and b."""
    if above is None:
        level = level.withColumn("m", level.agg((F.sum("bad") + 0.5) / (F.sum("n") + 1)).scalar())
    else:
        level = level.join(above.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), key)
    some = level.where("n > 0")
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m"))))
    fitted = F.when(F.sum(F.col("n") - 1) > 0, (spread - F.count(F.lit(1))) / F.sum(F.col("n") - 1))
    r = F.greatest(F.lit(CORRELATION[0]), F.least(F.lit(CORRELATION[1]), F.coalesce(fitted, F.lit(CORRELATION[1]))))
    a, b = F.col("w") * F.col("m") + F.col("bad"), F.col("w") * (1 - F.col("m")) + F.col("n") - F.col("bad")
    return level.withColumn("w", some.agg(1 / r - 1).scalar()).withColumn("a", a).withColumn("b", b).drop("w", "m")


def host_reputation(pages: DataFrame) -> DataFrame:
    """a, b, bound (of the bad rate) and blocked of every host in ``pages`` (host, bad: 1, 0 or null where not labelled)."""
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = settle(hosts).withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("domain")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = _shrunk(suffixes, None, "suffix")
    middle = _shrunk(domains, top, "suffix")
    judged = _shrunk(hosts, middle, "domain")
    total, mean = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (total + 1))
    odds = ODDS * (F.sum("bad") + 0.5) / (F.sum("n") - F.sum("bad") + 0.5)
    bar = suffixes.agg(F.least(F.lit(BAD), odds / (1 + odds))).scalar()
    return judged.select("host", "n", "a", "b", bound.alias("bound"), (bound > bar).alias("blocked"))


def judge_urls(pages: DataFrame, rules: dict[str, str], bad: Column | None = None, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and bound of every page.

    ``rules`` maps a rule to its verdict.  ``bad`` labels pages (1, 0 or null) over ``pages``' columns;
    by default the pages that a rule fits are labelled by its verdict.
    """
    given = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url}`").alias("_url"), (bad if bad is not None else F.lit(None)).cast("int").alias("_label"))
    split = with_host_and_path(given, "_url").withColumn("rule", matching_rule(rules))
    of_rule = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("rule")] if rules else F.lit(None).cast("string")
    split = split.withColumn("_ruled", of_rule)
    outcome = F.col("_label") if bad is not None else F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0)
    reputation = host_reputation(split.select("host", outcome.alias("bad"))).select("host", "bound", "blocked")
    learned = F.when(F.col("blocked"), "block").otherwise("allow")
    return split.join(reputation, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("_ruled", learned).alias("verdict"), "bound")
