"""URL filters: explicit rules, and an empirical-Bayes reputation of hosts.

Rules name a host and a path; the longest that fits a URL decides. Everything
else is judged by its host's record: labelled page outcomes (bad or not) are
summed per host, registered domain and suffix, and each level's rate is shrunk
towards the one above by a beta-binomial prior whose strength is fitted by the
method of moments to the spread of the rates at that level. A host is blocked
when the lower bound of its posterior bad rate is above the limit; one that has
no labels has its domain's, suffix's or the overall record.

Outcomes are pre-aggregated per host before anything is shuffled, and the levels
above are sums of host rows. Verdicts go back to the pages by host in a join
that adaptive execution may split for a host with many pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis import session
from precis.llm.common import quoted
from precis.llm.suffixes import RULES as RULE_LIST
from precis.session import measured_bytes, written

#: (rule, verdict): a host with a path that must start the URL's path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A host is blocked if its bad rate is above LIMIT with a margin of BOUND_SD posterior deviations.
LIMIT, BOUND_SD = 0.5, 1.64
#: Pseudo-outcomes of the overall rate, and the range of a level's fitted prior strength.
TOP_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1.0, 1000.0
#: The suffix of all IP addresses: no other host starts with a bracket.
IP = "[ip]"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: then up to ``?``, ``#`` or the end. Null or no ``://``: empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host or subdomain, and path prefix), else null."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        on = (host == name) | host.endswith("." + name)
        fits = F.when(on & path.startswith("/" + rest), F.lit(rule)).otherwise(fits)
    return fits


def suffix_table(spark: SparkSession, rules=RULE_LIST) -> DataFrame:
    """(``suffix``) of rules as the Public Suffix List writes them; those beyond ASCII in both spellings."""
    both = set(rules)
    for rule in rules:
        if not rule.isascii():
            both.add("!" * rule.startswith("!") + rule.lstrip("!").encode("idna").decode())
    return spark.createDataFrame([(r,) for r in sorted(both)], "suffix string")


def with_levels(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts`` (one row each) plus ``suffix`` and ``domain``, the registered one.

    The longest rule that fits a host's last labels gives its suffix (``*.x``: one label
    more than x; ``!w.x``: x after all), else the last label does; the domain has one label
    more. User, port and a dot at the end are no part of the name. A name without a
    dot is both; an IP address has the suffix ``IP`` and no domain (null)."""
    rule = F.regexp_replace("suffix", "^!", "")
    length = F.size(F.split(rule, r"\."))
    spared = F.col("suffix").startswith("!")
    rules = suffixes.select(rule.alias("_rule"), F.struct(
        F.when(spared, 1000).otherwise(length).alias("rank"), F.when(spared, length - 1).otherwise(length).alias("n")).alias("_fit"))
    most = suffixes.agg(F.max(length)).first()[0] or 1
    # a caller's table may be of any size
    rules = F.broadcast(rules) if measured_bytes(suffixes) <= session.BROADCAST_BYTES else rules.hint("merge")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")
    ends = [F.substring_index("_name", ".", -k) for k in range(1, most + 1)]
    ends += [F.concat(F.lit("*."), e) for e in ends[:-1]]
    rows = hosts.withColumn("_name", name)
    fits = rows.select("*", F.explode(F.array_distinct(F.array(*ends))).alias("_end")).join(
        rules, F.col("_end") == F.col("_rule"), "left")
    fits = fits.groupBy(*hosts.columns, "_name").agg(F.coalesce(F.max("_fit")["n"], F.lit(1)).alias("_n"))
    labels = F.split("_name", r"\.")

    def last(n: Column) -> Column:
        n = F.least(n, F.size(labels))
        return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")

    ip = F.col("_name").rlike(r"^([0-9]+(\.[0-9]+){3}$|\[)")
    return fits.select(*hosts.columns, F.when(ip, IP).otherwise(last(F.col("_n"))).alias("suffix"),
                       F.when(~ip, last(F.col("_n") + 1)).alias("domain"))


def prior_strength(groups: DataFrame, rate: str) -> float:
    """The strength of the beta prior around ``rate`` fitted to all ``groups``.

    The spread of observed rates beyond binomial noise comes from the true rates:
    the sum of n (bad/n - m)^2 has the mean m(1-m)(1 + (n-1)/(strength+1)) a group."""
    m, p = F.col(rate), F.col("bad") / F.col("n")
    sums = groups.where("n > 0").agg(
        F.sum(F.col("n") * (p - m) * (p - m) - m * (1 - m)), F.sum((F.col("n") - 1) * m * (1 - m))).first()
    extra, weight = sums[0] or 0.0, sums[1] or 0.0
    return min(max(weight / extra - 1, LEAST_STRENGTH), MOST_STRENGTH) if extra > 0 else MOST_STRENGTH


def _shrunk(groups: DataFrame, rate: str, name: str) -> DataFrame:
    """``groups`` plus their posterior: ``{name}_rate`` and ``{name}_weight``."""
    strength = F.lit(float(prior_strength(groups, rate)))
    weight = F.col("n") + strength
    return groups.withColumns({f"{name}_rate": (F.col("bad") + strength * F.col(rate)) / weight, f"{name}_weight": weight})


def host_reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(``host``, ``bad`` 0/1 or null where unlabelled) to one row per host: posterior
    ``rate`` of bad pages, its ``weight`` in pages, and the lower ``bound`` of the rate."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    suffixes = suffix_table(outcomes.sparkSession) if suffixes is None else suffixes
    hosts = written(with_levels(hosts, suffixes), "hosts")
    # every level is written before it is joined, so that the rows of a large suffix or domain can be split
    domains = written(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    top = ((bad or 0) + 0.5 * TOP_STRENGTH) / ((n or 0) + TOP_STRENGTH)
    suffixes = _shrunk(suffixes.withColumn("top", F.lit(float(top))), "top", "suffix").select("suffix", "suffix_rate")
    suffixes = written(suffixes, "suffixes")
    # an address has no domain: its host is shrunk towards the suffix
    domains = written(domains.join(suffixes, "suffix"), "domain-rates")
    known = _shrunk(domains.where("domain is not null"), "suffix_rate", "domain").select("suffix", "domain", "domain_rate")
    known = known.unionByName(domains.where("domain is null").select("suffix", "domain", F.col("suffix_rate").alias("domain_rate")))
    known = written(known.withColumnsRenamed({"suffix": "_suffix", "domain": "_domain"}), "levels")
    same = (F.col("suffix") == F.col("_suffix")) & F.col("domain").eqNullSafe(F.col("_domain"))
    hosts = _shrunk(hosts.join(known, same), "domain_rate", "host")
    rate, weight = F.col("host_rate"), F.col("host_weight")
    spread = F.sqrt(rate * (1 - rate) / (weight + 1))
    return hosts.select("host", rate.alias("rate"), weight.alias("weight"), (rate - BOUND_SD * spread).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules=RULES, limit: float = LIMIT, suffixes: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` (the longest
    that fits, else null), ``verdict`` and the host's posterior ``rate`` and ``bound``.

    ``outcomes`` has (``_page``, ``_bad``): labelled pages by id; null ids and null
    outcomes say nothing, and of several for a page the worst counts. Null urls and those without
    ``://`` have empty host and path and share the record of the empty host.
    ``suffixes`` has (``suffix``), rules as in ``suffix_table``, the default.
    Repeated rows stay repeated; other columns are not read; an empty table gives
    an empty result."""
    host, path = host_and_path(quoted(url_col))
    rows = pages.select(quoted(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    labels = outcomes.where("_page is not null and _bad is not null").groupBy("_page").agg(F.max("_bad").alias("bad"))
    records = rows.join(labels, F.col("_id") == F.col("_page"), "left").select("host", F.col("bad").cast("long").alias("bad"))
    known = host_reputation(records, suffixes).withColumnRenamed("host", "_host")
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    verdicts = F.create_map(*[F.lit(x) for pair in rules for x in pair]) if rules else F.lit(None)
    judged = F.when(F.col("bound") > limit, "block").otherwise("allow")
    out = rows.join(known, F.col("host") == F.col("_host")).withColumn("rule", rule)
    by_rule = F.element_at(verdicts, F.col("rule")) if rules else F.lit(None).cast("string")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule",
                      F.coalesce(by_rule, judged).alias("verdict"), "rate", "bound")
