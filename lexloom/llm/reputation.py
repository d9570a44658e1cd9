"""URL filters with empirical-Bayes host reputation.

A url is judged by the longest rule that fits it; where none does, by its host's reputation. Labelled pages give each
host successes and trials. Beta-binomial priors are shrunk down the hierarchy: the global rate is the prior of a
suffix, a suffix's posterior mean that of its registered domains, and a domain's that of its hosts. The strength of a
level's prior is estimated from how much the groups of that level differ (method of moments). A host is blocked when
the upper bound of its posterior stays under ``threshold``: hosts with few labels keep close to their domain, and only
evidence blocks.

All of it is DataFrame operations. Only three numbers per level reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import Scratch, quoted

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Common suffixes of two labels under which names are registered. The public suffix table has thousands and
# is not shipped here; a user passes it as ``suffixes``. Hosts under none of them have a suffix of one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


@dataclass(frozen=True)
class UrlRule:
    """``rule`` is a host and the beginning of a path, like ``example.com/en/7``; verdict is allow or block."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; empty if there is none."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(two.isin(*suffixes), two).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def registered_domain(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    three = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(two.isin(*suffixes) & (three != ""), three).when(two != "", two).otherwise(host)


def _strength(groups: DataFrame, least: float, most: float) -> float:
    """How many trials a prior of this level is worth, by the method of moments over its groups (n, s, prior)."""
    r = groups.where("n > 0").agg(F.sum("n").alias("n"), F.sum(F.pow(F.col("s") - F.col("n") * F.col("prior"), 2)).alias("spread"), F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("noise"), F.sum(F.col("n") * (F.col("n") - 1) * F.col("prior") * (1 - F.col("prior"))).alias("room")).first()
    # spread = noise + rho * room for a beta-binomial of intra-class correlation rho = 1 / (1 + strength)
    if not r["n"] or not r["room"]:
        return most
    rho = max(1e-6, (r["spread"] - r["noise"]) / r["room"])
    return min(most, max(least, 1 / rho - 1))


def reputations(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645, least: float = 2.0, most: float = 200.0, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, mean, lower, upper) for each of ``hosts`` (host). outcomes has host and good (boolean or 0/1); ``suffixes`` are
    those of two labels."""
    counts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("s"))
    base = hosts.select("host").distinct().join(counts, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0)).alias("s"), registered_domain(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"))
    base = Scratch(hosts.sparkSession, "hosts").put(base, "hosts")
    total = base.agg(F.sum("n"), F.sum("s")).first()
    rate = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)

    def level(keys: list[str], above: DataFrame | None) -> tuple[DataFrame, float]:
        groups = base.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        groups = groups.withColumn("prior", F.lit(rate)) if above is None else groups.join(above.select(*keys[:-1], F.col("mean").alias("prior")), keys[:-1])
        k = _strength(groups, least, most)
        return groups.withColumn("mean", (F.col("prior") * k + F.col("s")) / (F.col("n") + k)), k

    suffixes, _ = level(["suffix"], None)
    domains, _ = level(["suffix", "domain"], suffixes)
    rated, k = level(["suffix", "domain", "host"], domains)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
    return rated.select("host", "n", "mean", F.greatest(F.lit(0.0), F.col("mean") - z * sd).alias("lower"), F.least(F.lit(1.0), F.col("mean") + z * sd).alias("upper"))


def fitting_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null. A rule fits its host and all its subdomains,
    if the path starts with the rule's. The list is compiled into the plan: thousands of rules, not millions."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, z: float = 1.645, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """A row per row of ``pages``: its id, host, path, rule (or null), verdict (allow or block), reputation (posterior
    mean) and reputation_upper. The id's column is called ``id_col``, or page_id if that is one of the other names.

    ``outcomes`` has host and good for labelled pages.

    Defined cases: a null url or one without :// has an empty host and path, which is judged like any other host;
    null and repeated ids are carried through; rows of outcomes with a null label count for nothing; without rules all
    pages are judged by their hosts; columns may have any names, others are ignored; an empty table gives an empty table,
    and without outcomes all hosts have the prior rate of one half, which allows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    url = F.col(quoted(url_col)).cast("string")
    parsed = pages.select(F.col(quoted(id_col)).cast("long").alias("_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    hosts = scratch.put(reputations(outcomes, parsed, z, suffixes=suffixes).select("host", F.col("mean").alias("reputation"), F.col("upper").alias("reputation_upper")), "reputations")
    found = parsed.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules)).join(hosts, "host", "left")
    by_host = F.when(F.col("reputation_upper") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    name = "page_id" if id_col.lower() in ("host", "path", "rule", "verdict", "reputation", "reputation_upper") else id_col
    return found.select(F.col("_id").alias(name), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_host).alias("verdict"), "reputation", "reputation_upper")
