"""URL filter: listed rules first, then the reputation of a page's host by empirical Bayes.

Pages with a known outcome (blocked or not) are counted by host, registered domain and public suffix. At each level a beta-binomial prior
is centred on the posterior mean of the level above; how strongly it draws is fitted by moments over all groups of that level, and no prior counts for more
than the outcomes that its centre rests on. So a host with few outcomes leans on its domain, a domain on its suffix, and a suffix on the whole table. A page is blocked if even a lower posterior
bound of its host's blocked share, the mean less `z` standard deviations of the beta posterior, reaches `limit`.

All of it is expressions, aggregates that combine before they are shuffled, and one join by host of the pages with a written table of hosts: it is
broadcast if that table is small, and else a hot host is split by the adaptive skew join. Only the url is read.

Cases: a null url, and one without ://, have the empty host and path, which no rule fits; a host without a dot is its own domain and suffix, and so is an IP address;
repeated rows come back each and count each; without outcomes the share is 1/2 at every level and nothing is blocked; an empty table gives
no rows; extra columns, of whatever names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import stage_table

#: (verdict, host, path) as the contract gives them.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Second labels that make a suffix together with a country's two letters.
SECOND = "co|com|org|net|ac|gov|edu"
SUFFIX = rf"(?:(?:{SECOND})\.[a-z]{{2}}|[^.]*)"
ADDRESS = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])\z"
#: Bounds of a prior's strength, in outcomes that it weighs as much as.
LEAST, MOST = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where there is no ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does. Rules are a short list: each is a branch of one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def places(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; user names, ports and a last dot do not count."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*\z", ""), r"\.\z", "")
    alone = name.rlike(ADDRESS) | ~F.contains(name, F.lit("."))
    domain = F.when(alone, name).otherwise(F.regexp_extract(name, rf"(?:^|\.)([^.]*\.{SUFFIX})\z", 1))
    suffix = F.when(alone, name).otherwise(F.regexp_extract(name, rf"(?:^|\.)({SUFFIX})\z", 1))
    return domain, suffix


def strength(groups: DataFrame) -> DataFrame:
    """One row, strength: alpha + beta of the prior around `centre` that explains how far the groups' counts lie from it. groups: n, blocked, centre."""
    spread = F.col("centre") * (1 - F.col("centre"))
    excess = F.sum((F.col("blocked") - F.col("n") * F.col("centre")) ** 2 - F.col("n") * spread)
    room = F.sum(F.col("n") * (F.col("n") - 1) * spread)
    correlation = F.round(F.when(room > 0, excess / room), 9)  # sums hang on no order then
    fitted = F.when(correlation <= 1 / (MOST + 1), MOST).when(correlation > 0, 1 / correlation - 1).otherwise(MOST)
    return groups.agg(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), fitted)).alias("strength"))


def shrunk(groups: DataFrame) -> DataFrame:
    """groups with alpha and beta of the posterior, its mean and its weight, their sum. groups: n, blocked, centre, weight (of what the centre rests on)."""
    rows = groups.join(F.broadcast(strength(groups))).withColumn("strength", F.least("strength", "weight"))  # one row
    alpha = F.col("strength") * F.col("centre") + F.col("blocked")
    beta = F.col("strength") * (1 - F.col("centre")) + F.col("n") - F.col("blocked")
    rows = rows.withColumns({"alpha": alpha, "beta": beta, "weight": F.col("strength") + F.col("n")})
    return rows.withColumn("mean", F.col("alpha") / F.col("weight")).drop("strength")


def reputations(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, blocked, mean, lower): the posterior of each host's blocked share. outcomes: host, blocked (null: not known; the host is judged all the same)."""
    domain, suffix = places(F.col("host"))
    counted = outcomes.groupBy("host").agg(F.count("blocked").alias("n"), F.count_if(F.col("blocked")).alias("blocked"))
    counted = stage_table(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "blocked"), "hosts")
    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    domains = sums(counted, "domain", "suffix")
    n, blocked = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "blocked"))
    whole = counted.agg(((blocked + 1) / (n + 2)).alias("centre"), (n + 2).cast("double").alias("weight"))
    centre = lambda df, key: df.select(key, F.col("mean").alias("centre"), "weight")
    suffixes = shrunk(sums(domains, "suffix").join(F.broadcast(whole)))  # one row
    domains = shrunk(domains.join(centre(suffixes, "suffix"), "suffix"))
    found = shrunk(counted.join(centre(domains, "domain"), "domain"))
    weight = F.col("weight")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (weight * weight * (weight + 1)))
    return found.select("host", "n", "blocked", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - z * deviation, 6).alias("lower"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, lower) for each page: the longest rule's verdict, else its host's by what rules say of other pages.

    Pages that a rule decides are the labelled outcomes.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    known = stage_table(reputations(urls.select("host", (F.col("rule.verdict") == "block").alias("blocked")), z), "reputations")
    rows = urls.join(known.select("host", "mean", "lower"), "host")
    own = F.when(F.col("lower") >= limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", own).alias("verdict"), "mean", "lower")
