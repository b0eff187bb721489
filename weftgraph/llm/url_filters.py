"""URL filters from explicit rules and from the reputation of hosts, in DataFrame functions only.

*Reputation.* Labelled pages are outcomes: good or bad. Each host's rate of bad pages is a
beta-binomial posterior whose prior is the posterior of its registered domain, whose prior is
that of the public suffix, whose prior is the rate over all labelled pages. The weight of each
prior is estimated from the data (method of moments over the groups of that level). A host is
blocked if even the lower bound of its posterior (the quantile 1 - LEVEL of the beta distribution) exceeds `max_bad`: if
more than LEVEL of the distribution lies above it. That share is integrated by Simpson's rule over the
log-odds, stretched about the mode so that narrow and wide posteriors take the same nodes; no constant of the beta function is
needed, as it cancels. An unseen host inherits the level above.

*Rules* are (action, host, path prefix); a rule fits its host and all subdomains, if the path
starts with the rule's. The longest fitting rule decides, whatever the reputation says.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule, and is
judged by the group of empty hosts; pages without a label count as unlabelled; a null label
field makes that label no outcome; repeated rows are judged each by itself, and a repeated
label counts each time; without any labels all pages are allowed; an empty table gives an empty result; urls of
any length are read whole; of fitting rules of equal length the one whose text, then whose action, sorts last
decides; a share equal to LEVEL allows; extra columns are not read.

Plan: pages are aggregated by host on the map side, so a host with a third of all rows is one
row before the shuffle. All levels above are aggregates of that host table. The only join on
pages is with the host table, whose skewed side the adaptive skew join can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level names under which domains are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Production parameters: a host is blocked if its rate is above MAX_BAD with a probability of more than LEVEL, that is, if the lower bound of that level is.
MAX_BAD, LEVEL = 0.5, 0.84
#: Half the range of the integral in its own scale, and its steps.
REACH, NODES = 8, 320
#: Up to so many rules of a list are literals of the plan; more, and rules in a table, are joined. The result is the same.
LITERALS = 500


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two of a country's second level."""
    second = r"(?:^|\.)((?:" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2})$"
    two = F.regexp_extract(host, second, 1)
    return F.when(two != "", two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    labels = F.size(F.split(suffix_of(host), r"\."))
    parts = F.split(host, r"\.")
    keep = F.least(F.size(parts), labels + 1)
    return F.array_join(F.slice(parts, F.size(parts) - keep + 1, keep), ".")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """The longest fitting rule's action (0) or text (1); null if none fits."""
    out = F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit(action if what == 0 else rule_host + rule_path)).otherwise(out)
    return out


def rules_by_join(seen: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) of each distinct host and path of seen that some rule (action, host, path) fits: the longest.

    Equi-joins only: a rule's host has at most as many labels as the longest one, and its path one of
    the lengths that rules have, so a url's keys are its host's last labels with its path's prefixes.
    Keys are made of distinct urls; a key that very many of them share is split by the adaptive skew join.
    """
    r = rules.filter("action is not null").select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).na.fill("", ["rule_host", "rule_path"]).distinct()
    labels = F.size(F.split("rule_host", r"\."))
    shape = r.agg(F.coalesce(F.max(labels), F.lit(0)).alias("most"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"))  # one row
    urls = seen.select("host", "path").distinct().crossJoin(F.broadcast(shape))
    parts = F.split("host", r"\.")
    count = F.least(F.size(parts), F.col("most"))
    suffixes = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    keys = urls.withColumn("rule_host", F.explode(suffixes)).withColumn("rule_path", F.explode(prefixes)).drop("most", "lengths")
    text = F.concat("rule_host", "rule_path")
    fit = keys.join(r, ["rule_host", "rule_path"]).select("host", "path", F.struct(F.length(text).alias("n"), text.alias("rule"), "action").alias("r"))
    return fit.groupBy("host", "path").agg(F.max("r").alias("r")).select("host", "path", "r.rule", "r.action")


def _weight(groups: DataFrame, mean: str, count: str, bad: str) -> DataFrame:
    """One row: the prior's weight by the method of moments, over groups with outcomes.

    The spread of group rates about their prior means, beyond what counting alone makes, gives
    rho; the weight is 1 / rho - 1, held to [1, 1000].
    """
    n, k, m = F.col(count), F.col(bad), F.col(mean)
    had = groups.filter(n > 0)
    sums = had.agg(
        F.sum((k - n * m) * (k - n * m)).alias("spread"), F.sum(n * m * (1 - m)).alias("binomial"), F.sum(n * (n - 1) * m * (1 - m)).alias("pairs")
    )
    rho = F.when(F.col("pairs") > 0, (F.col("spread") - F.col("binomial")) / F.col("pairs")).otherwise(F.lit(1.0))
    rho = F.greatest(F.lit(1.0 / 1001), F.least(F.lit(0.5), F.coalesce(rho, F.lit(0.5))))
    return sums.select((1 / rho - 1).alias("weight"))


def above_steps(max_bad: float, total: str = "aggregate(sequence(0, {n}), 0D, (z, i) -> z + {f})") -> list[dict[str, str]]:
    """SQL projections over bad_rate and bad_rate_size; the last gives `p_above`, the share of Beta(rate * size, (1 - rate) * size) above max_bad. `total` adds f over i = 0 .. n."""
    log_odds = f"ln({max_bad!r} / (1 - {max_bad!r}))"
    share = lambda x: f"(least({x}, 0) - ln(1 + exp(-abs({x}))))"
    area = lambda low: total.format(n=NODES, f=f"(CASE WHEN i = 0 OR i = {NODES} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * cosh({low} + i * ({REACH} - ({low})) / {NODES}) * exp(a * {share(at(low))} + b * {share('-' + at(low))} - peak)") + f" * ({REACH} - ({low}))"
    at = lambda low: f"(mode + spread * sinh({low} + i * ({REACH} - ({low})) / {NODES}))"
    keep = {c: c for c in ("a", "b", "mode", "spread")}
    return [
        {"a": "bad_rate * bad_rate_size", "b": "(1 - bad_rate) * bad_rate_size"},
        {"a": "a", "b": "b", "mode": "ln(a / b)", "spread": "sqrt((a + b) / (a * b))"},
        {**keep, "peak": f"a * {share('mode')} + b * {share('-mode')}", "low": f"greatest(-{REACH}, least({REACH}, asinh(({log_odds} - mode) / spread)))"},
        {"every": area(f"(-{REACH})"), "beyond": area("low")},
        {"p_above": "round(beyond / every, 6)"},
    ]


def reputation(pages: DataFrame, outcomes: DataFrame, max_bad: float = MAX_BAD) -> DataFrame:
    """One row a host: (host, domain, suffix, labelled, bad, bad_rate, p_above).

    `pages` has page_id and url, `outcomes` page_id and bad (0 or 1). The hosts' own counts are computed once; all levels are made of them.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"))
    bad = outcomes.filter(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.count("*").alias("labels"), F.sum(F.col("bad").cast("long")).alias("bad"))
    labelled = seen.join(bad, "page_id").groupBy("host").agg(F.sum("labels").alias("n0"), F.sum("bad").alias("k0"))
    hosts = seen.select("host").distinct().join(labelled, "host", "left").select(
        "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.coalesce("n0", F.lit(0)).alias("n"), F.coalesce("k0", F.lit(0)).alias("k")
    )
    hosts = checkpointed(hosts)
    domains = hosts.groupBy("domain").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    # the prior of all has one good and one bad page, so that it is never 0 or 1
    total = suffixes.agg(((F.coalesce(F.sum("sk"), F.lit(0)) + 1) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2)).alias("top"))

    def shrunk(level: DataFrame, mean: str, n: str, k: str, out: str) -> DataFrame:
        weight = _weight(level, mean, n, k)
        with_weight = level.crossJoin(F.broadcast(weight))  # one row
        return with_weight.withColumn(out, (F.col("weight") * F.col(mean) + F.col(k)) / (F.col("weight") + F.col(n))).withColumn(f"{out}_size", F.col("weight") + F.col(n)).drop("weight")

    top = suffixes.crossJoin(F.broadcast(total))  # one row
    by_suffix = shrunk(top, "top", "sn", "sk", "suffix_rate")
    by_domain = shrunk(domains.join(by_suffix.select("suffix", "suffix_rate"), "suffix"), "suffix_rate", "dn", "dk", "domain_rate")
    by_host = shrunk(hosts.join(by_domain.select("domain", "domain_rate"), "domain"), "domain_rate", "n", "k", "bad_rate")
    out = by_host
    for step in above_steps(max_bad):
        own = ("host", "domain", "suffix", "n", "k", "bad_rate", "bad_rate_size")
        out = out.selectExpr(*own, *[f"{e} AS {c}" for c, e in step.items()])
    return out.select("host", "domain", "suffix", F.col("n").alias("labelled"), F.col("k").alias("bad"), F.round("bad_rate", 9).alias("bad_rate"), "p_above")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, max_bad: float = MAX_BAD) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, p_above) of every page; rules as a list or a table (action, host, path)."""
    urls = pages.select("page_id", "url")
    hosts = reputation(urls, outcomes, max_bad).select("host", "bad_rate", "p_above")
    seen = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_method = F.when(F.col("p_above") > LEVEL, "block").otherwise("allow")
    if isinstance(rules, list) and len(rules) > LITERALS:
        rules = pages.sparkSession.createDataFrame(rules, "action string, host string, path string")
    if isinstance(rules, list):
        ruled = seen.withColumns({"rule": rule_for(F.col("host"), F.col("path"), rules, 1), "action": rule_for(F.col("host"), F.col("path"), rules, 0)})
    else:
        ruled = seen.join(rules_by_join(seen, rules), ["host", "path"], "left")
    return ruled.join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("action", by_method).alias("verdict"), "bad_rate", "p_above")
