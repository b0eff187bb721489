"""Users, roles and plans: who may read what, whether a request is valid, and whether a plan still allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import snapshots

#: Roles from the least privilege to the most, hosts no repository may have, and providers.
ROLES = ("user", "support", "employee", "admin", "superadmin")
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "[::1]", "metadata.google.internal")
PROVIDERS = ("github", "gitlab", "azure_devops", "bitbucket", "other")
MAX_NAME, MAX_BRANCH, MAX_TOKEN = 256, 128, 1024


def level(role: Column) -> Column:
    """A role's place among the roles; an unknown or null one has the least."""
    place = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.coalesce(role, F.lit("")))
    return F.greatest(place - 1, F.lit(0)).cast("int")


def allowed_roles(users: DataFrame, *roles: str) -> DataFrame:
    """Users whose role is one of those named; the hierarchy does not count here."""
    return users.filter(F.col("role").isin(*roles))


def access(requests: DataFrame, users: DataFrame, repos: DataFrame) -> DataFrame:
    """requests (user_id, repo_id) with `allowed`: of admins and above always, of others on their own repositories.

    A user or repository that is not known is refused. Two equi-joins.
    """
    u = users.select("user_id", level(F.col("role")).alias("level"))
    r = repos.select("repo_id", "owner_id")
    at = F.lit(ROLES.index("admin"))
    owns = F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False))
    known = F.col("level").isNotNull()
    return requests.join(u, "user_id", "left").join(r, "repo_id", "left").select(*requests.columns, (known & ((F.col("level") >= at) | owns)).alias("allowed"))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port, brackets kept; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


def validated(requests: DataFrame) -> DataFrame:
    """requests (name, url, default_branch, git_provider, git_token), trimmed, with `reasons`: the fields that are refused.

    Every field is judged, in this order. Absent branch, provider and token have their defaults; an absent name or url is refused.
    """
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    name, url = F.trim(text("name", "")), text("url", "")
    branch, provider, token = F.trim(text("default_branch", "main")), F.lower(F.trim(text("git_provider", "github"))), text("git_token", "")
    host, scheme = host_of(url), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    bad = {
        "name": (name == "") | (F.length(name) > MAX_NAME),
        "url": ~scheme.isin("http", "https") | (host == "") | host.isin(*BLOCKED_HOSTS),
        "default_branch": (branch == "") | F.contains(branch, F.lit("..")) | F.startswith(branch, F.lit("/")) | (F.length(branch) > MAX_BRANCH),
        "git_provider": ~provider.isin(*PROVIDERS),
        "git_token": F.length(token) > MAX_TOKEN,
    }
    reasons = F.array_compact(F.array(*[F.when(b, F.lit(c)) for c, b in bad.items()]))
    return requests.withColumns({"reasons": reasons, "name": name, "default_branch": branch, "git_provider": provider})


def active_plans(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """(user_id, plan_id, started_at, limit_type, trial_days, daily_tokens, daily_scans) of each user's latest active subscription.

    subscriptions (id, user_id, plan_id, started_at, is_active); plans (plan_id, limits as JSON).
    Limits that are no JSON object are unlimited. Users without an active subscription have no row.
    """
    last = snapshots.latest(subscriptions.filter("is_active"), ["user_id"], [F.desc("started_at"), F.desc("id")])
    parsed = F.from_json("limits", "type string, trial_days int, daily_tokens bigint, daily_scans bigint, broken string", {"columnNameOfCorruptRecord": "broken"})
    p = plans.select("plan_id", F.when(F.trim(F.coalesce("limits", F.lit(""))) != "", parsed).alias("x"))
    whole = F.col("x").isNotNull() & F.col("x.broken").isNull()
    numbers = [F.when(whole, F.coalesce(F.col(f"x.{c}"), F.lit(0))).otherwise(F.lit(0)).alias(c) for c in ("trial_days", "daily_tokens", "daily_scans")]
    p = p.select("plan_id", F.when(whole, F.coalesce("x.type", F.lit(""))).otherwise(F.lit("unlimited")).alias("limit_type"), *numbers)
    return last.select("user_id", "plan_id", "started_at").join(p, "plan_id")


def trials(plans: DataFrame, as_of: str) -> DataFrame:
    """active_plans with `expired` and `days_left` at a time: plans by time end after their trial, others and 0 days never."""
    now = F.lit(as_of).cast("timestamp_ntz")
    timed = F.col("limit_type").isin("time_based", "combo") & (F.col("trial_days") > 0)
    ends = F.col("started_at").cast("timestamp_ntz") + F.make_dt_interval(F.col("trial_days"))
    left = F.floor((F.unix_seconds(ends.cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) / 86400).cast("int")
    return plans.withColumns({"expired": timed & (now >= ends), "days_left": F.when(timed & (now < ends), left)})


def system_totals(users: DataFrame, repos: DataFrame, parsers: int) -> DataFrame:
    """(item, n): users, repositories and parsers."""
    n = F.count("*").alias("n")
    return users.agg(n).select(F.lit("users").alias("item"), "n").unionByName(repos.agg(n).select(F.lit("repos").alias("item"), "n")).unionByName(
        users.sparkSession.range(1).select(F.lit("parsers").alias("item"), F.lit(parsers).cast("long").alias("n"))
    )
