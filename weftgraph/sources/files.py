"""Files of a folder, line authorship, and pushes."""

from __future__ import annotations

import hashlib
import hmac
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Language by extension, folders that are skipped, and the largest file.
LANGUAGES = {
    ".cs": "csharp", ".csx": "csharp", ".csproj": "xml", ".sln": "solution", ".java": "java", ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".json": "json", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".sql": "sql", ".config": "xml", ".props": "xml", ".targets": "xml",
}
SKIPPED = (".git", "bin", "obj", "node_modules", ".vs", "packages", "TestResults", "artifacts")
MAX_BYTES = 1_048_576


def language_of(path: Column) -> Column:
    """The language of a path's extension, whatever its case; null if it is unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def scan(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(path, language, hash, size_bytes[, content]) of the folder's files: known extension, not empty, not too large."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = re.escape(folder.rstrip("/").split("://")[-1].split(":")[-1])
    rel = F.regexp_replace("path", rf"^.*?{root}/", "")
    parts = F.split(rel, "/")
    in_skipped = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(s) for s in SKIPPED]))
    files = raw.filter((F.col("length") > 0) & (F.col("length") <= MAX_BYTES)).withColumn("path", rel).filter(~in_skipped).withColumn("language", language_of(F.col("path"))).filter("language is not null")
    return files.select("path", "language", F.sha2("content", 256).alias("hash"), F.col("length").cast("int").alias("size_bytes"), *(["content"] if content else []))


def blame(porcelain: DataFrame) -> DataFrame:
    """(file_path, text) of `git blame --line-porcelain` to lines: author (name, else mail, else unknown), time (UTC) and commit.

    A line without a time is of 2000-01-01.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = re.compile(r"^([0-9a-f]{40}) \d+ (\d+)")
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now: dict = {}
                for line in (text or "").split("\n"):
                    if m := head.match(line):
                        now = {"commit": m[1][:12], "line": int(m[2])}
                    elif line.startswith("\t") and now:
                        author = now.get("author") or now.get("author-mail", "").strip("<>") or "unknown"
                        rows.append((path, now["line"], author, int(now.get("committer-time", 946684800)), now["commit"]))
                    elif " " in line:
                        k, v = line.split(" ", 1)
                        now[k] = v
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()))], names=["file_path", "line_no", "author", "at", "commit"])

    out = porcelain.select("file_path", "text").mapInArrow(run, "file_path string, line_no int, author string, at long, commit string")
    return out.select("file_path", "line_no", "author", F.timestamp_seconds("at").alias("committed_at"), "commit")


def normal_url(url: Column) -> Column:
    """A repository's address without trailing slashes and .git, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""))


def pushes_to_repos(pushes: DataFrame, repos: DataFrame) -> DataFrame:
    """pushes (url, ref) that hit the default branch of a known repository (repo_id, url, default_branch)."""
    p = pushes.withColumn("key", normal_url(F.col("url"))).withColumn("branch", F.substring_index("ref", "/", -1)).drop("url")
    r = repos.select("repo_id", normal_url(F.col("url")).alias("key"), F.col("default_branch").alias("branch"))
    return p.join(r, ["key", "branch"]).drop("key")


def signature_matches(secret: str, body: bytes, header: str) -> bool:
    """Whether a push's `sha256=` header is the body's HMAC."""
    return hmac.compare_digest("sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest(), header or "")


#: The event of each provider that is a push.
PUSH_EVENTS = {"github": "push", "gitlab": "Push Hook"}


def pushes(hooks: DataFrame) -> DataFrame:
    """hooks (provider, event, payload as JSON) with url, ref, commit_sha and reason in place of event and payload.

    `reason` says why a hook is no push: another event, no url or no branch; else it is null. The generic
    form has repo_url, branch and commit_sha; the others a repository or project, a ref and the commit after it.
    """
    kind = "repository struct<clone_url string, html_url string>, project struct<http_url string>, repo_url string, branch string, commit_sha string, ref string, after string"
    p = F.from_json("payload", kind)
    x = hooks.withColumn("p", p)
    given = lambda *names: F.coalesce(*[F.when(F.col(f"p.{n}") != "", F.col(f"p.{n}")) for n in names])
    url = F.when(F.col("provider") == "github", given("repository.clone_url", "repository.html_url")).when(F.col("provider") == "gitlab", given("project.http_url")).otherwise(given("repo_url"))
    ref = F.when(F.col("provider").isin(*PUSH_EVENTS), given("ref")).otherwise(given("branch"))
    sha = F.when(F.col("provider").isin(*PUSH_EVENTS), given("after")).otherwise(given("commit_sha"))
    expected = F.lit(None).cast("string")
    for provider, event in PUSH_EVENTS.items():
        expected = F.when(F.col("provider") == provider, event).otherwise(expected)
    another = expected.isNotNull() & ~expected.eqNullSafe(F.col("event"))
    reason = F.when(another, "another event").when(url.isNull(), "no url").when(ref.isNull(), "no branch")
    kept = [c for c in hooks.columns if c not in ("event", "payload")]
    return x.select(*kept, url.alias("url"), ref.alias("ref"), sha.alias("commit_sha"), reason.alias("reason"))


def token_matches(secret: str, header: str) -> bool:
    """Whether a push's shared token is the secret."""
    return hmac.compare_digest(secret.encode(), (header or "").encode())


def retried(run, most: int = 3, base: float = 2.0, longest: float = 60.0, wait=time.sleep):
    """run() again after a failure, at most `most` times, waiting base * 2 ** n seconds and never longer than `longest`. The last error is raised."""
    for attempt in range(most + 1):
        try:
            return run()
        except Exception:
            if attempt == most:
                raise
            wait(min(base * 2**attempt, longest))
