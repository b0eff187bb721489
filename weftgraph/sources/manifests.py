"""Dependency manifests: files (file_path, content) to declared dependencies.

Line formats are JVM expressions; TOML, INI and XML go through the standard library, Arrow
batch by batch. A manifest that cannot be read gives no rows.
"""

from __future__ import annotations

import configparser
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a version range, and patterns of the line formats.
RANGE = r"[><=^~*|]"
REQUIREMENT = r"^([A-Za-z0-9_][A-Za-z0-9._-]*)\s*(?:\[.*?\])?\s*(.*?)$"
GRADLE = r"""(?:implementation|api|compile|testImplementation|testCompile|runtimeOnly|compileOnly)\s*[\('"]\s*([^:'"]+):([^:'"]+):([^'")\s]*)"""
GO_LINE = r"(?m)^\s*(\S+)\s+(v[\d.]+\S*)"
CMAKE = r"(?i)find_package\s*\(\s*(\w+)(?:\s+([\d.]+))?\s*"
GO_WORDS = ("require", "go", "module", "toolchain")
SKIPPED = (".git", "node_modules", "bin", "obj", ".vs", "packages", "TestResults", "artifacts", "venv", ".venv", "__pycache__")


def is_pinned(version: Column) -> Column:
    v = F.trim(version)
    return (v != "") & (v != "latest") & ~v.rlike(RANGE)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def _rows(df: DataFrame, name, version, ecosystem: str, is_dev=None, pinned=None) -> DataFrame:
    return df.select(name.alias("name"), version.alias("version"), F.lit(ecosystem).alias("ecosystem"), "file_path", (F.lit(False) if is_dev is None else is_dev).alias("is_dev"), (is_pinned(version) if pinned is None else pinned).alias("is_pinned"))


def requirements(files: DataFrame) -> DataFrame:
    lines = files.select("file_path", F.explode(F.split("content", r"\r\n|\r|\n")).alias("raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").rlike("^[#-]") & F.col("line").rlike(REQUIREMENT))
    said = F.regexp_replace(F.regexp_extract("line", REQUIREMENT, 2), r"^\s+|\s+$", "")
    version = F.regexp_replace(said, "^[=!<>~]+", "")
    return _rows(lines, F.regexp_extract("line", REQUIREMENT, 1), F.when(version == "", "*").otherwise(version), "pypi", pinned=said.startswith("==") & ~F.contains(said, F.lit(",")))


def _all(files: DataFrame, pattern: str, groups: int) -> DataFrame:
    found = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(k + 1)).alias(f"g{k + 1}") for k in range(groups)])
    return files.select("file_path", F.explode(found).alias("m")).select("file_path", "m.*")


def gradle(files: DataFrame) -> DataFrame:
    # a declaration is looked for line by line, as its line tells whether it is a test's
    lines = files.select("file_path", F.explode(F.split("content", r"\n")).alias("content"))
    found = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(GRADLE), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3)])
    rows = lines.select("file_path", "content", F.explode(found).alias("m")).select("file_path", "content", "m.*")
    version = F.when(F.col("g3") == "", "*").otherwise(F.col("g3"))
    return _rows(rows, F.concat("g1", F.lit(":"), "g2"), version, "maven", F.col("content").rlike("test(?:Implementation|Compile)"))


def go_mod(files: DataFrame) -> DataFrame:
    rows = _all(files, GO_LINE, 2).filter(~F.col("g1").isin(*GO_WORDS))
    return _rows(rows, F.col("g1"), F.col("g2"), "go", pinned=F.lit(True))


def cmake(files: DataFrame) -> DataFrame:
    rows = _all(files, CMAKE, 2)
    return _rows(rows, F.col("g1"), F.when(F.coalesce("g2", F.lit("")) == "", "*").otherwise(F.col("g2")), "cmake")


def package_json(files: DataFrame) -> DataFrame:
    kind = "dependencies map<string,string>, devDependencies map<string,string>"
    x = files.select("file_path", F.from_json("content", kind).alias("j"))
    both = None
    for field, dev in (("dependencies", False), ("devDependencies", True)):
        part = x.select("file_path", F.explode(f"j.{field}").alias("n", "v")).withColumn("dev", F.lit(dev))
        both = part if both is None else both.unionByName(part)
    return _rows(both, F.col("n"), F.coalesce("v", F.lit("*")), "npm", F.col("dev"))


# ---- structured formats: (name, version, is_dev) of one manifest --------------------------------


def _pep508(spec: str, dev: bool):
    if m := re.match(REQUIREMENT, spec.strip()):
        yield m[1], m[2].strip().rstrip(";").strip() or "*", dev


def pyproject(content: str) -> Iterator[tuple[str, str, bool]]:
    project = tomllib.loads(content).get("project", {})
    for spec in project.get("dependencies", []):
        yield from _pep508(spec, False)
    for specs in project.get("optional-dependencies", {}).values():
        for spec in specs:
            yield from _pep508(spec, True)


def setup_cfg(content: str) -> Iterator[tuple[str, str, bool]]:
    cfg = configparser.ConfigParser()
    cfg.read_string(content)
    for line in cfg.get("options", "install_requires", fallback="").splitlines():
        if line.strip():
            yield from _pep508(line, False)


def pom_xml(content: str) -> Iterator[tuple[str, str, bool]]:
    for node in ET.fromstring(content).iter():
        if node.tag.rpartition("}")[2] == "dependency":
            own = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in node}
            if own.get("artifactId"):
                yield f"{own.get('groupId', '')}:{own['artifactId']}", own.get("version") or "*", own.get("scope") in ("test", "provided")


def cargo_toml(content: str) -> Iterator[tuple[str, str, bool]]:
    data = tomllib.loads(content)
    for table, dev in (("dependencies", False), ("dev-dependencies", True), ("build-dependencies", True)):
        for name, spec in data.get(table, {}).items():
            yield name, (spec if isinstance(spec, str) else spec.get("version", "*") if isinstance(spec, dict) else "*"), dev


def csproj(content: str) -> Iterator[tuple[str, str, bool]]:
    for node in ET.fromstring(content).iter():
        if node.tag.rpartition("}")[2] == "PackageReference" and node.get("Include"):
            version = node.get("Version") or next((c.text for c in node if c.tag.rpartition("}")[2] == "Version"), None)
            yield node.get("Include"), version or "*", False


def vcpkg_json(content: str) -> Iterator[tuple[str, str, bool]]:
    for d in json.loads(content).get("dependencies", []):
        if isinstance(d, str):
            yield d, "*", False
        elif d.get("name"):
            yield d["name"], d.get("version>=", d.get("version", "*")), False


STRUCTURED: dict[str, tuple[str, Callable]] = {
    "pyproject.toml": ("pypi", pyproject), "setup.cfg": ("pypi", setup_cfg), "pom.xml": ("maven", pom_xml), "Cargo.toml": ("crates", cargo_toml), "*.csproj": ("nuget", csproj), "vcpkg.json": ("vcpkg", vcpkg_json),
}
LINES = {"package.json": package_json, "build.gradle": gradle, "go.mod": go_mod, "CMakeLists.txt": cmake}


def _structured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pinned = re.compile(RANGE)
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base = re.split(r"[/\\]", path)[-1]
            ecosystem, parse = STRUCTURED["*.csproj" if base.endswith(".csproj") else base]
            try:
                found = list(parse(content or ""))
            except (tomllib.TOMLDecodeError, configparser.Error, ET.ParseError, json.JSONDecodeError, AttributeError, TypeError):
                continue  # not a manifest after all
            rows += [(n, v, ecosystem, path, dev, bool(v.strip()) and v != "latest" and not pinned.search(v)) for n, v, dev in found]
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.bool_()] * 2)], names=["name", "version", "ecosystem", "file_path", "is_dev", "is_pinned"])


def dependencies(files: DataFrame) -> DataFrame:
    """Dependencies that all manifests among the files (file_path, content) declare; files in skipped folders are left out."""
    parts = F.split("file_path", r"[/\\]")
    x = files.select("file_path", F.col("content").cast("string").alias("content")).withColumn("base", base_name(F.col("file_path"))).filter(~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED])))
    is_requirements = (F.col("base").startswith("requirements") & F.col("base").endswith(".txt")) | (F.col("base") == "constraints.txt")
    out = requirements(x.filter(is_requirements))
    for base, parse in LINES.items():
        out = out.unionByName(parse(x.filter(F.col("base") == base)))
    rest = x.filter(F.col("base").isin(*[b for b in STRUCTURED if b[0] != "*"]) | F.col("base").endswith(".csproj")).select("file_path", "content")
    return out.unionByName(rest.mapInArrow(_structured, "name string, version string, ecosystem string, file_path string, is_dev boolean, is_pinned boolean"))
