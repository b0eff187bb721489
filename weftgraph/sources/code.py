"""Source code to symbols and edges: (path, language, content) rows, Arrow batch by batch.

Python is read by its own grammar (`ast`). The other languages are read by a small lexer that
follows braces and declarations; what it cannot see (macros, generated code) gives no rows.
`register` adds a parser. A file that cannot be parsed gives no rows.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL = "fq_name string, name string, kind string, file_path string, namespace string, parent_fq_name string, start_line int, end_line int, signature string, modifiers array<string>, parameters array<string>, base_types array<string>, return_type string, doc_comment string, cyclomatic_complexity int, cognitive_complexity int, structural_fingerprint string, statement_windows array<string>"
EDGE = "source string, target string, edge_type string, file_path string, line int"
SYMBOL_FIELDS = [f.split(" ")[0] for f in SYMBOL.split(", ")]
EDGE_FIELDS = [f.split(" ")[0] for f in EDGE.split(", ")]
MAX_SIGNATURE, WINDOW = 500, 5


class Found:
    """Symbols and edges of one file."""

    def __init__(self, path: str, namespace: str):
        self.path, self.namespace, self.symbols, self.edges = path, namespace, [], []

    def symbol(self, name: str, kind: str, parent: str | None, start: int, end: int, **more) -> str:
        fq = f"{parent}.{name}" if parent else f"{self.namespace}.{name}" if self.namespace else name
        base = {"fq_name": fq, "name": name, "kind": kind, "file_path": self.path, "namespace": self.namespace, "parent_fq_name": parent, "start_line": start, "end_line": end}
        rest = {"signature": "", "modifiers": [], "parameters": [], "base_types": [], "return_type": "", "doc_comment": "", "cyclomatic_complexity": 0, "cognitive_complexity": 0, "structural_fingerprint": "", "statement_windows": []}
        self.symbols.append(base | rest | more)
        if parent:
            self.edge(parent, fq, "contains", start)
        return fq

    def edge(self, source: str, target: str, kind: str, line: int = 0) -> None:
        self.edges.append({"source": source, "target": target, "edge_type": kind, "file_path": self.path, "line": line})


def dotted_path(path: str) -> str:
    return re.sub(r"\.[^./\\]+$", "", path).replace("\\", "/").strip("/").replace("/", ".")


# ---- Python -------------------------------------------------------------------------------------

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case, ast.comprehension)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Lambda, ast.Match, ast.FunctionDef, ast.AsyncFunctionDef)
_LEAVES = (ast.Name, ast.Constant, ast.arg, ast.alias, ast.Load, ast.Store, ast.Del, ast.keyword)


def cyclomatic(node: ast.AST) -> int:
    n = 1
    for x in ast.walk(node):
        n += isinstance(x, _BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
    return n


def cognitive(node: ast.AST, name: str) -> int:
    """Branches cost one and their depth; else, boolean operators and recursion cost one."""
    total, stack = 0, [(c, 0) for c in ast.iter_child_nodes(node)]
    while stack:
        x, depth = stack.pop()
        if isinstance(x, _BRANCHES):
            total += 1 + depth
        if isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
        if isinstance(x, ast.Call) and _called(x.func) == name:
            total += 1
        orelse = getattr(x, "orelse", None)
        if isinstance(orelse, list) and orelse and not (len(orelse) == 1 and isinstance(orelse[0], ast.If)):
            total += 1
        deeper = depth + isinstance(x, _NESTING)
        stack += [(c, depth if isinstance(orelse, list) and c in orelse and isinstance(c, ast.If) else deeper) for c in ast.iter_child_nodes(x)]
    return total


def fingerprint(node: ast.AST) -> str:
    """A hash of the kinds of nodes in order; names and literals do not count."""
    kinds: list[str] = []

    def visit(x: ast.AST) -> None:
        if not isinstance(x, _LEAVES):
            kinds.append(type(x).__name__)
        for c in ast.iter_child_nodes(x):
            visit(c)

    for statement in getattr(node, "body", []):
        visit(statement)
    return hashlib.sha256("|".join(kinds).encode()).hexdigest()[:16]


def windows(node: ast.AST) -> list[str]:
    each = [hashlib.md5("|".join(type(x).__name__ for x in ast.walk(s) if not isinstance(x, _LEAVES)).encode()).hexdigest()[:8] for s in getattr(node, "body", [])]
    if not each:
        return []
    return [hashlib.md5("".join(each[k : k + WINDOW]).encode()).hexdigest()[:16] for k in range(max(1, len(each) - WINDOW + 1))]


def _called(f: ast.expr) -> str:
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""


def parse_python(content: str, path: str) -> Found:
    tree, out = ast.parse(content), Found(path, dotted_path(path))
    lines = content.split("\n")
    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                out.edge(out.namespace or path, a.name, "imports")
        elif isinstance(node, ast.ImportFrom):
            out.edge(out.namespace or path, "." * node.level + (node.module or ""), "imports")

    def function(node, parent: str | None) -> None:
        decorators = [ast.unparse(d) for d in node.decorator_list]
        kind = "constructor" if node.name == "__init__" else "property" if any(d == "property" or d.endswith(".setter") for d in decorators) else "method"
        args = node.args
        names = [a.arg for a in (*args.posonlyargs, *args.args)] + [f"*{a.arg}" for a in [args.vararg] if a] + [a.arg for a in args.kwonlyargs] + [f"**{a.arg}" for a in [args.kwarg] if a]
        body = node.body[0].lineno
        signature = " ".join(x.strip() for x in lines[node.lineno - 1 : max(node.lineno, body - 1)])[:MAX_SIGNATURE]
        first = node.body[0]
        doc = ast.get_docstring(node) or "" if isinstance(first, ast.Expr) and re.match(r'\s*[rRuU]?("""|\'\'\')', lines[first.lineno - 1][first.col_offset :]) else ""
        fq = out.symbol(
            node.name, kind, parent, node.lineno, node.end_lineno, signature=signature, modifiers=decorators, parameters=[n for n in names if n not in ("self", "cls")],
            return_type=ast.unparse(node.returns) if node.returns else "", doc_comment=doc, cyclomatic_complexity=cyclomatic(node), cognitive_complexity=cognitive(node, node.name),
            structural_fingerprint=fingerprint(node), statement_windows=windows(node),
        )
        for x in ast.walk(node):
            if isinstance(x, ast.Call) and (name := _called(x.func)):
                out.edge(fq, name, "calls", x.lineno)

    def walk(body: list, parent: str | None) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                function(node, parent)
            elif isinstance(node, ast.ClassDef):
                bases = [ast.unparse(b) for b in node.bases]
                doc = ast.get_docstring(node) or ""
                fq = out.symbol(node.name, "class", parent, node.lineno, node.end_lineno, signature=lines[node.lineno - 1].strip()[:MAX_SIGNATURE], base_types=bases, doc_comment=doc, modifiers=[ast.unparse(d) for d in node.decorator_list])
                for b in bases:
                    out.edge(fq, b, "inherits", node.lineno)
                walk(node.body, fq)

    walk(tree.body, None)
    return out


# ---- languages with braces ----------------------------------------------------------------------

_TOKENS = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`""", re.S)
_BRANCH_WORDS = re.compile(r"\b(?:if|for|foreach|while|case|catch|match|loop|select)\b|\?(?![.?:])|&&|\|\|")
_CALL = re.compile(r"\b(new\s+)?([A-Za-z_]\w*)\s*(?:<[\w,\s<>]*>)?\s*\(")
_KEYWORDS = {"if", "for", "foreach", "while", "switch", "catch", "return", "using", "lock", "sizeof", "typeof", "nameof", "function", "else", "do", "new", "throw", "await", "super", "this", "base", "in"}
_OWN_KEYWORDS = {"go": {"go", "defer", "select", "func"}, "rust": {"loop", "impl", "match", "fn"}}
_MODIFIERS = {"public", "private", "protected", "internal", "static", "abstract", "sealed", "final", "virtual", "override", "async", "readonly", "export", "const", "partial", "synchronized", "default", "extern", "inline", "pub", "unsafe"}

_TYPE = {
    "csharp": r"\b(?P<kind>class|interface|struct|enum|record)\s+(?P<name>\w+)(?:<[^{>]*>)?(?:\([^)]*\))?\s*(?::\s*(?P<bases>[^{;]+?))?\s*(?:where[^{]*)?$",
    "java": r"(?:@)?\b(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\([^)]*\))?\s*(?:extends\s+(?P<bases>[\w.<>, ]+?))?\s*(?:implements\s+(?P<implements>[\w.<>, ]+?))?\s*$",
    "typescript": r"\b(?P<kind>class|interface|enum)\s+(?P<name>\w+)(?:<[^{]*?>)?\s*(?:extends\s+(?P<bases>[\w.<>, ]+?))?\s*(?:implements\s+(?P<implements>[\w.<>, ]+?))?\s*$",
    "go": r"\btype\s+(?P<name>\w+)\s+(?P<kind>struct|interface)\s*$",
    "rust": r"\b(?P<kind>struct|enum|trait|impl|mod)\b(?:<[^>]*>)?\s+(?:(?P<implements>[\w:<>]+)\s+for\s+)?(?P<name>\w+)(?:<[^{]*>)?[^{;(]*$",
    "c": r"\b(?P<kind>struct|enum)\s+(?P<name>\w+)\s*$",
    "cpp": r"\b(?P<kind>class|struct|enum(?:\s+class)?|namespace)\s+(?P<name>\w+)\s*(?:final\s*)?(?::\s*(?P<bases>[^{;]+?))?\s*$",
}
_FUNC = {
    "go": r"\bfunc\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<args>[^{]*?)\)\s*(?P<ret>[^{]*)$",
    "rust": r"\bfn\s+(?P<name>\w+)\s*(?:<[^{]*?>)?\((?P<args>[^{]*?)\)\s*(?:->\s*(?P<ret>[^{]+?))?\s*(?:where[^{]*)?$",
    "typescript": r"(?:\bfunction\s+(?P<name>\w+)|(?P<method>\w+)|\b(?:const|let)\s+(?P<arrow>\w+)\s*=\s*(?:async\s*)?)\s*(?:<[^{(]*?>)?\((?P<args>[^{]*?)\)\s*(?::\s*(?P<ret>[^{=]+?))?\s*(?:=>)?\s*$",
    "": r"(?P<ret>[\w.<>\[\],?*&:~ ]*?)\s*(?P<name>~?\w+)\s*(?:<[^{(]*?>)?\((?P<args>[^{}]*?)\)(?:\s*(?:const|noexcept|override)\b|\s+throws\s[^{]*|\s*:[^:{][^{]*)*\s*$",
}
_IMPORT = {
    "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "typescript": r"""^\s*import\s+(?:[^'"]*?from\s+)?['"]([^'"]+)['"]""",
    "go": r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$""", "rust": r"^\s*(?:pub\s+)?use\s+([^;]+);", "c": r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]""", "cpp": r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]""",
}
_SPACE = {"csharp": r"\bnamespace\s+([\w.]+)", "java": r"^\s*package\s+([\w.]+)\s*;", "go": r"^\s*package\s+(\w+)"}
_FIELD = {
    "go": re.compile(r"^\s*(?P<name>[A-Za-z_]\w*)\s+(?P<type>[\w.*\[\]]+)\s*(?:`.*)?$"),
    "rust": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?P<name>[a-z_]\w*)\s*:\s*(?P<type>[^,=]+),?\s*$"),
    "typescript": re.compile(r"^\s*(?:(?:public|private|protected|readonly|static)\s+)*(?P<name>\w+)[?!]?\s*:\s*(?P<type>[^;=(]+)(?:=[^;]*)?;?\s*$"),
    "": re.compile(r"^\s*(?:(?:public|private|protected|internal|static|readonly|final|const|volatile|unsigned)\s+)*(?P<type>[\w.<>\[\],?*&: ]+?)\s*\b(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?:=[^;]*)?;\s*$"),
}
_PROPERTY = re.compile(r"(?P<type>[\w.<>\[\]?,]+)\s+(?P<name>\w+)\s*$")


def _split(names: str | None) -> list[str]:
    out, depth, now = [], 0, ""
    for c in names or "":
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth <= 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [re.sub(r"<.*", "", re.sub(r"^(?:public|private|protected|virtual)\s+", "", x.strip())).strip() for x in [*out, now] if x.strip()]


def parse_braces(content: str, path: str, language: str) -> Found:
    """Declarations before each opening brace; what a function's braces hold gives its calls and complexity."""
    family = "typescript" if language == "tsx" else language
    keywords = (_KEYWORDS | _OWN_KEYWORDS.get(family, set())) - ({"new", "base", "do", "using", "lock"} if family in ("rust", "go") else set())
    blank = _TOKENS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], content)
    found = re.search(_SPACE[family], blank, re.M) if family in _SPACE else None
    out = Found(path, found[1] if found else "" if family in _SPACE else dotted_path(path))
    for m in re.finditer(_IMPORT[family], content, re.M):
        out.edge(out.namespace or path, m[1].strip(), "imports")
    types, functions = re.compile(_TYPE[family], re.S), re.compile(_FUNC.get(family, _FUNC[""]), re.S)
    stack: list[tuple[str, str | None, int | None, int]] = []  # (what, fq, symbol, where its body begins)
    last = 0
    line_of = lambda at: content.count("\n", 0, at) + 1
    for m in re.finditer(r"[{};]", blank):
        at = m.start()
        if m[0] == ";":
            last = last if blank.count("(", last, at) > blank.count(")", last, at) else at + 1
            continue
        if m[0] == "}":
            if stack:
                what, fq, index, begin = stack.pop()
                if index is not None:
                    s = out.symbols[index]
                    s["end_line"] = line_of(at)
                    if what == "function":
                        _finish(out, s, blank[begin:at], begin, line_of, keywords)
                    elif what == "type":
                        _fields(out, s, blank[begin:at], begin, family, line_of)
            last = at + 1
            continue
        head = blank[last:at].strip()
        start = last + (len(blank[last:at]) - len(blank[last:at].lstrip()))
        owner = next((fq for what, fq, _, _ in reversed(stack) if what == "type"), None)
        words = re.findall(r"\w+", head)
        mods = [w for w in dict.fromkeys(words) if w in _MODIFIERS]
        signature = re.sub(r"\s+", " ", head)[:MAX_SIGNATURE]
        in_function = any(what == "function" for what, *_ in stack)
        entry: tuple = ("block", None, None, at + 1)
        t = None if in_function else types.search(head)
        f = None if t or in_function else functions.search(head)
        if t:
            kind, name = t["kind"].split()[0], t["name"]
            g = t.groupdict()
            if kind == "impl":
                fq = f"{out.namespace}.{name}" if out.namespace else name
                if g.get("implements"):
                    out.edge(fq, g["implements"], "implements", line_of(start))
                entry = ("type", fq, None, at + 1)
            elif kind == "namespace" and family == "csharp":
                entry = ("block", None, None, at + 1)
            else:
                bases, impls = _split(g.get("bases")), _split(g.get("implements"))
                kind = {"trait": "interface", "mod": "namespace"}.get(kind, kind)
                fq = out.symbol(name, kind, owner, line_of(start), line_of(at), signature=signature, modifiers=mods, base_types=bases + impls, doc_comment=_doc(content, start))
                for b in bases:
                    out.edge(fq, b, "implements" if family == "csharp" and kind == "class" else "inherits", line_of(start))
                for b in impls:
                    out.edge(fq, b, "implements", line_of(start))
                entry = ("type", fq, len(out.symbols) - 1, at + 1)
        elif f:
            g = f.groupdict()
            name = g.get("name") or g.get("method") or g.get("arrow") or ""
            if name and name not in keywords and (g.get("ret") or "").strip() not in ("return", "new", "else", "throw"):
                parent = owner
                if g.get("owner"):
                    parent = f"{out.namespace}.{g['owner']}" if out.namespace else g["owner"]
                ret = " ".join(w for w in (g.get("ret") or "").split() if w not in _MODIFIERS).strip()
                own = (parent or "").rpartition(".")[2]
                kind = "constructor" if name == own or (family == "typescript" and name == "constructor") or (family == "rust" and name == "new" and parent) else "method"
                params = [p for p in _split(g.get("args")) if p not in ("self", "&self", "&mut self", "mut self", "void")]
                fq = out.symbol(name, kind, parent, line_of(start), line_of(at), signature=signature, modifiers=mods, parameters=params, return_type=ret, doc_comment=_doc(content, start))
                entry = ("function", fq, len(out.symbols) - 1, at + 1)
        elif owner and family == "csharp" and not in_function and (p := _PROPERTY.search(head)):
            fq = out.symbol(p["name"], "property", owner, line_of(start), line_of(at), signature=signature, modifiers=mods, return_type=p["type"])
            entry = ("property", fq, len(out.symbols) - 1, at + 1)
        stack.append(entry)
        last = at + 1
    return out


def _doc(content: str, start: int) -> str:
    before = content[:start].rstrip()
    if before.endswith("*/"):
        return before[before.rfind("/*") :]
    line = before.rpartition("\n")[2].strip()
    return line if line.startswith("//") else ""


def _finish(out: Found, s: dict, body: str, begin: int, line_of, keywords: set[str]) -> None:
    for c in _CALL.finditer(body):
        if c[2] not in keywords:
            out.edge(s["fq_name"], c[2], "calls", line_of(begin + c.start()))
    s["cyclomatic_complexity"] = 1 + len(_BRANCH_WORDS.findall(body))
    depth, total, at = 0, 0, 0
    marks = sorted([(m.start(), m[0]) for m in re.finditer(r"[{}]", body)] + [(m.start(), m[0]) for m in _BRANCH_WORDS.finditer(body)] + [(m.start(), "else") for m in re.finditer(r"\belse\b(?!\s*if)", body)])
    for at, what in marks:
        depth += (what == "{") - (what == "}")
        if what not in "{}":
            total += 1 if what in ("&&", "||", "else") else 1 + max(0, depth)
    s["cognitive_complexity"] = total + len(re.findall(rf"\b{re.escape(s['name'])}\s*\(", body))
    shape = re.sub(r"\b(?!if\b|else\b|for\b|while\b|return\b|switch\b|case\b|try\b|catch\b|new\b|throw\b)\w+\b", "x", re.sub(r"""["'`][^"'`\n]*["'`]""", "x", body))
    s["structural_fingerprint"] = hashlib.sha256(re.sub(r"\s+", "", shape).encode()).hexdigest()[:16]
    each = [hashlib.md5(re.sub(r"\s+", "", x).encode()).hexdigest()[:8] for x in shape.split(";") if x.strip(" \n\t{}")]
    s["statement_windows"] = [hashlib.md5("".join(each[k : k + WINDOW]).encode()).hexdigest()[:16] for k in range(max(1, len(each) - WINDOW + 1))] if each else []


def _fields(out: Found, s: dict, body: str, begin: int, family: str, line_of) -> None:
    if s["kind"] not in ("class", "struct", "interface", "record"):
        return
    pattern, depth, at = _FIELD.get(family, _FIELD[""]), 0, 0
    for line in body.split("\n"):
        if depth == 0 and (m := pattern.match(line)) and m["name"] not in _KEYWORDS and "(" not in line.partition("=")[0]:
            mods = [w for w in re.findall(r"\w+", line.partition(m["name"])[0]) if w in _MODIFIERS]
            out.symbol(m["name"], "field", s["fq_name"], line_of(begin + at + len(line) - len(line.lstrip())), line_of(begin + at + len(line) - len(line.lstrip())), modifiers=mods, return_type=m["type"].strip())
        depth += line.count("{") - line.count("}") + line.count("(") - line.count(")")
        at += len(line) + 1


PARSERS: dict[str, Callable[[str, str], Found]] = {"python": parse_python}
for _language in ("csharp", "java", "typescript", "tsx", "go", "rust", "c", "cpp"):
    PARSERS[_language] = lambda content, path, language=_language: parse_braces(content, path, language)


def register(language: str, parser: Callable[[str, str], Found]) -> None:
    """Read a language by another parser: a function of (content, path)."""
    PARSERS[language] = parser


def _run(what: str, fields: list[str], parsers: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                parser = parsers.get(language)
                if parser is None or content is None:
                    continue
                try:
                    found = parser(content.decode("utf-8", "replace") if isinstance(content, bytes) else content, path)
                except (SyntaxError, ValueError, RecursionError):
                    continue  # not parsed: no rows
                rows += getattr(found, what)
            kinds = {"modifiers": pa.list_(pa.string()), "parameters": pa.list_(pa.string()), "base_types": pa.list_(pa.string()), "statement_windows": pa.list_(pa.string())}
            ints = ("start_line", "end_line", "line", "cyclomatic_complexity", "cognitive_complexity")
            yield pa.record_batch([pa.array([r[f] for r in rows], kinds.get(f, pa.int32() if f in ints else pa.string())) for f in fields], names=fields)

    return run


def symbols(files: DataFrame) -> DataFrame:
    """One row a fq_name: of several, the last in order of file and line."""
    raw = files.select("path", "language", "content").mapInArrow(_run("symbols", SYMBOL_FIELDS, dict(PARSERS)), SYMBOL)
    return raw.groupBy("fq_name").agg(F.max_by(F.struct(*[f for f in SYMBOL_FIELDS if f != "fq_name"]), F.struct("file_path", "start_line")).alias("s")).select("fq_name", "s.*")


def edges(files: DataFrame) -> DataFrame:
    return files.select("path", "language", "content").mapInArrow(_run("edges", EDGE_FIELDS, dict(PARSERS)), EDGE)
