"""What a source file says, by a lexical pass over it: imports, calls, comments, variables, Terraform blocks.

One small state machine reads the tokens of a file in order; strings and comments are
tokens of their own, so nothing inside them counts as code.  It runs in Arrow batches
inside tasks; which library a call belongs to, and what it means, is left to joins.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from depgrove.operators.batches import cut

#: A string belongs to so many calls around it, innermost first.
AROUND = 8
EVIDENCE = 200

_STRINGS = r"""(?P<string>"(?:[^"\\\n]|\\[\s\S])*+"?|'(?:[^'\\\n]|\\[\s\S])*+'?)"""
_REST = r"(?P<word>[A-Za-z_$][\w$]*+)|(?P<mark>[()\[\]{},.=:@;])|(?P<line>\n)|[^\w$\s()\[\]{},.=:@;\"'`#/]++|[^\S\n]++|\d[\w.]*+|."
_SLASHES = r"(?P<comment>//[^\n]*+|/\*[\s\S]*?(?:\*/|\Z))"
LEXERS = {
    "python": re.compile(rf"""(?P<comment>\#[^\n]*+)|(?P<doc>\b[rRbBuUfF]{{0,2}}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))|{_STRINGS}|{_REST}"""),
    "go": re.compile(rf"{_SLASHES}|(?P<raw>`[^`]*+`?)|{_STRINGS}|{_REST}"),
    "javascript": re.compile(rf"{_SLASHES}|(?P<raw>`(?:[^`\\]|\\[\s\S])*+`?)|{_STRINGS}|{_REST}"),
}
DECLARING = {"def", "class", "func", "function"}
_ENV = re.compile(r"""(?:os\.(?:Getenv|LookupEnv|getenv|environ\.get)\(|os\.environ\[|process\.env\[)["']([A-Z_][A-Z0-9_]*+)["']|process\.env\.([A-Z_][A-Z0-9_]*+)|\$\{([A-Z_][A-Z0-9_]*+)\}|\$([A-Z_][A-Z0-9_]*+)\b""")
_PY_FROM = re.compile(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]*(\([^)]*+\)|[^\n(]+)", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+([^\n;]+)", re.M)
_GO_IMPORT = re.compile(r'^[ \t]*import[ \t]*(?:\(([^)]*+)\)|([^\n(]+))', re.M)
_GO_SPEC = re.compile(r'(?:([\w.]+)[ \t]+)?"([^"\n]+)"')
_JS_IMPORT = re.compile(r"""^[ \t]*import\b([^;'"]*+)['"]([^'"\n]+)['"]""", re.M)
_JS_REQUIRE = re.compile(r"""\b(?:const|let|var)\s+([\w$]++|\{[^}]*+\})\s*=\s*(?:await\s+)?(?:require|import)\s*\(\s*['"]([^'"\n]+)['"]\s*\)""")

FOUND = (
    "imports array<struct<local: string, library: string, name: string>>, "
    "calls array<struct<line: int, object: string, function: string, form: string, args: array<struct<at: int, name: string, value: string, whole: boolean>>, evidence: string>>, "
    "comments array<struct<line: int, text: string, evidence: string>>, variables array<struct<line: int, name: string, evidence: string>>, "
    "blocks array<struct<line: int, kind: string, type: string, label: string, evidence: string>>"
)


def go_package(path: str) -> str:
    """The name under which Go code sees an import without an alias."""
    parts = path.split("/")
    base = parts[-2] if re.fullmatch(r"v\d+", parts[-1]) and len(parts) > 1 else parts[-1]
    base = base.removesuffix(".go")
    return base.rpartition("-")[2] or base


def imports_of(language: str, code: str) -> list[tuple[str, str, str | None]]:
    """``local, library, name`` of code without comments; the last import of a local name counts."""
    out: dict[str, tuple[str, str | None]] = {}

    def named(library: str, items: str, between: str) -> None:
        for item in items.split(","):
            name, _, alias = (x.strip() for x in item.strip(" \t\r\n()").partition(between))
            if name:
                out[alias or name] = (library, name)

    if language == "python":
        for m in sorted([*_PY_FROM.finditer(code), *_PY_IMPORT.finditer(code)], key=lambda m: m.start()):
            if m.re is _PY_FROM:
                named(m[1], m[2], " as ")
            else:
                for item in m[1].split(","):
                    library, _, alias = (x.strip() for x in item.partition(" as "))
                    out[alias or library] = (library, None)
    elif language == "go":
        for m in _GO_IMPORT.finditer(code):
            for alias, path in _GO_SPEC.findall(m[1] or m[2]):
                out[alias or go_package(path)] = (path, None)
    else:
        for m in sorted([*_JS_IMPORT.finditer(code), *_JS_REQUIRE.finditer(code)], key=lambda m: m.start()):
            clause = m[1].strip()
            if m.re is _JS_IMPORT:
                if not clause.endswith("from"):
                    continue
                clause = clause[:-4].strip()
            plain, brace, inner = clause.partition("{")
            for item in plain.split(","):
                local = item.strip().removeprefix("*").strip().removeprefix("as ").strip()
                if local:
                    out[local] = (m[2], None)
            if brace:
                named(m[2], inner.partition("}")[0], " as " if m.re is _JS_IMPORT else ":")
    return [(local, library, name) for local, (library, name) in out.items()]


def _unquoted(text: str) -> str:
    body = text[1:]
    return body[:-1] if body.endswith(text[0]) else body


def scan(language: str, content: str) -> dict[str, list]:
    """The five lists of one file."""
    lines = content.split("\n")
    starts = [0]
    for line in lines[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    at_line = lambda at: bisect_right(starts, at)
    evidence = lambda n: lines[n - 1].strip()[:EVIDENCE]
    variables = sorted({(at_line(m.start()), next(filter(None, m.groups()))) for m in _ENV.finditer(content)})
    out = {"imports": [], "calls": [], "comments": [], "variables": [(n, name, evidence(n)) for n, name in variables], "blocks": []}
    if language == "terraform":
        out["blocks"] = [(n, *found, evidence(n)) for n, *found in terraform_blocks(lines)]
        return out
    code: list[str] = []  # without comments and many-line strings
    stack: list[dict | None] = []  # open brackets; calls have a frame
    calls: list[dict] = []
    before, word, owner, made, decorated = "", "", None, False, False
    key, last = None, None  # a keyword before a string; the string that the next mark may close
    for m in LEXERS[language].finditer(content):
        kind, text = m.lastgroup, m[0]
        if kind in ("comment", "doc"):
            n = at_line(m.start())
            if kind == "doc":
                text = text.lstrip("rRbBuUfF")
                text = text[3:-3] if text.endswith(text[:3]) and len(text) >= 6 else text[3:]
            else:
                text = text[2:].removesuffix("*/") if text.startswith("/*") else text.removeprefix("//") if language != "python" else text[1:]
            for i, part in enumerate(text.split("\n")):
                part = part.strip()
                part = "" if part == "*" else part.removeprefix("* ").strip()
                if part:
                    out["comments"].append((n + i, part, evidence(n + i)))
            code.append("\n" * m[0].count("\n"))
            continue
        code.append(text if kind != "raw" else "``" + "\n" * text.count("\n"))
        if kind == "line" or text.isspace():
            continue
        if kind in ("string", "raw"):
            value, entries, count = _unquoted(text), [], 0
            for i in range(len(stack) - 1, -1, -1):
                frame = stack[i]
                if frame is not None:
                    entry = {"at": frame["at"], "name": key, "value": value, "whole": i == len(stack) - 1 and before in ("(", ",")}
                    frame["args"].append(entry)
                    entries.append(entry)
                    count += 1
                    if count == AROUND:
                        break
            last, key, before = entries, None, "string"
            continue
        if last is not None and text not in (",", ")"):
            for entry in last:
                entry["whole"] = False
        last = None
        if kind == "word":
            if before == ".":
                owner = word
            else:
                owner, made = None, before == "word" and word == "new"
                decorated = before == "@"
                declared = before == "word" and word in DECLARING
            if before == "." and owner == "":
                declared = False
            word, before = text, "word"
            continue
        if text in "([{":
            frame = None
            if text == "(" and before == "word" and not declared:
                n = at_line(m.start())
                frame = {"line": n, "object": owner, "function": word, "form": "new" if made else "decorator" if decorated else "call", "args": [], "at": 0}
                calls.append(frame)
            stack.append(frame)
        elif text in ")]}":
            if stack:
                stack.pop()
        elif text == "," and stack and stack[-1] is not None:
            stack[-1]["at"] += 1
        key = word if text in "=:" and before == "word" else None
        if text != ".":
            word = word if text in "=:" else ""
        before = text
    for call in calls:
        out["calls"].append((call["line"], call["object"], call["function"], call["form"], [tuple(a.values()) for a in call["args"]], evidence(call["line"])))
    out["imports"] = imports_of(language, "".join(code))
    return out


_BLOCK = re.compile(r'(resource|data)\s+"([^"]+)"\s+"([^"]+)"|(module)\s+"([^"]+)"')
_SOURCE = re.compile(r'source\s*=\s*"([^"]+)"')
_DEPENDS = re.compile(r"depends_on\s*=\s*\[([^\]]*)(\])?")
_ADDRESS = re.compile(r"\b((?:aws|kubernetes|helm)_\w+)\.(\w+)\b")
_QUIET = re.compile(r'"(?:[^"\\]|\\.)*+"?|#.*|//.*')


def terraform_blocks(lines: list[str]) -> Iterator[tuple[int, str, str | None, str]]:
    """``line, kind, type, label``: top-level blocks by brace depth, what they depend on and refer to.

    Kinds are resource, data, module (type: its source), dependency and ref.
    """
    depth, block, waiting, listing = 0, None, None, False
    for n, line in enumerate(lines, 1):
        text = line.strip()
        if not text or text.startswith(("#", "//")):
            continue
        bare = _QUIET.sub("", text)
        opens = bare.count("{")
        was, depth = depth, depth + opens - bare.count("}")
        if listing:
            listing = "]" not in text
            yield from ((n, "dependency", *ref) for ref in _ADDRESS.findall(text))
            continue
        if waiting and was == 0 and depth > 0:
            block, waiting = waiting, None
        if was == 0 and (m := _BLOCK.match(text)):
            mine = ("module", None, m[5]) if m[4] else (m[1], m[2], m[3])
            if not m[4]:
                yield (n, *mine)
            block, waiting = (mine, None) if opens else (block, mine)
            if depth == 0:
                block = None
            continue
        if block and depth >= 1:
            kind, of, label = block
            if kind == "module":
                if depth == 1 and (m := _SOURCE.match(text)):
                    yield (n, "module", m[1], label)
            elif depth == 1 and (m := _DEPENDS.match(text)):
                yield from ((n, "dependency", *ref) for ref in _ADDRESS.findall(m[1]))
                listing = not m[2]
            else:
                yield from ((n, "ref", *ref) for ref in _ADDRESS.findall(text) if ref != (of, label))
        if depth == 0:
            block = None


def scanned(files: DataFrame) -> DataFrame:
    """``src, path, language`` and the five lists of ``src, path, language, content`` files.

    A null content is empty.  A file is scanned whole, in time linear in its length.
    """
    kept = [pa.field(c, pa.string()) for c in ("src", "path", "language")]
    found = to_arrow_schema(_parse_datatype_string(FOUND))
    schema = pa.schema([*kept, *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "content"):
            rows = [scan(language, content or "") for language, content in zip(batch.column("language").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            names = {f.name: [x.name for x in f.type.value_type] for f in found}
            lists = [pa.array([[_named(names[f.name], f.type.value_type, x) for x in row[f.name]] for row in rows], f.type) for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(pa.string()) for f in kept), *lists], schema=schema)

    given = files.select(*(F.col(c).cast("string").alias(c) for c in ("src", "path", "language", "content")))
    return given.mapInArrow(run, f"src string, path string, language string, {FOUND}")


def _named(names: list[str], kind: pa.StructType, values: tuple) -> dict:
    row = dict(zip(names, values, strict=True))
    if "args" in row:
        inner = [x.name for x in kind.field("args").type.value_type]
        row["args"] = [dict(zip(inner, a, strict=True)) for a in row["args"]]
    return row
