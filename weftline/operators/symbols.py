"""Symbols and references out of source files.

Python is read with the standard library's parser; TypeScript and JavaScript by declaration patterns with brace
matching, as no grammar for them is at hand. Files are independent rows, so one map over Arrow batches does it.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "path string, seq long, type string, kind string, name string, start_line int, end_line int, exported boolean, parent_name string, parent_type string, documentation string, parameters array<string>, return_type string, signature string, content string"
REFERENCES = "path string, seq long, kind string, source_name string, source_line int, name string"

_DECLARATION = re.compile(r"(?m)^[ \t]*(?P<export>export\s+(?:default\s+)?)?(?:(?:abstract\s+)?class\s+(?P<class>[A-Za-z_$][\w$]*)|(?:async\s+)?function\s*\*?\s*(?P<function>[A-Za-z_$][\w$]*)|(?:const|let|var)\s+(?P<arrow>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()\n]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>|(?P<import>import\b[^;\n]*))")
_METHOD = re.compile(r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*\([^()\n]*\)\s*(?::\s*[^{\n]+)?\{")
_CALL = re.compile(r"(?<![\w$])(?:new\s+)?(?:[A-Za-z_$][\w$]*\s*\.\s*)*([A-Za-z_$][\w$]*)\s*\(")
_KEYWORDS = frozenset("if for while switch catch return function new typeof await super constructor async import export do else".split())
_HEAD = re.compile(r"\(([^()]*)\)\s*(?::\s*([^{=\n]+))?")


def _brace_end(text: str, start: int) -> int:
    """Position after the block that begins at or after `start`; the line's end without one. Strings and comments don't count."""
    depth = 0
    for m in re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{}]|;|\n", re.S).finditer(text, start):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif m.group() in ";\n" and depth == 0 and (m.group() == ";" or "{" not in text[m.end() : m.end() + 2]):
            return m.start()
    return len(text)


def _comment_before(text: str, start: int) -> str | None:
    held = []
    for line in reversed(text[:start].rstrip().split("\n")):
        mark = line.strip()
        if not mark.startswith(("//", "/*", "*", "#")):
            break
        held.append(re.sub(r"^(?://+|/\*+|\*+/?|#+)\s?|\s*\*+/$", "", mark))
    return "\n".join(x for x in reversed(held) if x) or None


def _braced(text: str):
    """Symbols (as dicts) and references of TypeScript or JavaScript source."""
    symbols, references = [], []
    line = lambda at: text.count("\n", 0, at) + 1

    def add(kind, sub, name, start, end, exported, parent):
        content = text[start:end]
        head = _HEAD.search(content) if kind == "function" else None
        symbols.append({
            "type": kind, "kind": sub, "name": name, "start_line": line(start), "end_line": line(max(start, end - 1)), "exported": exported, "parent_name": parent, "parent_type": "class" if parent else None,
            "documentation": _comment_before(text, start), "parameters": [p.split(":")[0].strip() for p in head.group(1).split(",") if p.strip()] if head else [],
            "return_type": (head.group(2) or "").strip() or None if head else None, "signature": content.split("{")[0].split("\n")[0].strip(), "content": content, "span": (start, end),
        })

    for m in _DECLARATION.finditer(text):
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        if m.group("import"):
            add("import", "import", m.group("import").strip(), start, m.end(), False, None)
            continue
        end = _brace_end(text, m.end())
        name = m.group("class") or m.group("function") or m.group("arrow")
        add("class" if m.group("class") else "function", "class" if m.group("class") else "function" if m.group("function") else "arrow", name, start, end, bool(m.group("export")), None)
        if m.group("class"):
            head = text[m.end() : text.find("{", m.end())] if "{" in text[m.end() :] else ""
            if found := re.search(r"extends\s+([A-Za-z_$][\w$.]*)", head):
                references.append(("extends", name, line(start), found.group(1)))
            if found := re.search(r"implements\s+([^{]+)", head):
                references += [("implements", name, line(start), x.strip()) for x in found.group(1).split(",") if x.strip()]
            for method in _METHOD.finditer(text, m.end(), end):
                if method.group("name") not in _KEYWORDS - {"constructor"}:
                    at = method.start() + len(method.group()) - len(method.group().lstrip())
                    add("function", "method", method.group("name"), at, _brace_end(text, method.end() - 1), bool(m.group("export")), name)
    owners = sorted(((s["span"], s) for s in symbols if s["type"] == "function"), key=lambda x: x[0][1] - x[0][0])
    for m in _CALL.finditer(text):
        owner = next((s for (a, b), s in owners if a <= m.start() < b), None)
        if owner and m.group(1) not in _KEYWORDS and m.start(1) > owner["span"][0] + owner["content"].find("("):
            references.append(("call", owner["name"], owner["start_line"], m.group(1)))
    return symbols, references


def _python(text: str):
    symbols, references = [], []
    lines = text.split("\n")

    def visit(node, stack):
        for child in ast.iter_child_nodes(node):
            top = stack[-1] if stack else None
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom)):
                content = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                made = isinstance(child, ast.ClassDef)
                imported = isinstance(child, (ast.Import, ast.ImportFrom))
                symbols.append({
                    "type": "import" if imported else "class" if made else "function", "kind": "import" if imported else "class" if made else "method" if top and top[0] == "class" else "function",
                    "name": content.strip() if imported else child.name, "start_line": child.lineno, "end_line": child.end_lineno, "exported": not stack and not imported and not child.name.startswith("_"),
                    "parent_name": top[1] if top else None, "parent_type": top[0] if top else None, "documentation": None if imported else ast.get_docstring(child),
                    "parameters": [] if imported or made else [a.arg for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs)],
                    "return_type": ast.unparse(child.returns) if not imported and not made and child.returns else None, "signature": content.split("\n")[0].strip().rstrip(":"), "content": content,
                })
                if imported:
                    continue
                if made:
                    references.extend(("extends", child.name, child.lineno, ast.unparse(b)) for b in child.bases)
                visit(child, [*stack, ("class" if made else "function", child.name, child.lineno)])
                continue
            if isinstance(child, ast.Call) and top:
                target = child.func.attr if isinstance(child.func, ast.Attribute) else child.func.id if isinstance(child.func, ast.Name) else None
                if target:
                    references.append(("call", top[1], top[2], target))
            visit(child, stack)

    visit(ast.parse(text), [])
    return symbols, references


def parse(language: str | None, content: str | None):
    """(symbols, references) of a file; none for languages that aren't parsed and for Python that doesn't parse. TSX and JSX give none."""
    if content is None:
        return [], []
    if language == "python":
        try:
            return _python(content)
        except (SyntaxError, ValueError, RecursionError):
            return [], []
    return _braced(content) if language in ("typescript", "javascript") else ([], [])


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files(path, language, content)."""
    names = [c.split()[0] for c in SYMBOLS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [{**s, "path": p, "seq": k} for p, lang, c in zip(pdf["path"], pdf["language"], pdf["content"], strict=True) for k, s in enumerate(parse(lang, c)[0])]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "language", "content").mapInPandas(run, SYMBOLS)


def extract_references(files: DataFrame) -> DataFrame:
    """Calls, extends and implements of files(path, language, content)."""
    names = [c.split()[0] for c in REFERENCES.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(p, k, *r) for p, lang, c in zip(pdf["path"], pdf["language"], pdf["content"], strict=True) for k, r in enumerate(parse(lang, c)[1])]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "language", "content").mapInPandas(run, REFERENCES)


def check_syntax(files: DataFrame) -> DataFrame:
    """(path, valid) of files(path, language, content): Python by its parser, braces and strings for TypeScript and JavaScript; others are valid."""

    def valid(language, content) -> bool:
        if language == "python":
            try:
                ast.parse(content or "")
            except (SyntaxError, ValueError, RecursionError):
                return False
        elif language in ("typescript", "javascript", "tsx", "jsx"):
            stack = []
            for m in re.finditer(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{}()\[\]]", content or "", re.S):
                c = m.group()
                if c in "{([":
                    stack.append({"{": "}", "(": ")", "[": "]"}[c])
                elif c in "})]" and (not stack or stack.pop() != c):
                    return False
            return not stack
        return True

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "valid": [valid(lang, c) for lang, c in zip(pdf["language"], pdf["content"], strict=True)]})

    return files.select("path", "language", "content").mapInPandas(run, "path string, valid boolean")


def symbol_card(language: Column, imports: Column, referenced: Column) -> Column:
    """The text that stands for a symbol row when it is embedded; absent parts have no line."""
    line = lambda label, x, some: F.when(some, F.concat(F.lit(label), x))
    has = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    parts = F.array(
        F.concat(F.lit("# symbol "), F.col("type"), F.lit(":"), F.col("kind")), F.concat(F.lit("name: "), F.col("name")), F.concat(F.lit("signature: "), F.coalesce("signature", "name")),
        F.concat(F.lit("file: "), F.col("path")), F.concat(F.lit("language: "), language), F.when(F.col("exported"), F.lit("exported: true")),
        line("parent: ", F.concat_ws(" ", F.coalesce("parent_type", F.lit("unknown")), "parent_name"), has("parent_name")), line("documentation:\n", F.trim("documentation"), has("documentation")),
        line("parameters: ", F.array_join("parameters", ", "), F.size("parameters") > 0), line("returns: ", F.col("return_type"), has("return_type")),
        line("imports: ", F.array_join(imports, ", "), F.size(imports) > 0), line("references: ", F.array_join(referenced, ", "), F.size(referenced) > 0), F.lit("---"), F.trim("content"),
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
