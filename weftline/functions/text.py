"""Column expressions over text; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the text search ignores.
STOP_WORDS = "the is at which on a an and or but in with to for of as by from this that".split()
# Phrases that mark an unsure answer, and hedges.
UNCERTAIN = ("need more", "without seeing", "not enough context", "unclear", "not sure", "might be", "possibly", "i don't know", "cannot determine", "insufficient")
HEDGES = ("maybe", "perhaps", "could be", "seems like")
# Languages by file extension.
LANGUAGES = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx", ".py": "python", ".json": "json", ".md": "markdown", ".markdown": "markdown"}
# What a rules text must have and must not have.
REQUIRED_SECTIONS = ("code style", "safety", "testing")
FORBIDDEN = r"(?i)api\s*key|password|secret"
ACTIONS = ("fix", "refactor", "change", "update", "modify", "add")
SNIPPET_LINES, SNIPPET_CHARS = 80, 1200


def index_tokens(text: Column) -> Column:
    """Tokens of the lexical index: lower-cased runs of a-z, 0-9 and underscore."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: x != "")


def search_tokens(text: Column) -> Column:
    """Tokens of the text search: runs of a-z and 0-9, two or more long, without stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, x))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def trimmed_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def token_count(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    return F.ceil(utf16_length(text) / 4).cast("long")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))


def language_of(path: Column) -> Column:
    """Language by the last extension, lower-cased; null if unknown."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)))


def file_card(path: Column, content: Column) -> Column:
    """Path, up to 20 import lines, up to 20 export lines and the first 50 lines of a file."""
    lines = F.split(content, "\r?\n", -1)
    edge = lambda w: rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])"
    imports = F.slice(F.filter(lines, lambda x: x.rlike(edge("import") + r"|require\(")), 1, 20)
    exports = F.slice(F.filter(lines, lambda x: x.rlike(edge("export"))), 1, 20)
    return F.concat_ws("\n", F.concat(F.lit("# file "), path), F.lit("## imports"), F.array_join(imports, "\n"), F.lit("## exports"), F.array_join(exports, "\n"), F.lit("## header"), F.array_join(F.slice(lines, 1, 50), "\n"))


def snippet(content: Column) -> Column:
    """The first 80 lines, at most 1200 characters of them, without white space at the end."""
    text = F.array_join(F.slice(F.split(F.coalesce(content, F.lit("")), "\r?\n", -1), 1, SNIPPET_LINES), "\n")
    return trimmed_end(F.when(F.length(text) > SNIPPET_CHARS, F.concat(F.substring(text, 1, SNIPPET_CHARS), F.lit("\n..."))).otherwise(text))


def node_text(kind: Column, name: Column, path: Column, start: Column, end: Column, content: Column) -> Column:
    """A node's card in a context."""
    return F.concat(F.lit("## "), kind, F.lit(": "), name, F.lit("\nFile: "), path, F.lit("\nLines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n\n```\n"), snippet(content), F.lit("\n```"))


def char_entropy(text: Column) -> Column:
    """Shannon entropy over characters in bits, their counts divided by the length in UTF-16 units; 0 for an empty text.

    Each distinct character is counted by what its removal takes from the length, so a row costs some hundred native passes.
    """
    n = utf16_length(text).cast("double")
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    xlog = F.aggregate(counts, F.lit(0.0), lambda a, c: F.when(c > 0, a + c * F.log2(c)).otherwise(a))
    return F.when(F.length(text) == 0, 0.0).otherwise((F.length(text) * F.log2(n) - xlog) / n)



def confidence(response: Column) -> Column:
    """struct(is_high, score, reason) of an answer; the first rule that fits decides."""
    low = F.lower(response)
    uncertain = F.filter(F.array(*map(F.lit, UNCERTAIN)), lambda p: F.contains(low, p))
    hedges = F.size(F.filter(F.array(*map(F.lit, HEDGES)), lambda p: F.contains(low, p)))
    code = low.contains("function") | low.contains("class") | low.contains("const")
    say = lambda high, score, reason: F.struct(F.lit(high).alias("is_high"), F.lit(score).alias("score"), reason.alias("reason"))
    return (
        F.when(F.size(uncertain) > 0, say(False, 0.3, F.concat(F.lit('Contains uncertainty: "'), F.get(uncertain, 0), F.lit('"'))))
        .when(F.length(response) < 50, say(False, 0.4, F.lit("Response too short")))
        .when(hedges > 2, say(False, 0.5, F.lit("Too many hedging words")))
        .when(code & ~response.contains("```"), say(False, 0.6, F.lit("Missing expected code blocks")))
        .otherwise(say(True, 0.9, F.lit("Confident response")))
    )


def summary(raw: Column) -> Column:
    """The first line of the trimmed text, cut to 197 characters and dots beyond 200."""
    first = F.get(F.split(trimmed(raw), "\n", -1), 0)
    return F.when(F.length(first) > 200, F.concat(F.substring(first, 1, 197), F.lit("..."))).otherwise(first)


def code_blocks(raw: Column) -> Column:
    """array<struct(language, content)> of the fenced blocks."""
    fence = F.lit("(?s)```([A-Za-z0-9_+-]*)[^\\n]*\\n(.*?)```")
    return F.zip_with(F.regexp_extract_all(raw, fence, 1), F.regexp_extract_all(raw, fence, 2), lambda a, b: F.struct(F.lower(trimmed(a)).alias("language"), trimmed(b).alias("content")))


def follow_ups(raw: Column) -> Column:
    """Lines that begin with - or *, without the marker."""
    lines = F.filter(F.transform(F.split(raw, "\n", -1), trimmed), lambda x: x.rlike(r"^[-*]\s"))
    return F.transform(lines, lambda x: trimmed(F.regexp_replace(x, r"^[-*]\s*", "")))


def identifiers(text: Column) -> Column:
    """Distinct identifiers of a lower-cased text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z_][a-z0-9_]*)"), 1))


def import_path(statement: Column) -> Column:
    """The module of an import statement: from '...' first, then require('...'); null if neither."""
    get = lambda p: F.nullif(F.regexp_extract(statement, p, 1), F.lit(""))
    return F.coalesce(get(r"""from\s+['"]([^'"]+)['"]"""), get(r"""require\(\s*['"]([^'"]+)['"]\s*\)"""))


def imported_names(statement: Column) -> Column:
    """Names that an import statement brings: the named list (aliases as written), a default, a namespace."""
    named = F.filter(F.transform(F.split(F.regexp_extract(statement, r"import\s*\{([^}]*)\}", 1), ","), trimmed), lambda x: x != "")
    default = F.regexp_extract(statement, r"import\s+([A-Za-z0-9_$]+)\s+from", 1)
    space = F.regexp_extract(statement, r"import\s+\*\s+as\s+([A-Za-z0-9_$]+)", 1)
    return F.array_distinct(F.concat(named, F.filter(F.array(default, space), lambda x: x != "")))


def import_summary(statements: Column) -> Column:
    """Distinct lines `path` or `path: a, b` of an array of import statements, in order; `unknown` where there is no path."""

    def line(x: Column) -> Column:
        names = imported_names(x)
        path = F.coalesce(import_path(x), F.lit("unknown"))
        return F.when(F.size(names) == 0, path).otherwise(F.concat(path, F.lit(": "), F.array_join(names, ", ")))

    return F.array_distinct(F.transform(statements, line))


def parameter_names(parameters: Column) -> Column:
    """Names in a parameter list: parentheses off, split at commas, cut at colons."""
    inner = F.regexp_replace(trimmed(parameters), r"^\(|\)$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: trimmed(F.get(F.split(x, ":"), 0))), lambda x: x != "")


def normalized_path(path: Column) -> Column:
    """Forward slashes, with empty, . and .. parts folded; a leading / stays, and .. beyond the start of a relative path."""
    slashed = F.regexp_replace(path, r"\\", "/")
    rooted = slashed.startswith("/")
    empty = F.array().cast("array<string>")

    def fold(a: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != "..")
        return F.when((x == "") | (x == "."), a).when(up, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when((x == "..") & rooted, a).otherwise(F.concat(a, F.array(x)))

    folded = F.array_join(F.aggregate(F.split(slashed, "/", -1), empty, fold), "/")
    return F.when(F.length(path) == 0, path).otherwise(F.concat(F.when(rooted, "/").otherwise(""), F.when((folded == "") & ~rooted, ".").otherwise(folded), F.when(slashed.rlike("[^/.]/$"), "/").otherwise("")))


def mentioned_files(query: Column) -> Column:
    """File names with a known extension that a query mentions, as paths; of like extensions the shorter wins."""
    return F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(r"(?i)([A-Za-z0-9_\-./\\]+\.(?:ts|tsx|js|jsx|py))"), 1), normalized_path))


def mentions_path(query: Column, path: Column) -> Column:
    """Whether a query names a path's last part, or that without its extension."""
    base = F.lower(F.element_at(F.split(normalized_path(path), "/"), -1))
    return F.contains(F.lower(query), base) | F.contains(F.lower(query), F.regexp_replace(base, r"\.[^.]+$", ""))


def has_forbidden(text: Column) -> Column:
    return text.rlike(FORBIDDEN)


def missing_sections(titles: Column) -> Column:
    """Required section titles that an array of titles lacks."""
    return F.array_except(F.array(*map(F.lit, REQUIRED_SECTIONS)), F.transform(titles, F.lower))


def diff_line_kind(line: Column) -> Column:
    return F.when(line.startswith("@@"), "hunk").when(line.startswith("+"), "added").when(line.startswith("-"), "removed").otherwise("other")
