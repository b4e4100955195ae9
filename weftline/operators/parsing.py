"""Rows out of model answers, rules texts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

_DIFF = "(?s)```(?:diff|patch)[^\\n]*\\n(.*?)```"
_FILE = "(?s)FILE:\\s*([^\\n]+)\\n```[^\\n]*\\n(.*?)```"


def edits(responses: DataFrame) -> DataFrame:
    """(response_id, type, path, content) of responses(response_id, response): diff blocks and replaced files.

    One edit per path: the first, but a diff takes the place of a replacement.
    """
    diffs = responses.select("response_id", F.posexplode(F.regexp_extract_all("response", F.lit(_DIFF), 1)).alias("pos", "content")).withColumn("content", T.trimmed(F.col("content")))
    get = lambda p: F.nullif(T.trimmed(F.regexp_extract("content", p, 1)), F.lit(""))
    diffs = diffs.select("response_id", F.lit("diff").alias("type"), F.coalesce(get(r"(?m)^\+\+\+\s+b/(.+)$"), get(r"(?m)^---\s+a/(.+)$")).alias("path"), "content", "pos")
    pairs = F.arrays_zip(F.regexp_extract_all("response", F.lit(_FILE), 1).alias("path"), F.regexp_extract_all("response", F.lit(_FILE), 2).alias("content"))
    files = responses.select("response_id", F.posexplode(pairs).alias("pos", "f")).select("response_id", F.lit("replace").alias("type"), T.trimmed(F.col("f.path")).alias("path"), T.trimmed_end(F.col("f.content")).alias("content"), "pos")
    every = diffs.where("path is not null and content <> ''").unionByName(files.where("path <> ''"))
    first = F.row_number().over(Window.partitionBy("response_id", "path").orderBy(F.when(F.col("type") == "diff", 0).otherwise(1), "pos"))
    return every.withColumn("k", first).where("k = 1").drop("k", "pos")


def edit_preview(edits_: DataFrame, lines: int = 10) -> DataFrame:
    return edits_.withColumn("preview", F.array_join(F.slice(F.split("content", "\n", -1), 1, lines), "\n"))


def diff_lines(edits_: DataFrame) -> DataFrame:
    """(response_id, path, line_no, line, kind) of diff edits."""
    lines = edits_.where("type = 'diff'").select("response_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("kind", T.diff_line_kind(F.col("line")))


def rule_sections(rules: DataFrame) -> DataFrame:
    """(rules_id, pos, title, body) of rules(rules_id, raw): parts at second-level headings; a title without a body has an empty one."""
    raw = T.trimmed(F.col("raw"))
    parts = F.split(raw, r"\n##\s+", -1)
    rows = rules.select("rules_id", F.posexplode(parts).alias("pos", "part"))
    title = F.regexp_replace(T.trimmed(F.get(F.split("part", "\n", 2), 0)), r"^#+\s*", "")
    return rows.select("rules_id", "pos", title.alias("title"), T.trimmed(F.coalesce(F.get(F.split("part", "\n", 2), 1), F.lit(""))).alias("body")).where("title <> ''")


def validated_rules(rules: DataFrame) -> DataFrame:
    """(rules_id, error): null for valid rules, else the first thing wrong."""
    sections = rule_sections(rules).groupBy("rules_id").agg(F.collect_list("title").alias("titles"), F.sum(F.when(F.col("body") == "", 1).otherwise(0)).alias("bodiless"))
    every = rules.join(sections, "rules_id", "left")
    missing = T.missing_sections(F.coalesce("titles", F.array().cast("array<string>")))
    error = F.when(T.trimmed(F.coalesce("raw", F.lit(""))) == "", "empty").when(T.has_forbidden(F.col("raw")), "forbidden pattern").when(F.col("bodiless") > 0, "section without body").when(F.size(missing) > 0, F.concat(F.lit("missing section: "), F.get(missing, 0)))
    return every.select("rules_id", error.alias("error"))


def prompt_messages(system: DataFrame, context: DataFrame, history: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, pos, role, content): the system text, the context as a user turn, the history without system turns, the user's message.

    Inputs: system(conv_id, content), context(conv_id, content), history(conv_id, turn, role, text), asked(conv_id, content).
    """
    row = lambda df, part, role, content, turn: df.select("conv_id", F.lit(part).alias("part"), turn.cast("long").alias("turn"), role.alias("role"), content.alias("content"))
    none, user = F.lit(0), F.lit("user")
    parts = row(system, 0, F.lit("system"), F.col("content"), none).union(row(context.where("content <> ''"), 1, user, F.col("content"), none))
    parts = parts.union(row(history.where("role <> 'system'"), 2, F.col("role"), F.col("text"), F.col("turn"))).union(row(asked, 3, user, F.col("content"), none))
    return parts.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "turn")).cast("long").alias("pos"), "role", "content")


def system_prompt(base: str, rules=None, metadata: dict[str, str] | None = None) -> str:
    parts = [base, *([rules.strip()] if rules else []), *(["# Session Metadata\n" + "\n".join(f"- {k}: {v}" for k, v in metadata.items())] if metadata else [])]
    return "\n\n".join(parts)


def fold_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, text, n_turns): each conversation's texts in order of turn."""
    whole = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(whole, lambda x: x["text"]), "").alias("text"), F.count(F.lit(1)).alias("n_turns"))
