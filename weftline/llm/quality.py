"""Quality rules with adaptive thresholds; DataFrame functions only.

Each document gets a few text measures. Fixed rules reject the plainly bad. Beyond them, a measure is judged
against its own language and source. Most shares are zero, so quartiles of all of them would say nothing: KLL
quantile sketches (mergeable, combined on the map side) follow the shares above zero of the documents past the fixed
rules, a Tukey fence above their upper quartile gives the threshold, at most a ceiling, and documents are filtered by
a join with the thresholds. Groups with too few shares above zero fall back to their language, then to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise

_BLANKS = "\x20\t\n\x0b\x0c\r"
#: Measures that the sketches follow: shares of symbols, repeated lines and repeated words.
ADAPTIVE = ("symbol_share", "line_share", "repeat_share")
#: A threshold is Q3 + WIDTH * (Q3 - Q1) of the shares above zero, and at most its ceiling: where most of them are junk, a fence lies above the junk.
WIDTH = 6.0
CEILINGS = {"symbol_share": 0.10, "line_share": 0.30, "repeat_share": 0.30}
#: Shares above zero that a group needs for a threshold of its own.
LEAST = 20


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text (windows are told apart by 64-bit hashes).

    The windows' hashes are sorted with their positions; a window equal to a neighbour is repeated. In order of
    position each repeated window covers up to three words, fewer if the next one begins earlier.
    """

    def cover(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(3), F.get(at, i + 1) - p)).otherwise(3)), F.lit(0), lambda a, x: a + x)

    def positions(seen: Column) -> Column:
        same = lambda x, i, k: F.coalesce(F.get(seen, i + k)["h"] == x["h"], F.lit(False))
        found = F.filter(F.transform(seen, lambda x, i: F.when((i > 0) & same(x, i, -1) | same(x, i, 1), x["i"])), lambda p: p.isNotNull())
        return bound(F.sort_array(found), cover)

    def windows(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return bound(made, lambda m: F.when(F.size(F.array_distinct(F.transform(m, lambda x: x["h"]))) == F.size(m), 0).otherwise(bound(F.sort_array(m), positions)))

    return F.when(F.size(words) < 3, 0).otherwise(bound(words, windows))


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each document row; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+", -1), lambda x: x != "")
    measures = F.struct(
        F.length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bound(lines, F.size).cast("long").alias("n_lines"),
        bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
    )
    found = documents.select("doc_id", "lang", "source", measures.alias("m"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return found.select(
        "doc_id", "lang", "source", F.col("m.w.n").alias("n_words"), "m.word_chars", "m.n_symbols", "m.n_dup_lines", F.col("m.w.r").alias("n_repeat_words"),
        share(F.col("m.n_symbols"), F.col("m.word_chars")).alias("symbol_share"),
        share(F.col("m.n_dup_lines"), F.col("m.n_lines")).alias("line_share"),
        share(F.col("m.w.r"), F.col("m.w.n")).alias("repeat_share"),
    )


def thresholds(measured: DataFrame, width: float = WIDTH, least: int = LEAST) -> DataFrame:
    """Per (lang, source) that occurs: lang, source and max_<measure>, from merged quantile sketches."""
    some = [F.when(F.col(c) > 0, F.col(c)) for c in ADAPTIVE]
    sketches = measured.groupBy("lang", "source").agg(*(F.count(x).alias(f"n_{c}") for c, x in zip(ADAPTIVE, some, strict=True)), *(F.kll_sketch_agg_double(x).alias(c) for c, x in zip(ADAPTIVE, some, strict=True)))

    def fence(c: str) -> Column:
        q1, q3 = (F.kll_sketch_get_quantile_double(F.col(c), F.lit(q)) for q in (0.25, 0.75))
        return F.when(F.col(f"n_{c}") >= least, F.least(F.lit(CEILINGS[c]), q3 + F.lit(width) * (q3 - q1)))

    def merged(*by: str) -> DataFrame:
        return sketches.groupBy(*by).agg(*(F.sum(f"n_{c}").alias(f"n_{c}") for c in ADAPTIVE), *(F.kll_merge_agg_double(F.col(c)).alias(c) for c in ADAPTIVE))

    own = sketches.select("lang", "source", *(fence(c).alias(f"own_{c}") for c in ADAPTIVE))
    lang = merged("lang").select(F.col("lang").alias("l"), *(fence(c).alias(f"lang_{c}") for c in ADAPTIVE))
    whole = merged().select(*(fence(c).alias(f"all_{c}") for c in ADAPTIVE))
    return (
        own.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left")
        .join(F.broadcast(whole), F.lit(True), "left")
        .select("lang", "source", *(F.coalesce(f"own_{c}", f"lang_{c}", f"all_{c}", F.lit(CEILINGS[c])).alias(f"max_{c}") for c in ADAPTIVE))
    )


def quality(documents: DataFrame, width: float = WIDTH, least: int = LEAST) -> DataFrame:
    """Per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails the base rules. A null lang or source is a group of its own. Repeated rows
    repeat their result; an empty table gives an empty one; further columns are ignored.
    """
    measured = materialise(measure(documents), "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    limits = materialise(thresholds(measured.where(~failed), width, least), "quality-limits").select(F.col("lang").alias("l"), F.col("source").alias("s"), *(f"max_{c}" for c in ADAPTIVE))
    small = limits.count() <= 50_000
    fine = F.lit(True)
    for c in ADAPTIVE:
        fine = fine & (F.col(c) <= F.col(f"max_{c}"))
    joined = measured.join(F.broadcast(limits) if small else limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(fine, F.lit(True))).alias("kept"), *ADAPTIVE, *(f"max_{c}" for c in ADAPTIVE)
    )
