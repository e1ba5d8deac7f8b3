"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a Spark expression of the text alone, so scoring is a single narrow stage; no function of
the user's runs and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, take


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``low <= measure <= high``."""

    name: str
    low: float | None = None
    high: float | None = None


#: Common short words of English, German, French and Spanish; a text of any length in prose holds some of them.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for"),
    "de": ("der", "die", "und", "das", "in", "zu", "den", "mit"),
    "fr": ("le", "la", "de", "et", "les", "des", "un", "en"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "del"),
}

#: The default table; measures are those of :func:`quality_rules`.  Bounds of the ratios of symbols (0.1) and of the mean word
#: length follow the rules of Rae et al., "Scaling Language Models: Methods, Analysis & Insights from Training Gopher" (2021),
#: rounded outwards for the length; the share of stop words is far below that of prose in any of the four languages.
RULES = (
    Rule("n_words", low=50),
    Rule("repeat_word_ratio", high=0.5),
    Rule("mean_word_length", low=2.0, high=12.0),
    Rule("symbol_word_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("bang_word_ratio", high=0.5),
)

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """``body`` over ``value``, evaluated once a row however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more: windows sorted by content, equal neighbours marked."""

    def windows(w: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(w) - width)
        one = lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]).alias("s"), i.alias("i"))
        return F.sort_array(F.transform(spots, one))

    def repeated(t: Column) -> Column:
        same = lambda x, i: (F.get(t, i - 1)["s"] == x["s"]) | (F.get(t, i + 1)["s"] == x["s"])
        return F.sort_array(F.transform(F.filter(t, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

    def spread(p: Column) -> Column:
        step = lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))
        return F.aggregate(F.transform(p, step), F.lit(0), lambda a, x: a + x)

    some = let(words, lambda w: F.when(F.size(w) > width, let(let(windows(w), repeated), spread)))
    return F.coalesce(some, F.lit(0)).cast("long")


def counts(text: Column) -> dict[str, Column]:
    """The base counts of a text (null: as empty), each a long."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    bare = F.translate(text, _BLANKS, "")
    return {
        "words": words,
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_bangs": (F.length(bare) - F.length(F.translate(bare, "!", ""))).cast("long"),
    }


def verdict(rules: tuple[Rule, ...], measure: dict[str, Column]) -> Column:
    """One boolean for the whole table: every measure within its bounds."""
    kept = F.lit(True)
    for r in rules:
        if r.name not in measure:
            raise ValueError(f"no measure {r.name}; there are {sorted(measure)}")
        for bound, inside in ((r.low, lambda a, b: a >= b), (r.high, lambda a, b: a <= b)):
            if bound is not None:
                kept = kept & inside(measure[r.name], F.lit(float(bound)))
    return kept


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``, one row per row.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated three-word windows; such texts are never kept.  Null and empty texts have zero counts and fail.
    Null ids, repeated rows and other columns change nothing; an empty table gives no row.
    """
    rows = take(docs, id=id_col, text=text_col)
    base = counts(F.col("text"))
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    first = rows.select("id", *[c.alias(k) for k, c in base.items()])
    second = first.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bangs",
        _covered(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(stops))).alias("n_stops"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    measure = {
        "n_words": F.col("n_words"),
        "stop_word_ratio": F.col("n_stops") / n,
        "mean_word_length": F.col("word_chars") / n,
        "symbol_word_ratio": F.col("n_symbols") / n,
        "bang_word_ratio": F.col("n_bangs") / n,
        "repeat_word_ratio": F.col("n_repeat_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return second.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules, measure)).alias("kept"),
    )
