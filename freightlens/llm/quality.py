"""Line-first quality rules, in built-in functions only.

Each line of a text is judged by itself (navigation, boilerplate,
punctuation); failing lines are removed, and a document that loses more than
``max_lost`` of its word characters with them is rejected. Before that a text
must pass two base rules: enough words, and not too many of them in repeated
five-word windows.

Everything is computed within the row, in one pass without a shuffle; repeated
windows are found by sorting the window hashes of the row, so a text of n
words costs n log n.

Defined results: a null text has no words and is rejected by the base rule;
an empty line has no words and is kept as it is; rows are judged one by one,
so repeated rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.textops import SPACES, count_of, let, words

# Base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20

# Line rules (parameters of ours).
NAV_SEPARATOR = r"(?:^|\s)[|»›·•>/]+(?=\s|$)"
MIN_NAV_SEPARATORS = 3
MAX_NAV_WORDS = 3  # words between two separators, on average
BOILERPLATE = (
    r"(?i)\b(?:(?:enable|requires?|turn on) javascript|uses? cookies|cookie (?:policy|settings)"
    r"|privacy policy|terms of (?:use|service)|all rights reserved"
    r"|subscribe to (?:our|the) newsletter|sign up for (?:our|the))\b"
    r"|^\s*(?:log ?in|sign in|sign up|read more|share this|skip to content|back to top)\W*$"
)
MAX_BOILERPLATE_WORDS = 25
MIN_PUNCTUATED_WORDS = 16
PUNCTUATION = r"[.!?,;:…。！？、，；：؟،۔।]"
MAX_SYMBOLS_PER_WORD = 0.25
MAX_LOST = 0.5


def repeat_words(word_list: Column, window: int = WINDOW) -> Column:
    """How many words lie in ``window``-word windows that the text holds twice
    or more (the first occurrence included)."""

    def covered(sorted_windows: Column) -> Column:
        def repeated(x: Column, j: Column) -> Column:
            before = F.get(sorted_windows, j - 1)["h"] == x["h"]
            after = F.get(sorted_windows, j + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        starts = F.sort_array(F.transform(F.filter(sorted_windows, repeated), lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            none,
            lambda acc, p: F.struct(
                (acc["n"] + p + window - F.greatest(acc["end"], p)).alias("n"),
                (p + window).alias("end"),
            ),
            lambda acc: acc["n"],
        )

    def of_windows(hashes: Column) -> Column:
        def sorted_pairs() -> Column:
            pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            return F.sort_array(pairs)

        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(sorted_pairs(), covered)
        ).otherwise(F.lit(0))

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - window)
        at = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
        return F.when(
            F.size(h) > window, let(F.transform(starts, at), of_windows)
        ).otherwise(F.lit(0))

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), of_hashes)


def line_fails(line: Column) -> Column:
    """Whether a line that has words is navigation, boilerplate or unpunctuated."""

    def fails(n: Column) -> Column:
        def navigation(separators: Column) -> Column:
            dense = (n - separators) <= MAX_NAV_WORDS * (separators + 1)
            return (separators >= MIN_NAV_SEPARATORS) & dense

        separators = F.size(F.split(line, NAV_SEPARATOR, -1)) - 1
        boilerplate = (n <= MAX_BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
        symbols = (n >= 4) & (count_of(line, SYMBOLS) > MAX_SYMBOLS_PER_WORD * n)
        unpunctuated = (n >= MIN_PUNCTUATED_WORDS) & ~line.rlike(PUNCTUATION)
        return (n > 0) & (let(separators, navigation) | boilerplate | unpunctuated | symbols)

    return let(F.size(words(line)), fails)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``(id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_lines_failed, lost_chars,
    kept, cleaned_text)``; ``cleaned_text`` is the text without its failing
    lines."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return judged(base)


def judged(base: DataFrame, *carried: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)

    def count_all(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"), repeat_words(ws).cast("long").alias("repeated")
        )

    def judge_lines(ls: Column) -> Column:
        flagged = F.transform(
            ls, lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails"))
        )
        with_words = F.filter(ls, lambda x: F.btrim(x, F.lit(SPACES)) != "")
        lost = let(
            flagged,
            lambda fl: F.struct(
                F.aggregate(
                    F.filter(fl, lambda x: x["fails"]),
                    F.lit(0),
                    lambda acc, x: acc
                    + F.length(x["line"])
                    - count_of(x["line"], SPACES),
                ).alias("lost"),
                F.size(F.filter(fl, lambda x: x["fails"])).alias("failed"),
                F.array_join(
                    F.transform(F.filter(fl, lambda x: ~x["fails"]), lambda x: x["line"]), "\n"
                ).alias("cleaned"),
            ),
        )
        return F.struct(
            let(with_words, lambda w: F.size(w) - F.size(F.array_distinct(w))).alias("dup"),
            lost.alias("lost"),
        )

    found = base.select(
        "id",
        *carried,
        let(words(text), count_all).alias("w"),
        let(lines, judge_lines).alias("l"),
        (F.length(text) - count_of(text, SPACES)).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
    )
    base_failed = (F.col("w.n_words") < MIN_WORDS) | (
        100 * F.col("w.repeated") > MAX_REPEAT_PERCENT * F.col("w.n_words")
    )
    enough_left = F.col("l.lost.lost") <= MAX_LOST * F.col("word_chars")
    return found.select(
        "id",
        *carried,
        F.col("w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.repeated").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        F.col("l.lost.failed").cast("long").alias("n_lines_failed"),
        F.col("l.lost.lost").cast("long").alias("lost_chars"),
        (~base_failed & enough_left).alias("kept"),
        F.col("l.lost.cleaned").alias("cleaned_text"),
    )


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, without their failing lines, in the columns of
    ``docs``; a column ``n_chars`` gets the new length."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row)
    passed = judged(base, "row").where("kept")
    values = {c: F.col(f"row.`{c}`") for c in docs.columns}
    values[text_col] = F.col("cleaned_text")
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("cleaned_text").cast(docs.schema["n_chars"].dataType)
    return passed.select(*[values[c].alias(c) for c in docs.columns])
