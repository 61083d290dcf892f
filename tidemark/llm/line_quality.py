"""Quality rules, line first: each line is judged, failing lines go, then documents that lose
too much of their text.

Rules of a line that holds a word, the first that fits names it:

* ``boilerplate``: it holds one of ``BOILERPLATE`` (notices on cookies, scripts, rights).
* ``navigation``: separators of menus (``|``, ``›``, ``»``, ``•``, ``·``) stand between its words
  at least once for every five other words, or all of it is an entry of ``MENU``.
* ``symbols``: at least one in ten of its characters in words is a mark of ``SYMBOLS``.
* ``shouting``: of at least 10 letters at least 70 % are capitals, and it ends words in ``!!``.
* ``punctuation``: no sentence mark ends it, closing quotes and brackets aside.

A document goes if its lines that fail hold more than ``MOST_LOST`` of its characters in words,
or if the base rules fail it: fewer than ``LEAST_WORDS`` words, or more than a fifth of its words
inside repeated runs of five words. Headings and verses lose their lines, not their document, while
most of it is prose.

Everything is computed per row, with SQL functions only: no shuffle, no group, no Python.
A text whose runs of five words all differ is recognised by their hashes alone; the others sort
them. Two different runs of one text are taken for one with probability n^2 / 2^65 for n words.

Defined cases: a null or blank text has no words, so ``base_failed``, nothing kept of it (its
cleaned text is empty). Repeated rows are judged alike and all returned, ties cannot occur, an
empty table gives an empty result. The input row comes back whole as one struct column, so its
columns can have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

# What the rules look for.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|›»•·"
SENTENCE_MARKS = ".!?…。！？؟।:;"
CLOSERS = "\"'”’»)]"
BOILERPLATE = (
    "all rights reserved",
    "accept all cookies",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
    "this website uses cookies",
    "we use cookies",
)
MENU = (
    "about us|back to top|contact us|home|log ?in|log ?out|menu|next|previous|read more|"
    "register|search|share|sign in|sign up|sitemap|skip to (main )?content|tweet"
)

RULES = ("boilerplate", "navigation", "symbols", "shouting", "punctuation")
RUN = 5
LEAST_WORDS = 10
MOST_REPEATED = 0.2
MOST_LOST = 0.3

_BLANKS = " \t\n\x0b\f\r"


def _spaced(text: Column) -> Column:
    """All blanks become spaces. Few texts hold others than spaces and line ends."""
    for blank in _BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_spaced(text), " "), "")


def _word_chars(text: Column) -> Column:
    return F.length(F.replace(_spaced(text), F.lit(" "), F.lit(""))).cast("long")


def _holds(text: Column, any_of: str | tuple[str, ...]) -> Column:
    held = F.lit(False)
    for part in any_of:
        held |= F.contains(text, F.lit(part))
    return held


def _marks(text: Column, marks: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, marks, ""))).cast("long")


def text_signs(text: Column) -> dict[str, Column]:
    """What a text holds anywhere. A line cannot fail a rule whose signs its text lacks, and few
    texts hold any; so most lines are looked at by the punctuation rule only."""
    return {
        "says": _holds(F.lower(text), BOILERPLATE),
        "bars": _holds(text, SEPARATORS),
        "symbols": _holds(text, SYMBOLS),
        "shouts": F.contains(text, F.lit("!!")),
    }


def failing_rule(line: Column, signs: Column) -> Column:
    """The name of the rule that a line fails, or null; lines without a word fail none.

    ``signs`` is the struct of ``text_signs`` of the line or of a text that holds it."""
    bars = _marks(line, SEPARATORS)
    menu = signs["bars"] & (bars > 0) & (6 * bars >= F.size(_words(line)))
    entry = (F.length(line) < 60) & F.lower(line).rlike(
        rf"^[\x20\x09-\x0D]*({MENU})[\x20\x09-\x0D]*$"
    )
    symbols = _marks(line, SYMBOLS)
    capitals = F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}", ""))
    letters = F.length(line) - F.length(F.regexp_replace(line, r"\p{L}", ""))
    shouted = F.contains(line, F.lit("!!")) & (letters >= 10) & (10 * capitals >= 7 * letters)
    end = F.right(F.rtrim(line, F.lit(CLOSERS + _BLANKS)), F.lit(1))
    ended = F.lit(False)
    for mark in SENTENCE_MARKS:
        ended |= F.endswith(line, F.lit(mark))
    ended |= F.contains(F.lit(SENTENCE_MARKS), end)
    return (
        F.when(~line.rlike(WORD), F.lit(None).cast("string"))
        .when(signs["says"] & _holds(F.lower(line), BOILERPLATE), "boilerplate")
        .when(entry | menu, "navigation")
        .when(
            signs["symbols"] & (symbols > 0) & (10 * symbols >= _word_chars(line)), "symbols"
        )
        .when(signs["shouts"] & shouted, "shouting")
        .when(~ended, "punctuation")
    )


def _repeated_words(runs: str) -> Column:
    """Words inside runs that occur at least twice in the text, from the hashes of all runs."""
    return F.expr(
        f"""
        CASE WHEN size({runs}) = size(array_distinct({runs})) THEN 0L ELSE
          aggregate(
            sort_array(transform(
              filter(
                transform(array(sort_array(transform({runs}, (h, i) -> struct(h, i)))), s ->
                  transform(s, (x, j) -> CASE
                    WHEN x.h = get(s, j - 1).h OR x.h = get(s, j + 1).h THEN x.i END))[0],
                i -> i IS NOT NULL),
              i -> i)),
            struct(-{RUN} AS last, 0L AS n),
            (a, i) -> struct(i AS last, a.n + least({RUN}, i - a.last) AS n),
            a -> a.n)
        END"""
    )


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: ``document`` (the input row), ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long), ``lines`` (all lines in order, each
    with the rule that it fails), ``lost_chars`` (characters in words of failing lines),
    ``base_failed``, ``kept`` (boolean), ``cleaned`` (the other lines)."""
    whole = docs.select(
        F.struct("*").alias("document"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )
    parts = whole.withColumns(
        {"_words": _words(F.col("_text")), "_lines": F.split(F.col("_text"), "\n", -1)}
    )
    parts = parts.withColumns(
        {
            "_joined": F.array_join("_words", ""),
            "_runs": F.expr(
                f"""CASE WHEN size(_words) < {RUN} THEN array()
                ELSE transform(sequence(0, size(_words) - {RUN}), i -> xxhash64({
                    ', '.join(f'_words[i + {k}]' for k in range(RUN))})) END"""
            ),
            "_spoken": F.filter("_lines", lambda x: x.rlike(WORD)),
            "_signs": F.struct(*[c.alias(k) for k, c in text_signs(F.col("_text")).items()]),
            "n_words": F.size("_words").cast("long"),
        }
    )
    parts = parts.withColumn(
        "lines",
        F.transform(
            "_lines",
            lambda x: F.struct(x.alias("line"), failing_rule(x, F.col("_signs")).alias("rule")),
        ),
    )
    counted = parts.select(
        "document",
        "n_words",
        F.length("_joined").cast("long").alias("word_chars"),
        F.when(F.col("_signs.symbols"), _marks(F.col("_text"), SYMBOLS))
        .otherwise(F.lit(0))
        .cast("long")
        .alias("n_symbols"),
        (F.size("_spoken") - F.size(F.array_distinct("_spoken"))).cast("long").alias("n_dup_lines"),
        _repeated_words("_runs").alias("n_repeat_words"),
        "lines",
        F.aggregate(
            "lines",
            F.lit(0).cast("long"),
            lambda n, x: n + F.when(x["rule"].isNull(), 0).otherwise(_word_chars(x["line"])),
        ).alias("lost_chars"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    cleaned = F.array_join(
        F.transform(F.filter("lines", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n"
    )
    judged = counted.withColumn("base_failed", base)
    loses = F.col("lost_chars") > MOST_LOST * F.col("word_chars")
    return judged.withColumns({"kept": ~(F.col("base_failed") | loses), "cleaned": cleaned})


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stay, their columns as they came and their text without failing lines."""
    stay = judge(docs, text).where("kept")
    return stay.select(
        *[
            F.col("cleaned").alias(c) if c == text else F.col("document").getField(c).alias(c)
            for c in docs.columns
        ]
    )
