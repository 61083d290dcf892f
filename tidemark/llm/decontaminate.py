"""Benchmark decontamination by template canonicalisation.

Words of a text become a template: numbers, names (capitalised words inside a sentence) and units
after numbers turn into typed placeholders, everything else is lower-cased and loses its
punctuation. A second template of each text takes every capitalised word as a name, as names at the
start of a sentence may be exchanged too; windows of either may meet. Windows of ``WINDOW`` template words are hashed. Windows of the benchmark are
hash-joined with those of all documents, whole texts included. Where a document and an item share
``ENOUGH`` windows in a row of the item (all windows of a shorter item), the slots of the matched windows are
compared: every value that an item has in its slots must stand for one value throughout the
document's passage. Two values may become the same one if all windows of the item agree, or two
more than ``ENOUGH`` for each such tie, so that chance matches stay out. So a question whose numbers, names or units were exchanged is
caught, and a text that shares a frequent pattern with slots at random is not. Windows of fewer
than ``LITERALS`` literal words (in the second template ``BARE``, besides) are left out of the join,
as templates of placeholders say little. An item that has such windows is searched a third way, by
its own words, so that verbatim copies are found whatever they hold.

The benchmark's hashes go to every executor only if they were counted as few enough (``sized``); else
they are joined by a shuffle that adaptive execution can split.

Defined cases: a null or blank text on either side matches nothing; an item of fewer than
``WINDOW`` words is one window of its own length, by its template if it has ``LITERALS`` literal words,
else by its own words (so an item of one word matches every text with that word). Rows that occur again are matched again; items of equal text each match. Rows without
doc_id are matched and reported (doc_id null), and removed by ``clean_documents`` if they match.
Extra columns pass through ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, sized, stored

WINDOW, ENOUGH, LITERALS, BARE = 8, 4, 5, 3
_NUMBER, _NAME, _UNIT = "\x01", "\x02", "\x03"
_BEGIN, _END = "`", "^"
#: Units that are slots when they follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec min h hr hrs day days week weeks "
    "month months year years hz khz mhz ghz kb mb gb tb w kw mw v a ma k c f usd eur gbp dollars "
    "euros pounds cents percent meters metres kilometers kilometres miles feet inches grams "
    "kilograms liters litres hours minutes seconds"
).split()


def _marked(text: Column) -> Column:
    """The text with placeholders in place of slots, in lower case and without punctuation.

    Words keep their number and order. Capitalised words that are a name only if they are one wherever
    they stand are between ``_BEGIN`` and ``_END``, so that one pass serves both templates. These marks
    are case-ignorable, as a final sigma depends on what follows; in the text others stand for them.
    """
    for mark in (_BEGIN, _END):
        text = F.replace(text, F.lit(mark), F.lit("\u00a8"))
    begins, ends = f"(?<!{WORD[:-1]})", f"(?!{WORD[:-1]})"
    mark = "[^\\p{L}\\p{N}\\x20\\x09-\\x0D]*"
    number = f"{begins}{mark}\\p{{N}}[\\p{{N}}.,:/%-]*{mark}{ends}"
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    unit = f"(?<={_NUMBER})({SPACE})(?i:{units})(?=[^\\p{{L}}\\p{{N}}]*(?:{SPACE}|$))"
    # A capital after a letter, digit, comma or the like and one blank is inside a sentence.
    inside = f"(?<=[\\p{{L}}\\p{{N}},;:)\\x01-\\x03]{SPACE}\\p{{Lu}})"
    name = f"\\p{{Lu}}{inside}[\\p{{L}}\\p{{M}}'’-]*+"
    anywhere = "\\p{Lu}(?<![\\p{L}\\p{M}\\p{N}'’-]\\p{Lu})[\\p{L}\\p{M}'’-]*+"
    numbered = F.regexp_replace(F.regexp_replace(text, number, _NUMBER), unit, f"$1{_UNIT}")
    with_numbers = F.when(text.rlike("\\p{N}"), numbered).otherwise(text)
    named = F.regexp_replace(with_numbers, name, _NAME)
    marked = F.lower(F.regexp_replace(named, anywhere, f"{_BEGIN}$0{_END}"))
    return F.regexp_replace(marked, f"[^\\p{{L}}\\p{{N}}\\x01-\\x03{_BEGIN}{_END}\\x20\\x09-\\x0D]+", "")


def _split(text: Column) -> Column:
    """The words of a text without punctuation; words of punctuation alone vanish."""
    for blank in "\x09\x0a\x0b\x0c\x0d":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _typed(word: Column, every: bool) -> Column:
    """A word of ``_marked`` as it is in a template: with ``every``, marked names are placeholders."""
    pattern, slot = (f"{_BEGIN}[^{_END}]*.", _NAME) if every else (f"[{_BEGIN}{_END}]", "")
    return F.when(F.contains(word, F.lit(_BEGIN)), F.regexp_replace(word, pattern, slot)).otherwise(word)


def _words(text: Column, every: bool = False) -> Column:
    """The template's words. With ``every``, capitalised words are names wherever they stand."""
    return F.transform(_split(_marked(text)), lambda w: _typed(w, every))


def _values(text: Column) -> Column:
    """The text's own words, aligned with ``_words``."""
    kept = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+", "")
    return F.filter(F.split(kept, f"{SPACE}+"), lambda w: w != "")


def _windows(rows: DataFrame, keys: list[str], verbatim: bool) -> DataFrame:
    """``at`` and ``hash`` of each run of WINDOW template words of ``text``, of either template.

    With ``verbatim`` also of the text's own words.

    Each step is a projection of its own, so that no step is computed twice for a text; a filter
    between them would be. A text of fewer words gets one run, which no window of an item equals.
    """
    text = F.col("text")
    split = {"words": _split(_marked(text))}
    kinds = {"h1": _hashed("words", lambda w: _typed(w, False)), "h2": _hashed("words", lambda w: _typed(w, True))}
    if verbatim:
        split["own"] = _values(text)
        kinds["h3"] = _hashed("own")
    words = rows.select(*keys, *[w.alias(c) for c, w in split.items()])
    hashed = words.select(*keys, *[h.alias(c) for c, h in kinds.items()])
    # Runs are hashed as rows, not within a lambda, which Spark does not compile. The outer forms: the
    # others infer a filter on the size, which computes all of it again.
    last = F.greatest(*[F.size(c) for c in kinds], F.lit(WINDOW)) - WINDOW
    places = F.when(F.size("h1") > 0, F.sequence(F.lit(0), last))
    starts = hashed.select(*keys, *kinds, F.explode_outer(places).alias("at")).where("at IS NOT NULL")
    runs = starts.select(*keys, "at", *[_run(c, F.col("at")).alias(c) for c in kinds])
    # Where no capital is at issue, both templates have one hash.
    either = F.when(F.col("h1") == F.col("h2"), F.array("h1")).otherwise(F.array("h1", "h2"))
    hashes = F.array_distinct(F.array(*kinds)) if verbatim else either
    return runs.select(*keys, "at", F.explode_outer(hashes).alias("hash"))


def _hashed(words: str, read: Callable[[Column], Column] = lambda w: w) -> Column:
    return F.transform(words, lambda w: F.xxhash64(read(w)))


def _run(h: str, at: Column) -> Column:
    """Hash of the run of WINDOW hashed words from ``at``. Missing ones add nothing."""
    # The words of a run are looked up one by one: slices would be copied.
    return F.xxhash64(*[F.get(h, at + k) for k in range(WINDOW)])


def _runs(h: str) -> Column:
    """Hashes of the runs of WINDOW hashed words; of fewer words, of the whole."""
    runs = F.transform(h, lambda _, i: _run(h, i))
    return F.slice(runs, F.lit(1), F.greatest(F.size(h) - WINDOW + 1, F.lit(1)))


def _literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w >= "\x04"))


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with an own number (item), and their windows (way: 1 and 2 by a template, 3 by own words)."""
    items = benchmark.select(
        F.monotonically_increasing_id().alias("item"),
        F.col("item_id").cast("long"),
        F.col("text").cast("string"),
    )
    text = F.col("text")
    items = items.where("text IS NOT NULL").withColumns(
        {"template": _words(text), "names": _words(text, True), "own": _values(text)}
    )
    items = stored(items)
    hashed = items.where(F.size("template") >= WINDOW).withColumns(
        {"h1": _hashed("template"), "h2": _hashed("names"), "h3": _hashed("own")}
    )

    def ways(at: Column, first: Column, second: Column) -> Column:
        typed = _literals(F.slice("template", at + 1, WINDOW)) >= LITERALS
        named = typed & (_literals(F.slice("names", at + 1, WINDOW)) >= BARE)
        return F.array(
            F.when(typed, F.struct(F.lit(1).alias("way"), first.alias("hash"))),
            F.when(named, F.struct(F.lit(2).alias("way"), second.alias("hash"))),
        )

    owned = hashed.select("item", "template", F.posexplode(_runs("h3")))
    few = owned.where(_literals(F.slice("template", F.col("pos") + 1, WINDOW)) < LITERALS)
    owned = owned.join(few.select("item").distinct(), "item", "left_semi")
    owned = owned.select("item", F.col("pos").alias("at"), F.lit(3).alias("way"), F.col("col").alias("hash"))
    found = hashed.select(
        "item", "template", "names",
        F.posexplode(F.arrays_zip(_runs("h1").alias("h1"), _runs("h2").alias("h2"))),
    )
    found = found.select(
        "item", F.col("pos").alias("at"),
        F.explode(F.array_compact(ways(F.col("pos"), F.col("col.h1"), F.col("col.h2")))).alias("w"),
    )
    return items, stored(found.select("item", "at", "w.way", "w.hash").union(owned))


def _phrases(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, n)))


def _short_matches(rows: DataFrame, items: DataFrame) -> DataFrame:
    """row, item of texts that hold all words of an item that is shorter than a window."""
    brief = items.where(F.size("template").between(1, WINDOW - 1))
    short = brief.where(_literals(F.col("template")) >= LITERALS)
    verbatim = brief.where(_literals(F.col("template")) < LITERALS).select("item", "own")
    named = short.where(_literals(F.col("names")) >= BARE)
    short = short.select("item", F.col("template").alias("words")).union(named.select("item", "names"))
    short = short.union(verbatim).distinct()
    short = short.select("item", F.concat_ws(" ", "words").alias("phrase"), F.size("words").alias("n"))
    found = None
    lengths = [r["n"] for r in short.select("n").distinct().collect()]  # WINDOW - 1 at most
    for n in sorted(lengths):
        text = F.col("text")
        texts = rows.select("row", F.explode(F.array(_words(text), _words(text, True), _values(text))).alias("w"))
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        texts = texts.where(F.size("w") >= n)
        texts = texts.select("row", F.explode(F.array_distinct(_phrases(starts, n))).alias("phrase"))
        hits = texts.join(short.where(F.col("n") == n), "phrase").select("row", "item")
        found = hits if found is None else found.union(hits)
    return found


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (windows of the item that were found), item_windows and kind:
    'exact' if all slots are equal, else 'template'."""
    return _matched(_numbered(documents), benchmark).drop("row")


def _numbered(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.xxhash64("doc_id", "text").alias("row"),
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
    )


def _matched(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    items, windows = _items(benchmark)
    hashes = sized(stored(windows.select("hash").distinct()))
    verbatim = not windows.where("way = 3").isEmpty()
    found = _windows(rows, ["row"], verbatim).join(hashes, "hash", "left_semi")
    hits = stored(found.distinct())

    # Windows of one item at one distance between document and item form a passage.
    pairs = hits.withColumnRenamed("at", "there").join(windows, "hash")
    passages = pairs.groupBy("row", "item", "way", (F.col("there") - F.col("at")).alias("shift")).agg(
        F.sort_array(F.collect_set("at")).alias("places")  # as many as the item has windows
    )
    totals = windows.groupBy("item", "way").agg(F.count("*").alias("item_windows"))
    passages = passages.join(totals, ["item", "way"])
    long_enough = F.size("places") >= F.least(F.lit(ENOUGH), F.col("item_windows"))
    passages = stored(passages.where(long_enough & F.col("row").isNotNull()))

    # Slot values of both sides, of the rows that have passages only.
    wanted = sized(stored(passages.select("row").distinct()))
    texts = rows.join(wanted, "row", "left_semi")
    texts = texts.select("row", "doc_id", _values(F.col("text")).alias("doc_words"))
    sides = passages.join(
        items.select(
            "item",
            "item_id",
            "template",
            "names",
            _values(F.col("text")).alias("item_words"),
        ),
        "item",
    ).join(texts, "row")
    covered = F.array_distinct(
        F.flatten(F.transform("places", lambda p: F.sequence(p, p + WINDOW - 1)))
    )
    typed = F.when(F.col("way") == 2, F.col("names")).otherwise(F.col("template"))
    slots = F.filter(covered, lambda p: F.get(typed, p) < "\x04")
    values = F.transform(
        slots,
        lambda p: F.struct(
            F.get("item_words", p).alias("own"),
            F.get("doc_words", (p + F.col("shift")).cast("int")).alias("theirs"),
        ),
    )
    judged = sides.select("row", "doc_id", "item_id", "item_windows", "places",
                          F.array_distinct(values).alias("values"))
    own = F.transform("values", lambda v: v["own"])
    theirs = F.transform("values", lambda v: v["theirs"])
    count = F.size("values")
    ties = count - F.size(F.array_distinct(theirs))
    agreed = F.size("places")
    tolerated = (agreed == F.col("item_windows")) | (agreed >= ENOUGH + 2 * ties)
    consistent = (F.size(F.array_distinct(own)) == count) & ((ties == 0) | tolerated)
    equal = F.forall("values", lambda v: v["own"].eqNullSafe(v["theirs"]))
    judged = judged.where(consistent).select(
        "row", "doc_id", "item_id", "item_windows", F.size("places").alias("n"), equal.alias("equal")
    )
    result = judged.groupBy("row", "doc_id", "item_id").agg(
        F.max("n").cast("long").alias("n_windows"),
        F.max("item_windows").alias("item_windows"),
        F.when(F.max("equal"), "exact").otherwise("template").alias("kind"),
    )
    short = _short_matches(rows, items)
    if short is None:
        return result
    brief = short.distinct().join(rows.select("row", "doc_id"), "row")
    own = F.when(_literals(F.col("template")) < LITERALS, "exact").otherwise("template")
    brief = brief.join(items.select("item", "item_id", own.alias("kind")), "item").select(
        "row", "doc_id", "item_id", F.lit(1).cast("long").alias("n_windows"),
        F.lit(1).cast("long").alias("item_windows"), "kind",
    )
    return result.union(brief.distinct())


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that match no item of the benchmark."""
    marked = _matched(_numbered(documents), benchmark).select("row").distinct()
    marked = sized(stored(marked))
    inputs = F.struct(*[F.col(c) for c in documents.columns]).alias("inputs")
    rows = documents.select(F.xxhash64("doc_id", "text").alias("row"), inputs)
    return rows.join(marked, "row", "left_anti").select("inputs.*")
