"""Personal data by base patterns and bootstrapped contextual extraction.

Base entities are e-mail addresses, IP addresses, card and phone numbers, found by patterns in
whole texts. They are the seeds of the method, whole matches of any length, of several words or
without a digit too. A pattern is the word in front of an instance; an instance is a seed or any word
with a digit of at least ``LEAST_CHARS`` characters that no seed touches. A seed that starts inside a
word has what stands before it in that word as a second pattern. In the graph of patterns and instances scores pass to and fro for ``ROUNDS`` rounds: a pattern's confidence is
the mean score of its distinct instances, smoothed towards 0; an instance's score is 1 for a seed,
else the chance that one of its patterns at confidence is right (noisy or). Patterns of at least ``SUPPORT``
distinct seeds and a confidence of ``CONFIDENT`` then mark every instance behind them, as kind
``id``, unless a base pattern matched in it: what that accepted is marked, what it refused stays out.

All of it is SQL functions, groupings and joins. Positions come from splitting a text by a pattern
and adding up the lengths of parts and matches. Edges are distinct (pattern, instance) pairs; a
pattern such as a frequent word is joined salted, its scores are sums combined before the shuffle.

Defined cases: a null text is empty and has no spans. Rows without doc_id, and rows that occur again,
each give a row. Without seeds nothing is discovered. Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

#: Fixed values of the contract: the kinds in their order. The patterns match what the contract's
#: do, leftmost and not overlapping. They start where a run of characters starts or the last
#: match ended, and do not give back, so that long runs cost no repeated tries.
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\\.{_LABEL}++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){13,18}+(?![\\x20-]?[0-9])",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
_MAY_HOLD = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
LEAST_CHARS, ROUNDS, SUPPORT, CONFIDENT, DOUBT = 6, 3, 5, 0.8, 1.0
NEW_KIND = "id"
_BLANKS = "\t\n\v\f\r"
_INSTANCE = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9]*+[0-9][^\\x20\\x09-\\x0D]*+"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    marks = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(marks, lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(
        values,
        lambda v, i: F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + v) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")
    digits = _digits(match)
    if kind == "card":
        return _luhn(digits)
    return F.length(digits).between(10, 15)


def _placed(parts: Column, matches: Column) -> Column:
    """Structs start, end, value, before of matches, in code points. ``parts`` lie around them."""
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["part"])
        end = begin + F.length(pair["match"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(
        F.slice(parts, F.lit(1), F.size(matches)),
        matches,
        lambda p, m: F.struct(p.alias("part"), m.alias("match")),
    )
    places = F.aggregate(pairs, start, step)["spans"]
    return F.zip_with(
        places,
        pairs,
        lambda s, p: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), p["match"].alias("value"),
            p["part"].alias("before"),
        ),
    )


_NONE = "array<struct<start:int,end:int,value:string,before:string>>"


def _with_matches(rows: DataFrame, name: str, pattern: str, may: Column) -> DataFrame:
    """``rows`` with column ``name``, the matches of ``pattern`` in ``text`` where ``may`` holds.

    Parts and matches are columns of their own first, so that each is computed once.
    """
    found = F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("_matches", F.coalesce(found, F.array().cast("array<string>")))
    parts = F.when(F.size("_matches") > 0, F.split("text", pattern, -1))
    rows = rows.withColumn("_parts", parts)
    placed = F.when(F.size("_matches") > 0, _placed(F.col("_parts"), F.col("_matches")))
    placed = F.coalesce(placed, F.array().cast(_NONE))
    return rows.withColumn(name, placed).drop("_parts", "_matches")


def _last_word(flat: Column) -> Column:
    return F.lower(F.substring_index(F.rtrim(flat), " ", -1))


def _flat(text: Column) -> Column:
    return F.translate(text, _BLANKS, " " * len(_BLANKS))


def _word_before(match: Column, place: Column) -> Column:
    """The word in front of an instance. Between two words with a digit there may be blanks only."""
    between = F.rtrim(_flat(match["before"]))
    previous = F.when(place > 0, F.get("instances", place - 1)["value"]).otherwise("")
    return F.when(between == "", F.lower(previous)).otherwise(_last_word(between))


def _seeds(base: Column) -> Column:
    """Structs value, patterns of the base entities: what is in front of each, blank or not."""

    def seed(span: Column) -> Column:
        ahead = F.substring("flat", F.lit(1), span["start"])
        part = F.substring_index(ahead, " ", -1)  # of the word in which the entity starts
        whole = F.substring(ahead, F.lit(1), F.length(ahead) - F.length(part))
        value = F.substring("text", span["start"] + 1, span["end"] - span["start"])
        return F.struct(
            value.alias("value"),
            F.array_distinct(F.array(F.lower(part), _last_word(whole))).alias("patterns"),
        )

    return F.transform(base, seed)


def _base(documents: DataFrame) -> DataFrame:
    """row, doc_id, base (structs start, rank, kind, end, sorted), tested, instances, seeds."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")
    )
    rows = rows.withColumn("_digit", F.col("text").rlike("[0-9]"))
    for kind in KINDS:
        sign = F.lit(_MAY_HOLD[kind])
        may = F.contains("text", sign)
        if kind != "email":
            may = F.col("_digit") & may
        rows = _with_matches(rows, kind, _PATTERNS[kind], may)
    rows = _with_matches(rows, "instances", _INSTANCE, F.col("_digit"))

    def spans(rank: int, kind: str) -> Column:
        valid = F.filter(kind, lambda m: _holds(kind, m["value"]))
        return F.transform(
            valid,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                m["end"].alias("end"),
            ),
        )

    base = F.sort_array(F.concat(*[spans(i, kind) for i, kind in enumerate(KINDS)]))
    instances = F.transform(
        "instances",
        lambda m, i: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            _word_before(m, i).alias("pattern"),
        ),
    )
    instances = F.filter(instances, lambda m: F.length(m["value"]) >= LEAST_CHARS)
    tested = F.concat(
        *[
            F.transform(
                kind, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
            )
            for kind in KINDS
        ]
    )
    rows = rows.select(
        "row", "doc_id", "text", base.alias("base"), tested.alias("tested"), instances.alias("instances")
    )
    rows = rows.withColumn("flat", F.when(F.size("base") > 0, _flat(F.col("text"))))
    return rows.withColumn("seeds", _seeds(F.col("base"))).drop("text", "flat")


def _discovered(base: DataFrame) -> DataFrame:
    """row and spans of kind ``id``, found behind patterns that seeds have made trusted."""
    seen = base.select("row", "base", "tested", F.explode("instances").alias("i"))

    def inside(spans: str) -> Column:
        return F.exists(
            spans, lambda b: (b["start"] < F.col("i.end")) & (b["end"] > F.col("i.start"))
        )

    seen = seen.select(
        "row", "i.start", "i.end", "i.value", "i.pattern", inside("base").alias("seed"),
        inside("tested").alias("tested"),
    )
    seen = stored(seen.where("pattern <> '' AND NOT seed").drop("seed"))
    seeds = base.select(F.explode("seeds").alias("s")).select(
        F.explode("s.patterns").alias("pattern"), "s.value", F.lit(True).alias("seed")
    )
    words = seen.select("pattern", "value", F.lit(False).alias("seed"))
    edges = seeds.where("pattern <> ''").union(words)
    edges = stored(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for turn in range(ROUNDS):
        patterns = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + DOUBT)).alias("confidence"),
            F.count_if("seed").alias("support"),
        )
        patterns = stored(patterns)
        if turn + 1 < ROUNDS:
            trusted = patterns.withColumn(
                "confidence", F.when(F.col("support") >= SUPPORT, F.col("confidence")).otherwise(0.0)
            )
            met = salted_join(edges, trusted.drop("support"), ["pattern"], F.xxhash64("value"))
            missed = F.log(1 - F.least("confidence", F.lit(0.999999)))
            scores = met.groupBy("value").agg((1 - F.exp(F.sum(missed))).alias("score"))
            joined = edges.join(scores, "value")
            scored = joined.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.col("score")))
    trusted = patterns.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT))
    trusted = trusted.select("pattern", F.lit(True).alias("trusted"))
    new = salted_join(seen.where("NOT tested"), trusted, ["pattern"], F.col("row"))
    return new.where("trusted").groupBy("row").agg(
        F.collect_list(
            F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit(NEW_KIND).alias("kind"), "end")
        ).alias("more")
    )


def _written(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def find(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, and all spans as text, for every row."""
    base = stored(_base(documents))
    more = _discovered(base)
    both = base.join(more, "row", "left")
    found = F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))
    every = F.sort_array(F.concat("base", found))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return both.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(every).alias("spans"),
    )
