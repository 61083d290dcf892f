"""Line deduplication by an exact set-similarity join.

Lines are the parts of a text between line feeds. A line is the set of its runs of five words,
lower-cased (of fewer words, the whole). It is removed if an earlier line, in order of doc_id and
place, has a Jaccard similarity of at least 0.75 with it, whether that one is removed itself or
not; so the result does not depend on any order of work. Equal lines are one class, led by the
earliest.

The distinct runs (tokens) of a line are ordered by hash. All lines share that order, which makes the
prefix filter exact: two sets that are similar enough share their first common token within the first
n - ceil(0.75 n) + 1 tokens of each. Tokens of the prefixes that occur in one line only are dropped.
Pairs that share one of the others pass the length filter (sizes within 3/4) and the positional filter
(the tokens shared so far and those behind suffice), and are verified on all tokens of their lines,
which are read again from the texts.

A prefix token in more than ``HOT`` lines is not paired in that order. If the first common token of
a pair is such a one, both lines have it in their prefix; so all lines that have any are joined among
themselves in a second order, from rare to frequent, by the counts of these tokens in ``BUCKETS`` hashed
buckets, a table of fixed size. There a line needs only one earlier match, so groups of near copies are
not expanded into pairs: first each line is held against the earliest line of each of its prefix
tokens; only lines that are still unmatched are held against all earlier ones.

Tokens are made once for a line, and again only for lines of pairs. These also get parities: the tokens
are dealt into 64 * ``PARITIES`` groups by hash, and a bit tells whether a line has an odd number of a
group. Two lines differ in as many tokens, at least, as in bits, so pairs that differ in more bits than
similar lines can in tokens are dropped before verification; in the second order within the join.

Defined cases: a null text stays null and has no lines; a line without words is never removed.
Rows without doc_id come last. Rows of one doc_id are ordered by a hash of their text; rows equal in
both are one document and are cleaned alike. Extra columns pass through ``clean_lines`` unless
they bear the name of a result column. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, aside, restored, sized, stored, stored_columns

WORDS = 5
#: Lines of a token that are paired without an order of rarity.
HOT = 64
BUCKETS = 1 << 16
#: Tokens before a token that are looked up for an earlier meeting of a pair.
BACK = 8
#: Longs of parities of a line.
PARITIES = 4
#: Bits of a token's place in the order of rarity that hold its hash; its count is above them.
HASH_BITS = 40
_PLACE = ["late", "doc_id", "text_hash", "at"]


def _lines(documents: DataFrame) -> DataFrame:
    """Place and text of every line, null for those of null texts."""
    # Before the lines are dealt out, or each line would hash the text again.
    hashed = documents.select(
        F.col("doc_id").isNull().alias("late"),
        F.col("doc_id").cast("long"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").cast("string"),
    )
    rows = hashed.select(
        "late", "doc_id", "text_hash", F.posexplode_outer(F.split("text", "\n", -1))
    )
    return rows.select(
        "late", "doc_id", "text_hash", F.col("pos").alias("at"), F.col("col").alias("line")
    )


def _class() -> list[Column]:
    return [F.xxhash64("line").alias("c1"), F.xxhash64(F.lit(1), "line").alias("c2")]


def _tokens(lines: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` and the distinct tokens of each line, in order; none without words."""
    spaced = F.lower("line")
    for mark in "\x09\x0b\x0c\x0d":
        spaced = F.replace(spaced, F.lit(mark), F.lit(" "))
    words = F.array_remove(F.split(spaced, " "), "")
    hashed = lines.select(*columns, F.transform(words, lambda w: F.xxhash64(w)).alias("words"))
    n = F.size("words")
    # Of fewer words, the whole: missing ones are null and add nothing to a hash.
    runs = F.transform(
        "words", lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, WORDS)])
    )
    runs = F.slice(runs, F.lit(1), F.greatest(n - WORDS + 1, F.lit(1)))
    none = F.array().cast("array<bigint>")
    kept = [c for c in hashed.columns if c != "words"]
    distinct = F.when(n > 0, F.sort_array(F.array_distinct(runs))).otherwise(none)
    return hashed.select(*kept, distinct.alias("tokens"))


def _prefix(ordered: str) -> Column:
    n = F.size(ordered)
    return F.slice(ordered, F.lit(1), F.when(n > 0, n - F.ceil(n * 0.75) + 1).otherwise(0).cast("int"))


def _parities(sets: DataFrame) -> DataFrame:
    """id, n and, of 64 * PARITIES groups of tokens by hash, whether a line has an odd number of each."""
    tokens = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    bit = "shiftleft(1L, CAST(pmod(shiftright(token, 8), 64) AS INT))"
    odd = [
        F.expr(f"bit_xor(CASE WHEN pmod(token, {PARITIES}) = {k} THEN {bit} ELSE 0L END)").alias(f"odd{k}")
        for k in range(PARITIES)
    ]
    return tokens.groupBy("id", "n").agg(*odd)


def _may_be_similar(x: str, y: str) -> Column:
    """False only if too many tokens are in one of the lines alone: by length, and by their parities.

    Lines are similar enough if at most (n + m) / 7 tokens are; each makes one parity differ at most.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = F.lit(0)
    for k in range(PARITIES):
        differ += F.bit_count(F.col(f"{x}.odd{k}").bitwiseXOR(F.col(f"{y}.odd{k}")))
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * differ <= n + m)


def _paired(rows: DataFrame, others: DataFrame, once: bool = False) -> DataFrame:
    """Distinct ``later``, ``earlier`` (line_id, by id) of rows that share a token and may be similar.

    All filters are part of the join, so that pairs of a frequent token that fail are not made. With
    ``once``, where ``others`` have all their tokens, a pair is not made at a token if the lines share one
    of the ``BACK`` before it; their first common one has none before it.
    """
    x, y = rows.alias("x"), others.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    after = F.least(n - F.col("x.pos"), m - F.col("y.pos"))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("y.id") < F.col("x.id"))
    likely = (7 * after >= 3 * (n + m)) & _may_be_similar("x", "y")
    if once:
        likely &= ~F.arrays_overlap("x.before", "y.before")
    pairs = x.join(y, same & likely)
    return pairs.select(F.col("x.line_id").alias("later"), F.col("y.line_id").alias("earlier")).distinct()


def _counted(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs like ``_paired``, of rows with all shared tokens of their lines, that may be similar by all tokens that their prefixes share.

    Of c tokens that two prefixes share, all common tokens up to the last of them are known, and
    behind it at most those of the shorter rest are common. The prefix that ends first in the order has
    no other common tokens, so of its line at most c and those behind the prefix are.
    """
    x, y = rows.alias("x"), others.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("y.id") < F.col("x.id"))
    both = x.join(y, same & (4 * F.least(n, m) >= 3 * F.greatest(n, m))).select(
        F.col("x.id").alias("later"), F.col("y.id").alias("earlier"), n.alias("n"), m.alias("m"),
        F.least(n - F.col("x.pos"), m - F.col("y.pos")).alias("after"),
    )
    pairs = both.groupBy("later", "earlier", "n", "m").agg(
        F.count("*").alias("c"), F.min("after").alias("after")
    )
    most = F.least(F.col("after"), F.ceil(F.greatest("n", "m") * 0.75)) + F.col("c") - 1
    return pairs.where(7 * most >= 3 * (F.col("n") + F.col("m"))).select("later", "earlier")


def _sets(documents: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """id, place, hot and all tokens of ``classes`` (stored), read again from the texts.

    ``repeated`` tells whether rows of one doc_id and text occur again.
    """
    wanted = classes.select("id", "hot", F.struct(*_PLACE).alias("place"), *_PLACE)
    keys = sized(stored(wanted.select("doc_id", "text_hash").distinct()))
    texts = documents.withColumn("text_hash", F.xxhash64("text"))
    same_text = (texts.text_hash == keys.text_hash) & texts.doc_id.eqNullSafe(keys.doc_id)
    x = _lines(texts.join(keys, same_text, "left_semi")).alias("x")
    y = sized(wanted, 8).alias("y")
    at_place = F.col("x.text_hash") == F.col("y.text_hash")
    at_place &= F.col("x.at") == F.col("y.at")
    at_place &= F.col("x.doc_id").eqNullSafe(F.col("y.doc_id"))
    lines = x.join(y, at_place).select("y.id", "y.place", "y.hot", "x.line")
    if repeated:
        lines = lines.dropDuplicates(["id"])
    return stored(_tokens(lines, "id", "place", "hot"))


def _likely(parities: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (later, earlier) that may be similar by the ``parities`` of their lines."""
    x = pairs.join(parities.withColumnRenamed("id", "later"), "later").alias("x")
    both = x.join(parities.alias("y"), F.col("x.earlier") == F.col("y.id"))
    return both.where(_may_be_similar("x", "y")).select("later", "earlier")


def _similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (later, earlier; stored) that are similar enough, with their places."""
    ids = pairs.select(F.col("later").alias("id")).union(pairs.select("earlier")).distinct()
    sets = sets.join(sized(stored(ids), 1), "id", "left_semi")
    left = sets.select(F.col("id").alias("later"), F.col("tokens").alias("a"), F.col("place").alias("p"))
    right = sets.select(F.col("id").alias("earlier"), F.col("tokens").alias("b"), F.col("place").alias("q"))
    both = pairs.join(left, "later").join(right, "earlier")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(4 * shared >= 3 * (F.size("a") + F.size("b") - shared)).drop("a", "b")


def _by_rarity(sets: DataFrame, parities: DataFrame, hot: DataFrame) -> DataFrame:
    """The ids of ``sets`` that have an earlier match in it, by an order from rare to frequent."""
    # An array of counts by bucket, as a constant: BUCKETS numbers, whatever the input.
    counted = hot.groupBy(F.pmod("token", F.lit(BUCKETS)).alias("bucket")).count()
    counts = [0] * BUCKETS
    for bucket, n in counted.select("bucket", F.least("count", F.lit(1 << 22)).cast("int")).collect():
        counts[bucket] = n
    rarity = F.split(F.lit(",".join(map(str, counts))), ",").cast("array<int>")

    def order(token: Column) -> Column:
        count = F.get(rarity, F.pmod(token, F.lit(BUCKETS)).cast("int")).cast("long")
        return F.shiftleft(count, HASH_BITS).bitwiseOR(token.bitwiseAND(F.lit(2**HASH_BITS - 1)))

    rows = sets.select(
        F.col("id").alias("line_id"), F.sort_array(F.transform("tokens", order)).alias("ordered")
    )
    rows = rows.select("line_id", _prefix("ordered").alias("prefix"))
    rows = rows.select("line_id", "prefix", F.posexplode("prefix").alias("pos", "token"))
    pos = F.col("pos")
    before = F.slice("prefix", F.greatest(pos - BACK, F.lit(0)) + 1, F.least(pos, F.lit(BACK)))
    rows = rows.select("line_id", "pos", "token", before.alias("before"))
    # Numbered in order of place.
    numbered = sets.select("id", "place").repartitionByRange("place").sortWithinPartitions("place")
    numbered = stored(numbered.select(F.col("id").alias("line_id"), F.monotonically_increasing_id().alias("id")))
    numbered = numbered.join(parities.withColumnRenamed("id", "line_id"), "line_id")
    shared = _in_several(rows).join(numbered, "line_id")
    first_id = F.min("id").over(Window.partitionBy("token"))
    shared = stored(shared.withColumn("first", first_id))

    first = stored(_paired(shared, shared.where("id = first")))
    matched = stored(_similar(sets, first).select("later").distinct())
    rest = shared.join(matched, shared.line_id == matched.later, "left_anti")
    other = stored(_paired(rest, shared, once=True).join(first, ["later", "earlier"], "left_anti"))
    matched = matched.union(_similar(sets, other).select("later").distinct())
    return matched.select(F.col("later").alias("id"))


def _in_several(tokens: DataFrame) -> DataFrame:
    """The rows of tokens that occur in several lines, and in how many (lines)."""
    counted = tokens.withColumn("lines", F.count("*").over(Window.partitionBy("token")))
    return counted.where("lines > 1")


def removed_lines(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash and the places of the lines to remove, for documents that have any."""
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lines = _tokens(_lines(documents), *_PLACE, *_class())
    lines = lines.select(*_PLACE, "c1", "c2", F.size("tokens").alias("n"), _prefix("tokens").alias("prefix"))
    found = lines.groupBy("c1", "c2").agg(
        F.min(F.struct(*_PLACE)).alias("place"), F.count("*").alias("copies"),
        F.first("n").alias("n"), F.first("prefix").alias("prefix"),
    )
    found = found.where("n > 0").select("place.*", "c1", "c2", "copies", "n", "prefix")
    classes = stored_columns(found.withColumn("id", F.monotonically_increasing_id()))
    tokens = classes.select("id", "n", F.posexplode("prefix")).withColumnRenamed("col", "token")
    shared = stored(_in_several(tokens))

    keys = documents.groupBy("doc_id", F.xxhash64("text")).count()
    repeated = not keys.where("count > 1").isEmpty()
    # Pairs that share a token of more lines are found below.
    usual = shared.where(F.col("lines") <= HOT)
    pairs = stored(_counted(usual, usual))
    hot = shared.where(F.col("lines") > HOT)
    ids = pairs.select(F.col("later").alias("id")).union(pairs.select("earlier"))
    ids = ids.select("id", F.lit(False).alias("hot")).union(hot.select("id", F.lit(True)))
    ids = ids.groupBy("id").agg(F.max("hot").alias("hot"))
    sets = _sets(documents, stored(classes.select("id", *_PLACE).join(ids, "id")), repeated)
    parities = stored(_parities(sets))
    later = F.when(F.col("p") > F.col("q"), F.col("later")).otherwise(F.col("earlier"))
    matched = _similar(sets, stored(_likely(parities, pairs))).select(later.alias("id"))
    if not hot.isEmpty():
        matched = matched.union(_by_rarity(sets.where("hot"), parities, hot))
    matched = stored(matched.distinct()).withColumn("similar", F.lit(True))

    ends = classes.select("id", "c1", "c2", "copies", F.struct(*_PLACE).alias("place"))
    ends = ends.join(matched, "id", "left").where("copies > 1 OR similar")
    ends = sized(stored(ends.select("c1", "c2", "place", "similar")), 8)
    every = _lines(documents).select(*_PLACE, *_class())
    gone = every.join(ends, ["c1", "c2"])
    gone = gone.where(F.col("similar") | (F.struct(*[every[c] for c in _PLACE]) > F.col("place")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("gone"))


def clean_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with the kept lines in ``text``, n_lines and n_removed, which replace columns
    of their names; others can have any name."""
    gone = stored(removed_lines(documents))
    size = gone.agg(F.coalesce(F.sum(F.size("gone") + 4), F.lit(0))).first()[0]
    # Few enough lines to remove go to the texts; else texts are shuffled.
    gone = (F.broadcast(gone) if size <= 4 * MOST_BROADCAST else gone).alias("g")
    packed = aside(documents, "doc_id", "text")
    rows = packed.withColumn("_hash", F.xxhash64("text")).alias("d")
    same = (F.col("d._hash") == F.col("g.text_hash")) & F.col("d.doc_id").eqNullSafe(
        F.col("g.doc_id")
    )
    joined = rows.join(gone, same, "left")
    names = [c for c in rows.columns if c not in ("text", "_hash")]
    marked = joined.select(
        *[F.col(f"d.{c}") for c in names],
        F.col("d.text").cast("string").alias("text"),
        F.split(F.col("d.text").cast("string"), "\n", -1).alias("lines"),
        F.coalesce("g.gone", F.array().cast("array<int>")).alias("gone"),
    )
    kept = F.filter("lines", lambda _, i: ~F.array_contains("gone", i))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    cleaned = marked.select(
        *names,
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        n_lines.alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
    )
    added = ["text", "n_lines", "n_removed"]
    kept_names = [c for c in documents.columns if c not in added]
    return cleaned.select(*restored(kept_names, "doc_id"), *added)
