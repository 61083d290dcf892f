"""URL filter by the likelihood ratio of two character models.

Rules name hosts and path beginnings to allow or to block; the longest that fits decides. URLs
that no rule decides are judged by two smoothed Markov models of variable order, one of the URLs
that rules accept, one of those they reject. The probability of a character after up to three
others is interpolated: ``p(c | context) = (n(context c) + K p(c | shorter context)) /
(n(context) + K)``, from the uniform distribution upwards, so contexts that were never seen fall back
to shorter ones. The verdict is by the difference of the log likelihoods per character, against
a threshold calibrated on all rule-decided URLs: the cut that splits their scores with the
smallest sum of error rates, found on a histogram of fixed bins.

Everything is DataFrame work. The n-grams of all rule-decided URLs are counted, combined before the
shuffle; the distinct 4-grams of all URLs get one ratio each by joins of distinct n-grams, so a
frequent n-gram is one row there; last, the positions of the URLs are joined with the ratios,
salted, as some n-grams occur in every URL, and summed per page.

Defined cases: a null url, or one without '://', has empty host and path, no rule and score 0. A
null page_id is kept. Rows that occur again are judged again and count again in training. If one of
the two classes is empty there is nothing to tell apart: scores are 0. Scores of exactly the
threshold, and of 0 without a model, are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

#: Fixed values of the contract: verdict, host, beginning of the path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 3
PRIOR = 4.0
ALPHABET = 128.0
START = "\x02"
#: Scores of calibration fall into bins this wide, from -LIMIT to LIMIT.
BIN, LIMIT = 0.01, 5.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(url, r"^(?s).*?://(.*)$", 1)
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def rule_and_verdict(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, size: int) -> Column:
    """The ``size`` characters that end at each character of ``text``, padded in front."""
    padded = F.concat(F.lit(START * (size - 1)), text)
    return F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(size))
    )


def _counted(trained: DataFrame) -> DataFrame:
    """class, n-gram of ORDER + 1 characters and count."""
    grams = trained.select("class", F.explode_outer(_grams(F.col("text"), ORDER + 1)).alias("gram"))
    return grams.groupBy("class", "gram").agg(F.count("*").alias("n"))


def _ratios(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """gram and log ratio of the probabilities of its last character, for each wanted gram."""
    wide = stored(
        counts.groupBy("gram").agg(
            *[
                F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(f"n_{c}")
                for c in ("allow", "block")
            ]
        )
    )
    rows = wanted.select("gram", F.lit(1 / ALPHABET).alias("allow"), F.lit(1 / ALPHABET).alias("block"))
    for order in range(ORDER + 1):
        tail = F.substring("gram", -(order + 1), order + 1)
        before = F.substring(tail, 1, order)
        sums = [F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")]
        pieces = wide.groupBy(tail.alias("tail")).agg(*sums)
        contexts = pieces.groupBy(F.substring("tail", 1, order).alias("before")).agg(
            F.sum("n_allow").alias("m_allow"), F.sum("n_block").alias("m_block")
        )
        rows = rows.withColumn("tail", tail).withColumn("before", before)
        rows = rows.join(pieces, "tail", "left").join(contexts, "before", "left")
        rows = rows.select(
            "gram",
            *[
                (
                    (F.coalesce(f"n_{c}", F.lit(0)) + PRIOR * F.col(c))
                    / (F.coalesce(f"m_{c}", F.lit(0)) + PRIOR)
                ).alias(c)
                for c in ("allow", "block")
            ],
        )
    return rows.select("gram", (F.log("allow") - F.log("block")).alias("ratio"))


def _scored(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """row and score, the mean ratio over the characters, of the rows that have any."""
    grams = urls.select("row", F.explode_outer(_grams(F.col("text"), ORDER + 1)).alias("gram"))
    joined = salted_join(grams, ratios, ["gram"], F.col("row"), 16)
    # Whole millionths, so that the sum does not depend on the order of the rows.
    whole = F.round(F.col("ratio") * 1e6).cast("long")
    return joined.groupBy("row").agg((F.sum(whole) / F.count("*") / 1e6).alias("score"))


def _threshold(scored: DataFrame) -> DataFrame:
    """One row: the score from which a URL is accepted, by the scores of rule-decided URLs."""
    place = F.floor(F.least(F.greatest("score", F.lit(-LIMIT)), F.lit(LIMIT - BIN)) / BIN)
    bins = scored.groupBy(place.alias("bin")).agg(
        F.count(F.when(F.col("class") == "allow", 1)).alias("accepted"),
        F.count(F.when(F.col("class") == "block", 1)).alias("rejected"),
    )
    filled = bins.agg(
        F.sum("accepted").alias("a"),
        F.sum("rejected").alias("r"),
        F.sort_array(F.collect_list(F.struct("bin", "accepted", "rejected"))).alias("bins"),
    )  # 1000 bins at most
    first = F.struct(
        F.lit(0).cast("long").alias("missed"),
        F.lit(0).cast("long").alias("caught"),
        F.lit(2.0).alias("least"),
        F.lit(0.0).alias("cut"),
        F.lit(-LIMIT).alias("above"),
    )

    def passed(state: Column, x: Column) -> Column:
        """Errors of a cut between bin x and the one before, then bin x is put below the cut."""
        error = state["missed"] / F.col("a") + 1 - state["caught"] / F.col("r")
        better = error < state["least"]
        middle = (state["above"] + x["bin"] * F.lit(BIN)) / 2
        return F.struct(
            (state["missed"] + x["accepted"]).alias("missed"),
            (state["caught"] + x["rejected"]).alias("caught"),
            F.when(better, error).otherwise(state["least"]).alias("least"),
            F.when(better, middle).otherwise(state["cut"]).alias("cut"),
            ((x["bin"] + 1) * F.lit(BIN)).alias("above"),
        )

    found = filled.select("a", "r", F.aggregate("bins", first, passed)["cut"].alias("cut"))
    usable = (F.col("a") > 0) & (F.col("r") > 0)
    return found.select(F.when(usable, F.col("cut")).otherwise(F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides) of every page."""
    host, path = host_and_path(F.col("url").cast("string"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, decided = rule_and_verdict(F.col("host"), F.col("path"))
    split = split.select("*", rule.alias("rule"), decided.alias("decided"))
    rows = stored(
        split.select(
            F.monotonically_increasing_id().alias("row"),
            "*",
            F.concat("host", "path").alias("text"),
        )
    )
    trained = rows.where("decided IS NOT NULL AND text <> ''").select(F.col("decided").alias("class"), "text")
    counts = stored(_counted(trained))
    both = counts.select("class").distinct().count() == 2
    if both:
        written = rows.where("length(text) > 0")
        grams = written.select(F.explode_outer(_grams(F.col("text"), ORDER + 1)).alias("gram"))
        ratios = stored(_ratios(grams.distinct(), counts))
        scored = stored(
            _scored(written, ratios).join(rows.select("row", "decided"), "row")
        )
        known = scored.where("decided IS NOT NULL").select("score", F.col("decided").alias("class"))
        cut = _threshold(known).first()["cut"]
        rows = rows.join(scored.select("row", "score"), "row", "left")
    else:
        cut = 0.0
        rows = rows.withColumn("score", F.lit(0.0))
    score = F.coalesce("score", F.lit(0.0))
    # An empty text says nothing either way.
    modelled = F.when((score >= cut) | (F.col("text") == ""), "allow").otherwise("block")
    return rows.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("decided", modelled).alias("verdict"),
        score.alias("score"),
    )
