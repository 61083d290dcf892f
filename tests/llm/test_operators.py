"""Every operator against a brute-force version, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import time
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components as module_of_components
from tidemark.llm import (
    decontaminate,
    embedding_passes,
    language,
    line_dedup,
    minhash_hamming,
    mixing,
    personal_data,
    sharding,
    suffix_dedup,
    url_filter,
)
from tidemark.llm.components import components

DOCUMENTS = "doc_id long, text string, lang string, source string, size string, hash string, row int"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdeé", k=draw.randint(2, 6))) for _ in range(words))


def documents() -> list[tuple]:
    """Copies, near copies, nulls, blanks, repeated rows and a long text; clashing column names."""
    rows = [(i, prose(i, 60), "en", f"s{i % 3}") for i in range(20)]
    near = prose(1, 60).split()
    for i in range(20, 30):
        near[3 * (i - 20)] = f"x{i}"
        rows.append((i, " ".join(near[: 60 - i % 3]), "en", "s0"))
    rows += [(30, None, None, None), (31, "", "en", "s1"), (32, " \t\n", "en", None)]
    rows += [(33, "Three short words", "en", "s1"), (34, "three SHORT words", "de", "s1")]
    rows += [(35, prose(2, 60), "en", "s2"), (35, prose(2, 60), "en", "s2")]
    rows += [(None, prose(3, 60), "en", "s2"), (36, prose(9, 4000), "en", "s1")]
    rows += [(37, prose(4, 80) + "\n" + prose(5, 30), "en", "s0"), (38, prose(5, 30), "en", None)]
    return [(*r, "size", "hash", 1) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCUMENTS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def test_components(spark):
    draw = random.Random(4)
    pairs = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(160)]
    pairs += [(400 + i, 401 + i) for i in range(60)] + [(500, 500 + i) for i in range(1, 40)]
    sets = Sets(range(600))
    for a, b in pairs:
        sets.link(a, b)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    assert {(r["id"], r["component"]) for r in got} == {(n, sets.find(n)) for n in linked}
    assert len(got) == len(linked)


def test_settled_components_take_no_step(spark, monkeypatch):
    def no_step(*args):
        raise AssertionError("a step on a forest of stars")

    monkeypatch.setattr(module_of_components, "_large_star", no_step)
    stars = [(1, 5), (1, 6), (9, 2)]
    got = components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert sorted((r["id"], r["component"]) for r in got) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)]


def test_a_large_star_is_made_once_a_round(spark, monkeypatch):
    starts = []
    small = module_of_components._small_star

    def small_of_stored(edges, rows):
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
        starts.append("Join" in plan or "Aggregate" in plan)
        return small(edges, rows)

    monkeypatch.setattr(module_of_components, "_small_star", small_of_stored)
    chain = [(i, i + 1) for i in range(6)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {(r["id"], r["component"]) for r in got} == {(i, 0) for i in range(7)}
    assert starts and not any(starts)


def test_sketches_are_not_sent_through_the_driver(spark, monkeypatch):
    widths = []

    def sized(keys, longs=4):
        widths.append(len(keys.columns))
        return keys

    monkeypatch.setattr(minhash_hamming, "sized", sized)
    frame = spark.createDataFrame([r[:2] for r in documents()], "doc_id long, text string")
    assert minhash_hamming.near_duplicates(frame).count() == len(documents())
    assert widths and max(widths) <= 4


def test_embeddings(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(60, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 6] + draw.normal(size=16) * 0.05).tolist(), 0) for i in range(150)]
    rows += [(300, base[0].tolist(), 1), (301, (2 * base[0]).tolist(), 1), (0, base[0].tolist(), 0)]
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0, None] * 8), (None, base[0].tolist())]
    odd += [(404, [float("nan")] * 16), (405, [float("inf")] * 16), (406, [1.0, 2.0])]
    rows += [(i, v, 0) for i, v in odd]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_passes.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    good = {i: np.array(v) for i, v, _ in rows[: -len(odd)]}
    links, sets = Counter(), Sets(good)
    for a, x in good.items():
        for b, y in good.items():
            if a != b and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[a] += 1
                sets.link(a, b)
    for r in got:
        i = r["vec_id"]
        own = sets.find(i) if i in good else i
        assert (r["n_links"], r["component_id"]) == (links[i], own), i
        assert r["kept"] == (i is None or own == i)
    empty = embedding_passes.near_duplicates(frame.limit(0))
    assert empty.collect() == []


def test_a_group_larger_than_window_and_reach(spark, monkeypatch):
    for name, value in (("WINDOW", 4), ("REACH", 8), ("BLOCK", 16)):
        monkeypatch.setattr(embedding_passes, name, value)
    draw = np.random.default_rng(6)
    centre = draw.normal(size=8)
    rows = [(i, (centre + draw.normal(size=8) * 0.01).tolist()) for i in range(70)]
    rows += [(100 + i, draw.normal(size=8).tolist()) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_passes.near_duplicates(frame).collect()}
    assert all(got[i]["component_id"] == 0 for i in range(70))
    assert all(got[i]["n_links"] >= 69 for i in range(70))


def test_links_are_counted_as_longs(spark):
    """Structs would be compared all with all: the work of a vector grew with the square of its links."""
    draw = np.random.default_rng(7)
    centre = draw.normal(size=8)
    rows, i = [], 0
    for copies in (1, 1, 2, 3, 5, 8):
        vector = (centre + draw.normal(size=8) * 0.01).tolist()
        rows += [(i + k, vector) for k in range(copies)]
        i += copies
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embedding_passes.near_duplicates(frame).collect()
    assert {r["n_links"] for r in got} == {len(rows) - 1}
    many = 40_000
    linked = spark.range(2).selectExpr(
        "0L AS rep", "CAST(id AS INT) AS bit",
        f"flatten(array_repeat(sequence(1L, {many}L - 10000 * id), 3)) AS links",
    )
    begun = time.perf_counter()
    assert embedding_passes._others(linked.union(linked)).collect() == [(0, many + 2 * (many - 10000))]
    assert time.perf_counter() - begun < 30


def test_sharding(docs, nothing):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(documents())
    slots, where = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        assert r["hash"] == "hash" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
        where[raw].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    again = sharding.shard(docs.repartition(5)).collect()
    assert Counter((r["text"], r["shard"]) for r in again) == Counter((r["text"], r["shard"]) for r in rows)
    assert sharding.shard(nothing).collect() == []


def test_packing():
    draw = random.Random(7)
    sizes = sorted((draw.randint(1, 1000) for _ in range(900)), reverse=True)
    bins = sharding.pack(sizes, 16)
    loads = Counter()
    for size, chosen in zip(sizes, bins, strict=True):
        loads[chosen] += size
    assert set(loads) <= set(range(16)) and max(loads.values()) <= 1.001 * sum(sizes) / 16
    # Each item went to the tightest bin that held it.
    room = {}
    for size, chosen in zip([6, 5, 4, 3, 2], sharding.best_fit([6, 5, 4, 3, 2], 10), strict=True):
        fitting = {b: r for b, r in room.items() if r >= size}
        assert chosen == min(fitting, key=fitting.get) if fitting else chosen not in room
        room[chosen] = room.get(chosen, 10) - size


def test_an_oversized_group_is_split(spark):
    frame = spark.range(4000).selectExpr("id AS doc_id", "IF(id < 3000, 'same text', uuid()) AS text")
    loads = sharding.shard(frame).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in loads]
    assert len(sizes) == 16 and max(sizes) <= 1.1 * sum(sizes) / 16


def test_decontamination(spark, nothing):
    item = "The train went 40 km in Berlin with 3 apples before Anna sold 12 of them to Peter"
    bench = [(1, "A question: " + item), (2, "only five little words here"), (3, None), (4, "")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    other = "The train went 55 miles in Paris with 7 apples before Eva sold 13 of them to Paul"
    mixed_up = "The train went 55 miles in Paris with 55 apples before Eva sold 55 of them to Paul"
    rows = [
        (1, f"Some text. A question: {item}. And on."), (2, f"some text, {other} and on"),
        (3, mixed_up), (4, "It has only five little words here, yes"), (5, None), (6, ""),
        (7, prose(1, 200)), (8, item), (8, item), (None, f"x {item} y"),
        (9, " ".join(item.split()[:9])),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    found = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.matches(docs, benchmark).collect()}
    assert {(d, i) for d, i, _ in found} == {(1, 1), (2, 1), (4, 2), (8, 1), (None, 1)}
    assert (1, 1, "exact") in found and (2, 1, "template") in found
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 5, 6, 7, 9]
    assert decontaminate.matches(nothing, benchmark).collect() == []
    assert decontaminate.matches(docs, benchmark.limit(0)).collect() == []


def matched(spark, items: list[str], texts: list[str]) -> set:
    """(document, item, kind) by their places."""
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.matches(frame, benchmark).collect()}


def test_exchanged_names_at_sentence_starts(spark):
    items = [
        "Tom bought 3 apples. Tom sold 2 of them. How many does Tom have?",
        "Berlin lies 289 km from Hamburg. Munich lies 612 km from Hamburg. Which is nearer?",
        "Anna has bought 3 red apples today",
    ]
    texts = [
        "Eva bought 5 apples. Eva sold 4 of them. How many does Eva have?",
        "Paris lies 465 km from London. Lyon lies 738 km from London. Which is nearer?",
        "So it was. Peter has bought 4 red apples today, he says",
        # One name of the item for two.
        "Eva bought 5 apples. Paul sold 4 of them. How many does Kim have?",
        "We know: tom bought 3 apples. tom sold 2 of them. How many does tom have?",
    ]
    found = {(d, i) for d, i, _ in matched(spark, items, texts)}
    assert found == {(0, 0), (1, 1), (2, 2), (4, 0)}


def test_values_that_become_equal(spark):
    items = ["Tom has 3 apples and 5 pears and gives all of them to the others in the room"]
    texts = [items[0].replace("3", "4").replace("5", "4"), items[0].replace("3", "5"),
             "Well, " + items[0].replace("3", "4").replace("5", "4").replace("in the room", "at home"),
             items[0].replace("apples and 5 pears", "plums and 3 figs")]
    assert {d for d, _, _ in matched(spark, items, texts)} == {0, 1, 2, 3}
    # One value of the item for two is no match.
    items = ["Tom has 4 apples and 4 pears and gives all of them away"]
    assert matched(spark, items, [items[0].replace("4 pears", "5 pears")]) == set()


def test_items_of_few_literal_words(spark):
    items = ["What is 12 + 45 - 7 + 88 ?", "Name three primes", "ok: Anna, Bert, Carl, Dora, Emil, Fred, Gus, Hans, Ida"]
    texts = [f"So: {item} And on." for item in items]
    texts += ["So: What is 13 + 46 - 8 + 89 ?", "Name three numbers", "it: Eva, Paul, Kim, Lea, Max, Ole, Pia, Tom, Uwe"]
    assert matched(spark, items, texts) == {(i, i, "exact") for i in range(3)}


def test_hashes_of_runs_copy_no_slices(spark):
    """Each window was a slice, copied before it was hashed."""
    rows = [(i, [f"w{k % 7}" for k in range(i)]) for i in (1, 3, 7, 8, 9, 30)]
    words = spark.createDataFrame(rows, "id int, w array<string>")
    hashed = words.select("id", decontaminate._hashed("w").alias("h"))
    runs = decontaminate._runs("h")
    assert "lambdafunction(xxhash64(slice" not in str(runs) + hashed.select(runs)._jdf.queryExecution().toString()
    n = decontaminate.WINDOW
    starts = F.sequence(F.lit(1), F.greatest(F.size("h") - n + 1, F.lit(1)))
    expected = F.transform(starts, lambda i: F.xxhash64(F.slice("h", i, n)))
    for r in hashed.select(runs.alias("runs"), expected.alias("expected")).collect():
        assert r["runs"] == r["expected"]


def test_windows_of_both_templates_from_one_pass(spark):
    """Each template was made from the text by itself, and runs were hashed in lambdas, which are not compiled."""
    texts = [
        None, "", " ", "a b c", "Foo 3 km bar. Baz x y z A b, C",
        "So it was ^Bar` in A^B. \u0391\u03a3.\u0391 \u039f\u03a3 `Foo/Bar\tBaz O'Neil-Foo's U.S.A. 3Foo\nwent 1,000.5 kg",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    windows = decontaminate._windows(frame, ["row"], False)
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("kilometers") == 1 and "lambdafunction(xxhash64(get" not in plan
    found = {}
    for r in windows.collect():
        found.setdefault((r["row"], r["at"]), set()).add(r["hash"])
    name, number, unit = "\x02", "\x01", "\x03"
    words = {
        3: ["a b c".split()] * 2,
        4: [["foo", number, unit, "bar", "baz", "x", "y", "z", name, "b", name],
            [name, number, unit, "bar", name, "x", "y", "z", name, "b", name]],
        5: [["so", "it", "was", "bar", "in", name + "b", "\u03b1\u03c3\u03b1", name, "foobar", name, name,
             name + "sa", "3foo", "went", number, unit],
            [name, "it", "was", name, "in", name + name, name + name, name, name + name, name, name,
             name * 3, "3foo", "went", number, unit]],
    }
    expected = {}
    for row, kinds in words.items():
        for kind in kinds:
            runs = [(i, kind[i : i + 8]) for i in range(max(1, len(kind) - 7))]
            hashed = spark.createDataFrame(runs, "at int, w array<string>").select(
                "at", F.xxhash64(F.transform("w", lambda w: F.xxhash64(w))).alias("hash"))
            for r in hashed.collect():
                expected.setdefault((row, r["at"]), set()).add(r["hash"])
    assert found == expected


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str) -> list[tuple]:
    def valid(kind: str, match: str) -> bool:
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "phone":
            return 10 <= len(digits) <= 15
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0
        return True

    return sorted(
        (m.start(), rank, kind, m.end())
        for rank, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text)
        if valid(kind, m.group())
    )


def test_personal_data(spark, docs, nothing):
    texts = [
        "a@b.c-d@e.f x@a.b_c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3", None, "",
        "4111 1111 1111 1111 x 4111-1111-1111-1111, 12--4111111111111111 1", "é4111111111111111é",
        "+1 (555) 123-4567 +49-30.123456 +1+2345678901 (+12 345 678 901 234 5-", "😀 a@é.de a@d.de",
        "0" * 70 + ".1.1.1", "1 " * 3000, "a.b." * 500 + "@c.d" + ".e" * 400, "1" * 5000,
    ]
    texts += [f"reach me under e{i}@mail.com now" for i in range(9)] + ["reach me under user-77-zz now"]
    texts += ["reach me under 4111111111111112 now"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data.find(frame).collect():
        spans = base_spans(texts[r["doc_id"]] or "")
        written = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[2] == k for s in spans) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        # The pattern 'under', learned from addresses, finds one more; a refused card it does not.
        assert r["spans"] == ("id:15:25" if r["doc_id"] == len(texts) - 2 else written)
    assert personal_data.find(docs).count() == docs.count()
    assert personal_data.find(nothing).collect() == []


def test_every_base_entity_is_a_seed(spark):
    texts = [f"ring me +1 (017) 555-77{i}3 soon" for i in range(10, 19)]
    texts += [f"billed to 4111 1111 1111 {n} now" for n in ("1111", "1129", "1137", "1145", "1152",
                                                            "1160", "1178", "1186", "1194")]
    texts += [f"write at {c}@x.io now" for c in "abcdefghi"]
    texts += [f"from\tdesk7\n{c}@y.io now" for c in "abcdefghi"]
    texts += [f"see box:{c}@z.io now" for c in "abcdefghi"]
    # Seeds in brackets: the word in front is the pattern. No seed teaches 'item', a number within none.
    texts += [f"mail to us ({c}@v.io) now" for c in "abcdefghi"]
    ends = ["ring me user-77-zz soon", "billed TO user-78-zz", "at user-79-zz", "Desk7 user-80-zz"]
    ends += ["box: user-81-zz", "see user-82-zz", "mail us user-83-zz", "item user-84-zz", "+1 user-85-zz"]
    ends += ["write at ab1", "1111 user-86-zz"]
    frame = spark.createDataFrame(list(enumerate(texts + ends)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in personal_data.find(frame).collect()}
    for i, text in enumerate(texts):
        assert spans[i] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(text)) != ""
    found = ["id:" in spans[len(texts) + i] for i in range(len(ends))]
    assert found == [True] * 7 + [False] * 4


def test_urls(spark):
    urls = [f"http://good{i}.example.org.com/fine/{i}" for i in range(40)]
    urls += [f"https://bad{i}.example.net/es/worse/{i}" for i in range(40)]
    urls += ["HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "http://a.example.com/en/x"]
    urls += ["http://notexample.com/en/", "ftp://x.net/fr/", "http://x.net/de/", "http://net/es/"]
    urls += [None, "", "no host", "://", "a://b?c://d", "http://good7.fine.org/fine", "http://q.net"]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")]
    rules += [("net", "/es/", "block"), ("net", "/fr/", "block")]
    got = {r["page_id"]: r for r in url_filter.judge(frame).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0] + best[1])
        assert r["verdict"] == best[2] if best else r["verdict"] in ("allow", "block")
    by_url = {u: got[i] for i, u in enumerate(urls)}
    assert by_url["http://good7.fine.org/fine"]["verdict"] == "allow"
    assert by_url["http://q.net"]["verdict"] == "block"
    alone = url_filter.judge(frame.where("page_id < 40")).collect()
    assert {r["verdict"] for r in alone} == {"allow"}
    assert url_filter.judge(frame.limit(0)).collect() == []


def test_language(spark, nothing):
    words = {"aa": "kato mile nupo resa tovi".split(), "bb": "schrung pflicht krampf strumpf dwarf".split()}
    draw = random.Random(8)
    rows = [
        (i, " ".join(draw.choices(words[lang], k=draw.randint(4, 60))), lang)
        for i, lang in enumerate(["aa", "bb"] * 60)
    ]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 !!", "aa"), (None, "kato mile", None)]
    rows += [(203, "汉字 ελλάς " * 400, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(frame).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, lang in rows:
        r = by_id[i]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if i in (200, 201, 202):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif lang:
            assert r["lang_pred"] == lang
    kept = language.in_known_language(frame)
    assert kept.columns == frame.columns
    assert {200, 201, 202}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert language.identify(nothing).collect() == []
    unlabelled = language.identify(frame.where("lang IS NULL")).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_unlearned_scripts_and_letter_noise_are_rejected(spark):
    """Scores of texts that share no run with a prototype are noise, above 0 as often as not."""
    draw = random.Random(4)
    syllables = ("ka lo mi nu per ta vi so".split(), "schr ung pfl icht kram stru dw erf".split())
    spoken = [["".join(draw.choices(s, k=draw.randint(2, 4))) for _ in range(200)] for s in syllables]
    clean = [
        " ".join(draw.choices(spoken[i % 2], k=draw.choice([3, 6, 30, 300]))) for i in range(800)
    ]
    # Short words that share next to nothing with the others.
    clean += ["".join(draw.choices("bgjqxyzé", k=draw.randint(1, 4))) for _ in range(200)]
    rows = [(i, text, ["aa", "bb"][i % 2]) for i, text in enumerate(clean)]
    scripts = ["".join(map(chr, r)) for r in (
        range(0x430, 0x450), range(0x3B1, 0x3CA), range(0x4E00, 0x5E00), range(0x61, 0x7B))]
    for letters in scripts:
        for _ in range(60):
            words = ["".join(draw.choices(letters, k=draw.randint(2, 8))) for _ in range(60)]
            rows.append((len(rows), " ".join(words), None))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language.in_known_language(frame).select("doc_id").collect()}
    assert kept == set(range(len(clean)))


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] >= r["size"]
    words = [len((t[1] or "").split()) for t in documents()]
    assert sorted(r["size"] for r in rows) == sorted(words)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weights = dict(zip(order, [3, 1, 2] * 9, strict=False))
    aims, fixed = {}, {}
    while True:
        left = 1.5 * sum(words) - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        aims = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s: 2.0 * size[s] for s in open_ if aims[s] > 2 * size[s]}
        if not over:
            break
        fixed |= over
    assert target == pytest.approx(aims | fixed)
    largest = {s: max(r["size"] for r in rows if r["source"] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= max(largest[s], 120) for s in order)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, rows))
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns
    assert sum(len(r["text"].split()) for r in repeated.collect()) == sum(taken.values())
    assert mixing.mix(nothing).collect() == []


def test_repeated_strings(spark, nothing):
    draw = random.Random(3)
    base = "".join(draw.choice("ab é") for _ in range(3000))
    rows = []
    for i in range(40):
        parts = [(s := draw.randint(0, 2900), draw.randint(0, 900)) for _ in range(draw.randint(0, 4))]
        rows.append((i, "".join(base[s : s + n] for s, n in parts)))
    rows += [(50, "a" * 1500), (51, None), (52, ""), (53, "q" * 400), (54, "r" * 401), (55, "xyz" * 300)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (None, "z" * 399), (56, prose(1, 100)), (57, prose(1, 100))]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, copies int")
    texts = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(t[i : i + 400] for _, t in texts for i in range(len(t) - 399))
    expected = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 399):
            if starts[t[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in suffix_dedup.repeated_strings(frame).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert suffix_dedup.repeated_strings(nothing).collect() == []


def test_merge_never_loses_order():
    draw = random.Random(9)
    runs = []
    for _ in range(5):
        run = sorted(
            (bytes(draw.choices(b"ab", k=draw.randint(0, 12))), b"l", 1, 2, 3, 4, 5) for _ in range(30)
        )
        runs.append(suffix_dedup._front_coded(run))
    merged = list(suffix_dedup._merged([suffix_dedup._decoded(r) for r in runs]))
    strings = [e[0] for _, e in merged]
    assert strings == sorted(strings) and len(strings) == 150
    for (_, before), (same, entry) in zip(merged, merged[1:], strict=False):
        assert same == suffix_dedup._shared(before[0], entry[0])


def test_near_duplicates(docs, nothing):
    sets, ids = {}, [r[0] for r in documents() if r[0] is not None]
    for i, text, *_ in documents():
        words = [w.decode() for w in (text or "").encode().lower().split()]
        runs = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        if i is not None:
            sets[i] = runs
    groups = Sets(ids)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                groups.link(a, b)
    got = minhash_hamming.near_duplicates(docs).collect()
    assert len(got) == len(documents())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            own = groups.find(r["doc_id"])
            expected = (len(sets[r["doc_id"]]), own, own == r["doc_id"])
            assert (r["n_shingles"], r["component_id"], r["kept"]) == expected
    assert minhash_hamming.near_duplicates(nothing).collect() == []


def test_pairs_under_the_distance_share_their_first_key(spark):
    draw = np.random.default_rng(2)
    slots = draw.integers(0, 2**14, (40, 64))
    for i in range(1, 40):
        slots[i] = slots[0]
        changed = draw.choice(64, draw.integers(0, 32), replace=False)
        slots[i, changed] = draw.integers(0, 2**14, len(changed))
    packed = (slots.reshape(40, 16, 4) << 15 * np.arange(4)).sum(axis=2)
    names = minhash_hamming._PARTS
    frame = spark.createDataFrame(
        [(i, *map(int, p)) for i, p in enumerate(packed)], "rep long, " + ", ".join(f"{p} long" for p in names)
    )
    keys = frame.select("*", minhash_hamming._keys().alias("key"))
    met = keys.alias("x").join(keys.alias("y"), "key").where("x.rep < y.rep")
    apart = sum(minhash_hamming._differing("x", "y"))
    met = met.where(apart <= minhash_hamming.MOST_DIFFERENT)
    met = met.where(minhash_hamming._first_key("x", "y", F.col("key")))
    met = [tuple(r) for r in met.select("x.rep", "y.rep").collect()]
    assert len(met) == len(set(met))
    near = {(a, b) for a in range(40) for b in range(a + 1, 40) if (slots[a] != slots[b]).sum() <= 31}
    assert near and near == set(met)


def test_parities_pass_no_link_over():
    draw = np.random.default_rng(5)
    for size in (1, 7, 146, 3000):
        base = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
        other = np.unique(np.append(base[size // 7 :], draw.integers(0, 2**64, size // 7, np.uint64)))
        apart = len(np.setxor1d(base, other))
        odd = minhash_hamming.parities(base) ^ minhash_hamming.parities(other)
        assert sum(int(x).bit_count() for x in odd.view(np.uint64)) <= apart
        assert len(odd) == minhash_hamming.PARITIES


def test_links_that_only_the_crossing_finds(spark, monkeypatch):
    """Rounds are cut to one, classes of a key are split, links are those of brute force."""
    monkeypatch.setattr(minhash_hamming, "PAIRS_PER_CLASS", 1 << 40)
    monkeypatch.setattr(minhash_hamming, "OUTSIDE_PER_TASK", 3)
    draw = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in draw.sample(range(120), draw.randint(0, 7)):
            words[at] = f"x{draw.randint(0, 10**6)}"
        texts.append(" ".join(words))
    rows = [(i, text) for i, text in enumerate(texts)]
    found = minhash_hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    groups = Sets(range(90))
    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                groups.link(a, b)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert got == {i: groups.find(i) for i in range(90)}
    assert 1 < len(set(got.values())) < 90


def test_lines(spark, nothing):
    draw = random.Random(11)
    pool = [prose(100 + i, draw.randint(1, 25)) for i in range(25)]
    rows = []
    for i in range(40):
        lines = draw.choices(pool, k=draw.randint(0, 5)) + [prose(1000 + i, 12), "", "  "]
        for k in range(3):
            words = draw.choice(pool).split() + prose(i, 8).split()
            words[draw.randrange(len(words))] = f"w{i}{k}"
            lines.append("  ".join(words))
        draw.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, rows[3][1]), (53, rows[4][1].upper())]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_lines int")
    earlier, expected = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n") if text is not None else []:
            words = line.lower().split()
            runs = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
            if not any(4 * len(runs & o) >= 3 * len(runs | o) for o in earlier) or not runs:
                kept.append(line)
            if runs:
                earlier.append(runs)
        n = len(text.split("\n")) if text is not None else 0
        expected[i] = (None if text is None else "\n".join(kept), n, n - len(kept))
    got = line_dedup.clean_lines(frame).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == expected
    assert line_dedup.clean_lines(nothing).collect() == []


@pytest.mark.parametrize("hot", [1, 2, 64])
def test_lines_in_either_order(spark, monkeypatch, hot):
    """Tokens of many lines and of few, lines of one phrase, near copies, rows that occur again."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    draw = random.Random(hot)
    phrase, rows = prose(1, 30), []
    pool = [prose(10 + i, draw.randint(3, 60)) for i in range(8)]
    for i in range(30):
        lines = [f"{prose(200 + i, 25)} {phrase} {prose(300 + i, 25)}", draw.choice(pool)]
        words = draw.choice(pool).split()
        words[draw.choice([0, -1])] = f"w{i}"
        rows.append((i, "\n".join([*lines, " " + " ".join(words)])))
    earlier, expected = [], {}
    for i, text in rows:
        n = 0
        for line in text.split("\n"):
            words = line.split()
            runs = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
            n += any(4 * len(runs & o) >= 3 * len(runs | o) for o in earlier)
            earlier.append(runs)
        expected[i] = n
    frame = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    got = line_dedup.clean_lines(frame).collect()
    assert len(got) == 33 and {r["doc_id"]: r["n_removed"] for r in got} == expected


def test_near_copies_that_differ_too_much_are_not_verified(spark, monkeypatch):
    """Nearly all pairs of a group of copies with three words changed were verified, though few are similar."""
    monkeypatch.setattr(line_dedup, "HOT", 1)
    similar, candidates = line_dedup._similar, []

    def counted(sets, pairs):
        candidates.append(pairs.count())
        return similar(sets, pairs)

    monkeypatch.setattr(line_dedup, "_similar", counted)
    draw = random.Random(5)
    rows, earlier, expected, alike = [], [], {}, 0
    for i in range(30):
        words = [f"t{k}" for k in range(120)]
        for k in range(3):
            words[draw.randrange(120)] = f"w{i}x{k}"
        rows.append((i, " ".join(words)))
        runs = {tuple(words[k : k + 5]) for k in range(116)}
        found = sum(4 * len(runs & o) >= 3 * len(runs | o) for o in earlier)
        alike += found
        expected[i] = min(found, 1)
        earlier.append(runs)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.clean_lines(frame).collect()}
    assert got == expected and 0 < sum(expected.values()) < 30
    assert sum(candidates) < 100 + alike  # of 435 pairs


def test_near_copies_are_paired_once(spark, monkeypatch):
    """A pair was made at each frequent token that the prefixes of its lines share."""
    monkeypatch.setattr(line_dedup, "HOT", 1)
    draw = random.Random(9)
    rows, earlier, expected = [], [], {}
    for i in range(40):
        words = [f"t{k}" for k in range(160)]
        for k in range(4):
            words[draw.randrange(160)] = f"w{i}x{k}"
        rows.append((i, " ".join(words)))
        runs = {tuple(words[k : k + 5]) for k in range(156)}
        expected[i] = int(any(4 * len(runs & o) >= 3 * len(runs | o) for o in earlier))
        earlier.append(runs)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    distinct, joined = type(frame).distinct, []

    def counted(pairs):
        if pairs.columns == ["later", "earlier"]:
            joined.append((pairs.count(), distinct(pairs).count()))
        return distinct(pairs)

    monkeypatch.setattr(type(frame), "distinct", counted)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.clean_lines(frame).collect()}
    assert got == expected and 0 < sum(expected.values()) < 40
    made, pairs = joined[1]  # of lines without a match among the first of their tokens
    assert pairs > 0 and made == pairs


def test_lines_of_one_phrase_are_not_verified(spark):
    """All pairs that shared one token were held against each other with all their tokens."""
    rows = [(i, 100, p, t) for i in range(40) for p, t in [(0, 1000 + i), (3, 1), (4, 2)]]
    rows += [(50 + i, 100, p, p + 5000) for i in range(2) for p in range(26)]
    tokens = spark.createDataFrame(rows, "id long, n int, pos int, token long")
    assert line_dedup._counted(tokens, tokens).collect() == [(51, 50)]
