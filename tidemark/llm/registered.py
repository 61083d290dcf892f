"""The registered queries of the operators, and their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    embedding_passes,
    language,
    line_dedup,
    line_quality,
    minhash_hamming,
    mixing,
    personal_data,
    phrase_mining,
    sharding,
    spelling_variants,
    suffix_dedup,
    url_filter,
)
from .common import table


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_passes.near_duplicates(table(spark, sf_dir, "embeddings"))


def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.withColumn("score", F.round("score", 5))


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.withColumn("score", F.round("score", 5))


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def _near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_hamming.near_duplicates(table(spark, sf_dir, "documents"))


def _personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_strings(table(spark, sf_dir, "documents"))
    return found.drop("kept")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return cleaned.select("doc_id", "n_lines", "n_removed", kept.alias("kept_md5"))


def _line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "document.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "lost_chars",
    )


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return spelling_variants.group_words(
        spelling_variants.counted_words(documents, "text", "doc_id", every=199)
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sorted_projection_passes": _embeddings,
        "op2_best_fit_decreasing": _sharding,
        "op3_template_canonicalisation": _decontamination,
        "op4_bootstrapped_extraction": _personal_data,
        "op5_character_model_ratio": _urls,
        "op6_hyperdimensional_profiles": _language,
        "op7_hash_threshold_histograms": _mixing,
        "op8_suffix_merge_sort": _repeated_strings,
        "op9_multi_index_hamming": _near_duplicates,
        "op10_set_similarity_lines": _lines,
        "op11_line_first_cleaning": _line_quality,
        "op12_direct_address_tiling": _phrases,
        "op13_reduced_alphabet_generation": _spellings,
    }


_COMPONENTS = """
    reach(id, root) AS (
        SELECT id, id FROM ids
        UNION
        SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id),
    comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

_EMBEDDINGS_SQL = f"""
    WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
    edges AS (
        SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id
        WHERE list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.95),
    ids AS (SELECT vec_id AS id FROM v),
    {_COMPONENTS}
    SELECT c.id AS vec_id, (SELECT count(*) FROM edges WHERE a = c.id) AS n_links,
        c.component_id, c.id = c.component_id AS kept
    FROM comp c"""

_NEAR_SQL = f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(
            string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) >= 5
            THEN list_distinct(list_transform(range(1, len(w) - 3),
                lambda i: array_to_string(w[i:i + 4], ' ')))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
        FROM words),
    parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m,
            count(*) AS k
        FROM parts x JOIN parts y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    edges AS (SELECT a, b FROM common WHERE 100 * k >= 75 * (n + m - k)),
    ids AS (SELECT doc_id AS id FROM sets),
    {_COMPONENTS}
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id,
        s.doc_id = c.component_id AS kept
    FROM sets s JOIN comp c ON c.id = s.doc_id"""

_LINES_SQL = """
    WITH lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            unnest(range(len(string_split(text, chr(10))))) AS ln
        FROM documents),
    words AS (
        SELECT doc_id, ln, line, list_filter(
            string_split_regex(lower(line), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM lines),
    sets AS (
        SELECT doc_id, ln, line, CASE WHEN len(w) >= 5
            THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3),
                lambda i: array_to_string(w[i:i + 4], ' '))))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
        FROM words),
    classes AS (
        SELECT row_number() OVER (ORDER BY min(struct_pack(d := doc_id, p := ln))) AS id, s,
            len(s) AS n, min(struct_pack(d := doc_id, p := ln)) AS place
        FROM sets WHERE len(s) > 0 GROUP BY s),
    parts AS (SELECT id, n, unnest(s) AS g FROM classes),
    ranked AS (
        SELECT id, n, g, row_number() OVER (PARTITION BY id ORDER BY f, g) AS pos
        FROM (SELECT id, n, g, count(*) OVER (PARTITION BY g) AS f FROM parts)),
    prefix AS (SELECT id, n, g FROM ranked WHERE pos <= n - ceil(0.75 * n) + 1),
    pairs AS (
        SELECT DISTINCT x.id AS later, y.id AS earlier FROM prefix x JOIN prefix y
        ON x.g = y.g AND y.id < x.id AND 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)),
    shared AS (
        SELECT later, any_value(c.n) AS n, any_value(d.n) AS m,
            len(list_intersect(any_value(c.s), any_value(d.s))) AS k
        FROM pairs JOIN classes c ON c.id = later JOIN classes d ON d.id = earlier
        GROUP BY later, earlier),
    matched AS (SELECT DISTINCT later FROM shared WHERE 4 * k >= 3 * (n + m - k)),
    judged AS (
        SELECT doc_id, ln, line, len(sets.s) > 0 AND (
            struct_pack(d := doc_id, p := ln) <> place OR id IN (SELECT later FROM matched)) AS gone
        FROM sets LEFT JOIN classes ON classes.s = sets.s)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
        md5(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT coalesce(gone, false)),
            '')) AS kept_md5
    FROM judged GROUP BY doc_id"""

_MIXING_SQL = """
    WITH sized AS (
        SELECT doc_id, source,
            CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
        FROM documents),
    sources AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
    weighed AS (
        SELECT source, CAST(source_size AS BIGINT) AS source_size,
            [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
            CAST(2 * source_size AS BIGINT) AS most
        FROM sources),
    summed AS (
        SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
            CAST(coalesce(sum(most) OVER earlier, 0) AS DOUBLE) AS stopped,
            CAST(sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS DOUBLE) AS weights_left
        FROM weighed
        WINDOW earlier AS (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    stops AS (SELECT *, most <= (budget - stopped) / weights_left * weight AS stopped_here FROM summed),
    level AS (
        SELECT budget - stopped AS left_over, weights_left FROM stops WHERE NOT stopped_here
        ORDER BY CAST(most AS DOUBLE) / weight, stopped LIMIT 1),
    aims AS (
        SELECT source, source_size, CASE WHEN stopped_here THEN CAST(most AS DOUBLE)
            ELSE (SELECT left_over FROM level) * weight / (SELECT weights_left FROM level) END AS target
        FROM stops),
    along AS (
        SELECT doc_id, sized.source, size, source_size, target,
            CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds,
            coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY h
                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
            sum(size) OVER (PARTITION BY sized.source, h) AS own
        FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source)
    SELECT doc_id, source, size, source_size, target, CAST(size * least(2, rounds + CASE
        WHEN 2 * (upto - own) + own <= 2 * (target - rounds * source_size) THEN 1 ELSE 0 END)
        AS BIGINT) AS taken
    FROM along"""


_BLANK_SQL = "[\\x20\\x09-\\x0D]"


def _any_sql(text: str, phrases: tuple[str, ...]) -> str:
    return " OR ".join(f"contains({text}, '{p}')" for p in phrases)


def _less_sql(text: str, marks: str) -> str:
    return f"length({text}) - length(regexp_replace({text}, '{marks}', '', 'g'))"


_QUALITY_SQL = f"""
    WITH docs AS (
        SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (
        SELECT *, list_filter(string_split_regex(text, '{_BLANK_SQL}+'), lambda x: x <> '') AS w,
            string_split(text, chr(10)) AS ls
        FROM docs),
    runs AS (
        SELECT row, unnest(range(1, len(w) - 3)) AS i,
            unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
        FROM words),
    twice AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS c FROM runs) WHERE c > 1),
    covered AS (
        SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM twice)
        GROUP BY row),
    lines AS (SELECT row, unnest(ls) AS x FROM words),
    signs AS (
        SELECT *, len(list_filter(string_split_regex(x, '{_BLANK_SQL}+'), lambda y: y <> '')) AS nw,
            length(regexp_replace(x, '{_BLANK_SQL}+', '', 'g')) AS chars,
            {_less_sql('x', f'[{line_quality.SEPARATORS}]')} AS bars,
            {_less_sql('x', f'[{line_quality.SYMBOLS}]')} AS symbols,
            {_less_sql('x', '\\p{Lu}')} AS capitals, {_less_sql('x', '\\p{L}')} AS letters
        FROM lines),
    lost AS (
        SELECT row, sum(chars) AS lost FROM signs
        WHERE nw > 0 AND (
            {_any_sql('lower(x)', line_quality.BOILERPLATE)}
            OR (length(x) < 60
                AND regexp_matches(lower(x), '^{_BLANK_SQL}*({line_quality.MENU}){_BLANK_SQL}*$'))
            OR (bars > 0 AND 6 * bars >= nw)
            OR (symbols > 0 AND 10 * symbols >= chars)
            OR (contains(x, '!!') AND letters >= 10 AND 10 * capitals >= 7 * letters)
            OR NOT regexp_matches(
                x, '[{line_quality.SENTENCE_MARKS}]["''”’»)\\]\\x20\\x09-\\x0D]*$'))
        GROUP BY row),
    counted AS (
        SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_words,
            CAST(length(regexp_replace(text, '{_BLANK_SQL}+', '', 'g')) AS BIGINT) AS word_chars,
            CAST({_less_sql('text', f'[{line_quality.SYMBOLS}]')} AS BIGINT) AS n_symbols,
            list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS spoken
        FROM words),
    judged AS (
        SELECT c.*, coalesce(v.n, 0) AS n_repeat_words, CAST(coalesce(l.lost, 0) AS BIGINT) AS lost_chars
        FROM counted c LEFT JOIN covered v ON v.row = c.row LEFT JOIN lost l ON l.row = c.row)
    SELECT doc_id, n_words, word_chars, n_symbols,
        CAST(len(spoken) - len(list_distinct(spoken)) AS BIGINT) AS n_dup_lines, n_repeat_words,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR 10 * lost_chars > 3 * word_chars) AS kept,
        lost_chars
    FROM judged"""

_PHRASES_SQL = """
    WITH pieces AS (
        SELECT lang, row_number() OVER () AS piece,
            list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    spans AS (
        SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM pieces, (SELECT unnest(range(1, 6)) AS k)),
    often AS (
        SELECT lang, words, k, f FROM (
            SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS words, k, count(*) AS f
            FROM spans GROUP BY 1, 2, 3)
        WHERE f >= 100),
    cuts AS (
        SELECT lang, words, k, f AS a, string_split(words, ' ') AS w, unnest(range(1, k)) AS cut
        FROM often WHERE k > 1),
    scored AS (
        SELECT c.lang, c.words, c.k, c.a, c.cut, x.f AS l, y.f AS r, t.n,
            CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
        FROM cuts c
        JOIN often x ON x.lang = c.lang AND x.words = array_to_string(c.w[1:cut], ' ')
        JOIN often y ON y.lang = c.lang AND y.words = array_to_string(c.w[cut + 1:], ' ')
        JOIN totals t ON t.lang = c.lang),
    lowest AS (
        SELECT * FROM scored
        QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
    stay AS (
        SELECT * FROM lowest s WHERE NOT EXISTS (
            SELECT 1 FROM often o WHERE o.lang = s.lang AND o.k > s.k AND 100 * o.f >= 100 * s.a
                AND contains(' ' || o.words || ' ', ' ' || s.words || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, words) AS rank,
        words AS phrase, a, l, r, n, score
    FROM stay QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sorted_projection_passes": _EMBEDDINGS_SQL,
        "op7_hash_threshold_histograms": _MIXING_SQL,
        "op9_multi_index_hamming": _NEAR_SQL,
        "op10_set_similarity_lines": _LINES_SQL,
        "op11_line_first_cleaning": _QUALITY_SQL,
        "op12_direct_address_tiling": _PHRASES_SQL,
    }
