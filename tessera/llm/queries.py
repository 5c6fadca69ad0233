"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, table


def op1_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predictor

    docs = table(spark, sf_dir, "documents")
    learned = docs.select("doc_id", "text", "lang").where(id_bucket("doc_id", 5) != 0)
    predict = predictor(spark, fit(learned))
    held = F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), predict(F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.bits_per_byte").alias("bits_per_byte"))


def op2_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"))


def op4_discriminant_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .qualityclf import classify

    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(id_bucket("doc_id", 3) != 1)
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    held = F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge, mine

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(pages, mine(pages.join(labels, "page_id").select("url", "bad")))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_no_random_access_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return top_k(rows, F.col("id") % 50 == 0, 5)


def op10_three_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_removed", F.md5("text").alias("kept_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ppm_language_id, op2_bottom_k_near_dedup, op3_adaptive_quality_rules, op4_discriminant_quality,
        op5_tournament_packing, op6_suffix_automaton_dedup, op7_association_url_filter, op8_temperature_mixing,
        op9_no_random_access_topk, op10_three_line_dedup,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: DuckDB SQL for the operators that it can express, on the same tables.
SQL = {
    "op2_bottom_k_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words),
        items AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
        pairs AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        edges AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT doc_id AS node, doc_id AS low FROM documents
            UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node WHERE r.low < e.b),
        comp AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
        class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS c FROM sets)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept,
            CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE k.c END AS class_id
        FROM sets s JOIN comp c ON c.node = s.doc_id JOIN class k ON k.doc_id = s.doc_id""",
    "op3_adaptive_quality_rules": r"""
        WITH split AS (
            SELECT doc_id, lang, source, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS l FROM documents),
        grams AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) AS h FROM split WHERE len(w) >= 5),
        twice AS (SELECT doc_id, unnest(list(i)) AS i FROM grams GROUP BY doc_id, h HAVING count(*) > 1),
        again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
        counted AS (
            SELECT split.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS upper
            FROM split LEFT JOIN again USING (doc_id)),
        based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
        measured AS (
            SELECT doc_id, lang, source, base_failed, unnest([
                {'metric': 'word_length', 'x': word_chars / greatest(n_words, 1)}, {'metric': 'symbol_rate', 'x': n_symbols / greatest(n_words, 1)},
                {'metric': 'dup_line_share', 'x': n_dup_lines / greatest(n_lines, 1)}, {'metric': 'repeat_share', 'x': n_repeat_words / greatest(n_words, 1)},
                {'metric': 'upper_share', 'x': upper / greatest(word_chars, 1)}], recursive := true) FROM based),
        held AS (SELECT *, CAST(floor(ln(greatest(x, 1e-4)) / ln(1.02)) AS INTEGER) AS bucket, CAST(floor(ln(1e-4) / ln(1.02)) AS INTEGER) AS nil FROM measured),
        valued AS (SELECT *, CASE WHEN bucket <= nil THEN 0.0 ELSE pow(CAST(1.02 AS DOUBLE), bucket + 0.5) END AS v FROM held),
        own AS (SELECT lang, source, metric, 1 AS level, v FROM valued WHERE NOT base_failed
            UNION ALL SELECT lang, NULL, metric, 2, v FROM valued WHERE NOT base_failed
            UNION ALL SELECT NULL, NULL, metric, 3, v FROM valued WHERE NOT base_failed),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, metric ORDER BY v) AS r, count(*) OVER (PARTITION BY level, lang, source, metric) AS total,
            count(*) FILTER (v = 0) OVER (PARTITION BY level, lang, source, metric) AS zeros FROM own),
        read AS (
            SELECT level, lang, source, metric, max(total) AS docs, min(v) FILTER (r >= ceil(total * CAST(0.1 AS DOUBLE))) AS low, min(v) FILTER (r >= ceil(total * CAST(0.5 AS DOUBLE))) AS middle,
                min(v) FILTER (r >= ceil(total * CAST(0.9 AS DOUBLE))) AS high, coalesce(min(v) FILTER (r >= zeros + greatest(ceil((total - zeros) * CAST(0.25 AS DOUBLE)), 1)), 0) AS rare
            FROM ranked GROUP BY level, lang, source, metric),
        picked AS (
            SELECT a.lang, a.source, a.metric, CASE WHEN a.docs >= 100 THEN a ELSE CASE WHEN b.docs >= 100 THEN b ELSE c END END AS q
            FROM read a JOIN read b ON b.level = 2 AND a.lang IS NOT DISTINCT FROM b.lang AND a.metric = b.metric JOIN read c ON c.level = 3 AND a.metric = c.metric WHERE a.level = 1),
        fence AS (SELECT lang, source, metric, CASE WHEN metric = 'word_length' THEN q.low - 5 * (q.middle - q.low) ELSE CAST('-inf' AS DOUBLE) END AS bottom,
            CASE WHEN q.high > q.middle THEN q.high + 5 * (q.high - q.middle) ELSE greatest(q.high, q.rare) END AS top FROM picked),
        beyond AS (SELECT doc_id, string_agg(metric, ',' ORDER BY list_position(['word_length', 'symbol_rate', 'dup_line_share', 'repeat_share', 'upper_share'], metric)) AS failed_rules
            FROM valued JOIN fence USING (metric) WHERE valued.lang IS NOT DISTINCT FROM fence.lang AND valued.source IS NOT DISTINCT FROM fence.source AND (v < bottom OR v > top) GROUP BY doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
        FROM based LEFT JOIN beyond USING (doc_id)""",
    "op6_suffix_automaton_dedup": r"""
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50),
        windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
        firsts AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h),
        gone AS (SELECT doc_id, list(i) AS s FROM windows JOIN firsts USING (h) WHERE f < doc_id GROUP BY doc_id),
        covered AS (SELECT doc_id, list_distinct(flatten(list_transform(s, lambda i: range(i, i + 50)))) AS c FROM gone),
        left_ AS (SELECT words.doc_id, len(w) AS n, coalesce(len(c), 0) AS r,
            CASE WHEN c IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(c, i)))), ' '), '') END AS kept
            FROM words LEFT JOIN covered USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM left_""",
    "op8_temperature_mixing": r"""
        WITH RECURSIVE tok AS (
            SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens,
                md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
        src AS (SELECT source, count(*) AS docs, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM tok GROUP BY source),
        sh AS (SELECT tokens / (SELECT sum(tokens) FROM src) AS p FROM src WHERE tokens > 0),
        goal AS (SELECT 0.5 * (ln(count(*)) - sum(p * ln(p))) AS g, min(p) AS least FROM sh),
        bisect(i, lo, hi) AS (
            SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
            UNION ALL
            SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
                SELECT i, lo, hi, (lo + hi) / 2 AS mid, (
                    SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) <= max(g) + 1e-12
                        AND pow(max(least), (lo + hi) / 2 - 1) / sum(pow(p, (lo + hi) / 2)) <= 4 + 1e-12
                    FROM sh, goal) AS ok
                FROM bisect WHERE i < 45)),
        expo AS (SELECT round(hi, 8) AS a FROM bisect WHERE i = 45),
        plan AS (
            SELECT source, docs, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM src), (SELECT a FROM expo)) / (SELECT sum(pow(p, a)) FROM sh, expo) ELSE 0 END AS weight,
                tokens / (SELECT sum(tokens) FROM src) AS p FROM src),
        dealt AS (
            SELECT doc_id, tok.source, n_tokens, d, round(weight, 9) AS weight, CASE WHEN p > 0 THEN round(weight / p, 9) ELSE 1.0 END AS epochs,
                CAST('0x' || substr(d, 1, 8) AS BIGINT) % CAST(ceil(docs / 4096) AS BIGINT) AS block
            FROM tok JOIN plan ON tok.source IS NOT DISTINCT FROM plan.source),
        summed AS (
            SELECT *, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY d, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto, sum(n_tokens) OVER (PARTITION BY source, block) AS every,
                row_number() OVER (PARTITION BY source, block ORDER BY d, doc_id, n_tokens) - 1 AS position, count(*) OVER (PARTITION BY source, block) AS block_docs
            FROM dealt)
        SELECT doc_id, source, n_tokens, weight, epochs, block, position, block_docs, CAST(floor(epochs) + CASE WHEN upto - n_tokens / 2.0 < (epochs - floor(epochs)) * every THEN 1 ELSE 0 END AS INTEGER) AS copies FROM summed""",
    "op9_no_random_access_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_three_line_dedup": """
        WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        starts AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE text IS NOT NULL AND len(l) >= 3),
        windows AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS h FROM starts WHERE trim(l[i] || l[i + 1] || l[i + 2], ' ') <> ''),
        ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM windows),
        gone AS (SELECT doc_id, list_distinct(flatten(list([i, i + 1, i + 2]))) AS c FROM ranked WHERE r > 1 GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(c), 0) AS BIGINT) AS n_removed,
            md5(CASE WHEN c IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(c, i)), lambda i: l[i]), chr(10)), '') END) AS kept_md5
        FROM lines LEFT JOIN gone USING (doc_id)""",
}
