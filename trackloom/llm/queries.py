"""The queries of this subpackage: each numbered operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, decontam, filter_audit, html_extract, language_id, license_scan, minhash, packing, quality, sharding, spelling, substring_dedup, token_counts
from .common import SHINGLE_WORDS, SIMILARITY, read_table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), counts=True)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    classifier = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, classifier, keep=["doc_id"])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("filter")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(read_table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(read_table(spark, sf_dir, "documents"))


def base_token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op4_token_counts."""
    return op4_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op8_quality_rules."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op9_license_scan."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op10_sharding."""
    return op10_sharding(spark, sf_dir).select("doc_id", "size", "law")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (base_token_bytes, base_quality_counts, base_license_places, base_shard_sizes, op1_benchmark_decontamination, op2_minhash_near_dedup, op3_html_extraction, op4_token_counts, op5_substring_dedup, op6_language_id, op7_packing, op8_quality_rules, op9_license_scan, op10_sharding, op11_filter_audit, op12_spelling_variants, op13_best_fit_packing)}


def leak_sql(size: int = SHINGLE_WORDS, least: float = SIMILARITY) -> str:
    """All windows of an item's size in each document that shares a shingle with the item: others have nothing in common with it."""
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    runs = lambda w: f"list_distinct(list_transform(range(1, len({w}) - least({size}, len({w})) + 2), lambda i: array_to_string({w}[i:i + least({size}, len({w})) - 1], ' ')))"
    weight = lambda r: f"coalesce(list_sum(list_transform({r}, lambda x: length(replace(x, ' ', '')))), 0)"
    return f"""WITH items AS (SELECT item_id, w, len(w) AS m, least({size}, len(w)) AS k, {runs('w')} AS runs FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
 docs AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
 parts AS (SELECT item_id, k, unnest(runs) AS s FROM items),
 places AS (SELECT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM docs, (SELECT DISTINCT k FROM items))),
 met AS (SELECT DISTINCT doc_id, item_id FROM places JOIN parts USING (s, k)),
 spots AS (SELECT doc_id, item_id, m, runs, docs.w AS w, unnest(range(0, greatest(len(docs.w) - m, 0) + 1)) AS start FROM met JOIN docs USING (doc_id) JOIN items USING (item_id)),
 windows AS (SELECT doc_id, item_id, m, start, runs, {runs('v')} AS own FROM (SELECT *, w[start + 1:start + m] AS v FROM spots)),
 pairs AS (SELECT doc_id, item_id, start, m, {weight('list_intersect(own, runs)')} AS c, {weight('own')} + {weight('runs')} AS t FROM windows),
 scored AS (SELECT *, c::DOUBLE / (t - c)::DOUBLE AS similarity FROM pairs)
SELECT doc_id, item_id, similarity, start::INTEGER AS start, m::INTEGER AS n_words FROM scored WHERE similarity >= {least}
 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""


QUALITY_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
 t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 runs AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM t)),
 often AS (SELECT r, s FROM runs GROUP BY r, s HAVING count(*) > 1),
 covered AS (SELECT r, count(DISTINCT p + k) AS n FROM runs JOIN often USING (r, s), range(5) f(k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed FROM t LEFT JOIN covered USING (r)"""
LICENSE_SQL = r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 p AS (SELECT doc_id, w, list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS m, list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS a,
 list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS g FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(m) + len(a) + len(g))::BIGINT AS n_base, least(list_min(m), list_min(a), list_min(g))::BIGINT AS first_word, greatest(list_max(m), list_max(a), list_max(g))::BIGINT AS last_word,
 concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM p"""

AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
 firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
 told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM w JOIN firsts USING (t) LEFT JOIN told USING (doc_id)),
 c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
 l AS (SELECT chr(65 + k::INT) AS x, 1 << k::INT AS bit FROM range(5) r(k)),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
 s AS (SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS own, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS before FROM o, range(1, 6) r(step)),
 f AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT * EXCLUDE own, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM f"""
SPELLING_SQL = r"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents),
 own AS (SELECT run, count(*) AS c, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS raw FROM runs GROUP BY doc_id, run),
 bits AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
 hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(raw)), lambda i: ('0x' || substr(hex(raw), 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM own, bits),
 words AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
 cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
 near AS (SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
 best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS most FROM near GROUP BY word),
 forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN near END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)),
 paths(word, last, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT p.word, f.word, f.form FROM paths p JOIN forms f ON p.form = f.word)
SELECT forms.*, paths.last AS root FROM forms JOIN paths USING (word) WHERE paths.form IS NULL"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: the others learn, sample, tokenize or hash in ways of their own."""
    return {
        "op1_benchmark_decontamination": leak_sql(),
        "op11_filter_audit": AUDIT_SQL,
        "op12_spelling_variants": SPELLING_SQL,
        "base_token_bytes": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents",
        "base_quality_counts": QUALITY_SQL,
        "base_license_places": LICENSE_SQL,
        "base_shard_sizes": "SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, 'key' AS law FROM documents",
    }
