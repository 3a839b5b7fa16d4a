"""The queries of this subpackage, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.llm import alignment, bpe, contamination, html_text, language, packing, phrases, quality_neighbours, quality_rules, repeats, shards, simhash, url_rules
from backtrail.llm.common import fold, table
from backtrail.session import cut_lineage

Build = Callable[[SparkSession, str], DataFrame]

# The rules of the address query (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold() % 5 != 0)
    scored = quality_neighbours.score(docs, quality_neighbours.fit(docs, labels), threshold=0.3)
    return scored.select("doc_id", (fold() % 5 == 0).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document in the 49k word vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = bpe.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they contain."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return contamination.contained(docs, items).select("doc_id", "item_id", "n_shingles", "n_found", "containment")


_CONTAINED_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark),
item_shingles AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS size,
    unnest(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM item_words WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
doc_words AS (
  SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, text, size,
    unnest(list_transform(range(1, greatest(len(w) - size, -1) + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS s
  FROM doc_words, (SELECT DISTINCT size FROM item_shingles))
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM doc_shingles JOIN item_shingles USING (size, s) JOIN sizes USING (item_id)
GROUP BY doc_id, text, item_id, n_shingles HAVING count(*) / n_shingles >= 0.8
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold() % 4 == 2
    model = language.train(docs.where(~held_out).select("text", "lang"))
    told = cut_lineage(language.predict(docs.withColumn("held_out", held_out), model, keep=["held_out", "lang"]))
    limits = language.calibrate(told.where(~F.col("held_out")))
    return told.select("doc_id", "held_out", "lang_pred", "score", "bits", language.accepted(limits).alias("accepted"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of equal counts, equal texts together."""
    return shards.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packing.pack(parts, docs.count(), capacity=4096)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, budget=3, words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page address judged by the longest rule that fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rule_table(spark, URL_RULES))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by rules that vote."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in two vocabularies, aligned by bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.alignment_report(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that earlier documents hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = repeats.remove_repeats(docs, length=50)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return left.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op13_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two and three words of every language, by the score of their weakest cut."""
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return phrases.collocations(phrases.phrase_counts(docs, threshold=10, longest=3), covered=50, best=2000)


_REPEAT_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS place, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT r, place, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT r, place, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM docs)),
first_ones AS (SELECT s, min(place) AS least_place FROM strings GROUP BY s),
hits AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM strings JOIN first_ones USING (s) WHERE least_place < place),
runs AS (
  SELECT r, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hits)
  GROUP BY r, run),
heads AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS upto FROM runs),
parts AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(h, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) AS kept
  FROM heads JOIN docs USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN parts USING (r)
"""

_PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
spans AS (
  SELECT lang, size, unnest(list_transform(range(1, greatest(len(w) - size, -1) + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, range(1, 4) AS sizes(size)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
found AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND f >= 10),
inside AS (
  SELECT lang, phrase, max(over_a) AS over_a
  FROM (SELECT lang, a AS over_a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM found WHERE size = 3)
  GROUP BY ALL),
kept AS (
  SELECT found.* FROM found LEFT JOIN inside USING (lang, phrase) WHERE 100 * coalesce(over_a, 0) < 50 * a),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS front, array_to_string(w[k + 1:size], ' ') AS back
  FROM kept, range(1, 3) AS ks(k) WHERE k < size),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r,
    ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = front JOIN counts y ON y.lang = cuts.lang AND y.phrase = back),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM lowest)
SELECT lang, place::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE place <= 2000
"""

_URL_SQL = rf"""
WITH rules(rule_host, rule_path, said) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fitting AS (
  SELECT *, (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) AS fits
  FROM (SELECT DISTINCT host, path FROM parts), rules),
best AS (
  SELECT host, path,
    arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) FILTER (WHERE fits) AS "rule",
    arg_max(said, length(rule_host) + length(rule_path)) FILTER (WHERE fits) AS said
  FROM fitting GROUP BY host, path)
SELECT page_id, parts.host, parts.path, "rule", coalesce(said, 'allow') AS verdict
FROM parts JOIN best ON parts.host = best.host AND parts.path = best.path
"""

QUERIES: dict[str, Build] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_counts": op2_token_counts,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_url_filters": op9_url_filters,
    "op10_quality_rules": op10_quality_rules,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_repeat_removal": op12_repeat_removal,
    "op13_phrase_collocation": op13_phrase_collocation,
}

ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_decontamination": _CONTAINED_SQL,
    "op9_url_filters": _URL_SQL,
    "op12_repeat_removal": _REPEAT_SQL,
    "op13_phrase_collocation": _PHRASE_SQL,
}
