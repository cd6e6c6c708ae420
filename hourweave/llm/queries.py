"""One query per text operator, over the whole tables, and SQL where it can say the same."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourweave.llm import (
    attention,
    hosts,
    language,
    lines,
    mixing,
    nearest,
    packing,
    phrases,
    pieces,
    quality,
    scratch,
    similar,
    substrings,
    unigrams,
    whitening,
)

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
SUBWORDS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> None:
    """Workers import this package: a cluster gets it by --py-files, a local session from this folder."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, _ROOT]))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(doc_id, n: int):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def op1_language_id(spark, d):
    docs = _read(spark, d, "documents")
    held_out = _remainder(F.col("doc_id"), 4) == 2
    found = language.predict(docs, language.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_substring_dedup(spark, d):
    cut = substrings.remove_repeats(_read(spark, d, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["first"])
    return cut.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark, d):
    found = lines.duplicate_lines(_read(spark, d, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("bigint").alias("n_dropped"), "dropped")


def op4_source_mix(spark, d):
    """Documents by the training position of their first copy (null: not taken; those come last, in no order)."""
    plan = mixing.by_position(mixing.assign(_read(spark, d, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op5_url_filters(spark, d):
    return hosts.judge_urls(_read(spark, d, "pages"))


def op6_quality_rules(spark, d):
    judged = quality.judge(_read(spark, d, "documents"), quality.trusted_sample(_read(spark, d, "labels")))
    return judged.select(F.col("row.doc_id").alias("doc_id"), *[c for c in judged.columns if c != "row"])


def op7_ngram_jaccard(spark, d):
    found = similar.similarity_classes(_read(spark, d, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op8_top_k(spark, d):
    return nearest.top_k(_read(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_sentencepiece(spark, d):
    model = pieces.read_model(TOKENIZER)
    coded = pieces.encode_texts(_read(spark, d, "documents"), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_lm_scoring(spark, d):
    docs = _read(spark, d, "documents")
    held_out = _remainder(F.col("doc_id"), 5) == 1
    ranks = pieces.read_model(SUBWORDS)
    with scratch.short_shuffles(spark):
        cut = attention.coded(docs, ranks, PATTERN, ~held_out)
        counts = attention.counted(cut, ranks, PATTERN)
        chunks = attention.met(cut, counts, spent=True)
        model = attention.fit_met(chunks, counts, ranks, PATTERN)
        base = unigrams.word_scores(docs, ~held_out)
    return attention.score_met(chunks, model).join(base, "key").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        (F.col("logs") - F.col("n_tokens") * F.col("log_norm")).alias("base_score"),
        "score",
    )


def op11_phrase_mining(spark, d):
    return phrases.collocations(_read(spark, d, "documents"))


def op12_whitening(spark, d):
    return whitening.whiten(_read(spark, d, "embeddings"))


def op13_packing(spark, d):
    pieces_of = packing.pack(_read(spark, d, "documents"), pieces.read_model(WORDS).decode())
    return pieces_of.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_url_filters": op5_url_filters,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_top_k": op8_top_k,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_whitening": op12_whitening,
    "op13_packing": op13_packing,
}
SQL: dict[str, str] = {
    "op4_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
listed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM per),
weighed AS (
  SELECT *, place % 3 + 1 AS weight, 3 * source_size AS full_size FROM listed),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            )::DOUBLE
            / (sum(weight) OVER (ORDER BY full_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
chosen AS (
  SELECT level AS water FROM levels WHERE level * weight <= full_size ORDER BY full_size / weight, place LIMIT 1),
targets AS (
  SELECT source, source_size, place, least(full_size::DOUBLE, water * weight) AS target FROM levels, chosen),
streamed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.place, round(t.target)::BIGINT AS quota,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR), s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS started
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
SELECT doc_id, size, source_size, target, place, started / nullif(quota, 0) AS u,
       CASE WHEN source_size = 0 THEN 0
            ELSE (quota // source_size) * size
                 + least(greatest(quota - (quota // source_size) * source_size - started, 0), size) END::BIGINT AS taken
FROM streamed)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE place % 3
  WHEN 0 THEN CASE WHEN u < 0.5 THEN u / 0.5 WHEN u < 5 / 6 THEN 1 + (u - 0.5) * 3 ELSE 2 + (u - 5 / 6) * 6 END
  WHEN 1 THEN u * 3
  ELSE CASE WHEN u < 1 / 6 THEN u * 6 WHEN u < 0.5 THEN 1 + (u - 1 / 6) * 3 ELSE 2 + (u - 0.5) / 0.5 END END / 3, 9) END AS position
FROM mixed
""",
    "op8_top_k": """
WITH usable AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS code
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.code, v.code)::BIGINT AS score
  FROM usable q JOIN usable v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_phrase_mining": r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
spans AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
f AS (
  SELECT lang, k::INTEGER AS k, phrase, count(*)::BIGINT AS f FROM spans GROUP BY ALL HAVING count(*) >= 100),
totals AS (
  SELECT lang, count(*)::BIGINT AS n FROM spans WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, t.n, j, fl.f AS l, fr.f AS r,
         (1000::HUGEINT * c.f * t.n // (fl.f::HUGEINT * fr.f))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN totals t ON t.lang = c.lang
  JOIN f fl ON fl.lang = c.lang AND fl.k = j AND fl.phrase = array_to_string(w[1:j], ' ')
  JOIN f fr ON fr.lang = c.lang AND fr.k = c.k - j AND fr.phrase = array_to_string(w[j + 1:], ' ')),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
dropped AS (
  SELECT DISTINCT s.lang, s.phrase
  FROM f s JOIN f g ON g.lang = s.lang AND s.k > 1 AND g.k > s.k AND g.f >= s.f
   AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b ANTI JOIN dropped d USING (lang, phrase))
WHERE rank <= 2000
""",
}
