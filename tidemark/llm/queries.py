"""Registered queries of the ten operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bands, dialogue, fingerprints, forest, importance, language, mixing, packing, quality, secrets, statements, suffixes, superkmers, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function name."""
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_minhash_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return fingerprints.edit_report(docs, classes=bands.near_classes(docs))


@query
def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, folder), width=100)


@query
def op3_linked_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.spans(documents(spark, folder)))


@query
def op4_subset_sum_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder), weights=(3, 1, 2), share=1.5, limit=2)


@query
def op5_risk_controlled_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder), labels(spark, folder), risk=0.02, error=0.05)


def quality_sql(risk: float = 0.02, error: float = 0.05) -> str:
    ratio = {r: f"CASE WHEN {d} > 0 THEN {n} / {d} ELSE 0.0 END" for r, (n, d, _) in quality.RULES.items()}
    tried = " UNION ALL ".join(
        f"SELECT stratum, '{rule}' AS rule, {step} AS step, CAST({cut} AS DOUBLE) AS cut, count(*) AS n, count(*) FILTER (WHERE {ratio[rule]} > {cut}) AS x FROM good GROUP BY stratum"
        for rule, (_, _, cuts) in quality.RULES.items()
        for step, cut in enumerate(cuts)
    )
    p = risk / len(quality.RULES)
    failed = ", ".join(f"CASE WHEN {ratio[rule]} > (SELECT cut FROM cutoffs c WHERE c.stratum = m.stratum AND c.rule = '{rule}') THEN '{rule}' END" for rule in quality.RULES)
    return f"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
repeated AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM repeated GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM words d LEFT JOIN covered c USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
good AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tried AS ({tried}),
proven AS (
  SELECT stratum, rule, step, cut,
    CASE WHEN x >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, x + 1),
      lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p})))) END
    <= {error} / ((SELECT count(DISTINCT stratum) FROM good) * {len(quality.RULES)}) AS ok
  FROM tried),
passed AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY step) AS so_far FROM proven),
cutoffs AS (SELECT stratum, rule, min(cut) AS cut FROM passed WHERE so_far GROUP BY stratum, rule),
judged AS (SELECT *, array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM judged"""


ORACLES["op5_risk_controlled_quality"] = quality_sql()


@query
def op6_language_bitmasks(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    test = language.held_out(F.col("doc_id"))
    model = language.fit(docs, training=~test)
    return language.predict(docs, model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op7_lsh_forest_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(documents(spark, folder))


@query
def op8_karmarkar_karp_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), tokenizer_path(), capacity=1024, end_id=0)


@query
def op9_super_kmer_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return superkmers.remove_repeats(documents(spark, folder), width=35)


@query
def op10_toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    field = toxicity.fit(docs, labels(spark, folder), training=~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, field)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


@query
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return importance.resample(documents(spark, folder), benchmark, percent=10, least_words=20, longest=1, buckets=10_000, seed=2024)


ORACLES["op11_importance_resampling"] = statements.RESAMPLED


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = dialogue.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    return dialogue.repair(rows, gone=F.col("gone"))


ORACLES["op12_conversation_repair"] = statements.REPAIRED


@query
def op13_spherical_cells(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), cosine=0.98)


ORACLES["op13_spherical_cells"] = statements.LINKED


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
