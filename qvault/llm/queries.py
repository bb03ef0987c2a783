"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qvault.llm.decontamination import find_contained
from qvault.llm.divergence import audit_sources
from qvault.llm.embedding_dedup import near_duplicate_vectors
from qvault.llm.hard_negatives import mine_hard_negatives
from qvault.llm.language_id import identify_languages
from qvault.llm.language_model import score_documents
from qvault.llm.line_dedup import dedup_lines
from qvault.llm.mixing import label_domains, mix
from qvault.llm.quality_rules import apply_quality_rules
from qvault.llm.simhash import near_duplicates
from qvault.llm.token_planes import tokenize_to_files
from qvault.llm.toxicity import score_toxicity
from qvault.llm.warc import read_warc, record_table, records, write_warc
from qvault.storage import load, new_path

#: The public tokenizer that op7 and the pipeline write with; its file is a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register




def fold(doc_id, n: int):
    """crc32 of the id as text, modulo ``n``; a null id is in fold 0 of no test."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op1_line_dedup",
    f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, {LOWER.format(f"trim(line, {BLANKS})")} AS k FROM lines
), dup AS (
  SELECT k, min(doc_id) AS keep_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)
), flagged AS (
  SELECT doc_id, pos, line, dup.k IS NOT NULL AND doc_id <> keep_doc AS gone FROM keyed LEFT JOIN dup ON keyed.k = dup.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
""",
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(load(spark, sf_dir, "documents"), min_chars=10, min_docs=2)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op6_decontamination",
    f"""
WITH w AS (
  SELECT item_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)
), q AS (SELECT item_id, count(*) AS q FROM i GROUP BY item_id),
dw AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), d AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
)
SELECT doc_id, item_id, any_value(q) AS n_item_shingles, count(*) AS n_shared, count(*) / any_value(q) AS containment
FROM d JOIN i USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(q) - 1e-9
""",
)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), shingle=3)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op7_token_planes")
def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_to_files(load(spark, sf_dir, "documents"), tokenizer=tokenizer_path(), end_id=1)


@query("op5_warc")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_warc(record_table(load(spark, sf_dir, "pages"), min_revisit_bytes=0), folder)
    return records(read_warc(spark, folder, payload=False))


@query("op2_language_model")
def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(load(spark, sf_dir, "documents"), held_out=fold(F.col("doc_id"), 7) == 2)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = score_toxicity(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"), learn=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify_languages(docs, learn=~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: The shares of tokens that op8 and the pipeline mix to.
TARGETS = {"good": 0.95, "low": 0.05}


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(load(spark, sf_dir, "documents"), label_domains(load(spark, sf_dir, "labels")), TARGETS)
    return mixed.select("doc_id", "n_tokens", *[F.col("p")[d].alias(f"p_{d}") for d in TARGETS], "rate", "copies")


@query(
    "op11_source_divergence",
    f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY t.lang, t.source, t.term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
p AS (
  SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (s.total + 5 * l.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (kept.n + 5) // (l.total + 5 * l.v) AS q
  FROM s JOIN kept ON s.lang = kept.lang JOIN l ON l.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term
), f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts) WHERE part = 'pair' OR rank <= 50
""",
)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(load(spark, sf_dir, "documents"), min_docs=30, top=50)


@query(
    "op12_hard_negatives",
    """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 10
""",
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    relabelled = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(relabelled, anchors=F.col("vec_id") % 100 == 0)


@query(
    "op13_embedding_dedup",
    """
WITH RECURSIVE u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), r AS (
  SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached
), c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c USING (vec_id)
""",
)
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(load(spark, sf_dir, "embeddings"), threshold=0.98)
