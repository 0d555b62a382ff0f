"""A thin query for each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import automaton
from tidemark.llm.bpe import round_trip
from tidemark.llm.crosspolytope import near_vectors
from tidemark.llm.html import extract_text
from tidemark.llm.kmtree import nearest
from tidemark.llm.lexical import rank_documents
from tidemark.llm.lines import drop_shared_lines
from tidemark.llm.lm import score_documents
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix_sources, taken_words
from tidemark.llm.negatives import mine_negatives
from tidemark.llm.quality import score_quality
from tidemark.llm.secrets import scan_secrets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """All documents scored for quality."""
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20, by inner product."""
    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op3_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of near-duplicate documents on shingles of four words."""
    return near_duplicates(table(spark, sf, "documents"), width=4)


@query
def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates for secrets in all documents, and which of them are secrets."""
    return scan_secrets(table(spark, sf, "documents"))


@query
def op5_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(table(spark, sf, "pages"))


@query
def op6_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All documents mixed to the sources' target weights: words taken of each."""
    return taken_words(mix_sources(table(spark, sf, "documents")))


@query
def op7_lm_scoring_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    """All documents scored by stupid backoff on triples, pairs and words: the production order."""
    scored = score_documents(table(spark, sf, "documents"), order=3)
    return scored.select(
        "doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log", 6).alias("mean_log")
    )


@query
def op7_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """All documents scored by stupid backoff on pairs and words, as its SQL fixes it."""
    scored = score_documents(table(spark, sf, "documents"))
    return scored.select(
        "doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log", 6).alias("mean_log")
    )


@query
def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """All texts encoded with the byte-level BPE of 50,257 tokens, and decoded."""
    import public_tokenizers

    return round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that three documents or more share, dropped from all but the last of them."""
    kept = drop_shared_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op10_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of vectors with a cosine of 0.95 or more."""
    return near_vectors(table(spark, sf, "embeddings"))


@query
def op11_automaton_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """All texts encoded by the byte-level BPE's ranks, and decoded."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return automaton.round_trip(table(spark, sf, "documents"), path, pattern)


@query
def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=20)


@query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives for each positive of each vector whose id is divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), each AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM lines
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper != doc_id AS dropped FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE["op6_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS src
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE src % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * s AS cap FROM totals
), levelled AS (
  SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(cap) OVER ahead, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER ahead, 0)) AS level,
    row_number() OVER (ORDER BY s / w, src) AS nth
  FROM weighed WINDOW ahead AS (ORDER BY s / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first AS (
  SELECT arg_min(level, nth) AS level, min(nth) AS nth FROM levelled WHERE cap >= level * w
), targets AS (
  SELECT source, src, s, CASE WHEN l.nth < f.nth THEN cap ELSE f.level * w END AS target FROM levelled l, first f
), plan AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal, (s + 1023) // 1024 AS blocks FROM targets
), split AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE goal // s END AS whole,
    CASE WHEN s = 0 THEN 0 ELSE goal % s END AS rest FROM plan
), placed AS (
  SELECT d.*, src, s, target, blocks, whole, rest, coalesce(sum(size) OVER (
    PARTITION BY src ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM sized d JOIN split p ON d.source IS NOT DISTINCT FROM p.source
), pieces AS (
  SELECT *, unnest(range(off // 1024, (off + size - 1) // 1024 + 1)) AS block FROM placed WHERE size > 0
), mapped AS (
  SELECT *, CASE WHEN block = blocks - 1 THEN block
    ELSE (block * (CASE WHEN (blocks - 1) % 1000003 != 0 THEN 1000003 ELSE 1000033 END) + 7919 * (src + 1)) % (blocks - 1) END AS nth,
    greatest(off, block * 1024) AS a, least(off + size, (block + 1) * 1024) AS z
  FROM pieces
), words AS (
  SELECT src, off, sum(whole * (z - a) + CASE WHEN nth < rest // 1024 THEN z - a
    WHEN nth = rest // 1024 THEN greatest(0, least(z - a, rest % 1024 - (a - block * 1024))) ELSE 0 END) AS taken
  FROM mapped GROUP BY src, off
)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE coalesce(taken, 0) END::BIGINT AS taken
FROM placed LEFT JOIN words ON placed.src = words.src AND placed.off = words.off AND placed.size > 0
"""

ORACLE["op7_lm_scoring"] = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT r, unnest(list_concat([''], w[:-2])) AS a, unnest(w) AS b FROM split WHERE len(w) > 0
), singles AS (SELECT b AS w, count(*) AS n FROM words GROUP BY b
), known AS (SELECT w, n FROM singles UNION ALL SELECT '', count(*) FROM split WHERE len(w) > 0
), pairs AS (SELECT a, b, count(*) AS n FROM words GROUP BY a, b
), valued AS (
  SELECT p.a, p.b, CASE WHEN p.n >= 2 THEN ln(p.n) - ln(x.n)
    ELSE ln(0.4) + ln(y.n) - ln((SELECT sum(n) FROM singles)) END AS v
  FROM pairs p JOIN known x ON p.a = x.w JOIN known y ON p.b = y.w
), summed AS (SELECT r, sum(v) AS s FROM words JOIN valued USING (a, b) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0.0), 4) AS log_score,
  round(CASE WHEN len(w) > 0 THEN s / len(w) ELSE 0.0 END, 6) AS mean_log
FROM split LEFT JOIN summed USING (r)
"""

ORACLE["op7_lm_scoring_trigrams"] = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), marked AS (
  SELECT r, unnest(range(0, len(w) + 1)) AS i, unnest(list_concat([''], w)) AS c FROM split WHERE len(w) > 0
), words AS (
  SELECT r, c, lag(c, 1) OVER inside AS b, lag(c, 2) OVER inside AS a FROM marked
  WINDOW inside AS (PARTITION BY r ORDER BY i)
), one AS (SELECT c, count(*) AS n FROM words GROUP BY c
), two AS (SELECT b, c, count(*) AS n FROM words WHERE b IS NOT NULL GROUP BY b, c
), three AS (SELECT a, b, c, count(*) AS n FROM words WHERE a IS NOT NULL GROUP BY a, b, c
), valued AS (
  SELECT r, CASE WHEN z.n >= 2 THEN ln(z.n) - ln(p.n)
    ELSE CASE WHEN a IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN y.n >= 2 THEN ln(y.n) - ln(q.n)
      ELSE ln(0.4) + ln(x.n) - ln((SELECT sum(n) FROM one WHERE c != '')) END END AS v
  FROM words JOIN one x USING (c) JOIN two y USING (b, c) JOIN one q ON q.c = words.b
  LEFT JOIN three z USING (a, b, c) LEFT JOIN two p ON p.b = words.a AND p.c = words.b
), summed AS (SELECT r, sum(v) AS s FROM valued GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0.0), 4) AS log_score,
  round(CASE WHEN len(w) > 0 THEN s / len(w) ELSE 0.0 END, 6) AS mean_log
FROM split LEFT JOIN summed USING (r)
"""

ORACLE["op12_lexical_search"] = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (SELECT doc_id, r, w, CAST(len(w) AS BIGINT) AS n FROM split WHERE len(w) > 0
), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs
), bags AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) GROUP BY r, t
), weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT t, count(*) AS df FROM bags GROUP BY t), totals
), asked AS (
  SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t
), factors AS (SELECT doc_id, r, 75 + (25 * n * docs) // terms AS m FROM docs, totals
), scored AS (
  SELECT item_id, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN bags USING (t) JOIN weights USING (t) JOIN factors USING (r) GROUP BY item_id, doc_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

ORACLE["op13_hard_negatives"] = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id
), positives AS (
  SELECT anchor_id, other, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.other AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
  n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
