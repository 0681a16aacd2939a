"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .decontamination import contaminated
from .divergence import source_divergence
from .embeddings import near_vectors
from .html import extracted
from .html import fit as fit_field
from .mixing import mix
from .packing import packed_documents
from .pitman_yor import language_model_scores
from .sharding import shard_documents
from .simhash import simhash_components
from .spelling import spelling_variants
from .tables import table
from .tokens import read_digests, write_tokens
from .toxicity import fit, toxicity
from .urls import judge_urls

# The contract's tokenizer and end id.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
PACKING_TOKENIZER = "word_bpe_49k.json"
PACKING_END_ID = 0


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh output folder on the shared storage."""
    return f"{shared_folder(spark)}/lanecast/{name}-{uuid.uuid4().hex}"


def fold(remainder: int):
    """Whether a document's fold, crc32 of its id as text modulo 5, is ``remainder``.

    A null id is in no fold.
    """
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return F.coalesce(own == remainder, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~fold(0))
    score = toxicity(F.col("text"), model, spark)
    return docs.select("doc_id", fold(0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    text = extracted(F.col("html"), fit_field(pages), spark)
    found = pages.select("page_id", "url", text.alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, read back from the written files."""
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    write_tokens(docs, folder, public_tokenizers.path(TOKENIZER), END_ID)
    return read_digests(spark, folder)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) where the document holds a passage like the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mix(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; equal texts are neighbours."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores of every document, learned from those outside fold 1."""
    return language_model_scores(table(spark, sf_dir, "documents"), ~fold(1))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the more frequent word that it is a variant of."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path(PACKING_TOKENIZER)
    return packed_documents(docs, path, PACKING_END_ID).drop("row")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source's words differ from other sources' and from its language's."""
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html_extraction": op2_html_extraction,
    "op3_token_output": op3_token_output,
    "op4_decontamination": op4_decontamination,
    "op5_mix_sources": op5_mix_sources,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_sharding": op8_sharding,
    "op9_url_filter": op9_url_filter,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_source_divergence": op13_source_divergence,
}

_OP11 = """
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), bytes AS (
  SELECT *, hex(encode(doc_id || ':' || run)) AS h FROM runs
), steps AS (
  -- A byte is added, then eight bits are divided off (steps of -1).
  SELECT doc_id, run, n, flatten(list_transform(range(1, length(h), 2),
    lambda k: [('0x' || substr(h, k, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS s
  FROM bytes
), sums AS (
  SELECT run, n, xor(list_reduce(s, lambda c, b:
    CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT),
    4294967295::BIGINT) AS crc
  FROM steps
), thinned AS (
  SELECT n, CASE WHEN crc % 31 = 0 THEN
      substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2)
    ELSE run END AS word
  FROM sums
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), shorter AS (
  SELECT DISTINCT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT word, rest FROM shorter WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM shorter WHERE rest IN (SELECT word FROM words)
), ranked AS (
  SELECT e.word, e.other, o.n AS other_n, count(*) OVER (PARTITION BY e.word) AS n_near,
         row_number() OVER (PARTITION BY e.word ORDER BY o.n DESC, e.other) AS place
  FROM near e JOIN words o ON o.word = e.other
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form,
         CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chains AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""

_OP13 = """
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), hits AS (
  SELECT lang, source, doc, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS everywhere FROM hits
  GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), langs AS (
  SELECT g.lang, coalesce(k.v, 0) AS v, coalesce(k.n, 0) AS n
  FROM (SELECT DISTINCT lang FROM groups) g
  LEFT JOIN (SELECT lang, count(*) AS v, sum(everywhere) AS n FROM kept GROUP BY lang) k USING (lang)
), counts AS (
  SELECT h.lang, h.source, h.term, count(*) AS c FROM hits h JOIN kept k USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n
  FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), dense AS (
  SELECT t.lang, t.source, k.term, coalesce(c.c, 0) AS c,
         (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (t.n + 2 * l.v))::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (k.everywhere + 2) // (l.n + 2 * l.v))::HUGEINT AS whole
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), differences AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN differences d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - whole) * (p - whole) // (p + whole))::BIGINT
  FROM dense WHERE c > 0 AND p > whole
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# DuckDB statements for the queries that SQL can express.
SQL: dict[str, str] = {"op11_spelling_variants": _OP11, "op13_source_divergence": _OP13}
