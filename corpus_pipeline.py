"""A training corpus from ``documents``: filter, deduplicate, decontaminate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  Empty inputs give empty outputs;
null texts count as empty; columns beside those of ``documents`` pass through all
stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanecast.llm import queries
from lanecast.llm.decontamination import contaminated
from lanecast.llm.mixing import mix, word_count
from lanecast.llm.simhash import simhash_components
from lanecast.llm.tables import freeze, table
from lanecast.llm.tokens import read_digests, write_tokens
from lanecast.llm.toxicity import fit, toxicity


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` written with a number per row, which null and repeated ids lack; its column."""
    column = f"row_{uuid.uuid4().hex}"
    return freeze(docs.withColumn(column, F.monotonically_increasing_id()), name), column


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below one half.

    The model learns from the labelled rows of ``docs`` outside fold 0; scores don't
    see labels, ids, sources or languages.
    """
    model = fit(docs, table(spark, sf_dir, "labels"), ~queries.fold(0))
    return docs.where(toxicity(F.col("text"), model, spark) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the least id (null ids last)."""
    rows, row = _numbered(docs, "rows")
    found = simhash_components(rows, id_column=row)
    named = rows.select(row, "doc_id").join(found, row)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row")))
    kept = named.groupBy("component_id").agg(first.alias("f")).select(F.col("f.row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, row = _numbered(docs, "rows")
    hits = contaminated(rows, table(spark, sf_dir, "benchmark"), id_column=row)
    hits = freeze(hits.select(F.col("doc_id").alias(row)).distinct(), "hits")
    return rows.join(hits, row, "left_anti").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    copies = mix(docs).where("copies > 0").select("doc_id", "size", "source", "nth", "copies")
    # Helper columns have names of their own, whatever the documents' columns are called.
    mark = uuid.uuid4().hex
    copies = copies.select([F.col(c).alias(f"{c}_{mark}") for c in copies.columns])
    words, number = f"words_{mark}", f"number_{mark}"
    # Rows of equal id, size and source are told apart by their number among each other.
    alike = (
        F.col("doc_id").eqNullSafe(F.col(f"doc_id_{mark}"))
        & (F.col(words) == F.col(f"size_{mark}"))
        & F.col("source").eqNullSafe(F.col(f"source_{mark}"))
        & (F.col(number) == F.col(f"nth_{mark}"))
    )
    window = F.row_number().over(
        Window.partitionBy("doc_id", words, "source").orderBy(F.xxhash64("text"))
    )
    numbered = docs.withColumn(words, word_count(F.col("text")))
    joined = numbered.withColumn(number, window.cast("long")).join(copies, alike)
    repeats = F.explode(F.sequence(F.lit(1), F.col(f"copies_{mark}")))
    return joined.withColumn(f"copy_{mark}", repeats).select([F.col(f"`{c}`") for c in docs.columns])


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token blocks; per document what the files hold."""
    import public_tokenizers

    folder = queries.new_folder(spark, "corpus")
    write_tokens(docs, folder, public_tokenizers.path(queries.TOKENIZER), queries.END_ID)
    return read_digests(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_output", write_ids),
]

# The network of the first stage and the draws of the fourth are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
