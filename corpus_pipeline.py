"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept. All but the last return the
columns they were given; nulls, empty texts, repeated rows and empty tables have
the results that the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.llm import language_id, minhash, mixing, repeats, sp_bpe
from lithos.llm.common import drop_staged, only_kept, small_batches, staged, table

#: Near-duplicates: words of a shingle, per cent of the union that is shared.
SHINGLE, SIMILAR = 5, 80
#: A document whose best language is less likely than this is rejected, as is one without letters. The best of k
#: languages has 1/k at least, so with three languages or fewer only texts without letters go, and with four few others.
LEAST_LANGUAGE = 0.3
#: No source is passed more than about so many times.
MOST_REPEATS = 1.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and hardly any others (see LEAST_LANGUAGE); fills in a language that is not given."""
    small_batches(spark)
    net = language_id.train(docs)
    found = language_id.label(docs, net, lang_col="_lang", score_col="_score")
    kept = found.where((F.col("_lang") != language_id.UNKNOWN) & (F.col("_score") >= LEAST_LANGUAGE))
    return kept.withColumn("lang", F.coalesce("lang", "_lang")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate component; of rows with one id the first by text."""
    kept = minhash.near_duplicates(docs.where("doc_id is not null"), SHINGLE, SIMILAR).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    once = Window.partitionBy("_kept").orderBy(F.xxhash64("text"))  # by the join's key, so that texts are dealt once
    rows = docs.withColumn("_kept", F.col("doc_id").cast("long")).join(kept, "_kept", "left_semi").withColumn("_row", F.row_number().over(once)).where("_row = 1")
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings that start earlier as well; a document of which only blanks are left goes."""
    out = repeats.without_repeats(docs.withColumn("_had", F.coalesce(F.col("text").rlike("\\S"), F.lit(False))))
    out = out.where(F.col("text").rlike("\\S") | ~F.col("_had"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, none of the largest, by the temperature that meets the repetition limit."""
    return mixing.mix(docs, entropy_share=None, most_repeats=MOST_REPEATS, budget_share=None)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of the ids and of what they decode to."""
    small_batches(spark)
    return sp_bpe.encoded(docs, sp_bpe.default_model())


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeated strings", cut_repeats),
    ("source mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Learned and iterative stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with only_kept(spark) as kept:
            kept.append(staged(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        drop_staged(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
