"""From documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; ``run`` writes it to the
shared folder and reads it again as the next stage's ``docs``. All stages but the last return
the columns they were given. Rows are judged by id and text: rows without an id, and rows that
share an id but not the text, go by a number made from both, beyond the range of ids. Empty
tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import cube_mix, simhash_decontam, tensor_minhash, token_store, toxicity
from factloom.llm.merkle_manifest import positions
from factloom.llm.shared import scratch, ship, table, written

KEY, REV, NTH = "__pipeline_key", "__pipeline_rev", "__pipeline_nth"
SCORE, COPIES, ROW, SHARED = "__pipeline_score", "__pipeline_copies", "__pipeline_row", "__pipeline_shared"
TOKENIZER = "byte_bpe_50k.json"
WORD = r"[\p{L}\p{Nl}\p{No}]"  # what a word of the classifier has
INK = r"[^\x20\x09-\x0D]"  # what a word of a shingle has


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each id and text: the id, where no other text has it.

    Else, and without an id, a number from 2^62 on, made from both.
    """
    made = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), "text"), 2).bitwiseOR(F.lit(1 << 62))
    text_of = F.xxhash64(F.coalesce("text", F.lit("")))
    shared = docs.select(F.col("doc_id").cast("long").alias(SHARED), text_of.alias("text")).groupBy(SHARED).agg(
        F.min("text").alias("low"), F.max("text").alias("high")).filter(F.col(SHARED).isNotNull() & (F.col("low") != F.col("high")))
    shared = written(shared.select(SHARED), scratch(docs.sparkSession, "pipeline-shared-ids"))
    own = F.coalesce(F.col("doc_id").cast("long"), made)
    if not shared.limit(1).count():
        return docs.withColumn(KEY, own)
    joined = docs.join(shared, F.col("doc_id").cast("long") == F.col(SHARED), "left")
    return joined.withColumn(KEY, F.when(F.col(SHARED).isNull(), own).otherwise(made)).drop(SHARED)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 stay, and those without words.

    All stay where the labels taught it nothing (none, or of one class).
    """
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.crc_held_out())
    if not model.weights:
        return docs
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return toxicity.score(docs, model, keep=docs.columns, name=SCORE).filter(
        wordless | (F.col(SCORE) < 0.5)).drop(SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; all texts without words stay.

    Of rows that repeat id and text one stays, the smallest by the other columns.
    """
    ship(spark)
    keyed = _keyed(docs)
    worded = F.coalesce(F.col("text").rlike(INK), F.lit(False))
    found = tensor_minhash.duplicates(keyed.filter(worded).select(KEY, "text"), doc_id=KEY)
    kept = found.filter("kept").groupBy(F.col("id").alias(KEY)).agg(F.count(F.lit(1)).alias(NTH))
    kept = written(kept, scratch(spark, "pipeline-kept"))
    once, often = kept.filter(F.col(NTH) == 1), kept.filter(F.col(NTH) > 1)
    stay = keyed.filter(worded).join(once, KEY, "left_semi").select(*docs.columns).unionByName(
        docs.filter(~worded))
    if often.limit(1).count():
        row = F.struct("text", *(c for c in docs.columns if c != "text"))
        repeated = keyed.filter(worded).join(often, KEY, "left_semi").groupBy(KEY).agg(F.min(row).alias(ROW))
        stay = stay.unionByName(repeated.select(f"{ROW}.*").select(*docs.columns))
    return stay


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item stay."""
    ship(spark)
    keyed = _keyed(docs)
    found = simhash_decontam.contamination(keyed.select(KEY, "text"), table(spark, sf_dir, "benchmark"), doc_id=KEY)
    tainted = written(found.select(F.col("id").alias(KEY)).distinct(), scratch(spark, "pipeline-tainted"))
    return keyed.join(tainted, KEY, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    ship(spark)
    rev = F.xxhash64(F.xxhash64(F.coalesce("text", F.lit(""))), F.col("source"))
    keyed = _keyed(docs).withColumn(REV, rev)
    mixed = cube_mix.mix(keyed.select(KEY, "text", "source"), doc_id=KEY)
    copies = mixed.select(F.col("id").alias(KEY), F.xxhash64("rev", "source").alias(REV),
                          F.col("nth").alias(NTH), F.col("copies").alias(COPIES))
    copies = written(copies, scratch(spark, "pipeline-copies"))
    # rows repeated as they are get numbers of their own, by ranges of their order
    several = copies.filter(F.col(NTH) == 2).select(KEY, REV).distinct()
    if several.limit(1).count():
        several = written(several, scratch(spark, "pipeline-several"))
        rows = keyed.join(several, [KEY, REV], "left_semi").select(KEY, REV, F.struct(*docs.columns).alias(ROW))
        repeated = positions(rows, [KEY, REV], [ROW], "pipeline-rows")
        numbered = keyed.join(several, [KEY, REV], "left_anti").withColumn(NTH, F.lit(1).cast("long")).unionByName(
            repeated.select(f"{ROW}.*", KEY, REV, (F.col("pos") + 1).alias(NTH)))
    else:
        numbered = keyed.withColumn(NTH, F.lit(1).cast("long"))
    taken = numbered.join(copies.filter(F.col(COPIES) > 0), [KEY, REV, NTH])
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), COPIES)).alias(NTH)).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards; per document what reading them back gives."""
    ship(spark)
    folder = token_store.store_folder(spark)
    manifest = token_store.write(docs, folder, public_tokenizers.path(TOKENIZER))
    return token_store.read(manifest, folder, with_ids=False).withColumnRenamed("n_ids", "n_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
    ("token ids", write_tokens),
]

# training a classifier, hashing and tokenising have no SQL: tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), scratch(spark, f"pipeline-stage-{number}"))
    return docs
