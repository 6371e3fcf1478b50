"""A training-data pipeline over ``documents``: each stage's rows are written as Parquet and are the next stage's input.

quality -> near duplicates -> decontamination -> mixing -> token ids. All stages
but the last return the columns of ``documents``. Null ids: a row without an id is
never linked with another, judged by its own text, and kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeassay.llm import decontaminate, jaccard_join, mixing, rule_ensemble, store, token_planes
from lakeassay.llm.queries import tokenizer_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not among ``ids``; every column as it was."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def _free(docs: DataFrame, *names: str) -> list[str]:
    """These names, with as many marks behind as none of the documents' columns has."""
    tail = "_" * (1 + max(map(len, docs.columns), default=0))
    return [n + tail for n in names]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    with _stage(spark):
        judged = rule_ensemble.classify_quality(docs, _read(spark, sf_dir, "labels"))
        return _without(docs, judged.where("predicted = 0").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates; of rows that share that id, the first by their columns."""
    with _stage(spark):
        members, _ = jaccard_join.near_duplicates(docs, every_link=False)
        kept = _without(docs, members.where("component_id <> doc_id").select("doc_id"))
        repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
        if not repeated.limit(1).count():
            return kept
        again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns)
        (place,) = _free(docs, "place")
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"]))
        return _without(kept, repeated).unionByName(again.withColumn(place, first).where(F.col(place) == 1).drop(place))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    with _stage(spark):
        return _without(docs, decontaminate.find_leaks(docs, _read(spark, sf_dir, "benchmark")).select("doc_id"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row a copy, none for a document that it leaves out."""
    with _stage(spark):
        key, mark, copies, rows, place, turn = _free(docs, "key", "mark", "copies", "rows", "place", "turn")
        given = mixing.mix(docs).groupBy(F.col("doc_id").alias(key), F.col("mark").alias(mark)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
        joined = docs.join(given, docs["doc_id"].eqNullSafe(given[key]) & (F.xxhash64(docs["text"]) == given[mark])).where(F.col(copies) > 0)
        # Rows of the same id and text share its copies; the first of them get what does not divide.
        order = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")] or [mark]
        joined = joined.withColumn(place, F.row_number().over(Window.partitionBy(key, mark).orderBy(*order)))
        own = F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(place) <= F.col(copies) % F.col(rows), 1).otherwise(0)
        many = joined.withColumn(turn, own).where(F.col(turn) > 0)
        return many.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(turn)))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the files written."""
    with _stage(spark):
        return token_planes.token_digest(docs, tokenizer_path())


def _stage(spark: SparkSession):
    # A stage's input has been written by now: what earlier stages left in the shared folder can go.
    store.sweep(spark, "pipeline")
    return store.scope("pipeline")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]

#: The classifier, the mixture's rounding and the tokenizer cannot be expressed in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        docs = store.write(out, f"stage-{name}")
