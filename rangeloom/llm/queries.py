"""The numbered queries over the synthetic tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, lines, mixing, neardup, neighbours, packing, pages, quality, substring, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_read(spark, sf_dir, "documents"), texts=False)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_boilerplate(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(_read(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", "taken")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(_read(spark, sf_dir, "pages"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.annotate(docs, quality.fit(docs, _read(spark, sf_dir, "labels"))).drop("text")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents")).drop("ids")


QUERIES = {
    "op1_substring": op1_substring,
    "op2_lines": op2_lines,
    "op3_mixing": op3_mixing,
    "op10_licenses": op10_licenses,
    "op4_toxicity": op4_toxicity,
    "op5_pages": op5_pages,
    "op6_minhash": op6_minhash,
    "op7_quality": op7_quality,
    "op8_neighbours": op8_neighbours,
    "op9_packing": op9_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_lines": f"""
WITH lines AS ({lines.LINES_SQL.format(docs="documents")}), done AS ({lines.SQL.format(docs="documents")})
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)""",
    "op3_mixing": mixing.SQL.format(docs="documents"),
    "op10_licenses": licenses.SQL,
    "op1_substring": substring.SQL,
    "op6_minhash": neardup.SQL,
}
