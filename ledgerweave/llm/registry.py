"""Queries of this subpackage by name, each over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.llm import license_scan as licenses, mixing
from ledgerweave.llm.decontaminate import contaminated
from ledgerweave.llm.line_dedup import line_dedup
from ledgerweave.llm.pitman_yor import score_texts
from ledgerweave.llm.quality_rules import quality_rules
from ledgerweave.llm.secret_scan import secret_scan
from ledgerweave.llm.simhash_dedup import simhash_components
from ledgerweave.llm.substring_dedup import substring_dedup
from ledgerweave.llm.toxicity import toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"), licenses.known_table(spark))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_read(spark, sf_dir, "documents")).drop("kept_text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op3_license_scan": op3_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op8_mixing": op8_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op2_decontaminate": op2_decontaminate,
}

SQL = {
    "op3_license_scan": licenses.SQL,
    "op8_mixing": mixing.SQL,
    "op4_substring_dedup": r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, unnest(range(1, len(w) - 11)) as k, w from d where len(w) >= 13
), g as (
  select doc_id, k, array_to_string(w[k:k + 12], ' ') as g from s
), m as (
  select doc_id, k, min(doc_id) over (partition by g) as least from g
), r as (
  select distinct doc_id, unnest(range(k, k + 13)) as p from m where least < doc_id
), gone as (
  select doc_id, list(p) as ps from r group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
       sha256(case when ps is null then array_to_string(w, ' ')
              else array_to_string([x[1] for x in list_zip(w, range(1, len(w) + 1)) if not list_contains(ps, x[2])], ' ') end) as kept_sha256
from d left join gone on gone.doc_id = d.doc_id
""",
}
