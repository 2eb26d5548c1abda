"""The queries opN_<name> over the tables of a folder, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, htmltext, langid, licenses, linededup, media, mixing, neardup, packing, pii
from .common import read_table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(read_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), words=4)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read_table(spark, sf_dir, "documents"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1_media, the columns that SQL can tell."""
    return op1_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4_licenses, the base columns."""
    return op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6_pii, the base columns."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUERIES = {f.__name__: f for f in (op1_media, op2_lines, op3_mixing, op4_licenses, op5_html, op6_pii, op7_ann, op8_packing, op9_neardup, op10_langid, media_payloads, license_places, pii_base)}
ORACLE_SQL = {"op2_lines": linededup.SQL, "op3_mixing": mixing.SQL, "op9_neardup": neardup.SQL, "media_payloads": media.SQL, "license_places": licenses.SQL, "pii_base": pii.SQL}
