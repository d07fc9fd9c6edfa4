"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelens.llm import ann, binslack, bitplanes, chat, html, langid, merkle, mixing, neardup, packing, pii, quality, rules
from pagelens.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "documents"))


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extracted(table(spark, folder, "pages"))


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.conversation_calls(table(spark, folder, "conversations"))


def op7_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest_vectors(table(spark, folder, "embeddings"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(table(spark, folder, "documents"))


def op9_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_report(table(spark, folder, "documents"))


def op10_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_report(table(spark, folder, "documents"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest_report(table(spark, folder, "documents"))


def op12_binslack(spark: SparkSession, folder: str) -> DataFrame:
    return binslack.best_fit(table(spark, folder, "documents"))


def op13_bitplanes(spark: SparkSession, folder: str) -> DataFrame:
    return bitplanes.cluster_report(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_packing, op2_quality, op3_pii, op4_simhash, op5_html, op6_chat, op7_ann, op8_mixing, op9_rules, op10_langid,
        op11_merkle, op12_binslack, op13_bitplanes)
}

ORACLES: dict[str, str] = {
    "op6_chat": chat.ORACLE, "op8_mixing": mixing.ORACLE, "op9_rules": rules.oracle(),
    "op11_merkle": merkle.ORACLE, "op13_bitplanes": bitplanes.oracle()}
