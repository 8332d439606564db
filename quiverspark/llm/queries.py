"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quiverspark.llm import ann, langid, licenses, near_dup, packing, pii, quality, spm, token_store, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": token_store.op1_token_store,
        "op2_near_dup": near_dup.op2_near_dup,
        "op3_pii": pii.op3_pii,
        "op4_sentencepiece": spm.op4_sentencepiece,
        "op5_langid": langid.op5_langid,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_licenses": licenses.op7_licenses,
        "op8_packing": packing.op8_packing,
        "op9_ann": ann.op9_ann,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_licenses": licenses.OP7_SQL}
