"""The queries of this subpackage by name; oracle_sql() has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.op01_pii import op1_pii
from millrace.llm.op02_mixing import op2_mixing
from millrace.llm.op03_quality import op3_quality
from millrace.llm.op04_html import op4_html
from millrace.llm.op05_tokens import op5_tokens
from millrace.llm.op06_neardup import op6_neardup
from millrace.llm.op07_jaccard import op7_jaccard
from millrace.llm.op08_ann import op8_ann
from millrace.llm.op09_bpe import op9_bpe
from millrace.llm.op10_language import op10_language
from millrace.llm.op11_collocation import SQL as OP11_SQL
from millrace.llm.op11_collocation import op11_collocation
from millrace.llm.op12_toxicity import op12_toxicity
from millrace.llm.op13_audit import SQL as OP13_SQL
from millrace.llm.op13_audit import op13_audit


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii, op2_mixing, op3_quality, op4_html, op5_tokens, op6_neardup, op7_jaccard, op8_ann, op9_bpe, op10_language, op11_collocation, op12_toxicity, op13_audit, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_collocation": OP11_SQL, "op13_audit": OP13_SQL}
