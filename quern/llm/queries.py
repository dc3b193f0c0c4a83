"""The thin queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.conversations import op11_conversations
from quern.llm.fingerprints import op9_fingerprints
from quern.llm.jaccard import op5_jaccard
from quern.llm.licenses import op13_licenses
from quern.llm.lines import LineParams, op1_lines
from quern.llm.packing import op7_packing
from quern.llm.pieces import op8_sentencepiece
from quern.llm.pii import op6_pii
from quern.llm.quality import op2_quality
from quern.llm.scoring import SCORING_SQL, op4_scoring
from quern.llm.topk import TOPK_SQL, op3_topk
from quern.llm.toxicity import op10_toxicity
from quern.llm.upsert import op12_upsert


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup with all edits that its similarity allows, as in the pipeline."""
    return op1_lines(spark, sf_dir, LineParams(edits=None))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": all_lines,
    "op2_quality": op2_quality,
    "op3_topk": op3_topk,
    "op4_scoring": op4_scoring,
    "op5_jaccard": op5_jaccard,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_conversations": op11_conversations,
    "op12_upsert": op12_upsert,
    "op13_licenses": op13_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk": TOPK_SQL,
    "op4_scoring": SCORING_SQL,
}
