"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import ann, bpe, chat_format, cover_tree, html_extract, lang_id, line_dedup, lm_score, mixing, ngram_join
from wardline.llm.common import table
from wardline.sources.tables import spread


def _over(name: str, apply: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: apply(table(spark, sf_dir, name))


def _spread(apply: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """For operators whose work is one pass of Python over rows as they are scanned."""
    return lambda rows: apply(spread(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": _over("documents", bpe.op1),
        "op2_line_dedup": _over("documents", line_dedup.op2),
        "op3_chat": _over("conversations", chat_format.op3),
        "op4_main_text": _over("pages", _spread(html_extract.op4)),
        "op5_ngram_join": _over("documents", ngram_join.op5),
        "op6_language": _over("documents", _spread(lang_id.op6)),
        "op7_lm_score": _over("documents", lm_score.op7),
        "op8_hilbert": _over("embeddings", ann.op8),
        "op9_cover_tree": _over("embeddings", cover_tree.op9),
        "op10_mixing": _over("documents", mixing.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op7_lm_score": lm_score.ORACLE, "op9_cover_tree": cover_tree.ORACLE}
