"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rotaspark.llm.bpe import op3_bpe
from rotaspark.llm.conversations import OP11_SQL, op11_conversations
from rotaspark.llm.cover_tree import OP9_SQL, op9_cover_tree
from rotaspark.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from rotaspark.llm.html_extract import OP5_SQL, op5_html
from rotaspark.llm.line_dedup import OP6_SQL, op6_line_dedup
from rotaspark.llm.lexical import OP13_SQL, op13_lexical
from rotaspark.llm.near_join import OP2_SQL, op2_ngram_jaccard
from rotaspark.llm.packing import op1_packing
from rotaspark.llm.quality import OP12_SQL, op12_quality
from rotaspark.llm.suffix_dedup import OP4_SQL, op4_suffix_dedup
from rotaspark.llm.toxicity import op10_toxicity
from rotaspark.llm.warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_bpe": op3_bpe,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_html": op5_html,
        "op6_line_dedup": op6_line_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_warc": op8_warc,
        "op9_cover_tree": op9_cover_tree,
        "op10_toxicity": op10_toxicity,
        "op11_conversations": op11_conversations,
        "op12_quality": op12_quality,
        "op13_lexical": op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op4_suffix_dedup": OP4_SQL, "op5_html": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_warc": OP8_SQL, "op9_cover_tree": OP9_SQL, "op11_conversations": OP11_SQL, "op12_quality": OP12_SQL, "op13_lexical": OP13_SQL}
