"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewright.llm.byte_bpe import op10_byte_bpe
from cuewright.llm.conversation_repair import op11_conversation_repair
from cuewright.llm.decontaminate import op3_decontaminate
from cuewright.llm.license_scan import op13_license_scan
from cuewright.llm.lm_score import op9_lm_score
from cuewright.llm.multi_index import op5_multi_index
from cuewright.llm.ngram_jaccard import op4_ngram_jaccard
from cuewright.llm.secret_scan import op2_secret_scan
from cuewright.llm.sharding import op6_jump_shards
from cuewright.llm.token_files import op1_token_ids
from cuewright.llm.token_alignment import op12_token_alignment
from cuewright.llm.toxicity import op7_toxicity
from cuewright.llm.url_lists import OP8_SQL, op8_url_lists


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_ids, op2_secret_scan, op3_decontaminate, op4_ngram_jaccard, op5_multi_index, op6_jump_shards, op7_toxicity, op8_url_lists, op9_lm_score, op10_byte_bpe, op11_conversation_repair, op12_token_alignment, op13_license_scan]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_lists": OP8_SQL}
