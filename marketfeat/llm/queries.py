"""Queries of this folder by name, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketfeat.llm.bpe import op11_byte_bpe
from marketfeat.llm.chat import OP1_SQL, op1_typed_chat
from marketfeat.llm.chunks import op3_gear_chunks
from marketfeat.llm.embeddings import op9_p_stable
from marketfeat.llm.languages import op4_marginal_unigrams
from marketfeat.llm.lines import op10_log_templates
from marketfeat.llm.mixing import op5_entropy_mixing
from marketfeat.llm.packing import op7_bin_completion
from marketfeat.llm.phrases import OP13_SQL, op13_phrase_collocations
from marketfeat.llm.simhash import op6_simhash_multi_index
from marketfeat.llm.substrings import OP8_SQL, op8_recompression
from marketfeat.llm.toxicity import op2_deobfuscated_toxicity
from marketfeat.llm.whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_typed_chat, op2_deobfuscated_toxicity, op3_gear_chunks, op4_marginal_unigrams, op5_entropy_mixing,
        op6_simhash_multi_index, op7_bin_completion, op8_recompression, op9_p_stable, op10_log_templates,
        op11_byte_bpe, op12_embedding_whitening, op13_phrase_collocations,
    )
}

ORACLE: dict[str, str] = {"op1_typed_chat": OP1_SQL, "op8_recompression": OP8_SQL, "op13_phrase_collocations": OP13_SQL}
