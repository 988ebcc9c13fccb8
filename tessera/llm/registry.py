"""Queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from tessera.llm import chat, conversation_repair, lexical_search, line_dedup, mixing, ngram_jaccard, sharding, substring_dedup, warc
from tessera.llm.ann import op4_ann
from tessera.llm.decontamination import op3_decontaminate
from tessera.llm.pii import op10_pii
from tessera.llm.toxicity import op7_toxicity

QUERIES = {"op1_mix_sources": mixing.op1_mix_sources, "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard, "op3_decontaminate": op3_decontaminate, "op4_ann": op4_ann, "op5_chat_format": chat.op5_chat_format, "op6_line_dedup": line_dedup.op6_line_dedup, "op7_toxicity": op7_toxicity, "op8_shard_documents": sharding.op8_shard_documents, "op9_warc": warc.op9_warc, "op10_pii": op10_pii, "op11_lexical_search": lexical_search.op11_lexical_search, "op12_substring_dedup": substring_dedup.op12_substring_dedup, "op13_conversation_repair": conversation_repair.op13_conversation_repair}
ORACLES: dict[str, str] = {"op1_mix_sources": mixing.ORACLE, "op2_ngram_jaccard": ngram_jaccard.ORACLE, "op5_chat_format": chat.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op8_shard_documents": sharding.ORACLE, "op9_warc": warc.ORACLE, "op11_lexical_search": lexical_search.ORACLE, "op12_substring_dedup": substring_dedup.ORACLE, "op13_conversation_repair": conversation_repair.ORACLE}
