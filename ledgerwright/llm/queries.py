"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerwright.llm import collocations, conversations, decontaminate, embeddings, jaccard, language, lines, mixing, neighbours, personal_data, secret_scan, suffixes, warc


def queries() -> dict:
    return {
        "op1_language_id": language.op1_language_id,
        "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
        "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_personal_data": personal_data.op6_personal_data,
        "op7_warc": warc.op7_warc,
        "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
        "op9_suffix_array_dedup": suffixes.op9_suffix_array_dedup,
        "op10_source_mixing": mixing.op10_source_mixing,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_collocations": collocations.op12_collocations,
        "op13_embedding_near_dedup": embeddings.op13_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc": warc.OP7_SQL,
        "op8_benchmark_decontamination": decontaminate.OP8_SQL,
        "op10_source_mixing": mixing.mixing_sql(),
        "op11_conversation_repair": conversations.OP11_SQL,
        "op12_collocations": collocations.OP12_SQL,
        "op13_embedding_near_dedup": embeddings.OP13_SQL,
    }
