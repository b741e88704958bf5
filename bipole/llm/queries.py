"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from bipole.llm import decontaminate, jaccard, language, packing, pii, secrets, sharding, substrings, vectors, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_pii": pii.op1_pii,
        "op2_secrets": secrets.op2_secrets,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_warc_salvage": warc.op5_warc_salvage,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_kd_sharding": sharding.op8_kd_sharding,
        "op9_embedding_near_dedup": vectors.op9_embedding_near_dedup,
        "op10_language_id": language.op10_language_id,
        "kd_shards_small": sharding.kd_shards_small,
        "passage_spans": substrings.passage_spans,
        "planted_vectors": vectors.planted_vectors,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": decontaminate.OP4_SQL,
        "op5_warc_salvage": warc.OP5_SQL,
        "op6_jaccard_join": jaccard.OP6_SQL,
        "op8_kd_sharding": sharding.OP8_SQL,
        "op9_embedding_near_dedup": vectors.OP9_SQL,
        "kd_shards_small": sharding.SMALL_SQL,
        "passage_spans": substrings.SPANS_SQL,
        "planted_vectors": vectors.PLANTED_SQL,
    }
