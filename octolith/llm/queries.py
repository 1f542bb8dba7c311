"""The thin queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

import corpus_pipeline
from octolith.llm import bpe, chat, exact_dedup, packing, quality, secrets, sharding, simhash, token_files, warc


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_chat_format": chat.op1_chat_format,
        "op2_balanced_labels": sharding.op2_balanced_labels,
        "op3_bpe_words": bpe.op3_bpe_words,
        "op4_secret_battery": secrets.op4_secret_battery,
        "op5_warc_index": warc.op5_warc_index,
        "op6_token_files": token_files.op6_token_files,
        "op7_pack_pow2": packing.op7_pack_pow2,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_simhash_gray": simhash.op9_simhash_gray,
        "op10_quality_forest": quality.op10_quality_forest,
    }


def oracle_sql():
    return {
        "op1_chat_format": chat.OP1_SQL,
        "op5_warc_index": warc.OP5_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
    }
