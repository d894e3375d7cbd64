"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from skein.llm import bpe, chat, exact_dedup, fill_middle, hard_negatives, langid, licenses, mixing, quality, secrets, simhash, token_counts, warc


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_distribution_divergence": quality.query,
    "op2_markov_secrets": secrets.query,
    "op3_warc_salvage": warc.query,
    "op4_language_mixture": langid.query,
    "op5_license_scan": licenses.query,
    "op6_bpe": bpe.query,
    "op7_chat_snapshots": chat.query,
    "op8_simhash": simhash.query,
    "op9_mixing": mixing.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_token_transducer": token_counts.query,
    "op12_fill_middle": fill_middle.query,
    "op13_hard_negatives": hard_negatives.query,
    "pipeline": pipeline,
}

ORACLES = {
    "op3_warc_salvage": warc.SQL,
    "op7_chat_snapshots": chat.SQL,
    "op9_mixing": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_fill_middle": fill_middle.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
