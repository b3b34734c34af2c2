"""The registered queries of this subpackage: name -> callable(spark, sf_dir), and oracle SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from quillrank.llm import (bfd_packing, digests, licences, near_copies, oracle, pieces, pow2_packing, prefix_trie, quality,
                           quotes, surrogates, toxicity, turn_repair, url_templates)

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_quote_links": quotes.op2,
    "op3_byte_digests": digests.op3,
    "op4_near_copies": near_copies.op4,
    "op5_toxicity": toxicity.op5,
    "op6_pieces": pieces.op6,
    "op7_surrogates": surrogates.op7,
    "op8_pow2_packing": pow2_packing.op8,
    "op9_bfd_packing": bfd_packing.op9,
    "op10_licences": licences.op10,
    "op11_turn_repair": turn_repair.op11,
    "op12_url_templates": url_templates.op12,
    "op13_prefix_trie": prefix_trie.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_quality_rules": oracle.OP1,
}
