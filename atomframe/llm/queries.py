"""The operators' queries over the driver's tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

from . import (
    alignment, embeddings, fingerprints, lexical, mixing, near_dups, packing, quality, sharding, token_files, topk, toxicity, warc,
)

QUERIES = {
    "op1_mixture_draws": mixing.op1_mixture_draws,
    "op2_quality_discriminant": quality.op2_quality_discriminant,
    "op3_toxicity_trees": toxicity.op3_toxicity_trees,
    "op4_stratified_shards": sharding.op4_stratified_shards,
    "op5_length_buckets": packing.op5_length_buckets,
    "op6_lattice_neighbours": embeddings.op6_lattice_neighbours,
    "op7_imatch_fingerprints": fingerprints.op7_imatch_fingerprints,
    "op8_bayes_minhash": near_dups.op8_bayes_minhash,
    "op9_warc_members": warc.op9_warc_members,
    "op10_token_files": token_files.op10_token_files,
    "op11_pointer_jumping": alignment.op11_pointer_jumping,
    "op12_norm_buckets": lexical.op12_norm_buckets,
    "op13_sorted_lists": topk.op13_sorted_lists,
}
ORACLES = {
    "op1_mixture_draws": mixing.SQL,
    "op4_stratified_shards": sharding.SQL,
    "op6_lattice_neighbours": embeddings.SQL,
    "op8_bayes_minhash": near_dups.SQL,
    "op9_warc_members": warc.SQL,
    "op12_norm_buckets": lexical.SQL,
    "op13_sorted_lists": topk.SQL,
}
