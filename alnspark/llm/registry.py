"""The corpus queries and their SQL, for the driver's entry module."""

from __future__ import annotations

import corpus_pipeline
from alnspark.llm import ann, decontaminate, fim, fingerprint_dedup, jaccard_join, line_dedup, mixing, packing, prefix_trie, resharding, suffix_dedup, toxicity, warc
from alnspark.llm.common import table


def _on(name: str, function):
    return lambda spark, sf_dir: function(spark, table(spark, sf_dir, name))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_line_dedup": _on("documents", line_dedup.query),
    "op2_suffix_array": _on("documents", suffix_dedup.query),
    "op3_partenum_join": _on("documents", jaccard_join.query),
    "op4_fingerprint_index": _on("documents", fingerprint_dedup.query),
    "op5_resharding": _on("documents", resharding.query),
    "op6_winnowing": lambda spark, sf_dir: decontaminate.query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op7_warc_revisit": _on("pages", warc.query),
    "op8_pruned_graph": _on("embeddings", ann.query),
    "op9_toxicity": lambda spark, sf_dir: toxicity.query(spark, table(spark, sf_dir, "documents"), sf_dir),
    "op10_best_two_fit": _on("documents", packing.query),
    "op11_sainte_lague": _on("documents", mixing.query),
    "op12_fill_in_middle": _on("documents", fim.query),
    "op13_prefix_trie": _on("conversations", prefix_trie.query),
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL, "op2_suffix_array": suffix_dedup.SQL, "op3_partenum_join": jaccard_join.SQL, "op4_fingerprint_index": fingerprint_dedup.SQL,
    "op6_winnowing": decontaminate.SQL, "op7_warc_revisit": warc.SQL, "op11_sainte_lague": mixing.SQL, "op12_fill_in_middle": fim.SQL, "op13_prefix_trie": prefix_trie.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
