"""The registered queries of the training-data operators: thin digests over the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.llm import parts, preference
from textloom.llm.common import table


def op1_suffix_tree(spark, sf_dir):
    from textloom.llm.suffix_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op2_preference_pairs(spark, sf_dir):
    from textloom.llm.preference import preference_pairs, swapped_answers

    pairs = preference_pairs(swapped_answers(table(spark, sf_dir, "conversations")))
    digest = lambda c: F.array_join(F.transform(F.col(c), lambda p: F.concat(p["from"].cast("string"), F.lit("-"), p.to.cast("string"))), ",").alias(c)
    return pairs.select("pair_id", "prompt", "prompt_turns", "chosen", "rejected", digest("chosen_mask"), digest("rejected_mask"))


def op3_token_store(spark, sf_dir):
    from textloom.llm.store import new_store_path, verify_store, write_store

    path = new_store_path(spark)
    write_store(table(spark, sf_dir, "documents"), path)
    return verify_store(spark, path)


def op4_quality_rules(spark, sf_dir):
    from textloom.llm.rules import quality_rules

    judged, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality(spark, sf_dir):
    from textloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_phrase_fingerprints(spark, sf_dir):
    from textloom.llm.phrases import phrase_fingerprints

    return phrase_fingerprints(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    from textloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_toxicity(spark, sf_dir):
    from textloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_words", F.size("passages").alias("n_passages"))


def op9_packing(spark, sf_dir):
    from textloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark, sf_dir):
    from textloom.llm.near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op11_token_alignment(spark, sf_dir):
    from textloom.llm.align import align_tokenizers

    found, _ = align_tokenizers(table(spark, sf_dir, "documents"), keep_groups=False)
    return found.drop("groups")


def op12_periodic_runs(spark, sf_dir):
    from textloom.llm.runs import looped, repeated_runs, run_digests

    return run_digests(repeated_runs(looped(table(spark, sf_dir, "documents"))))


def op13_nearest_vectors(spark, sf_dir):
    from textloom.llm.nearest import nearest_vectors

    return nearest_vectors(table(spark, sf_dir, "embeddings"), every=20, k=20)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_suffix_tree, op2_preference_pairs, op3_token_store, op4_quality_rules, op5_quality, op6_phrase_fingerprints, op7_mixing, op8_toxicity, op9_packing, op10_near_duplicates, op11_token_alignment, op12_periodic_runs, op13_nearest_vectors, pipeline)} | parts.QUERIES
ORACLE_SQL: dict[str, str] = {"op2_preference_pairs": preference.ORACLE, "op10_near_duplicates": parts.NEAR, **parts.ORACLE_SQL}
