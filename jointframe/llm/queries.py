"""The registered queries of the package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jointframe.llm import decontam, fim, langid, lattice, linedup, packing, quality, resample, simhash, suffix, tokenbin, toxicity, urlgraph
from jointframe.session import Tables


def op1_quality_rules(t: Tables) -> DataFrame:
    return quality.judge(t.documents.select("doc_id", "text")).drop("text")


def op2_language_id(t: Tables) -> DataFrame:
    return langid.digest(t.documents.select("doc_id", "text", "lang"))


def op3_token_binary(t: Tables) -> DataFrame:
    return tokenbin.round_trip(t.documents.select("doc_id", "text"))


def op4_best_fit_packing(t: Tables) -> DataFrame:
    return packing.pack_documents(t.documents)


def op5_simhash_near_dedup(t: Tables) -> DataFrame:
    return simhash.digest(t.documents.select("doc_id", "text"))


def op6_suffix_dedup(t: Tables) -> DataFrame:
    return suffix.digest(t.documents.select("doc_id", "text"))


def op7_toxicity(t: Tables) -> DataFrame:
    return toxicity.digest(t.documents.select("doc_id", "text"), t.labels)


def op8_benchmark_decontamination(t: Tables) -> DataFrame:
    return decontam.verdicts(decontam.find_matches(t.documents.select("doc_id", "text"), t.benchmark)).drop("text")


def op9_line_dedup(t: Tables) -> DataFrame:
    return linedup.digest(t.documents.select("doc_id", "text", "source"))


def op10_url_filters(t: Tables) -> DataFrame:
    return urlgraph.judge(t.pages).drop("trust", "distrust")


def op11_fill_in_middle(t: Tables) -> DataFrame:
    return fim.digest(t.documents.select("doc_id", "text"))


def op12_embedding_near_dedup(t: Tables) -> DataFrame:
    return lattice.digest(t.embeddings)


def op13_importance_resampling(t: Tables) -> DataFrame:
    return resample.digest(t.documents.select("doc_id", "text"), t.benchmark)


BUILDERS = (
    op1_quality_rules, op2_language_id, op3_token_binary, op4_best_fit_packing, op5_simhash_near_dedup, op6_suffix_dedup, op7_toxicity,
    op8_benchmark_decontamination, op9_line_dedup, op10_url_filters, op11_fill_in_middle, op12_embedding_near_dedup, op13_importance_resampling,
)
SQL = {
    "op1_quality_rules": quality.SQL, "op9_line_dedup": linedup.SQL, "op11_fill_in_middle": fim.SQL, "op12_embedding_near_dedup": lattice.SQL,
    "op13_importance_resampling": resample.SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir)) for f in BUILDERS}
