"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkweave.llm import decontaminate, language, languagemodel, lexical, licenses, linedup, mixing, neardup, personal, quality, secrets, toxicity, trie
from linkweave.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bbit_neardup": lambda spark, sf: neardup.components(load(spark, sf, "documents"), shingle=2),
    "op2_line_dedup": lambda spark, sf: linedup.deduplicated(load(spark, sf, "documents").select("doc_id", "text")),
    "op3_quality_rules": lambda spark, sf: quality.quality(load(spark, sf, "documents")),
    "op4_benchmark_leaks": lambda spark, sf: decontaminate.contaminated(load(spark, sf, "documents"), load(spark, sf, "benchmark")),
    "op5_license_scan": lambda spark, sf: licenses.scan(load(spark, sf, "documents")),
    "op6_language_id": lambda spark, sf: language.identify(load(spark, sf, "documents")),
    "op7_toxicity": lambda spark, sf: toxicity.score(load(spark, sf, "documents"), load(spark, sf, "labels")),
    "op8_pitman_yor_scores": lambda spark, sf: languagemodel.score(load(spark, sf, "documents")),
    "op9_secret_scan": lambda spark, sf: secrets.scan(load(spark, sf, "documents")),
    "op10_source_mixing": lambda spark, sf: mixing.mix(load(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")),
    "op11_personal_data": lambda spark, sf: personal.scan(load(spark, sf, "documents")),
    "op12_prefix_trie": lambda spark, sf: trie.build(load(spark, sf, "conversations")),
    "op13_lexical_search": lambda spark, sf: lexical.search(load(spark, sf, "documents"), load(spark, sf, "benchmark")),
}
ORACLES: dict[str, str] = {
    "op1_bbit_neardup": neardup.oracle(shingle=2),
    "op3_quality_rules": quality.ORACLE,
    "op9_secret_scan": secrets.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
