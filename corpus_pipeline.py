"""A corpus pipeline of five stages, each of which works on all that the stage before kept.

Rejected by the weak-label classifier or by the quality rules, or a copy or near copy of a document that stays: such a
document goes. What is left is cut into packed sequences of tokens. All stages but the last return the columns of the
documents as they came.

Defined cases: a null text is an empty one, and the rules reject it, as any text of under 50 words; texts of any length
are read whole; of equal or near texts the row with the smallest doc_id stays, a null one before all others; wholly
repeated rows are exact copies; an empty table passes all stages and gives no pieces; other columns, whatever they are
called, are carried through the first four stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alignscope.llm import exact_dedup, jaccard_join, packing, quality_rules, weak_quality
from alignscope.llm.common import Tables, cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", lambda spark, docs, sf_dir: weak_quality.keep_good(docs)),
    ("quality rules", lambda spark, docs, sf_dir: quality_rules.keep_good(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: exact_dedup.drop_copies(docs)),
    ("n-gram Jaccard join", lambda spark, docs, sf_dir: jaccard_join.drop_near_copies(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack_documents(docs, _tokenizer())),
]

#: Model training, minhashing and packing have no SQL; tests/llm/test_pipeline.py compares each stage and ``run`` with
#: plain Python on a small table.
ORACLE_SQL = None


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages; each writes a table, which goes when the next one has read it."""
    with Tables(spark) as tables:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            kept = tables.cut(stage(spark, docs, sf_dir))
            if k:
                tables.drop(docs)
            docs = kept
        return cut(STAGES[-1][1](spark, docs, sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    return run_stages(spark, table(spark, sf_dir, "documents"), sf_dir)
