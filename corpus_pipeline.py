"""The corpus pipeline: documents -> quality -> toxicity -> near copies -> personal data -> packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
``run`` writes each stage's result as Parquet to the shared folder, reads it
back as the next one's input, and deletes the stage's own intermediate files (of the
surrogates stage: raw texts and the table of surrogates).  All but the last return the columns of documents.

Defined cases: rows with null or empty texts fail the quality rules; a repeated row is
kept or dropped like its first; other columns, whatever their names, pass through to
the packing; an empty table gives no rows.
"""

from __future__ import annotations

from quillrank.llm import near_copies, pow2_packing, quality, surrogates, toxicity
from quillrank.llm.common import documents, scratch, shared_folder
from quillrank.session import apply_defaults


def quality_stage(spark, docs, sf_dir):
    return quality.quality_filter(docs)


def toxicity_stage(spark, docs, sf_dir):
    apply_defaults(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity_filter(docs, model)


def near_copy_stage(spark, docs, sf_dir):
    apply_defaults(spark)
    return near_copies.near_copy_filter(docs)


def surrogate_stage(spark, docs, sf_dir):
    apply_defaults(spark)
    return surrogates.pseudonymise(docs)


def packing_stage(spark, docs, sf_dir):
    apply_defaults(spark)   # a stage can run by itself; workers then take small batches
    return pow2_packing.pack(docs, ids=False)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", near_copy_stage),
    ("surrogates", surrogate_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the learnt scores nor the tokeniser.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
