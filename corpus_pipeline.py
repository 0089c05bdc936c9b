"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
documents, with whatever columns the input has; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import removed, scope, stored, table
from tessera.llm.decontamination import without_leaks
from tessera.llm.near_dup import without_near_duplicates
from tessera.llm.packing import MIXTURE_POWER, pack
from tessera.llm.quality import judge, language_references
from tessera.llm.secrets import redact_secrets


def _whole(docs: DataFrame) -> F.Column:
    """A row as one column, so that no name in it can clash with an operator's."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged against references from this stage's input.

    Null, blank and short texts fail the base rule and go. A null language has no reference, so the base rule alone
    judges such rows. Equal rows have equal verdicts; an empty table stays empty; columns may have any name.
    """
    rows = docs.select(_whole(docs), "text", "lang")
    return judge(rows, language_references(docs), ("_doc",)).where("kept").select("_doc.*")


def near_duplicate_removal(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of near-copies at 0.8.

    Shingles take five words here, the width for near-duplicate stages; op4's contract sets four for its own result.
    Texts alone decide: different texts under one doc_id all stay, as do all rows with null or blank texts; rows with
    a null doc_id go where a row with an id has the same or a near text. Repeated rows leave one.
    """
    return without_near_duplicates(docs, width=5)


def benchmark_decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and blank texts hold none and stay. Equal rows go or stay together; null and blank items are in nothing; with
    an empty benchmark all stay. Columns may have any name.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars as it is then.

    Null texts stay null, with a null n_chars, and blank ones as they are. Every row stays, repeated ones too; an empty table stays empty.
    Columns may have any name.
    """
    done = redact_secrets(docs.select("text", _whole(docs)), keep=("_doc",))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*(changed.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, mixed as op1 mixes them: one row per piece, with its ids.

    A null or blank text gives its end id alone; a null source is a queue of its own; repeated rows are packed as
    often as they occur; an empty table gives no pieces. Of the columns, doc_id and source go into the result.
    """
    pieces = pack(docs, keep=("doc_id", "source"), power=MIXTURE_POWER)
    return pieces.withColumn("ids_crc32", F.crc32("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicate_removal", near_duplicate_removal),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_redaction", secret_redaction),
    ("packing", packing),
]

#: Histogram distances, MinHash components and tokenizer ids are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents. Once a stage's rows are written, its input and the tables that it made on the way are removed."""
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES:
        with scope() as made:
            docs = stored(stage(spark, docs, sf_dir), name)
        removed(*before, *(t for t in made if t is not docs))
        before = [docs]
    return docs
