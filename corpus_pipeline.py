"""Corpus pipeline: toxicity, near-duplicate join, secrets, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what each returns to the shared folder and reads it
again for the next. All but the last return the columns of documents. Decisions are taken per row, so repeated rows and rows that
share a doc_id, or have none, are told apart; rows travel as structs beside the operators' columns, so names cannot clash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from strandlake.llm import byte_bpe, mixing, ngram_join, secrets, toxicity
from strandlake.llm.common import keyed, table, unused, written


def _columns(docs):
    """The columns of documents out of the struct `doc`."""
    return [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]


def drop_toxic(spark, docs, sf_dir):
    """Documents scored 0.5 or more go; null and empty texts stay, and so does everything where no labels are."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    name = unused(docs.columns, "score")
    return toxicity.score(docs, model, score_col=name).where(F.col(name) < 0.5).select(*docs.columns)


def keep_one_of_each_group(spark, docs, sf_dir):
    """Of each component of near copies, equal rows among them, one row stays: that of the smallest doc_id (null last), the first in
    order of reading where ids are equal. Texts without words belong to no group and stay."""
    rows = keyed(docs)
    joined = ngram_join.near_components(rows.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "row"), row_col="row")
    return rows.join(joined.where(~F.col("is_first")).select("row"), "row", "left_anti").select(*_columns(docs))


def mask_secrets(spark, docs, sf_dir):
    """Live-looking secrets are masked in the text; all documents stay."""
    return secrets.redact(docs)


def mix(spark, docs, sf_dir):
    """Each row comes as many times as the mix takes it, which may be never."""
    rows = keyed(docs)
    mixed = mixing.mix_sources(rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), F.col("doc.source").alias("source")), keep=("row",))
    taken = mixed.where("passes > 0").select("row", F.col("passes").cast("int").alias("passes"))
    return rows.join(taken, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass")).select(*_columns(docs))


def token_ids(spark, docs, sf_dir):
    """doc_id, lang, source, n_tokens, ids."""
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), offsets_col=None)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("byte_bpe", token_ids),
]

#: The learned score and the identifiers of byte pairs have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
