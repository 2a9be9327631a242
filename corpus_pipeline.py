"""The corpus pipeline: stages of the training-data operators, in order.

Every stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the
columns of ``docs``; the last returns the encoded documents. Null and empty
texts go in the first stage, as they have no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import bpe, decontam, langid, secrets
from twinfold.llm.frames import pick, position, scope, ship, stage, unstage
from twinfold.llm.neardup import drop_near_duplicates
from twinfold.llm.queries import vocabulary
from twinfold.sources.tables import read_table, spread

# In every stage but the last all columns pass through, whatever their names,
# nulls in them stay, and a column is an input only if its name is exact or no
# other name is. An empty table stays empty.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones.

    A document goes if it is null, empty or without letters, or if less than a
    fifth of its n-grams belong to any learned language; so all go if none is
    labelled. Very long texts are read whole. Equal texts are judged alike and
    repeated rows stay repeated; ties go to the smaller name.
    """
    ship(spark)
    return langid.keep_identified(docs, langid.learn(langid.training_rows(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Documents are linked if four fifths of their 5-word shingles are common.
    Rows that share an id but not their text are different documents. Of
    several with the smallest id of a group one is kept, and of copies of a
    row, id and text alike, any one; a null id is larger than all others. Texts
    without words, null or empty, are linked with nothing and stay. Very long
    texts are compared whole.
    """
    ship(spark)
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: ten words, or a shorter item.

    Null and empty texts have no words and stay, and all stay if the benchmark
    is empty. Repeated rows stay or go together. Very long texts are read whole.
    """
    ship(spark)
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` brought up to date.

    Texts without secrets, null or empty, are as before, and so is ``n_chars``
    of a null text. Overlapping secrets get one mask. Repeated rows stay
    repeated. Very long texts are scanned whole.
    """
    ship(spark)
    masked = secrets.redact_secrets(docs)
    names, text = masked.columns, position(docs, "text")
    rows = masked.toDF(*[f"_{i}" for i in range(len(names))])
    if "n_chars" in names:
        at = f"_{names.index('n_chars')}"
        rows = rows.withColumn(at, F.coalesce(F.length(f"_{text}").cast("long"), F.col(at)))
    return rows.toDF(*names)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, little-endian unsigned 32-bit integers,
    and whether they decode to its text.

    A null text counts as empty and has no tokens. Repeated rows stay repeated,
    very long texts are encoded whole, columns other than the id, language and
    source are left out.
    """
    ship(spark)
    rows = pick(docs, "doc_id", "lang", "source", "text")
    encoded = bpe.encode_documents(rows, *vocabulary(), decode=True)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", whole.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

#: The learned stages cannot be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to the documents, each to what the last wrote.

    When a stage has been written down, all tables it needed are deleted.
    """
    docs = spread(read_table(spark, sf_dir, "documents"))
    given: list[DataFrame] = []
    for number, (_, apply) in enumerate(STAGES, 1):
        if number == len(STAGES):
            return apply(spark, docs, sf_dir)
        with scope() as keep:
            docs = keep(stage(apply(spark, docs, sf_dir)))
        unstage(*given)
        given = [docs]
    return docs
