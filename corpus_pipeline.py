"""A corpus from raw documents: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`, and others that come along.  The last gives each document that is left its rate in the mixture.

Edge cases: rows without an id pass all stages; an empty table gives an empty one; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graticule.llm import common, decontam, mixing, neardup, secrets, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field gives at least 0.5 go; null and empty texts have no toxic word, repeated rows go or stay together."""
    field = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    common.settle(spark)
    return toxicity.reject(docs, field)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest id stays.

    Null and empty texts are copies of each other; rows of one id with different texts are documents of their own, repeated rows one.
    """
    return neardup.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go; null texts, and items without words, hit nothing."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced and n_chars follows; null texts stay null."""
    return secrets.redact(docs, secrets.fit_on_base(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with their posteriors and their rates towards the target shares of languages; texts without words weigh nothing."""
    common.settle(spark)
    return mixing.mixed(docs, _table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_copies),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

#: The stages learn from the documents; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage keeps is written to the shared folder before the next one, and the stage's other scratch tables go then."""
    docs, before = _table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        common.clear(spark, docs, before)
    return STAGES[-1][1](spark, docs, sf_dir)
