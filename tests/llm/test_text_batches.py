"""Whole texts go to Python in small Arrow batches, and once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, language, near_dup, quality
from barloom.session import bound_batches

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    spark.conf.unset(BATCH_BYTES)
    yield spark
    spark.conf.unset(BATCH_BYTES)


def largest_batch(spark):
    @F.arrow_udf("long")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    texts = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    return texts.select(held("text").alias("n")).agg(F.max("n")).first()[0]


OPERATORS = {
    "quality": lambda docs, other: quality.score(docs, {"good": b"", "bad": b"", "fit": None}),
    "language": lambda docs, other: language.keep_languages(docs),
    "near_dup": lambda docs, other: near_dup.drop_near_duplicates(docs),
    "decontaminate": lambda docs, other: decontaminate.decontaminate(docs, other),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_batches_of_texts_are_bounded(unset, name):
    assert largest_batch(unset) > 20_000_000
    docs = unset.createDataFrame([(1, "one two three four five", "en", "web1")], "doc_id long, text string, lang string, source string")
    OPERATORS[name](docs, unset.createDataFrame([("a", "six seven")], "item_id string, text string"))
    assert largest_batch(unset) < 6_000_000


def test_a_size_that_was_set_stays(unset):
    unset.conf.set(BATCH_BYTES, "1m")
    bound_batches(unset)
    assert unset.conf.get(BATCH_BYTES) == "1m"


def test_texts_are_cleaned_once(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "b")], "item_id string, text string")
    rest = decontaminate.decontaminate(docs, items)
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [tuple(r) for r in rest.collect()] == [(1, "a c")]
