"""Registered corpus queries: SQL twins, the pipeline, and held-out accuracy on the given tables."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools"), os.path.join(ROOT, "tests")]
import compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from plans import check_plan, stored_plans_checked  # noqa: E402

from habitatq.llm import catalog  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_twin(spark, con, name):
    def run(spark, folder):
        df = catalog.REGISTRY[name](spark, folder)
        check_plan(df, python=True)
        return df

    with stored_plans_checked(python=True):
        assert compare.compare(spark, con, name, run, catalog.SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(catalog.REGISTRY) - set(catalog.SQL)))
def test_plan(spark, name):
    with stored_plans_checked(python=True):
        check_plan(catalog.REGISTRY[name](spark, SMALL), python=True)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.REGISTRY) == list(range(1, 14))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"  # the smallest tables hold out a score of labels only
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = catalog.op10_language_id(spark, folder).filter("held_out AND lang_pred <> 'und'").join(docs, "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = catalog.op8_pairwise_quality(spark, folder).filter("held_out").join(labels, "doc_id")
    right = found.groupBy("quality").agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")).alias("share"))
    assert all(r.share >= 0.85 for r in right.collect()), right.collect()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.dtypes == docs.dtypes, name
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert before.count() >= 0.7 * docs.count()
    packed = corpus_pipeline.run(spark, SMALL)
    by_doc = packed.groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {r.doc_id for r in by_doc.collect()} == {r.doc_id for r in before.collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
