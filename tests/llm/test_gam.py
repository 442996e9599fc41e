import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import gam


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.Gam().fit(x, y, np.ones(len(y)))
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    test = rng.random((1000, 4))
    right = (model.predict(test) > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))
    assert right.mean() > 0.9


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.random((500, 3))
    m = gam.Gam().fit(x, (x[:, 0] > 0.3).astype(float), np.ones(500), rounds=20)
    for row, p in zip(x[:20], m.predict(x[:20])):
        s = m.intercept + sum(t[np.searchsorted(e, v)] for t, e, v in zip(m.tables, m.edges, row))
        s += sum(t[np.searchsorted(m.pair_edges[i], row[i]), np.searchsorted(m.pair_edges[j], row[j])] for i, j, t in m.pairs)
        assert p == pytest.approx(1 / (1 + np.exp(-s)))


def test_features_are_finite_shares():
    for t in [b"", b" \n ", b"x", b"\xff\xfe", b"A!! B!! " * 50, b"w" * 200_000]:
        f = gam.features_of(t)
        assert len(f) == len(gam.FEATURES) and np.isfinite(f).all()


def corpus(documents, spark):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("etaoins") for _ in range(rng.randint(1, 9))) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(60).upper().replace(" ", "!! ") if bad else prose(60)))
        labels.append((i, 0 if bad else 1, 0))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_labels_have_no_effect(spark, documents):
    docs, labels = corpus(documents, spark)
    held = lambda c: c % 5 == 0
    got = {r.id: r.score for r in gam.classify(docs, labels, held).collect()}
    flipped = labels.withColumn("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.id: r.score for r in gam.classify(docs, flipped, held).collect()} == got
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all((s >= 0.3) == (truth[i] == 1) for i, s in got.items() if i % 5 == 0)


def test_awkward_rows(spark, documents):
    docs, labels = corpus(documents, spark)
    odd = documents([(None, None), (9000, ""), (9001, "z" * 300_000), (1, "same"), (1, "same")])
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (9000, None, 0), (1, 1, 0), (1, 1, 1)], labels.schema))
    got = gam.classify(docs.unionByName(odd), more, lambda c: c % 5 == 0).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 for r in got)
    none = gam.classify(odd, labels.limit(0), lambda c: F.lit(False)).collect()
    assert [r.score for r in none] == [0.5] * 5
    assert gam.classify(documents([]), labels, lambda c: F.lit(False)).count() == 0


def test_query_on_held_out_rows(spark):
    from quarry.llm.queries import op2_gam

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op2_gam(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [x for x in labels if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert held and all(got[x.doc_id].held_out for x in held)
    right = sum(got[x.doc_id].predicted == x.quality for x in held)
    assert right / len(held) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
