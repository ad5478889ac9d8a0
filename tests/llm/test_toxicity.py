"""Toxicity on held-out documents, the label model on votes of known quality, and odd tables."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fairtract.llm import toxicity
from fairtract.llm.queries import op12_toxicity

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    """Of held-out toxic documents nine tenths are found, of clean ones 99 in 100 are left alone.

    About one label in a hundred of the given table is wrong.
    """
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = op12_toxicity(spark, SF_DIR)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.toPandas()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count() and rows.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out))
    assert (rows.predicted == (rows.score >= 0.5)).all()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert len(toxic) > 50 and toxic.predicted.mean() >= 0.9 and clean.predicted.mean() <= 0.01


def test_held_out_labels_teach_nothing(spark):
    """Scores stay the same if the labels of held-out documents are turned round; other columns play no part."""
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))
    turned = F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("toxic")})
    a = toxicity.judge(docs, labels).toPandas().sort_values("doc_id")
    b = toxicity.judge(other, labels.withColumn("toxic", turned)).toPandas().sort_values("doc_id")
    assert np.allclose(a.score, b.score)


def simulated(n=40_000):
    """Votes of a world in which voters 1 and 2 copy each other and the rest are independent."""
    rng = np.random.default_rng(8)
    toxic = rng.random(n) < 0.15
    m = len(toxicity.VOTERS)
    right = np.linspace(0.3, 0.8, m)
    v = np.where(toxic[:, None], rng.random((n, m)) < right, rng.random((n, m)) < 0.03)
    v[:, 2] = np.where(rng.random(n) < 0.95, v[:, 1], v[:, 2])
    votes = (v.astype(np.int64) << np.arange(m)).sum(axis=1)
    return toxic, votes, right


def test_label_model_finds_accuracies_and_correlations(spark):
    toxic, votes, right = simulated()
    for labelled in (0.0, 0.05):
        label = np.where(np.random.default_rng(1).random(len(votes)) < labelled, toxic.astype(int), -1)
        frame = pd.DataFrame({"votes": votes, "label": label}).value_counts().reset_index(name="n")
        model = toxicity.fit_label_model(spark.createDataFrame(frame))
        assert model.parent[2] == 1 or model.parent[1] == 2
        assert abs(model.prior - toxic.mean()) < 0.01
        assert ((model.posterior(votes) > 0.5) == toxic).mean() > 0.995
        alone = [j for j in range(3, len(right)) if model.parent[j] < 0]
        assert len(alone) > 10 and np.allclose(model.fires[1, 0, alone], right[alone], atol=0.03)


def test_long_texts_are_read_whole():
    reader = toxicity.Reader(["grumpf"], ["blor"])
    long = "wort " * 500_000 + "grumpf grumpf you are an idiot blorum blorin"
    votes, x = reader.read(long)
    names = {n for i, n in enumerate(toxicity.VOTERS) if votes >> i & 1}
    assert {"words 0", "insults", "german", "addressed", "stems 0"} <= names and "no word" not in names
    assert np.isclose(x[0], np.log1p(2)) and np.isclose(x[1], np.log1p(2))
    assert sum(map(len, toxicity._chunks(long))) == len(long)
    assert reader.read(None)[0] == reader.read("")[0]


def test_odd_tables(spark):
    schema = "doc_id long, text string, score double, votes int, label string"
    labels = "doc_id long, quality int, toxic int"
    odd = [(1, None, 0.0, 1, "x"), (None, "you idiot, you worthless scum", 0.0, 1, "x"), (2, "", 0.0, 1, "x"), (3, "fine words", 0.0, 1, "x")]
    odd += [(3, "fine words", 0.0, 1, "x")] * 2 + [(i, "you idiot, you worthless scum" if i % 3 else "fine words here", 0.0, 1, "x") for i in range(4, 60)]
    some = [(i, None, None if i % 7 == 0 else int(i % 3 > 0)) for i in range(4, 40)] + [(5, 1, 0), (None, 1, 1)]
    for rows, known in ((odd, some), (odd, []), ([], some), ([], []), (odd[:1], [])):
        docs, told = spark.createDataFrame(rows, schema), spark.createDataFrame(known, labels)
        out = toxicity.judge(docs, told).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        if len(rows) > 5:
            abusive = {r[1] for r in rows if r[1] and "idiot" in r[1]}
            by_id = {r.doc_id: r.predicted for r in out}
            assert all(by_id[r[0]] == int(r[1] in abusive) for r in rows)
