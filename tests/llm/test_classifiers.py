"""Trained operators: licence families that must not be taken for others, bounded fits, shapes of words."""

import random

import numpy as np

from pyspark.sql import functions as F

from netexp.llm import licenses, quality, toxicity

OTHER_FAMILIES = [
    "Published under the terms of the Eclipse Public License 2.0", "Made available under the Eclipse Public License, version 1.0", "This file is covered by the EPL 2.0", "Licensed under the terms of the Artistic License, version 2.0",
    "This library is under the zlib license", "Licensed under the Boost Software License, Version 1.0", "Licensed under the EUPL, version 1.2", "Released under the ISC license", "Licensed under the SIL Open Font License, Version 1.1", "Released under the Ruby license 2.0",
]
SAME_FAMILIES = [("MIT", "This project is MIT licensed"), ("MIT", "MIT licensed."), ("Apache-2.0", "Published under the Apache License 2.0"), ("GPL", "Published under the GPL v3 license, see the GNU General Public License"), ("CC-BY", "Texts are licensed under CC BY 4.0")]


def ordinary(n):
    rng = random.Random(4)
    return [" ".join(f"w{rng.randrange(200)}" for _ in range(12)) for _ in range(n)]


def test_other_families_are_unknown(spark):
    model = licenses.LicenceModel(ordinary(200))
    assert model.held_out_accuracy > 0.95
    frame = spark.createDataFrame([(0, "\n\n".join(f"{line}\n" for line in OTHER_FAMILIES))] + [(i, t) for i, (_, t) in enumerate(SAME_FAMILIES, 1)], "doc_id long, text string")
    assert {r.doc_id: r.family for r in licenses.licence_scan(spark, frame, model).collect()} == {i: f for i, (f, _) in enumerate(SAME_FAMILIES, 1)}


def test_texts_that_differ_in_case_and_null_ids(spark):
    model = licenses.LicenceModel(ordinary(50))
    rows = [(1, "MIT License"), (1, "MIT LICENSE"), (1, "MIT License"), (None, "MIT License"), (None, "MIT License"), (2, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("names", F.lit(1)).withColumn("row_key", F.lit(2))
    found = [(r.doc_id, r.family) for r in licenses.licence_scan(spark, frame, model).collect()]
    assert sorted(found, key=str) == [(1, "MIT"), (1, "MIT"), (None, "MIT")]


def test_the_model_of_a_table_is_one(spark):
    """Ties in doc_id and the order of rows change nothing; nor is there a model without lines."""
    rows = [(i % 5, line) for i, line in enumerate(ordinary(600))]
    one = licenses.fit_licences(spark.createDataFrame(rows, "doc_id long, text string"), max_documents=100, max_ordinary=60)
    two = licenses.fit_licences(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), max_documents=100, max_ordinary=60)
    assert one.rows() == two.rows() and one.gate == two.gate
    assert licenses.fit_licences(spark.createDataFrame([], "doc_id long, text string")).held_out_accuracy > 0.9


def test_toxicity_fit_is_bounded_in_rows(spark, monkeypatch):
    """Rows that repeat a labelled id are one document of the fit; very long texts are read whole."""
    lines = ordinary(40)
    rows = [(i, lines[i] + (" vile" if i % 4 == 0 else "")) for i in range(40)]
    frame = spark.createDataFrame(rows + rows[:1] * 500 + [(0, lines[3])] * 50 + [(99, "calm " * 60_000 + "vile " * 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.toxicity_chain(spark, frame, labels, ["toxic"]).count() == 40 + 500 + 50 + 1
    monkeypatch.setattr(toxicity, "Chain", lambda names, features, marks: (len(features), marks.shape))
    assert toxicity.fit_chain(frame, labels, ["toxic"]) == (40, (40, 1))
    assert toxicity.fit_chain(frame, labels, ["toxic"], max_labelled=10) == (10, (10, 1))


def test_quality_sees_the_shape_of_words():
    """A text's shape; junk of words that no other text has is told by it."""
    raw = np.frombuffer("Well, 20 men!Été 7x".encode(), np.uint8)
    buf, offsets = quality.shapes(raw, np.array([0, 13, 13, len(raw)]))
    assert [bytes(buf[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == ["Aa, 0 a!", "", "a 0a"]
    buckets, doc = quality.ngram_buckets(raw, np.array([0, 13, 13, len(raw)]))
    assert np.bincount(doc, minlength=3).tolist() == [10, 0, 6]
