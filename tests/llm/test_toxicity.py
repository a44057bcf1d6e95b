"""Toxicity: held-out accuracy, disguises, exception phrases."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import toxicity as X

INSULTS = ["grobnar", "veltish", "dumfry"]


def text(toxic, n):
    random.seed(n)
    words = ["".join(random.choices(["ta", "lo", "min", "ker", "vas", "ou"], k=random.choice([1, 2, 3]))) for _ in range(random.choice([20, 80, 800]))]
    for _ in range(4 if toxic else 0):
        words.insert(random.randrange(len(words)), random.choice(INSULTS))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, text(i % 9 == 0, i), int(i % 9 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t, "score") for i, t, _ in rows], "doc_id bigint, text string, score string")
    return docs, spark.createDataFrame([(i, x, 1) for i, _, x in rows], "doc_id bigint, toxic int, quality int")


@pytest.fixture(scope="module")
def model(corpus):
    return X.fit(*corpus, usable=F.col("id") % 3 != 1)


def test_held_out_accuracy(corpus, model):
    docs, labels = corpus
    found = X.toxicity(docs, model).join(labels, "doc_id").filter("doc_id % 3 = 1").collect()
    assert len(found) == 400
    assert sum(r.predicted == r.toxic for r in found) >= 396
    assert all(0 <= r.score <= 1 for r in found)


def score(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r for r in X.toxicity(docs, model).collect()}


def test_disguises_are_found(spark, model):
    base = "ta lo min ker vas ou ta "
    texts = [base + w for w in ("GROBNAR dumfry veltish", "gr0bnar dumfry v3ltish", "grоbnаr dumfry veltish", "gróbnar dümfry veltish", "gro​bnar dumfry velti­sh", "ｇｒｏｂｎａｒ dumfry veltish")]
    assert all(r.predicted == 1 for r in score(spark, model, texts).values())


def test_clean_texts_and_odd_ones(spark, model):
    texts = [None, "", "ta lo min", "2024-01-02 a1b2 user@mail7.example.com $$$ 3.5%", "ta " * 200_000, "\x00﻿"]
    found = score(spark, model, texts)
    assert all(r.predicted == 0 for r in found.values()) and found[0].score == found[1].score
    assert len(found) == len(texts)


def test_exception_phrases(model):
    quiet = X.Model(model.entries, (*X.EXCEPTIONS, "grobnar fish"))
    loud, calm = quiet.automaton(), X.fold("ta lo Grobnar fish ta")
    assert X.strength(calm, model.automaton()) > 0 and X.strength(calm, loud) == 0
    assert X.strength(X.fold("ta grobnar lo fish"), loud) > 0


def test_length_lowers_the_strength(model):
    machine = model.automaton()
    assert X.strength("grobnar", machine) > X.strength("grobnar " + "ta " * 5000, machine) > 0


@pytest.mark.parametrize("plain, folded", [("1d10t", "idiot"), ("m0r0n!", "moron!"), ("the$$$ 1234", "the$$$ 1234"), ("ÉTÉ", "ete"), ("tr@sh", "trash"), ("$cum", "scum")])
def test_fold(plain, folded):
    assert X.fold(plain) == folded


def test_without_toxic_rows(spark, corpus):
    docs, labels = corpus
    for some in (labels.filter("toxic = 0"), labels.limit(0), labels.filter("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        found = X.toxicity(docs, X.fit(docs, some)).collect()
        assert len(found) == 1200 and all(r.predicted == 0 for r in found)
    assert X.toxicity(docs.limit(0), X.Model()).collect() == []


def test_repeated_and_null_labels(spark):
    docs = spark.createDataFrame([(i % 50, text(i % 50 % 2 == 0, i % 50)) for i in range(100)] + [(None, "grobnar")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(50)] * 2 + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    assert X.toxicity(docs, X.fit(docs, labels)).count() == 101


def test_chance_hits_do_not_add_up(spark):
    """Entries that stand in clean texts now and then; texts joined from held-out clean ones, with a toxic passage and without."""
    generator = random.Random(5)
    stems = ["ta", "lo", "min", "ker", "vas", "ou", "del", "pri", "sen", "gol"]

    def passage(toxic):
        words = ["".join(generator.choices(stems, k=generator.choice([2, 3]))) for _ in range(200)]
        for _ in range(6 if toxic else generator.random() < 0.05):
            words[generator.randrange(200)] = generator.choice(INSULTS)
        return " ".join(words)

    rows = [(i, passage(i % 9 == 0), int(i % 9 == 0)) for i in range(1800)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = X.fit(docs, spark.createDataFrame([r[::2] for r in rows], "doc_id bigint, toxic int"))
    sizes = [50, 100, 200, 400]  # passages, of more than 1,000 characters each
    joined = ["\n".join(passage(False) for _ in range(n)) for n in sizes for _ in range(3)]
    assert all(r.predicted == 0 for r in score(spark, model, joined).values())
    toxic = " ".join(passage(True) for _ in range(3))
    held = ["\n".join([*(passage(False) for _ in range(n)), toxic]) for n in (0, 5, 20, 50) for _ in range(3)]
    assert all(r.predicted == 1 for r in score(spark, model, held).values())


def test_exceptions_of_long_texts_are_swept_once():
    """A megabyte of exception phrases beside hits: time grows with the text, and what counts is as in a plain scan."""
    import time

    from shelfmark.llm import toxicity as T

    model = T.Model({" idiot ": 2.0, " tra": 1.0}, exceptions=("trash can", "can xx"))
    machine = model.automaton()
    piece = "trash can xx idiot trap "
    began = time.perf_counter()
    total, size = T.weighed((piece * 45_000).strip(), machine)
    assert size > 1_000_000 and time.perf_counter() - began < 20
    assert total == pytest.approx(45_000 * 3.0)  # "trash" lies in an exception, "trap" does not
