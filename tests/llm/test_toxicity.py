import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.llm.language_id import fold
from auralake.llm.toxicity import Chains, document_features, fit, learned, lines_of, score_documents, score_texts, train

BAD = ["grobian", "lumpazi", "schuftig", "schuftel"]


def corpus(n=400, seed=4):
    r, rows = random.Random(seed), []
    for _ in range(n):
        toxic = int(r.random() < 0.2)
        words = [r.choice("abcdefgh") * r.randrange(1, 4) + r.choice("xyz") for _ in range(r.randrange(5, 60))]
        for _ in range(r.randrange(3, 6) * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        if len(words) > 20:
            words[10] += "\n"
        rows.append((" ".join(words), toxic))
    return rows


def test_messages_against_enumeration():
    r = np.random.default_rng(0)
    lengths = np.array([3, 1, 4, 2, 4])
    e, links = r.normal(size=14), r.normal(size=(2, 2))
    p, counts = Chains(lengths).messages(e, links)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        own, z, m, q = e[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(own @ np.array(tags) + sum(links[a, b] for a, b in zip(tags, tags[1:])))
            z += s
            m += s * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                q[a, b] += s
        want += list(m / z)
        pairs += q / z
        at += n
    assert p == pytest.approx(want) and counts == pytest.approx(pairs)


def test_spans_point_at_the_words():
    model = fit(corpus(), 0.2)
    text = "Ünlü aax\nSCHUFTEL, bby grobian lumpazi"
    (got,) = score_texts([text], model)
    assert [text[s["start"] : s["end"]] for s in got["spans"]] == ["SCHUFTEL", "grobian lumpazi"]
    assert got["predicted"] == 1
    assert lines_of("A-b\n\n c") == [[b"a", b"b"], [b"c"]]


def test_held_out_accuracy_and_edges(spark, make_docs):
    rows = corpus(600)
    docs = make_docs([t for t, _ in rows])
    labels = spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(rows)] + [(10**6, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = learned(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in score_documents(docs.withColumn("toxicity", F.lit(1)), model).collect()}
    held = {r[0] for r in docs.filter(fold("doc_id", 5) == 0).collect()}
    assert held and sum(got[k]["predicted"] == rows[k][1] for k in held) >= 0.97 * len(held)
    odd = make_docs([None, "", "...", "aax " * 30_000, "grobian", "İ grobian lumpazi schuftel"])
    out = score_documents(odd, model).collect()
    assert len(out) == 6 and all(0 <= r["toxicity"]["score"] <= 1 for r in out)
    assert out[0]["toxicity"]["predicted"] == 0 and out[0]["toxicity"]["spans"] == []
    bare = score_documents(odd, learned(docs, labels.limit(0))).collect()
    assert {r["toxicity"]["score"] for r in bare} == {0.0}
    assert score_documents(docs.limit(0), model).count() == 0


def test_scores_do_not_depend_on_the_batch():
    model = fit(corpus(), 0.2)
    texts = [t for t, _ in corpus(50, seed=9)]
    together = [x["score"] for x in score_texts(texts, model)]
    assert together == pytest.approx([score_texts([t], model)[0]["score"] for t in texts])


def brute_marginals(words, model):
    """Probability of T of each word of a line, over all tag sequences."""
    emit, total, p = [model.emission(w) for w in words], 0.0, [0.0] * len(words)
    for tags in itertools.product((0, 1), repeat=len(words)):
        weight = math.exp(sum(e for e, t in zip(emit, tags) if t) + sum(model.links[a, b] for a, b in zip(tags, tags[1:])))
        total += weight
        for k, t in enumerate(tags):
            p[k] += weight * t
    return [x / total for x in p]


def test_scores_spans_and_predictions_against_brute_force(spark, make_docs):
    model = fit(corpus(), 0.2)
    r = random.Random(3)
    words = ["aax", "bby", "grobian", "lumpazi", "schuftel", "schuft", "grob", "Ünlü", "cc"]
    texts = ["\n".join(" ".join(r.choice(words) for _ in range(r.randrange(0, 8))) for _ in range(r.randrange(1, 4))) for _ in range(40)]
    rows = score_documents(make_docs(texts), model).collect()
    seen = set()
    for row in rows:
        text, got = texts[row["doc_id"]], row["toxicity"]
        lines = lines_of(text)
        p = [x for line in lines for x in brute_marginals(line, model)]
        features = document_features(np.array([sum(p)]), np.array([len(p)]))
        score = float(1 / (1 + np.exp(-(features @ model.scorer))[0]))
        assert got["score"] == pytest.approx(score, abs=1e-6) and got["expected"] == pytest.approx(sum(p), abs=1e-6)
        assert got["predicted"] == int(score >= 0.5)
        flagged = [w.decode() for w, x in zip([w for line in lines for w in line], p) if x >= 0.5]
        found = [w for s in got["spans"] for w in text[s["start"] : s["end"]].lower().split()]
        assert found == flagged
        seen.add(got["predicted"])
    assert seen == {0, 1}


def test_labels_and_rows_that_repeat(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t, y) for k, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    model = train(docs)  # null and shared ids are told apart by their texts
    own = train(spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int"))
    held = [t for t, _ in corpus(40, seed=5)]
    assert [x["predicted"] for x in score_texts(held, model)] == [x["predicted"] for x in score_texts(held, own)]
    same = spark.createDataFrame([(1, "grobian here", 1)] * 400 + [(2, "aax here", 0)] * 400, "doc_id long, text string, toxic int")
    few = train(same, sample=(3, 3))  # repeated rows count once, and the shares stay true
    assert few.prior == 0.5 and all(0 <= x["score"] <= 1 for x in score_texts(["grobian here", "aax here"], few))
    both = spark.createDataFrame([(1, "grobian", 1), (1, "grobian", 0)], "doc_id long, text string, toxic int")
    assert 0 <= score_texts(["grobian"], train(both))[0]["score"] <= 1
    twice = score_documents(docs.limit(5).union(docs.limit(5)), model)
    assert twice.count() == 10
    tight = train(docs, sample_bytes=1)  # not one text fits: nothing is learned, every score is the share of toxic ones
    assert score_texts(["grobian"], tight)[0]["score"] == pytest.approx(sum(y for _, y in rows) / len(rows))


def test_labels_meet_no_texts(spark, monkeypatch):
    from auralake.llm import toxicity

    rows = corpus(200)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    seen = []
    whole = toxicity.without_texts
    monkeypatch.setattr(toxicity, "without_texts", lambda df: seen.append(whole(df)) or seen[-1])
    got, want = train(docs, labels, sample=(20, 30)), train(docs.join(labels, "doc_id"), sample=(20, 30))
    assert got.weights == want.weights and got.bias == want.bias and got.prior == want.prior
    assert all("text" not in df.columns for df in seen) and len(seen) == 2
