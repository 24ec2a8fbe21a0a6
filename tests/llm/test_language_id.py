import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auralake.llm.language_id import LOWER, code_lengths, fold, identify, learned, train

SYLLABLES = {"aa": "ba bo bi bu".split(), "bb": "ki ko ka ke".split(), "cc": "ñi çé ôu né".split()}


def texts(n=240, seed=2):
    r, out = random.Random(seed), []
    for _ in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 30))]
        out.append((" ".join(words).capitalize() + ".", lang))
    return out


def brute_bits(text, training, order):
    """PPM over bytes from the definition, context by context."""
    follow = defaultdict(Counter)
    for t in training:
        x = bytes(order) + t.encode().translate(LOWER)
        for i in range(order, len(x)):
            for k in range(order + 1):
                follow[x[i - k : i]][x[i]] += 1
    x = bytes(order) + text.encode().translate(LOWER)
    bits = 0.0
    for i in range(order, len(x)):
        for k in range(order, -1, -1):
            c = follow.get(x[i - k : i])
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if x[i] in c:
                bits -= math.log2(c[x[i]] / whole)
                break
            bits -= math.log2(len(c) / whole)
        else:
            bits += 8
    return bits


@pytest.fixture(scope="module")
def docs(make_docs):
    rows = texts()
    return make_docs([t for t, _ in rows], langs={k: x for k, (_, x) in enumerate(rows)})


SCRIPTS = {
    "el": ["καλημέρα κόσμε", "ο κόσμος είναι μικρός", "η θάλασσα και ο ήλιος"], "ru": ["доброе утро мир", "мир тесен", "море и солнце"],
    "uk": ["доброго ранку світе", "світ тісний", "море і сонце їжак"], "zh": ["早上好世界", "世界很小", "大海和太阳"],
}


def test_code_lengths_are_exact(docs, make_docs):
    rows = [(t, x) for x, own in SCRIPTS.items() for t in own] + texts()
    model = train(make_docs([t for t, _ in rows], langs={k: x for k, (_, x) in enumerate(rows)}), order=3)
    assert model.languages == sorted([*SCRIPTS, *SYLLABLES])
    for k, lang in enumerate(model.languages):
        own = [t for t, x in set(rows) if x == lang]
        for text in ("Bako ñi", "kike kako. XY", "", "bobabi " * 40, "МИР и море 世界", "κόσμος 🎈", "\x00\x01"):
            assert code_lengths([text], model)[0, k] == pytest.approx(brute_bits(text, own, 3), rel=1e-9, abs=1e-6)


def test_predictions_and_scores_against_brute_force(docs):
    rows = texts()
    held = {r[0] for r in docs.filter(fold("doc_id", 4) == 2).select("doc_id").collect()}
    own = {x: [t for k, (t, y) in enumerate(rows) if y == x and k not in held] for x in SYLLABLES}
    got = {r["doc_id"]: r for r in identify(docs, learned(docs)).collect()}
    for k in range(0, len(rows), 17):
        bits = {x: brute_bits(rows[k][0], set(own[x]), 3) for x in sorted(own)}
        best = min(bits, key=bits.get)
        share = 1 / sum(2 ** -(b - bits[best]) for b in bits.values())
        assert got[k]["lang_pred"] == best and got[k]["lang_score"] == pytest.approx(share)


def test_rows_with_one_doc_id_are_told_apart(docs, spark):
    rows = [(7 if k % 2 else None, t, x) for k, (t, x) in enumerate(texts())]
    shared = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = train(shared.filter("doc_id = 7"), per_language=5)
    assert small.languages == ["aa", "bb", "cc"]
    # five texts of a language are at most so many distinct byte strings
    assert all(0 < len(t.strings[3]) <= 5 * max(len(x[1].encode()) for x in rows) for t in small.trees)
    assert train(shared).languages == small.languages
    one = spark.createDataFrame([(7, "the same row", "aa")] * 500, "doc_id long, text string, lang string")
    assert train(one, per_language=5).languages == ["aa"]


def test_ties_go_to_the_first_name(spark, make_docs):
    rows = [(k, "same text here", x) for k, x in enumerate(["bb", "aa"])]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (row,) = identify(make_docs(["same here"]), model).collect()
    assert row["lang_pred"] == "aa" and row["lang_score"] == 0.5


def test_long_text_is_scored_in_parts(docs, monkeypatch):
    model = train(docs, order=2)
    text = "bako ñiçé " * 500
    whole = code_lengths([text, "x"], model)
    monkeypatch.setattr("auralake.llm.language_id.CHUNK", 37)
    assert code_lengths([text, "x"], model) == pytest.approx(whole, rel=1e-6)


def test_held_out_accuracy_and_edges(docs, make_docs):
    rows = texts()
    got = {r["doc_id"]: r for r in identify(docs.withColumn("lang_pred", F.lit(3)), learned(docs)).collect()}
    held = {r[0] for r in docs.filter(fold("doc_id", 4) == 2).select("doc_id").collect()}
    assert held and sum(got[k]["lang_pred"] == rows[k][1] for k in held) >= 0.98 * len(held)
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    odd = make_docs([None, "", "123 !?", "\x00", "é", "b" * 300_000, "zzz qqq"], langs={1: None})
    out = {r["doc_id"]: r["lang_pred"] for r in identify(odd, learned(docs)).collect()}
    assert [out[k] for k in range(4)] == ["und"] * 4 and all(out[k] in SYLLABLES for k in (4, 5, 6))
    none = identify(odd, learned(docs.limit(0))).collect()
    assert len(none) == 7 and {r["lang_pred"] for r in none} == {"und"}
    assert identify(docs.limit(0), learned(docs)).count() == 0
    assert identify(docs.union(docs), learned(docs)).count() == 2 * len(rows)


def test_sample_is_bounded(docs):
    small = train(docs, per_language=5)
    assert small.languages == ["aa", "bb", "cc"]
