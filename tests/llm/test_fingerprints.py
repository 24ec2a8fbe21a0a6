import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auralake.llm.fingerprints import digests, edited_documents, likeness, op4_document_fingerprints, recovered, sketch, written


def paragraphs(text):
    return set(Counter(x for x in re.split(r"\n|(?<=[.!?]) ", text) if x).items())


def texts():
    r = random.Random(2)
    line = lambda: " ".join(r.choice(["ab", "cé", "🎉", "d."]) + str(r.randrange(30)) for _ in range(4))
    out = ["\n".join(line() for _ in range(n)) for n in (0, 1, 2, 5, 9, 30, 200, 900)]
    return out + [None, "", "\n\n", "same\nsame\nsame", "One. Two! Three? four", "z" * 9999, out[4], "x\n" * 3000]


def test_against_brute_force(make_docs):
    rows = texts()
    docs = make_docs(rows, extra={"id": F.lit("clash"), "half": F.lit(1), "other": F.lit(2)}).repartition(3)
    got = edited_documents(docs).select(
        "doc_id", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.expr(written(sketch("own"))).alias("fp"),
        likeness("own", "new").alias("near_edited"), likeness("own", "other").alias("near_next"),
    ).collect()
    assert len(got) == len(rows)
    text = [t or "" for t in rows]
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    prints = {}
    for r in got:
        k = r["doc_id"]
        following = text[k - 1] if k else text[-1]
        half = len(text[k]) // 2
        edited = text[k][: len(text[k]) - half] + following[:half]
        assert r["edited"] == edited and r["sha"] == hashlib.sha256(edited.encode()).hexdigest()
        own = paragraphs(text[k])
        assert r["near_edited"] == pytest.approx(jaccard(own, paragraphs(edited)))
        assert r["near_next"] == pytest.approx(jaccard(own, paragraphs(following)))
        assert prints.setdefault(text[k], r["fp"]) == r["fp"]
    assert len(set(prints.values())) >= len(prints) - 1  # "" and "\n\n" have no paragraph


def test_recovered_digests_are_the_difference(spark):
    df = spark.createDataFrame([("\n".join(map(str, range(a, b))), "\n".join(map(str, range(c, d)))) for a, b, c, d in
        [(0, 0, 0, 0), (0, 3, 2, 9), (0, 500, 3, 501), (0, 700, 700, 1500), (0, 0, 0, 40)]], "a string, b string")
    df = df.select(F.expr(digests("a")).alias("a"), F.expr(digests("b")).alias("b"))
    out = df.select("*", F.expr(recovered("a", "b")).alias("r")).collect()
    for r in out:
        assert sorted(r["r"]["mine"]) == sorted(set(r["a"]) - set(r["b"]))
        assert sorted(r["r"]["theirs"]) == sorted(set(r["b"]) - set(r["a"]))


def test_repeated_ids_nulls_and_empty_table(spark, make_docs):
    docs = make_docs(["a\nb", "c"])
    twice = edited_documents(docs.union(docs)).collect()
    assert sorted((r["doc_id"], r["edited"]) for r in twice) == [(0, "a\nc"), (0, "a\nc"), (1, "c"), (1, "c")]
    odd = spark.createDataFrame([(None, "x"), (5, None), (5, "yy"), (5, "zzzz"), (None, "vw"), (5, "yy")], "doc_id long, text string")
    got = edited_documents(odd).collect()
    assert sorted(r["text"] for r in got) == ["", "vw", "x", "yy", "yy", "zzzz"] and [r["doc_id"] for r in got].count(None) == 2
    # in order of doc_id and hash, each takes the first half of the next one below it
    order = sorted(((r["doc_id"] is not None, hashlib.md5(r["text"].encode()).hexdigest()), r["text"]) for r in got)
    below = {t: order[k - 1][1] for k, (_, t) in enumerate(order) if k == 0 or order[k - 1][1] != t}
    for r in got:
        half = len(r["text"]) // 2
        assert r["edited"] == r["text"][: len(r["text"]) - half] + below[r["text"]][:half]
    assert edited_documents(docs.filter("doc_id = 0")).head()["edited"] == "a\na"
    assert edited_documents(docs.limit(0)).count() == 0


def test_the_querys_own_path_and_a_long_text(spark, make_docs, tmp_path):
    rows = [*texts(), "\n".join(f"line {k}" for k in range(12_000)), "\n".join(f"line {k}" for k in range(3, 12_100)), texts()[6]]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op4_document_fingerprints(spark, str(tmp_path)).collect()}
    text = [t or "" for t in rows]
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for k, t in enumerate(text):
        following = text[k - 1] if k else text[-1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(jaccard(paragraphs(t), paragraphs(edited)))
        assert r["near_next"] == pytest.approx(jaccard(paragraphs(t), paragraphs(following)))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (paragraphs(t) == paragraphs(edited))
    assert got[6]["fingerprint"] == got[len(rows) - 1]["fingerprint"]
