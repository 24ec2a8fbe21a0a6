import random
import re

import numpy as np
from pyspark.sql import functions as F

from auralake.llm.common import connected_components, maybe_in
from auralake.llm.ngram_join import bitmap, jaccard_components, most_shared, shingle_set

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed=0, groups=12, most=14):
    r, out = random.Random(seed), []
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("xyz") + str(r.randrange(40))
    common = [word() for _ in range(12)]
    for _ in range(groups):
        base = [word() for _ in range(r.choice([3, 8, 40, 120]))] + common * r.randrange(2)
        for _ in range(r.randrange(1, most)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(copy) // 12)):
                k = r.randrange(len(copy))
                copy[k : k + r.randrange(2)] = [word()]
            out.append(" ".join(copy))
    chain = [word() for _ in range(200)]  # each links with the next, not with all
    for k in range(20):
        chain = chain[:]
        chain[(9 * k) % 200] = word()
        out.append(" ".join(chain))
    r.shuffle(out)
    return out


def test_bitmaps_bound_the_overlap():
    r = np.random.default_rng(1)
    for _ in range(200):
        pool = r.integers(0, 2**63, 300, dtype=np.uint64)
        x, y = (np.unique(r.choice(pool, r.integers(1, 250))) for _ in range(2))
        assert most_shared(bitmap(x), len(x), bitmap(y), len(y)) >= len(np.intersect1d(x, y))


def test_components_against_brute_force(make_docs):
    texts = near_copies() + [None, "", " \n", "a", "A", "b c", "b  C", "x\x1cy z", "é à", "w " * 20_000]
    texts += [texts[3], texts[3], texts[0].upper()]
    docs = make_docs(texts, extra={"n": F.lit(1), "id": F.lit("clash"), "tile": F.lit(0), "k1": F.lit(0)}).repartition(6)
    for n, num, den in ((4, 85, 100), (5, 80, 100), (2, 60, 100)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, n, num, den).collect()}
        want = brute(texts, n, num, den)
        assert len({c for _, c in want}) < len(texts) - 30
        assert [got[k] for k in range(len(texts))] == want


def test_large_group_of_near_copies_and_hot_shingles(make_docs):
    r = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(400):
        copy = list(base)
        copy[r.randrange(60)] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join([*base[:15], *(f"u{r.randrange(10**6)}" for _ in range(45))]) for _ in range(200)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(make_docs(texts), 4, 80, 100).collect()}
    assert [got[k] for k in range(len(texts))] == [c for _, c in brute(texts, 4, 80, 100)]


def test_edges_of_tables(spark, make_docs):
    docs = make_docs(["a b c d e", "a b c d e", "q"])
    assert jaccard_components(docs.limit(0)).count() == 0
    assert jaccard_components(docs.filter("doc_id = 2")).count() == 1
    assert jaccard_components(docs.union(docs)).count() == 6
    none = connected_components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0
    path = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(path).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    ids = spark.createDataFrame([(k,) for k in range(0, 100, 7)], "doc_id long")
    assert {r[0] for r in maybe_in(spark.range(2000), "id", ids).collect()} >= set(range(0, 100, 7))
    assert maybe_in(spark.range(2000), "id", ids).count() < 40
