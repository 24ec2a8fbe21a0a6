import random
import re

from pyspark.sql import functions as F

from auralake.llm.decontamination import SuffixAutomaton, find_leaks
from auralake.llm.words import ALNUM, SPACED, split

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        x = words(item)
        n = min(window, len(x))
        for p in range(len(x) - n + 1) if n else []:
            for q in range(len(w) - n + 1):
                if w[q : q + n] == x[p : p + n]:
                    hit |= set(range(q, q + n))
                    names.add(str(name))
    return len(w), hit, sorted(names)


def test_words_by_bytes_are_the_words_of_the_pattern():
    text = "".join(map(chr, [*range(0x300), 0x2028, 0x3000, 0x1F389])) + " Ab1_c-ÉÀ x\x1cy"
    assert [w.decode() for w in split(text, ALNUM)] == words(text)
    assert [w.decode() for w in split(text, SPACED)] == re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def case(seed, vocabulary=4, n=40):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij"[:vocabulary])
    items = [(k, " ".join(word() for _ in range(r.randrange(0, 12)))) for k in range(6)]
    texts = [" ".join(word() for _ in range(r.randrange(0, 60))) for _ in range(n)]
    return items, texts


def test_automaton_against_brute_force():
    for seed in range(25):
        items, texts = case(seed, vocabulary=2 + seed % 4)
        auto = SuffixAutomaton([(str(k), split(t, ALNUM)) for k, t in items], 5)
        for t in texts:
            spans, names = auto.matches(split(t, ALNUM))
            n, hit, want = brute(t, items, 5)
            assert {i for lo, hi in spans for i in range(lo, hi)} == hit and sorted(names) == want


def test_find_leaks(spark, make_docs):
    items, texts = case(3, vocabulary=3)
    items += [(7, None), (8, ""), (9, "One, two; THREE four five six seven")]
    texts += [None, "", "!!!", "x One two three FOUR five-six seven y", "a " * 40_000, texts[0], texts[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(texts, extra={"leak": F.lit("clash"), "n_hit": F.lit(1)})
    cleaned = []
    for automaton_words in (200_000, 9):
        got = find_leaks(docs, bench, window=5, max_coverage=0.9, automaton_words=automaton_words).collect()
        assert len(got) == len(texts)
        for r in got:
            n, hit, names = brute(texts[r["doc_id"]], items, 5)
            leak = r["leak"]
            assert (leak["n_words"], leak["n_hit"], sorted(leak["items"])) == (n, len(hit), names)
            assert leak["drop"] == (len(hit) > 0.9 * n)
            assert not brute(leak["clean_text"], items, 5)[1]
            if not hit:
                assert leak["clean_text"] == texts[r["doc_id"]]
        cleaned.append({r["doc_id"]: r["leak"]["clean_text"] for r in got})
    assert cleaned[0] == cleaned[1]
    clean = find_leaks(docs, bench.limit(0)).filter("leak.n_hit > 0 OR NOT (leak.clean_text <=> text)")
    assert clean.count() == 0
    assert find_leaks(docs.limit(0), bench).count() == 0


def test_windows_that_come_together_in_the_end(spark, make_docs):
    items = [(1, "a b c d e f"), (2, "u v w x y z"), (3, "d d d d d g")]
    docs = make_docs(["a b c u v w x y z d e f", "p a b c u v w x y z d e f q r", "nothing here"])
    bench = spark.createDataFrame(items, "item_id long, text string")
    for automaton_words in (100, 12, 6):
        got = [r["leak"] for r in find_leaks(docs, bench, window=6, automaton_words=automaton_words).orderBy("doc_id").collect()]
        assert [x["clean_text"].split() for x in got] == [[], ["p", "q", "r"], ["nothing", "here"]]
        assert [x["n_hit"] for x in got] == [6, 6, 0] and [x["items"] for x in got] == [["2"], ["2"], []]
