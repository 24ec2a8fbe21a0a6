import math

import pytest
from pyspark.sql import functions as F

from auralake.llm.url_filter import DIMENSIONS, GRAMS, RULES, fitted, judge_urls, labelled_urls, scores, trained

URLS = [
    None, "", "no scheme", "://", "http://COM", "http://com/", "http://A.com/x", "http://acom/x", "http://example.com",
    "http://example.com/en/1", "http://example.com/en", "http://m.example.com/en/1?q", "http://www.example.com/en/1",
    "http://a.www.example.com/en/#x", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/1", "http://x.org?/es/",
    "http://é.NET/fr/ß", "http://user@x.net:80/fr/", "a://b://c.com/d", "http://casino-win.example.org/en/1",
    "http://ththre.example.org/en/1", "http://x.net/" + "a" * 50_000, "http://x.net/fr/\nline",
]


def score(host, path, w):
    """Gram by gram."""
    found = {0}
    for mark, part in ((1, host), (2, path)):
        data = b"^" + part.encode() + b"$"
        for n in GRAMS:
            for i in range(len(data) - n + 1):
                h = mark * 16 + n
                for b in data[i : i + n]:
                    h = (h ^ b) * 0x100000001B3 % 2**64
                found.add((h ^ h >> 29) % DIMENSIONS)
    return 1 / (1 + math.exp(-sum(w[g] for g in found) / math.sqrt(len(found)) - w[-1]))


def brute(url, w):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    if best:
        return host, path, *best
    return host, path, None, "block" if score(host, path, w) >= 0.5 else "allow"


def test_against_brute_force(spark):
    rows = list(enumerate(URLS + URLS[:5]))
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "verdict": F.lit(1)})
    w = trained().astype("float32").astype("float64")
    got = {r["page_id"]: r for r in judge_urls(pages).collect()}
    assert len(got) == len(rows)
    for k, url in rows:
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == brute(url, w), url
    assert judge_urls(pages.limit(0)).count() == 0


def test_scores_of_a_batch_are_those_of_each_url():
    w = trained()
    rows = [("", ""), ("a", ""), ("lucky.test", "/é/1"), ("x" * 500, "/"), ("", "/only/path")]
    assert scores([h for h, _ in rows], [p for _, p in rows], w) == pytest.approx([score(h, p, w) for h, p in rows])


def held_out(folds=6):
    """(true, found) of every url of the table, by a model that has not seen it."""
    rows, out = labelled_urls(), []
    for k in range(folds):
        w = fitted([r for i, r in enumerate(rows) if i % folds != k])
        test = [r for i, r in enumerate(rows) if i % folds == k]
        out += [(y, p >= 0.5) for (y, _, _), p in zip(test, scores([h for _, h, _ in test], [p for _, _, p in test], w))]
    return out


def test_the_model_tells_its_table_apart_and_generalises():
    w, rows = trained(), labelled_urls()
    assert all((score(h, p, w) >= 0.5) == bool(y) for y, h, p in rows)
    got = held_out()
    hit = sum(y and f for y, f in got)
    precision, recall = hit / sum(f for _, f in got), hit / sum(y for y, _ in got)
    print(f"held out: precision {precision:.2f}, recall {recall:.2f} of {len(got)}")
    assert precision >= 0.85 and recall >= 0.5
