"""Benchmark decontamination by a generalised suffix automaton (operator 5).

The automaton holds the word sequences of all benchmark items. Documents stream
through it word by word; the state gives the longest suffix read that occurs in
some item, and its suffix links give every window (``window`` consecutive item
words, or a whole shorter item) that ends there. Words that no item has reset
the state, so only runs of benchmark words are walked.

An automaton holds at most ``automaton_words`` item words, which bounds what is
broadcast; a larger benchmark is split into several, and documents pass
through one after the other, which finds the same windows.

Spans that a window covers are removed from the text, and what then stands
together is searched again, round by round, until no window is left. A round
ends when all automata have had the text, so their number never changes the
result; rounds after the first only take the texts that the last one changed.
A document of which a share of more than ``max_coverage`` is covered is marked
to be dropped.

Defined cases: a null text has no words and stays null; items with no words are
ignored; item_ids that repeat count once; an empty benchmark leaves all
documents clean; extra columns pass through, a column named ``leak`` is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table
from .words import ALNUM, places, split

LEAK = "n_words long, spans array<long>, items array<string>, clean_text string, left array<long>, open boolean"


class SuffixAutomaton:
    """Of several word sequences. ``ends[v]``: (window length, items) for each
    window that is a suffix of the strings of state v."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(k, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]) for k, words in items if words]
        for _, words in coded:
            last = 0
            for c in words:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(w) for _, w in coded)])
        found: list[dict[int, set[str]]] = [{} for _ in self.next]
        for k, words in coded:
            size, v = min(window, len(words)), 0
            for i, c in enumerate(words):
                v = self.next[v][c]
                if i + 1 >= size:
                    u = v
                    while self.len[self.link[u]] >= size:
                        u = self.link[u]
                    found[u].setdefault(size, set()).add(k)
        self.ends: list[tuple] = [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            self.ends[v] = self.ends[self.link[v]] + tuple((n, frozenset(x)) for n, x in sorted(found[v].items()))

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = self._state(self.len[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, length: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(0)
        self.len.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Covered word ranges, merged, and the items whose windows occur."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids > 0, [False]))))
        spans: list[list[int]] = []
        items: set[str] = set()
        for lo, hi in edges.reshape(-1, 2):
            if hi - lo < self.shortest:
                continue
            v = length = 0
            for i, c in enumerate(ids[lo:hi].tolist(), int(lo) + 1):
                while v and c not in self.next[v]:
                    v = self.link[v]
                    length = self.len[v]
                if c in self.next[v]:
                    v, length = self.next[v][c], length + 1
                longest = 0
                for n, of in self.ends[v]:
                    if n <= length:
                        items |= of
                        longest = max(longest, n)
                if longest:
                    start = i - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i])
        return spans, items


def without(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    data, at, out = text.encode("utf-8", "surrogatepass"), 0, []
    where = places(text, ALNUM)
    for lo, hi in spans:
        out.append(data[at : where[lo][0]])
        at = where[hi - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def automata(benchmark: DataFrame, window: int, automaton_words: int) -> Iterator[SuffixAutomaton]:
    """One automaton for each ``automaton_words`` words of the items, in turn."""
    held, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = split(row[1], ALNUM)
        if words and n and n + len(words) > automaton_words:
            yield SuffixAutomaton(held, window)
            held, n = [], 0
        held.append((row[0], words))
        n += len(words)
    if n:
        yield SuffixAutomaton(held, window)


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and out[-1][1] >= lo:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _search(docs: DataFrame, automaton: SuffixAutomaton | None, first: bool, last: bool, alone: bool) -> DataFrame:
    """``leak`` after one automaton of a round has had the texts.

    ``left``: what the round has found so far. The ``last`` automaton of a round
    ends it: what was found is cut out, and texts that this changed are open. An
    automaton that is ``alone`` goes through all rounds at once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(automaton)
    schema = T.StructType(docs.schema.fields)
    longs = pa.list_(pa.int64())
    kind = pa.struct(
        [("n_words", pa.int64()), ("spans", longs), ("items", pa.list_(pa.string())), ("clean_text", pa.string())]
        + [("left", longs), ("open", pa.bool_())]
    )
    flat = lambda spans: [x for s in spans for x in s]
    paired = lambda x: np.array(x or [], np.int64).reshape(-1, 2).tolist()

    def one(text: str | None, seen: dict) -> dict:
        found = sent.value
        clean = text if seen["clean_text"] is None else seen["clean_text"]
        words = split(clean, ALNUM)
        spans, items = found.matches(words) if found and words else ([], set())
        left = merged(paired(seen["left"]) + spans)
        out = seen | {"left": flat(left), "clean_text": clean, "open": True}
        if first:
            out |= {"n_words": len(words), "spans": out["left"], "items": sorted({*(seen["items"] or []), *items})}
        if last:
            out |= {"left": [], "open": bool(left) and not alone}
            while left:
                clean = without(clean, left)
                left = found.matches(split(clean, ALNUM))[0] if alone else []
            out["clean_text"] = clean
        return out

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            text, leak = batch.schema.get_field_index("text"), batch.schema.get_field_index("leak")
            rows = [one(t.as_py(), x.as_py()) for t, x in zip(batch.column(text), batch.column(leak))]
            yield batch.set_column(leak, "leak", pa.array(rows, kind))

    return docs.mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, automaton_words: int = 200_000
) -> DataFrame:
    """``docs`` with ``leak``: ``n_words``, ``n_hit``, ``spans`` (word ranges
    covered, as lo, hi, lo, hi, …), ``items``, ``clean_text``, ``drop``."""
    kind = T.DataType.fromDDL(LEAK)
    found = docs.withColumn("leak", F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields)))

    def through(found: DataFrame, first: bool) -> tuple[DataFrame, bool]:
        """One round, and whether it was the only one needed."""
        several = automata(benchmark, window, automaton_words)
        automaton, after, alone = next(several, None), next(several, None), True
        while after is not None:
            alone = False
            found = staged(_search(found, automaton, first, False, False), "leaks")
            automaton, after = after, next(several, None)
        return _search(found, automaton, first, True, alone), alone

    found, done = through(found, True)
    parts = []
    while not done:
        found = staged(found, "round")
        parts.append(found.filter("NOT leak.open"))
        found = found.filter("leak.open")
        done = found.isEmpty()
        if not done:
            found, done = through(found, False)
    for part in parts:
        found = found.unionByName(part)
    spans = F.col("leak.spans")
    n_hit = F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return found.withColumn(
        "leak",
        F.struct(
            "leak.n_words", n_hit.alias("n_hit"), "leak.spans", "leak.items", "leak.clean_text",
            (n_hit > F.lit(max_coverage) * F.col("leak.n_words")).alias("drop"),
        ),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), window=10).select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("leak.items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op5_decontamination": op5_decontamination}

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL = {
    "op5_decontamination": rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, p, h.n, item_id
  FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM places) h JOIN windows USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""
}
