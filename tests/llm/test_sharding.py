import heapq
import zlib
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auralake.llm.sharding import schedule, shard_documents


def brute(sizes, shards):
    """Loads after each size, one group at a time, longest first."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        out.append((size, s))
        heapq.heappush(heap, (load + size, s))
    return out


def dealt(sizes, shards):
    out = []
    for size, lo, hi, turn in schedule(dict(Counter(sizes)), shards):
        out += [(size, turn[k % len(turn)]) for k in range(hi - lo)]
    return out


@given(st.lists(st.one_of(st.integers(1, 6), st.integers(1, 400)), max_size=120), st.integers(1, 7))
def test_schedule_is_that_of_one_group_at_a_time(sizes, shards):
    assert dealt(sizes, shards) == brute(sizes, shards)


def test_schedule_of_many_equal_groups():
    assert dealt([900] + [3] * 500 + [2] * 41, 8) == brute([900] + [3] * 500 + [2] * 41, 8)
    assert sum(hi - lo for _, lo, hi, _ in schedule({20: 10**12, 10**9: 3}, 40)) == 10**12 + 3
    assert schedule({}, 3) == []


def test_query_against_one_group_at_a_time(make_docs):
    texts = [f"{i % 90} " * (1 + i % 17) for i in range(500)] + ["same"] * 40
    got = shard_documents(make_docs(texts), shards=6).collect()
    group = Counter()
    for t in texts:
        group[t] += len(t.encode()) + 16
    want, load = Counter(), Counter()
    for size, s in brute(group.values(), 6):
        want[s] += size
    for r in got:
        load[r["shard"]] += r["size"]
    assert load == want


def test_groups_stay_together_and_slots_have_no_gaps(make_docs):
    texts = [f"text {i % 70} " * (1 + i % 9) for i in range(400)] + ["same"] * 150 + [None, None, "", "x" * 30_000]
    docs = make_docs(texts, extra={"size": F.lit(1), "shard": F.lit("clash"), "n": F.lit(2)})
    rows = shard_documents(docs, shards=5).collect()
    assert len(rows) == len(texts)
    where, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in rows:
        t = texts[r["doc_id"]]
        where[t].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert r["size"] == len((t or "").encode()) + 16
        assert r["text_crc32"] == zlib.crc32((t or "").encode())
    assert all(len(x) == 1 for x in where.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_loads_are_near_equal(make_docs):
    texts = [f"{i} " * (i % 50 + 1) for i in range(3000)]
    load = defaultdict(int)
    for r in shard_documents(make_docs(texts), shards=4).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.01 * min(load.values())


def test_repeated_rows_and_empty_table(make_docs):
    docs = make_docs(["a", "b"])
    got = shard_documents(docs.union(docs), shards=2).collect()
    assert len(got) == 4 and len({(r["shard"], r["slot"]) for r in got}) == 4
    assert shard_documents(docs.limit(0), shards=3).count() == 0
