"""Jaccard join of documents on word n-grams (operator 9).

A document's set holds the 64-bit hashes of its distinct n-word shingles.
Documents with equal sets form a class; one of each class goes on.

Tiles: under one order of all shingles (rare before frequent, then by hash),
two sets that link share a shingle among the first few of each. A tile is such
a shingle with the sets that have it among their first, in order of size, so
that only a narrow band of sizes meets a set. Rounds link them:

1. In two rounds, each set, in a few of its tiles, with the one before it and
   the first of its band (so at most some pairs a set), and components of the
   links that hold.
2. In tiles that still hold several components, all pairs across them but none
   inside the largest. So large groups of near copies stay about linear.

A pair is first bounded by bitmaps of as many hash bits as the set has
shingles: a bit that only one of them has set is a shingle that only it has.
What passes is settled by intersecting the sorted sets.

Only the order of shingles uses their counts; any order gives all links.

Defined cases: a null, empty or blank text has an empty set and is linked with
nothing; rows with one doc_id count as one document; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, connected_components, kept_by_worker, maybe_in, staged, table
from .words import SPACED, split

BUCKETS = 1 << 21
#: tiles (a set's rarest first) in which it is linked before all pairs across components are made
ROUNDS = ((1, 4), (5, 12))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of a shorter text the one of all its words."""
    words = split(text, SPACED)
    hashes = kept_by_worker("words", "xxh3", _WordHashes)
    if len(hashes) > 200_000:
        hashes.clear()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    x = np.full(len(w) - size + 1 if size else 0, size, np.uint64)
    for k in range(size):
        x = x * _STEP + w[k : len(w) - size + 1 + k]
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return np.unique(x)


def bitmap(x: np.ndarray) -> bytes:
    """One hash bit a shingle, in as many bits as there are shingles or more."""
    bits = max(64, 1 << max(0, int(len(x) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(x % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def most_shared(a: bytes, na: int, b: bytes, nb: int) -> int:
    """No two sets with these bitmaps and sizes share more."""
    if len(a) > len(b):
        a, na, b, nb = b, nb, a, na
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    only = lambda p, q: int(np.bitwise_count(p & ~q).sum(dtype=np.int64))
    return min(na - only(x, y), nb - only(y, x))


def _arrow(df: DataFrame, schema: str, rows) -> DataFrame:
    """Rows of ``rows(batch as lists of columns)`` for each Arrow batch."""
    out = to_arrow_schema(T.DataType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            cols = rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    return df.mapInArrow(run, schema)


def shingle_levels(docs: DataFrame, n: int) -> np.ndarray:
    """How frequent the shingles of each of ``BUCKETS`` hash buckets are, in
    eighths of a power of two; 0 for rare ones.

    All documents are counted, batch by batch; a shingle counts where a batch
    has it in two sets or more, so what is sent is small, and a shingle of a
    few dozen documents is noticed at any size of the corpus.
    """

    def rows(batch):
        sets = {(x := shingle_set(t.as_py(), n)).tobytes(): x for t in batch.column(0)}
        if not sets:
            return [[], []]
        x, c = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        return [(x[c > 1] % np.uint64(BUCKETS)).astype(np.int64), c[c > 1].astype(np.int64)]

    found = _arrow(docs.select("text"), "b long, c long", rows).groupBy("b").agg(F.sum("c").alias("c"))
    level = F.least(F.floor(F.log2(F.col("c").cast("double")) * 8), F.lit(255)).cast("short").alias("l")
    got = found.filter("c >= 4").select(F.col("b").cast("int").alias("b"), level).toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[got["b"].to_numpy()] = got["l"].to_numpy()
    return out


def sets_of(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``doc_id, n, k1, k2, first array<long>, bits binary`` for each row:
    size, 128-bit key of the set (null if empty), its first shingles in the
    common order, and its bitmap."""
    # BUCKETS bytes, whatever the corpus
    sent = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, n))

    def rows(batch):
        levels, out = sent.value, [[], [], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = shingle_set(text.as_py(), n)
            key = xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None
            k1, k2 = np.frombuffer(key, np.int64).tolist() if key else (None, None)
            by = np.argsort(levels[(x % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")
            p = len(x) - (num * len(x) + den - 1) // den + 1 if len(x) else 0
            values = (doc_id, len(x), k1, k2, x[by[:p]].view(np.int64), bitmap(x))
            for c, v in zip(out, values):
                c.append(v)
        return out

    schema = "doc_id long, n long, k1 long, k2 long, first array<long>, bits binary"
    return _arrow(docs.select("doc_id", "text"), schema, rows)


def _needed(na, nb, num: int, den: int):
    """The least overlap of two linked sets of these sizes."""
    return (num * (na + nb) + num + den - 1) // (num + den)


def _across(tiles: DataFrame, num: int, den: int, block: int = 1 << 20) -> DataFrame:
    """Pairs ``a, b`` of sets of one tile in different components.

    ``tiles``: ``tile, n, id, pos, comp``, tiles dealt whole to partitions and
    sorted by tile and n. Sets of a tile's largest component are not paired
    with each other; pairs are made block by block.
    """

    def pairs(n, ids, pos, comp):
        names, at, counts = np.unique(comp, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        major = at == counts.argmax()
        other = np.flatnonzero(~major)
        # sets of a size that can link with each of the others
        lo = np.searchsorted(n, (num * n[other] + den - 1) // den, "left")
        hi = np.searchsorted(n, den * n[other] // num, "right")
        width = hi - lo
        for part in np.split(np.arange(len(other)), np.flatnonzero(np.diff(np.cumsum(width) // block)) + 1):
            w = width[part]
            i = np.repeat(other[part], w)
            j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(lo[part], w)
            ok = (at[i] != at[j]) & (major[j] | (i < j))
            i, j = np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])  # i is not larger: rows are in order of size
            need = _needed(n[i], n[j], num, den)
            index = n[i] - (2 * num * n[i] + num + den - 1) // (num + den) + 1
            ok = (pos[i] < index) & (1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= need)
            if ok.any():
                yield ids[i[ok]], ids[j[ok]]

    def run(batches):
        held: list[np.ndarray] = []

        def flush(upto):
            tile, n, ids, pos, comp = upto
            cuts = np.flatnonzero(np.diff(tile)) + 1
            for part in zip(*(np.split(x, cuts) for x in (n, ids, pos, comp))):
                for a, b in pairs(*part):
                    yield np.stack([np.minimum(a, b), np.maximum(a, b)])

        def once(found):
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def tiles_of():
            nonlocal held
            for batch in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
                last = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
                if last:
                    yield from flush([x[:last] for x in held])
                    held = [x[last:] for x in held]
            if held and len(held[0]):
                yield from flush(held)

        found, size = [], 0  # a pair of several tiles is sent once, as far as a block goes
        for pair in tiles_of():
            found.append(pair)
            size += pair.shape[1]
            if size >= block:
                yield once(found)
                found, size = [], 0
        if found:
            yield once(found)

    return tiles.select("tile", "n", "id", "pos", "comp").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b) that link: bitmaps first, then the sets."""
    side = lambda s, cols: reps.select(F.col("doc_id").alias(s), *(F.col(c).alias(c + s) for c in cols))
    joined = pairs.join(side("a", ["n", "bits"]), "a").join(side("b", ["n", "bits"]), "b")

    def bounded(batch):
        a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
        need = _needed(na, nb, num, den)
        keep = [
            k for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5)))
            if most_shared(x.as_py(), int(na[k]), y.as_py(), int(nb[k])) >= need[k]
        ]
        return [a[keep], b[keep]]

    left = staged(_arrow(joined.select("a", "b", "na", "nb", "bitsa", "bitsb"), "a long, b long", bounded), "bounded")
    ids = staged(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")

    def sets(batch):
        found = [shingle_set(t.as_py(), n).tobytes() for t in batch.column(1)]
        return [batch.column(0).to_numpy(zero_copy_only=False), found]

    texts = maybe_in(docs.select("doc_id", "text"), "doc_id", ids).join(ids, "doc_id", "left_semi")
    full = staged(_arrow(texts, "doc_id long, s binary", sets), "sets")
    side2 = lambda s: full.select(F.col("doc_id").alias(s), F.col("s").alias("s" + s))

    def exact(batch):
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep = []
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if den * shared >= num * (len(x) + len(y) - shared):
                keep.append(k)
        return [a[keep], b[keep]]

    return _arrow(left.join(side2("a"), "a").join(side2("b"), "b").select("a", "b", "sa", "sb"), "a long, b long", exact)


def _named(tiles: DataFrame, stars: DataFrame | None) -> DataFrame:
    """``tiles`` with ``comp``; tiles of one component are done and left out."""
    if stars is None:
        return tiles.withColumn("comp", F.col("id"))
    alone = Window.partitionBy("tile")
    named = tiles.join(stars.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    ends = {"_lo": F.min("comp").over(alone), "_hi": F.max("comp").over(alone)}
    return named.withColumns(ends).filter("_lo <> _hi").drop("_lo", "_hi", "component")


def _neighbours(named: DataFrame, num: int, den: int) -> DataFrame:
    """Each set with others of its tile, of another component and a size that
    can link: the one before it in size, and the first of its band of sizes."""
    near = Window.partitionBy("tile").orderBy("n", "id")
    band = Window.partitionBy("tile", "band").orderBy("id")
    size = F.log(F.col("n").cast("double")) / float(np.log(den / num))
    one = F.struct("id", "n", "comp")
    others = F.array(F.lag(one).over(near), F.first(one).over(band))
    out = named.withColumn("band", F.floor(size)).select("id", "n", "comp", "turn", others.alias("_o"))
    out = out.select("id", "n", "comp", "turn", F.explode("_o").alias("o")).filter("comp <> o.comp")
    return out.filter((F.col("o.n") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("o.n") * num))


def _joined(stars: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the links so far and the new ones."""
    if stars is not None:
        links = links.union(stars.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return checkpointed(connected_components(links))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``: two
    documents link when ``den * shared >= num * together``."""
    docs = docs.select("doc_id", "text")
    sets = staged(sets_of(docs, n, num, den), "sets")
    classes = staged(sets.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    owner = classes.select("k1", "k2", F.col("rep").alias("doc_id"))
    reps = sets.join(owner, ["doc_id", "k1", "k2"], "left_semi")

    rows = reps.select(F.col("doc_id").alias("id"), "n", F.posexplode("first").alias("pos", "tile")).distinct()
    alone = Window.partitionBy("tile")
    tiles = rows.withColumn("_c", F.count(F.lit(1)).over(alone)).filter("_c > 1")
    turn = F.row_number().over(Window.partitionBy("id").orderBy("pos")).alias("turn")
    tiles = staged(tiles.select("tile", "n", "id", F.col("pos").cast("long"), turn), "tiles")
    stars = None
    for first, last in ROUNDS:
        pairs = _neighbours(_named(tiles, stars), num, den).filter(F.col("turn").between(first, last))
        pairs = pairs.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b")).distinct()
        stars = _joined(stars, _verified(pairs, reps, docs, n, num, den))
    mixed = _named(tiles, stars).select("tile", "n", "id", "pos", "comp")
    dealt = mixed.repartition("tile").sortWithinPartitions("tile", "n", "id")
    components = _joined(stars, _verified(_across(dealt, num, den).distinct(), reps, docs, n, num, den))

    return (
        sets.join(classes, ["k1", "k2"], "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}

ORACLE_SQL = {
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(4, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)"""
}
