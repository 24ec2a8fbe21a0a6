"""Document fingerprints: invertible Bloom lookup sketches (operator 4).

All of it is DataFrame and SQL expressions.

A text is cut at line ends and after sentence ends into paragraphs. Each
distinct paragraph with its number of occurrences has a 64-bit digest. A sketch
has three rows of eight cells; a digest goes to one cell of each row, which
counts its digests and xors them and their check values. Subtracting the
sketches of two versions leaves the digests that only one has. A cell with one
digest left shows it; taking it out of its other cells may free more
("peeling").

Where peeling gets stuck, both versions are sketched again over more cells: their
digests are dealt by their first bits to sketches of about ``LOAD`` digests each,
and where one of those gets stuck, by three bits more, until every one peels off.
So what differs is always recovered whole, in time in proportion to the digests
(and the sorting of them).

A fingerprint is the text's first sketch, written out. The likeness of two
texts is the share of digests that both have among those that one has.

Defined cases: a null text is empty; two empty texts are alike (1); a null
doc_id comes first, as the smallest number (which is read as null); of rows that
share a doc_id the next one is that with the next smaller hash of its text, and
wholly equal rows have the same next one; each row of the table has a row of its
own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import neighbours, table

NO_ID = -(2**63)
ROWS, WIDTH_BITS, FAN_BITS = 3, 3, 3
WIDTH = 1 << WIDTH_BITS
CELLS = ROWS * WIDTH
#: digests of two versions that are sketched together on average, after the first sketch
LOAD = 8
_NONE = "CAST(array() AS ARRAY<BIGINT>)"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _check(k: str) -> str:
    return f"(xxhash64({k}) & 4294967295L)"


def digests(text: str) -> str:
    """Sorted digests of the paragraphs of a SQL string expression."""
    hashes = f"sort_array(transform(filter(split({text}, '\\n|(?<=[.!?]) '), x -> x <> ''), x -> xxhash64(x)))"
    firsts = "filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i] <> s[i - 1])"
    counted = _let("f", firsts, "transform(f, (p, j) -> xxhash64(s[p], coalesce(get(f, j + 1), size(s)) - p))")
    return _let("s", hashes, f"if(size(s) = 0, {_NONE}, {counted})")


def items(keys: str, sign: int = 1) -> str:
    """Digests with their check values and the cells they go to, as a mask."""
    cells = " | ".join(
        f"shiftleft({1 << (WIDTH * r)}L, int(shiftrightunsigned(k, {WIDTH_BITS * r}) & {WIDTH - 1}L))" for r in range(ROWS)
    )
    return f"transform({keys}, k -> named_struct('k', k, 'h', {_check('k')}, 'm', {cells}, 's', {sign}))"


_EMPTY = f"array_repeat(named_struct('n', 0, 'k', 0L, 'h', 0L), {CELLS})"


def inserted(cells: str, added: str, sign: str) -> str:
    """Cells after items were put in (sign +) or taken out (-), cell by cell."""
    changed = f"named_struct('n', o.n {sign} q.s, 'k', o.k ^ q.k, 'h', o.h ^ q.h)"
    each = f"transform({cells}, (c, i) -> aggregate(filter(it, q -> getbit(q.m, i) = 1), c, (o, q) -> {changed}))"
    return _let("it", added, each)


def sketch(keys: str) -> str:
    """Cells of a SQL expression of digests."""
    return inserted(_EMPTY, items(keys), "+")


def subtract(x: str, y: str) -> str:
    return f"zip_with({x}, {y}, (a, b) -> named_struct('n', a.n - b.n, 'k', a.k ^ b.k, 'h', a.h ^ b.h))"


def peel(cells: str, rounds: int = 4) -> str:
    """``cells`` (what is left), ``mine`` and ``theirs`` (digests recovered)."""
    found = f"filter(st.cells, c -> (c.n = 1 OR c.n = -1) AND {_check('c.k')} = c.h)"
    signed = f"transform({found}, c -> named_struct('k', c.k, 's', c.n))"
    pure = f"array_distinct({signed})"
    full = "zip_with(pure, " + items("transform(pure, q -> q.k)") + ", (q, t) -> named_struct('k', t.k, 'h', t.h, 'm', t.m, 's', q.s))"
    side = lambda s, name: f"concat(st.{name}, transform(filter(pure, q -> q.s = {s}), q -> q.k))"
    step = (
        f"if(size(pure) = 0, st, named_struct('cells', {inserted('st.cells', full, '-')},"
        f" 'mine', {side(1, 'mine')}, 'theirs', {side(-1, 'theirs')}))"
    )
    start = f"named_struct('cells', {cells}, 'mine', {_NONE}, 'theirs', {_NONE})"
    return f"aggregate(sequence(1, {rounds}), {start}, (st, r) -> {_let('pure', pure, step)})"


_CLEAR = "forall(pl.cells, c -> c.n = 0 AND c.k = 0 AND c.h = 0)"


def recovered(a: str, b: str, cells_a: str | None = None, cells_b: str | None = None) -> str:
    """``mine`` and ``theirs``: the digests that only one of two SQL
    expressions of digests has.

    First from their sketches (``cells_a``, ``cells_b`` if they are at hand);
    where that gets stuck, sketched larger until all peel off.
    """
    first = peel(subtract(cells_a or sketch(a), cells_b or sketch(b)))
    return _let("pl", first, f"if({_CLEAR}, named_struct('todo', 0, 'mine', pl.mine, 'theirs', pl.theirs), {_larger(a, b)})")


def _larger(a: str, b: str) -> str:
    # the items of both, those of b with sign -, in order of their digests: what
    # shares first bits stands together, and the sketch of a part is the
    # difference of both sides' sketches, as sketches are sums
    both = f"sort_array(concat({items(a)}, {items(b, -1)}))"
    width = f"greatest(1, int(ceil(log2((size({a}) + size({b})) / {LOAD}D))))"
    bits = f"greatest(64 - (width + {FAN_BITS} * l), 0)"
    starts = f"filter(sequence(0, size(t) - 1), i -> i = 0 OR shiftrightunsigned(t[i].k, {bits}) <> shiftrightunsigned(t[i - 1].k, {bits}))"
    parts = _let("f", starts, "transform(f, (p, j) -> slice(t, p + 1, coalesce(get(f, j + 1), size(t)) - p))")
    tried = _let(
        "pl",
        peel(inserted(_EMPTY, "w", "+"), rounds=8),
        f"if({_CLEAR}, named_struct('w', slice(w, 1, 0), 'mine', pl.mine, 'theirs', pl.theirs),"
        f" named_struct('w', w, 'mine', {_NONE}, 'theirs', {_NONE}))",
    )
    each = f"transform(flatten(transform(s.todo, t -> {parts})), w -> {tried})"
    left = "filter(transform(tried, x -> x.w), w -> size(w) > 0)"
    done = lambda side: f"concat(s.{side}, flatten(transform(tried, x -> x.{side})))"
    step = _let("tried", each, f"named_struct('todo', {left}, 'mine', {done('mine')}, 'theirs', {done('theirs')})")
    start = f"named_struct('todo', array({both}), 'mine', {_NONE}, 'theirs', {_NONE})"
    folded = f"aggregate(sequence(0, {-(-64 // FAN_BITS)}), {start}, (s, l) -> if(size(s.todo) = 0, s, {step}))"
    return _let("width", width, _let("g", folded, "named_struct('todo', size(g.todo), 'mine', g.mine, 'theirs', g.theirs)"))


def written(cells: str) -> str:
    return f"array_join(transform({cells}, c -> concat_ws('.', hex(c.n), hex(c.k), hex(c.h))), '-')"


def likeness(a: str, b: str, cells_a: str | None = None, cells_b: str | None = None) -> Column:
    """Share of the digests in both among those in one, from what differs."""
    share = "if(total = 0, 1D, CAST(total - apart AS DOUBLE) / (total + apart))"
    apart = _let("r", recovered(a, b, cells_a, cells_b), "size(r.mine) + size(r.theirs)")
    return F.expr(_let("total", f"size({a}) + size({b})", _let("apart", apart, share)))


def edited_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text, edited`` and the digests ``own``, ``new`` (of the edited
    text) and ``other`` (of the next document)."""
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    following, n = neighbours(docs, "id")
    if repeated := n != docs.count():
        digest = F.md5(F.col("text").cast("binary")).alias("h")
        docs = docs.groupBy("id", digest).agg(F.max("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        docs = docs.select(F.struct("id", "h").alias("id"), "text", "copies")
        following, _ = neighbours(docs, "id")
    number = F.col("id.id") if repeated else F.col("id")
    copies = [F.expr("explode(sequence(1, int(copies)))").alias("_copy")] if repeated else []
    half = docs.select("id", F.floor(F.char_length("text") / 2).cast("int").alias("half"))
    asks = half.join(following, "id").select(F.col("id").alias("asker"), "half", "next_key")
    heads = docs.join(asks, F.col("id") == F.col("next_key")).select(
        "asker", "half", F.expr("substring(text, 1, half)").alias("head"), F.expr(digests("text")).alias("other")
    )
    # both joins shuffle (id, text) by id, so that is done once
    joined = docs.join(heads, F.col("id") == F.col("asker")).select(
        F.nullif(number, F.lit(NO_ID)).alias("doc_id"), "text", "other", *copies, F.expr("concat(substring(text, 1, char_length(text) - half), head)").alias("edited")
    ).drop("_copy")
    return joined.withColumns({"own": F.expr(digests("text")), "new": F.expr(digests("edited"))})


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    sketched = edited_documents(table(spark, sf_dir, "documents")).withColumns(
        {f"{c}_cells": F.expr(sketch(c)) for c in ("own", "new", "other")}
    )
    return sketched.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(written("own_cells")).alias("fingerprint"),
        F.expr(written("new_cells")).alias("edited_fingerprint"),
        likeness("own", "new", "own_cells", "new_cells").alias("near_edited"),
        likeness("own", "other", "own_cells", "other_cells").alias("near_next"),
    )


QUERIES = {"op4_document_fingerprints": op4_document_fingerprints}
