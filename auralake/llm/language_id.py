"""Language identification by prediction by partial matching (operator 3).

For each language a context tree over bytes, up to ``order`` back, holds how
often each byte followed each context. Its statistics are frozen after
training. A byte costs ``-log2`` of its share in the longest known context, or
of the escape to the next shorter one (method C: as many escapes as there are
distinct followers) plus its cost there, down to 8 bits for a byte that was
never seen; a text's language is the one with the shortest total code.

Bytes are all 256, with ASCII letters lower-cased. A tree is kept as sorted
arrays of the byte strings that occurred, so its size goes with the training
texts and not with the alphabet. Because the statistics are frozen, a byte's
cost depends on it and the ``order`` bytes before alone: the distinct strings
of a block of text are looked up once for each language.

Training reads whole texts of a sample of at most ``per_language`` distinct
rows of each language, those with the smallest hashes of doc_id and text, so
that rows with one doc_id are told apart and repeated rows count once; counting
runs as a Spark aggregation over byte strings. The model has a part for each
distinct ``lang``, a megabyte or two for 600 texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
and so is everything if nothing can be learned; ties go to the first language
in order of name; repeated rows are judged one by one; rows with a null doc_id
can be learned from as any others; an empty table gives no rows; extra columns
pass through, columns named ``lang_pred``, ``lang_score`` and ``code_bits`` are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_groups, table

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: bytes, and rows, that are scored together
CHUNK, ROWS = 1 << 19, 512


def fold(column: str, modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


@dataclass
class Tree:
    """The contexts of one language, by length."""

    strings: list[np.ndarray]  # of depth + 1 bytes, big-endian, sorted
    direct: list[np.ndarray]  # bits of the last byte of each after the others
    contexts: list[np.ndarray]  # of depth bytes, sorted
    escape: list[np.ndarray]  # bits of the escape from each

    @classmethod
    def grown(cls, grams: np.ndarray, counts: np.ndarray, order: int) -> Tree:
        tree = cls([], [], [], [])
        for depth in range(order + 1):
            strings, at = np.unique(grams & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
            n = np.bincount(at.reshape(-1), counts, len(strings))
            contexts, at, kinds = np.unique(strings >> 8, return_inverse=True, return_counts=True)
            all_of = np.bincount(at.reshape(-1), n, len(contexts)) + kinds
            tree.strings.append(strings)
            tree.direct.append(np.log2(all_of[at.reshape(-1)]) - np.log2(n))
            tree.contexts.append(contexts)
            tree.escape.append(np.log2(all_of) - np.log2(kinds))
        return tree

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string of order + 1 bytes, in ascending order."""
        out = np.full(len(grams), 8.0)
        for depth, (strings, direct, contexts, escape) in enumerate(zip(self.strings, self.direct, self.contexts, self.escape)):
            own = grams & ((1 << 8 * (depth + 1)) - 1)
            at, known = _found(contexts, own >> 8)
            out += np.where(known, escape[at], 0)
            at, known = _found(strings, own)
            out = np.where(known, direct[at], out)
        return out


def _found(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


@dataclass
class Model:
    languages: list[str]
    order: int
    trees: list[Tree]


def count_grams(docs: DataFrame, size: int) -> DataFrame:
    """``lang, gram, n``: byte n-grams (up to 8 bytes, big-endian in a long)."""

    def run(batches):
        for batch in (g for b in batches for g in in_groups(b, 1, ROWS, CHUNK)):
            found: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = bytes(size - 1) + text.as_py().encode("utf-8", "surrogatepass").translate(LOWER)
                x = np.frombuffer(data, np.uint8).astype(np.int64)
                gram = sum(x[k : len(x) - size + 1 + k] << (8 * (size - 1 - k)) for k in range(size))
                found.setdefault(lang, []).append(gram)
            for lang, parts in found.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                )

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )


def train(labelled: DataFrame, order: int = 3, per_language: int = 600) -> Model:
    """Learn from ``text`` and ``lang``, null in neither, of ``labelled``."""
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("_h", F.xxhash64("doc_id", "text"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n"), F.min("_h").alias("_lo"))
    # a hash below this keeps about twice the rows that are taken, and always one
    share = (F.col("_h") / 2.0**64 + 0.5) * F.col("_n") < 2.0 * per_language
    near = known.select("lang", "_h").join(F.broadcast(sizes), "lang").filter(share | (F.col("_h") == F.col("_lo")))
    least = F.slice(F.sort_array(F.collect_set("_h")), 1, per_language)
    cuts = near.groupBy("lang").agg(F.array_max(least).alias("_cut"))
    sample = known.join(F.broadcast(cuts), "lang").filter("_h <= _cut").dropDuplicates(["lang", "_h"])
    got = count_grams(sample, order + 1).toPandas()
    trees, languages = [], sorted(got["lang"].unique())
    for lang in languages:
        own = got[got["lang"] == lang]
        trees.append(Tree.grown(own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64), order))
    return Model(languages, order, trees)


def code_lengths(texts: list[str], model: Model) -> np.ndarray:
    """Bits of each text in each language: texts x languages."""
    out, group, size = np.zeros((len(texts), len(model.languages))), [], 0
    pad, order = bytes(model.order), model.order

    def score() -> None:
        x = np.frombuffer(b"".join(d for _, d in group), np.uint8).astype(np.int64)
        grams = sum(x[k : len(x) - order + k] << (8 * (order - k)) for k in range(order + 1))
        grams, at = np.unique(grams.astype(np.uint32) if order < 4 else grams, return_inverse=True)
        grams, at = grams.astype(np.int64), at.reshape(-1)
        ends = np.cumsum([len(d) for _, d in group])
        bounds = np.stack([ends - [len(d) for _, d in group], ends - order], 1).reshape(-1)[:-1]
        rows = [r for r, _ in group]
        for k, tree in enumerate(model.trees):
            np.add.at(out[:, k], rows, np.add.reduceat(tree.costs(grams)[at], bounds)[::2])

    for row, text in enumerate(texts):
        data = pad + text.encode("utf-8", "surrogatepass").translate(LOWER)
        for start in range(order, len(data), CHUNK):  # each part of a long text brings its context along
            part = data[start - order : start + CHUNK]
            group.append((row, part))
            size += len(part)
            if size >= CHUNK:
                score()
                group, size = [], 0
    if group:
        score()
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (share of the language among
    all, from code lengths) and ``code_bits`` (bits of the text in it)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = {"lang_pred": T.StringType(), "lang_score": T.DoubleType(), "code_bits": T.DoubleType()}
    kept = docs.drop(*new)
    text_at = kept.columns.index("text")

    def run(batches):
        model = sent.value
        for batch in (g for b in batches for g in in_groups(b, text_at, ROWS, 4 * CHUNK)):
            texts = batch.column(text_at).to_pylist()
            known = [k for k, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
            pred, score, bits = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if known:
                cost = code_lengths([texts[k] for k in known], model)
                best = cost.argmin(1)
                least = cost.min(1)
                share = 1 / np.exp2(-np.minimum(cost - least[:, None], 1000)).sum(1)
                for row, k, p, b in zip(known, best, share, least):
                    pred[row], score[row], bits[row] = model.languages[k], p, float(b)
            cols = [pa.array(pred, pa.string()), pa.array(score), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *new])

    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in new.items())])
    return kept.mapInArrow(run, schema)


def learned(docs: DataFrame, **options) -> Model:
    """The model of the documents that are not held out (crc32 mod 4 is 2)."""
    return train(docs.filter(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"), **options)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), learned(docs)).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "code_bits"
    )


QUERIES = {"op3_language_id": op3_language_id}
