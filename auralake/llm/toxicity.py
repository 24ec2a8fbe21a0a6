"""Toxic spans and document scores by a linear-chain CRF (operator 2).

Tokens are words; a line of the text is one chain with tags O and T. A token's
emission sums the weights of the word and of its prefixes; transitions are
shared. Labels are known for documents only, so the tokens to learn from are
labelled at a distance: in a toxic document, a word is T where the word or one
of its prefixes occurs in far more toxic than clean documents; everything else
is O. Forward and backward messages give each token's probability of T. The
expected number of T tokens and their rate give the document's score by a
logistic regression; adjoining tokens of at least ``0.5`` are its spans.

Training reads whole texts of a sample of at most ``sample[0]`` toxic and
``sample[1]`` clean labelled documents, and of at most ``sample_bytes`` bytes of
either kind (those with the smallest hashes of doc_id and text, so that rows
with one doc_id are told apart and repeated rows count once), weighted back to
their true shares.

Defined cases: a null or empty text has no tokens and gets the score of none;
a document with several labels counts once for each; without both kinds of
label every score is the share of toxic ones (0 if there are none); repeated
rows are judged one by one; an empty table gives no rows; extra columns pass
through, a column named ``toxicity`` is replaced.
"""

from __future__ import annotations

import math
import uuid
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_groups, kept_by_worker, table
from .language_id import fold
from .words import ALNUM, places

PREFIXES = (4, 5, 6, 7, 8)  # in bytes
TOXICITY = (
    "score double, predicted int, expected double, spans array<struct<start:int,end:int,p:double>>"
)


def lowered(text: str) -> str:
    """Lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def lines_of(text: str | None) -> list[list[bytes]]:
    """Words of each line that has some."""
    if not text:
        return []
    split = (line.translate(ALNUM).split() for line in lowered(text).encode("utf-8", "surrogatepass").split(b"\n"))
    return [words for words in split if words]


def features(word: bytes) -> list[int]:
    """Hashes of the word itself (marked) and of its prefixes."""
    return [xxhash.xxh3_64_intdigest(f) for f in (b"=" + word, *(word[:n] for n in PREFIXES if len(word) >= n))]


class Chains:
    """Tokens of several chains, laid out step by step: all first tokens (of
    the longest chain first), then all second ones, and so on."""

    def __init__(self, lengths: np.ndarray):
        by_length = np.argsort(-lengths, kind="stable")
        self.longest = int(lengths.max()) if len(lengths) else 0
        # chains with more than t tokens
        self.active = (len(lengths) - np.cumsum(np.bincount(lengths, minlength=self.longest + 1)))[: self.longest]
        self.begin = np.concatenate(([0], np.cumsum(self.active)))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        rank = np.empty(len(lengths), np.int64)
        rank[by_length] = np.arange(len(lengths))
        step = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
        self.place = (self.begin[step] + np.repeat(rank, lengths)).astype(np.int32)

    def messages(self, emission: np.ndarray, links: np.ndarray):
        """Marginals of T, in token order, and the expected link counts.

        ``links[i, j]`` is the score of tag j after tag i; odds of T against O
        are all that the messages need."""
        c = np.exp(links)
        e = np.empty(len(emission))
        e[self.place] = np.exp(np.clip(emission, -30, 30))
        ahead, behind, counts = np.empty(len(e)), np.ones(len(e)), np.zeros((2, 2))
        for t in range(self.longest):
            lo, hi = self.begin[t], self.begin[t + 1]
            if t:
                r = ahead[self.begin[t - 1] :][: hi - lo]
                ahead[lo:hi] = e[lo:hi] * (c[0, 1] + c[1, 1] * r) / (c[0, 0] + c[1, 0] * r)
            else:
                ahead[lo:hi] = e[lo:hi]
        for t in range(self.longest - 2, -1, -1):
            lo, n = self.begin[t], self.active[t + 1]
            x = e[self.begin[t + 1] :][:n] * behind[self.begin[t + 1] :][:n]
            behind[lo : lo + n] = (c[1, 0] + c[1, 1] * x) / (c[0, 0] + c[0, 1] * x)
            r = ahead[lo : lo + n]
            pairs = np.stack([np.full(n, c[0, 0]), c[0, 1] * x, c[1, 0] * r, c[1, 1] * r * x])
            counts += (pairs / pairs.sum(0)).sum(1).reshape(2, 2)
        odds = ahead * behind
        return (odds / (1 + odds))[self.place], counts


@dataclass
class Model:
    weights: dict[int, float]  # of features, by hash
    bias: float
    links: np.ndarray
    scorer: np.ndarray | None  # weights of document features
    prior: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def emission(self, word: bytes) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


class _Emissions(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> float:
        self[word] = e = self.model.emission(word)
        return e


def _emissions_of(model: Model, most: int = 200_000) -> _Emissions:
    """Emissions of the words that this worker has met; bounded."""
    known = kept_by_worker("emissions", model.key, lambda: _Emissions(model))
    if len(known) > most:
        known.clear()
    return known


def document_features(expected: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    rate = expected / np.maximum(tokens, 1)
    return np.stack([np.ones(len(expected)), np.log1p(expected), np.minimum(expected, 4), np.log1p(100 * rate)], 1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps of a weighted logistic regression."""
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(50):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str | None, int]], prior: float, rounds: int = 30, support: int = 5, lift: float = 12.0) -> Model:
    """Fit the CRF and the document scorer to (text, label) rows."""
    labels = np.array([y for _, y in rows], float)
    if not 0 < labels.sum() < len(labels):
        return Model({}, 0.0, np.zeros((2, 2)), None, prior)
    # words and features as numbers: only each distinct word is kept once as a string
    word_ids: dict[bytes, int] = {}
    tokens, lengths, sizes = array("i"), array("i"), []
    for text, _ in rows:
        before = len(tokens)
        for line in lines_of(text):
            lengths.append(len(line))
            tokens.extend(word_ids.setdefault(w, len(word_ids)) for w in line)
        sizes.append(len(tokens) - before)
    tokens, lengths = np.array(tokens, np.int32), np.array(lengths, np.int64)
    doc_of = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    hashes, each = array("Q"), array("i")
    for w in word_ids:
        own = features(w)
        hashes.extend(own)
        each.append(len(own))
    n_words, each = len(word_ids), np.array(each, np.int64)
    del word_ids
    names, feature_at = np.unique(np.array(hashes, np.uint64), return_inverse=True)
    del hashes
    word_at, first = np.repeat(np.arange(n_words), each), np.cumsum(each) - each

    seen = np.zeros((2, len(names)))
    for k, part in enumerate(np.split(tokens, np.cumsum(sizes)[:-1])):
        words = np.unique(part)
        n = each[words]
        at = np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        seen[int(labels[k]), np.unique(feature_at[at])] += 1
    n0, n1 = len(labels) - labels.sum(), labels.sum()
    telling = (seen[1] >= support) & ((seen[1] + 0.5) / (n1 + 1) >= lift * (seen[0] + 0.5) / (n0 + 1))
    tells = np.bincount(word_at, telling[feature_at], n_words) > 0
    marked = tells[tokens] & (labels[doc_of] == 1)
    kept = seen.sum(0) >= support
    number = np.cumsum(kept) - 1
    used = kept[feature_at]
    word_at, feature_at, names = word_at[used], number[feature_at[used]], names[kept]

    weight = np.where(labels == 1, prior / n1, (1 - prior) / n0) * len(labels)
    chains = Chains(lengths)
    ends = np.cumsum(lengths)
    inner = np.ones(len(tokens), bool)
    inner[ends - 1] = False  # a chain's last token links to none
    a = np.flatnonzero(inner)
    gold = np.zeros((2, 2))
    np.add.at(gold, (marked[a].astype(int), marked[a + 1].astype(int)), 1)

    w, bias, links = np.zeros(len(names)), -3.0, np.zeros((2, 2))
    sums = [np.full(len(names), 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(rounds):  # Adagrad on the whole sample
        emit = bias + np.bincount(word_at, w[feature_at], n_words)
        p, counts = chains.messages(emit[tokens], links)
        by_word = np.bincount(tokens, p - marked, n_words)
        grads = [
            np.bincount(feature_at, by_word[word_at], len(names)) + 0.05 * w,
            float(by_word.sum()),
            (counts - gold) + 0.05 * links,
        ]
        for k, g in enumerate(grads):
            sums[k] = sums[k] + np.square(g)
        w = w - 0.5 * grads[0] / np.sqrt(sums[0])
        bias -= 0.5 * grads[1] / math.sqrt(sums[1])
        links = links - 0.5 * grads[2] / np.sqrt(sums[2])
    emit = bias + np.bincount(word_at, w[feature_at], n_words)
    p, _ = chains.messages(emit[tokens], links)
    expected = np.bincount(doc_of, p, len(rows))
    x = document_features(expected, np.array(sizes))
    weights = {int(f): float(v) for f, v in zip(names, w) if abs(v) > 1e-3}
    return Model(weights, float(bias), links, logistic(x, labels, weight), prior)


def without_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_h, _b`` for ``text``: what tells a row apart, and the bytes of its text."""
    length = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.withColumns({"_h": F.xxhash64("doc_id", "text"), "_b": length}).drop("text")


def train(docs: DataFrame, labels: DataFrame | None = None, sample: tuple[int, int] = (1500, 3000), sample_bytes: int = 64 << 20, **options) -> Model:
    """Learn from ``doc_id``, ``text`` of ``docs`` and their ``toxic`` (0 or 1), there or in ``labels``.

    Labels meet rows without their texts; only the sample's rows, a bounded
    number, are broadcast to fetch theirs."""
    known = without_texts(docs)
    if labels is not None:
        known = known.join(labels.select("doc_id", "toxic"), "doc_id")
    known = known.filter("toxic IN (0, 1)")
    sizes = known.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("_n"), F.approx_count_distinct("_h").alias("_d"), F.min("_h").alias("_lo")
    )
    counts = {r["toxic"]: r["_n"] for r in sizes.collect()}
    most = F.when(F.col("toxic") == 1, sample[0]).otherwise(sample[1])
    # a hash below this keeps about twice the rows that are taken, and always one; two rows of sizes, two kinds
    share = (F.col("_h") / 2.0**64 + 0.5) * F.col("_d") < 2.0 * most
    near = known.select("toxic", "_h", "_b").join(F.broadcast(sizes), "toxic").filter(share | (F.col("_h") == F.col("_lo")))
    found = near.groupBy("toxic").agg(F.slice(F.sort_array(F.collect_set(F.struct("_h", "_b"))), 1, max(sample)).alias("first"))
    cuts = []
    for r in found.collect():
        total, cut = 0, None
        for h, size in r["first"][: sample[0] if r["toxic"] == 1 else sample[1]]:
            total += size
            if total > sample_bytes:
                break
            cut = h
        if cut is not None:
            cuts.append(f"(toxic = {int(r['toxic'])} AND _h <= {cut})")
    chosen = known.filter(" OR ".join(cuts) or "false").select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_t"), "_h").distinct()
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_own"))
    texts = texts.join(F.broadcast(chosen), F.col("_own").eqNullSafe(F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    rows = texts.select(F.col("_t").alias("toxic"), "_h", "text").dropDuplicates(["toxic", "_h"]).collect()
    kept = [(t or "", y) for y, _, t in sorted((r["toxic"], r["_h"], r["text"]) for r in rows)]
    total = sum(counts.values())
    return fit(kept, counts.get(1, 0) / total if total else 0.0, **options)


def score_texts(texts: list[str | None], model: Model) -> list[dict]:
    """``TOXICITY`` of each text."""
    emissions = _emissions_of(model)
    get = emissions.__getitem__
    values, lengths, sizes = [], [], []
    for text in texts:
        n = 0
        for words in lines_of(text):
            values.append(np.fromiter(map(get, words), np.float64, len(words)))
            lengths.append(len(words))
            n += len(words)
        sizes.append(n)
    sizes = np.array(sizes, np.int64)
    if model.scorer is None or not lengths:
        p = np.zeros(int(sizes.sum()))
    else:
        p, _ = Chains(np.array(lengths, np.int64)).messages(np.concatenate(values), model.links)
    ends = np.cumsum(sizes)
    total = np.concatenate(([0.0], np.cumsum(p)))
    expected = total[ends] - total[ends - sizes]
    if model.scorer is None:
        score = np.full(len(texts), model.prior)
    else:
        score = sigmoid(document_features(np.maximum(expected, 0), sizes) @ model.scorer)
    out = []
    for text, s, x, lo, hi in zip(texts, score.tolist(), expected.tolist(), ends - sizes, ends):
        spans = offending(text, p[lo:hi]) if hi > lo and p[lo:hi].max() >= 0.5 else []
        out.append({"score": s, "predicted": int(s >= 0.5), "expected": max(x, 0.0), "spans": spans})
    return out


def offending(text: str, p: np.ndarray) -> list[dict]:
    """Character ranges of adjoining tokens of at least one half."""
    low = lowered(text)
    data, where = low.encode("utf-8", "surrogatepass"), places(low, ALNUM)
    spans, last = [], -2
    for k in np.flatnonzero(p >= 0.5).tolist():
        start, end = (len(data[:b].decode("utf-8", "surrogatepass")) for b in where[k])
        if k == last + 1:
            spans[-1]["end"], spans[-1]["p"] = end, max(spans[-1]["p"], float(p[k]))
        else:
            spans.append({"start": start, "end": end, "p": float(p[k])})
        last = k
    return spans


def score_documents(docs: DataFrame, model: Model, group: int = 500, group_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with ``toxicity`` (``TOXICITY``); at most ``group`` texts are
    scored together, and of more than ``group_bytes`` only one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("toxicity")
    text_at = kept.columns.index("text")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("expected", pa.float64()), ("spans", spans)])

    def run(batches):
        for whole in batches:
            for batch in in_groups(whole, text_at, group, group_bytes):
                found = pa.array(score_texts(batch.column(text_at).to_pylist(), sent.value), kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "toxicity"])

    return kept.mapInArrow(
        run, T.StructType([*kept.schema.fields, T.StructField("toxicity", T.DataType.fromDDL(TOXICITY))])
    )


def learned(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model of the labels that are not held out (crc32 mod 5 is 0)."""
    own = labels.filter(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    return train(docs.select("doc_id", "text"), own, **options)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, learned(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "toxicity.score",
        "toxicity.predicted",
        F.size("toxicity.spans").alias("n_spans"),
    )


QUERIES = {"op2_toxicity": op2_toxicity}
