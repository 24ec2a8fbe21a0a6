import json
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auralake.llm.packing import best_fit, cut, pack_documents, sequences
from auralake.llm.token_files import Codes, read_token_files, tokens_at, write_codes, write_token_files
from auralake.llm.tokens import Encoder, cuts_at_blanks, default_path

ODD = [
    None, "", " ", "\n", "a", "a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "a\n", "\na", "don't it's 's",
    "tab\tin side", "a\t b", "a b  c", " a b", "x  y", "1 22 333 a1b2", "<|endoftext|> a <|endoftext|>b",
    "é à ñ 你好 世界 🎉 🎉🎉", "!!! ### $$$", "a\r\nb\r\n", "a\x1cb \x1c c", "word " * 3000, "long" * 9000,
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def random_texts(n=400, seed=5):
    r = random.Random(seed)
    words = ["the", "Foo,", "bar.", "été", "\n", "\t", " ", "x1", "it's", "$$$", "ñ", " ", "-", "\n\n", "a" * 30]
    return ["".join(r.choice(words) + r.choice([" ", " ", "\n", ""]) for _ in range(r.randrange(60))) for _ in range(n)]


def test_pieces_give_the_ids_of_whole_texts(plain):
    texts = ODD + random_texts()
    for most in (200_000, 10):
        got = Encoder(default_path(), most_pieces=most).encode(texts, group=7)
        for text, ids in zip(texts, got, strict=True):
            assert ids.tolist() == plain(text), ascii(text)[:80]


def test_letters_with_punctuation_around(plain):
    r = random.Random(8)
    words = ["Foo", "été", "ñ", "你好", "ªº", "ǅ", "x", "Ⅷ", "²", "a\u0301", "ﬁ", "don't", "endoftext", ""]
    around = ["", ".", ",", "...", '("', '"', ").", "--", "?!", "'", "<|", "|>", "\x01", "1"]
    pieces = [r.choice(around) + r.choice(words) + r.choice(around) for _ in range(900)]
    texts = [r.choice([" ", "\n"]).join(pieces[k : k + 9]) for k in range(0, 900, 9)]
    for text, ids in zip(texts, Encoder(default_path()).encode(texts), strict=True):
        assert ids.tolist() == plain(text), ascii(text)


def test_other_tokenizers_encode_whole_texts(tmp_path, plain):
    spec = json.loads(open(default_path(), encoding="utf-8").read())
    assert cuts_at_blanks(spec)
    added = {"id": 50257, "content": "two words", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [added]}):
        assert not cuts_at_blanks(spec | change)
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(spec | {"normalizer": {"type": "Lowercase"}}), encoding="utf-8")
    (ids,) = Encoder(str(path)).encode(["Some TEXT\nand More"])
    assert ids.tolist() == plain("some text\nand more")


def test_long_text_in_chunks(plain):
    text = "alpha beta\ngamma's " * 130_000 + "end"
    (ids,) = Encoder(default_path()).encode([text])
    assert ids.tolist() == plain(text)


def test_best_fit_fills_every_slot_once():
    r = random.Random(1)
    for _ in range(30):
        cap = r.choice([7, 16, 100])
        hist = {n: r.randrange(1, 200) for n in r.sample(range(1, cap + 1), r.randrange(1, min(cap, 12)))}
        taken: dict = {}
        for length, lo, hi, seq, each, off in best_fit(hist, cap):
            for k in range(hi - lo):
                taken.setdefault(seq + k // each, []).append((off + k % each * length, length, lo + k))
        ranks: dict = {}
        for parts in taken.values():
            at = 0
            for off, length, rank in sorted(parts):
                assert off == at
                at += length
                ranks.setdefault(length, []).append(rank)
            assert at <= cap
        assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in hist.items()}
        # against first-fit decreasing, piece by piece
        bins = []
        for n in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
            k = next((i for i, free in enumerate(bins) if free >= n), None)
            if k is None:
                bins.append(cap - n)
            else:
                bins[k] -= n
        assert len(taken) <= len(bins) * 1.02 + 1


def test_packing(make_docs, plain):
    texts = [t for t in ODD if t is None or len(t) < 40_000] + ["same text"] * 200 + random_texts(80)
    docs = make_docs(texts, extra={"length": F.lit("clash"), "n": F.lit(1), "offset": F.lit(0)})
    packed = pack_documents(docs, capacity=64, end_id=2, keep_ids=True)
    rows = packed.collect()
    ids = {i: plain(t) + [2] for i, t in enumerate(texts)}
    by_doc: dict = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for i, x in ids.items():
        assert sorted(by_doc[i]) == [(k, s, n) for k, (s, n) in enumerate(cut(len(x), 64))]
    lengths = {r["sequence_id"]: len(r["ids"]) for r in sequences(packed).collect()}
    assert max(lengths.values()) <= 64 and sum(lengths.values()) == sum(map(len, ids.values()))
    assert len(lengths) <= 1.03 * sum(map(len, ids.values())) / 64 + 1
    assert pack_documents(docs.limit(0)).count() == 0
    twice = pack_documents(docs.union(docs), capacity=64).collect()
    assert len(twice) == 2 * len(rows) and len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)


def test_codes_round_trip():
    r = np.random.default_rng(3)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], r.integers(0, 50_000, 5000), r.integers(0, 255, 1025)):
        ids = np.array(ids, np.uint32)
        codes = Codes(write_codes(ids))
        assert codes.n == len(ids) and [codes[i] for i in range(len(ids))] == ids.tolist()
        for _ in range(50):
            lo = int(r.integers(0, len(ids) + 1))
            hi = int(r.integers(lo, len(ids) + 1))
            assert codes.read(lo, hi).tolist() == ids[lo:hi].tolist()


def test_token_files(spark, make_docs, plain):
    texts = ODD + random_texts(60)
    docs = make_docs(texts, extra={"start": F.lit("clash"), "part": F.lit(9)}).repartition(5)
    rows = read_token_files(write_token_files(docs, end_id=0, block_tokens=300)).orderBy("doc_id").collect()
    at = 0
    for i, r in enumerate(rows):
        ids = plain(texts[i]) + [0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(r) == (i, at, len(ids), crc)
        at += len(ids)
    assert len(rows) == len(texts)
    assert read_token_files(write_token_files(docs.limit(0))).count() == 0
    small = docs.filter("doc_id < 3")
    assert read_token_files(write_token_files(small.union(small))).count() == 6


def test_single_ids_from_files(spark, make_docs, plain):
    texts = ODD + random_texts(60)
    blocks = write_token_files(make_docs(texts).repartition(5), end_id=0, block_tokens=300)
    ids = [i for t in texts for i in plain(t) + [0]]
    r = random.Random(4)
    asked = [0, len(ids) - 1, len(ids), -1, *r.choices(range(len(ids)), k=1000)]
    positions = spark.createDataFrame([(p,) for p in asked], "position long")
    for span in (64, 1 << 17):
        got = {x["position"]: x["id"] for x in tokens_at(blocks, positions, span).collect()}
        assert got == {p: ids[p] for p in asked if 0 <= p < len(ids)}
    path = blocks.inputFiles()[0]
    column = pq.ParquetFile(path.removeprefix("file://")).metadata.row_group(0).column(6)
    assert column.path_in_schema == "codes" and column.compression == "UNCOMPRESSED" and not column.has_dictionary_page


def test_an_id_is_read_without_decoding_others():
    ids = np.random.default_rng(1).integers(0, 50_000, 100_000).astype(np.uint32)
    data = bytearray(write_codes(ids))
    whole, at = np.frombuffer(data, np.uint8), 54_321
    codes = Codes(memoryview(data))
    first = codes.levels[0][2]  # the lowest chunks of all ids, in place
    offset = first.__array_interface__["data"][0] - whole.__array_interface__["data"][0]
    spoilt = np.frombuffer(data, np.uint8).copy()
    spoilt[offset : offset + len(first)] ^= 255
    spoilt[offset + at] ^= 255
    data[:] = spoilt.tobytes()
    assert codes[at] == ids[at] and codes[at + 1] != ids[at + 1]
