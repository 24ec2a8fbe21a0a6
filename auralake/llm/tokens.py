"""Token ids of whole texts through the ``tokenizers`` library.

Byte-level BPE with the usual pattern never joins across a single space or line
end between two non-blank characters, so a text is cut there, and each distinct
piece is encoded once a worker and kept in a bounded cache. Texts with other
blanks at a cut (runs of blanks, a blank at an end) are encoded whole, and so is
every text where the tokenizer file says that it works in another way. Each way
gives the ids that encoding the whole text gives.

Most new pieces are letters with some punctuation around them. What the pattern
makes of those is known, so their parts go to the model as they are, in the
characters that stand for bytes, without the pattern's search.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np

from .common import kept_by_worker

LINE, FIRST = "\ue000", "\ue001"  # a piece after a line end; the first piece
CHUNK = 1 << 20
#: characters that the pattern takes as one run, beside letters; none is in an added token
AROUND = '.,;:!?"()-'
PART, END = "\n", "\x01"  # between the parts of a piece; before each piece


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Pieces(dict):
    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return dict(zip(own + sorted(set(range(256)) - set(own)), own + list(range(256, 512))))


def cuts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file describes byte-level BPE with the usual pattern and nothing else."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    added = [t["content"] for t in spec.get("added_tokens") or []]
    return (
        model.get("type") == "BPE" and not model.get("dropout") and not spec.get("normalizer") and not spec.get("truncation")
        and {k: cut.get(k, True) for k in plain} == plain
        and not any(" " in t or "\n" in t or t.strip(AROUND).isalpha() for t in added)
    )


class Encoder:
    """``encode(texts)`` gives an array of ids for each text, in order."""

    def __init__(self, path: str, most_pieces: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most_pieces
        with open(path, encoding="utf-8") as f:
            self.cuts = cuts_at_blanks(json.load(f))
        if self.cuts:
            (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
            self.shown = byte_characters() | {ord(END): ord(PART), ord(PART): ord(PART)}
            self.parts = Tokenizer.from_file(path)
            self.parts.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(PART)
            vocabulary = self.parts.get_vocab(with_added_tokens=False)
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of each id
            self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._reset()

    def _reset(self) -> None:
        self.pieces = _Pieces()
        self.start, self.length, self.odd = (np.zeros(1024, t) for t in (np.int64, np.int64, bool))
        self.flat, self.used = np.zeros(8192, np.uint32), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self) -> None:
        fresh, n = self.pieces.fresh, len(self.pieces)
        if not fresh:
            return
        if n > len(self.start):
            grown = max(n, 2 * len(self.start))
            self.start, self.length, self.odd = (np.resize(x, grown) for x in (self.start, self.length, self.odd))
        known, texts, other, other_texts = [], [], [], []
        for k, piece in enumerate(fresh, n - len(fresh)):
            mark = piece[:1] in (LINE, FIRST)
            body = piece[1:] if mark else piece
            inner = body.strip(AROUND)
            self.odd[k] = False
            if inner.isalpha():
                at = body.index(inner)
                head, tail, blank = body[:at], body[at + len(inner) :], "" if mark else " "
                texts.append(f"{blank}{head}{PART}{inner}{PART}{tail}" if head else f"{blank}{inner}{PART}{tail}")
                known.append(k)
            elif not body or body[0].isspace() or body[-1].isspace() or "\u180e" in body or END in body:
                self.odd[k] = True
            else:
                other_texts.append(body if mark else " " + body)
                other.append(k)
        if texts:
            data = (END.join(texts) + END).encode("utf-8", "surrogatepass")
            (coded,) = self.parts.encode_batch_fast([data.decode("latin-1").translate(self.shown)], add_special_tokens=False)
            ids, raw = np.array(coded.ids, np.uint32), np.frombuffer(data, np.uint8)
            ends = np.flatnonzero(raw == ord(END))
            upto = np.cumsum((raw != ord(END)) & (raw != ord(PART)))[ends]  # bytes up to the end of each piece, as those of ids
            stop = np.searchsorted(np.cumsum(self.bytes_of[ids]), upto) + 1
            self._store(known, ids, np.append(0, stop[:-1]), stop)
        if other:
            # before each of these texts the line end is a token of its own, and none has one inside
            (coded,) = self.tokenizer.encode_batch_fast(["\n" + "\n".join(other_texts)], add_special_tokens=False)
            ids = np.array(coded.ids, np.uint32)
            ends = np.flatnonzero(ids == self.line)
            self._store(other, ids, ends + 1, np.append(ends[1:], len(ids)))
        first = n - len(fresh)
        for k, piece in enumerate(fresh, first):
            if piece[:1] == LINE and not self.odd[k]:  # that piece has its line end
                self._with_line_end(k)
        self.pieces.fresh = []

    def _grow(self, n: int) -> None:
        if self.used + n > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + n))

    def _store(self, numbers: list[int], ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        self._grow(len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[numbers], self.length[numbers] = self.used + start, stop - start
        self.used += len(ids)

    def _with_line_end(self, k: int) -> None:
        at, n = int(self.start[k]), int(self.length[k])
        self._grow(n + 1)
        self.flat[self.used] = self.line
        self.flat[self.used + 1 : self.used + 1 + n] = self.flat[at : at + n]
        self.start[k], self.length[k] = self.used, n + 1
        self.used += n + 1

    def _numbers(self, text: str) -> Iterator[np.ndarray]:
        """The numbers of a text's pieces, a chunk of the text at a time."""
        at, first = 0, FIRST
        while at <= len(text):
            cut = text.find(" ", at + CHUNK) if len(text) - at > CHUNK else -1
            chunk = text[at:] if cut < 0 else text[at:cut]
            pieces = (first + chunk.replace("\n", " " + LINE)).split(" ")
            yield np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
            at, first = (len(text) + 1 if cut < 0 else cut + 1), ""

    def encode(self, texts: Iterable[str | None], group: int = 64) -> Iterator[np.ndarray]:
        held: list[tuple[str, np.ndarray | None]] = []
        size = 0
        for text in texts:
            text = text or ""
            plain = self.cuts and text and LINE not in text and FIRST not in text
            held.append((text, np.concatenate(list(self._numbers(text))) if plain else None))
            size += len(text)
            if len(held) >= group or size > CHUNK:
                yield from self._assemble(held)
                held, size = [], 0
        yield from self._assemble(held)

    def _assemble(self, held) -> Iterator[np.ndarray]:
        self._learn()
        for text, numbers in held:
            if numbers is None or self.odd[numbers].any():
                yield self._whole(text) if text else np.zeros(0, np.uint32)
                continue
            lengths = self.length[numbers]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.start[numbers] - (ends - lengths), lengths)
            yield self.flat[shift + np.arange(len(shift))]
        if len(self.pieces) > self.most:
            self._reset()


def encoder(path: str) -> Encoder:
    """One encoder a worker process and path; it outlives a task."""
    return kept_by_worker("encoder", path, lambda: Encoder(path))
