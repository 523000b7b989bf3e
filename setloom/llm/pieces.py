"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

Merging repeats one rule: of all neighbours whose join is a piece, join those of the best score, of equals the leftmost. Let two
neighbouring pieces be compatible if merging their own characters gives just these two. No merge crosses a border of the result,
so in it all neighbours are compatible; and of any cut of a text into compatible neighbours the first merge to cross a border
would cross it for these two alone as well. So there is exactly one such cut, and it is the result. It is looked for from the
left: Aho-Corasick gives the longest piece at every place; it, then the pieces that it begins with, are tried against the piece
before; where none fits, the place is marked as failed in a bitfield and the last piece is taken back. What leads to a place is
unique too, so a failed place stays failed.

No merge crosses a place where two characters follow each other as in no piece. Texts are cut there, by kinds of characters that
are checked against the model's pieces (before blanks, between Latin letters and others), and each different part is encoded once
for many texts.
"""

from __future__ import annotations

import codecs
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import lean, runs_of_rows, strings, utf8

SPACE = "▁"  # what a blank is written as
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in model files
BPE = 2
RAW = -1  # a character that no piece has
BLANK, LETTER = 2, 1
PAIRS, PARTS, LONG = 400_000, 800_000, 60  # how many pairs and parts, up to which length, a process remembers (some 200 MB)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: lambda: 8, 2: varint, 5: lambda: 4}[key & 7]()
            yield key >> 3, data[at : at + n]
            at += n


def _one_each(error: UnicodeError) -> tuple[str, int]:
    """Bytes that are no UTF-8 are replaced one by one."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("one_each", _one_each)


class Remembered(dict):
    """Results of a function of strings, if they are short: of those asked for last at least `most` / 2, and at most `most`."""

    def __init__(self, function: Callable[[str], bytes], most: int) -> None:
        self.function, self.most, self.before = function, most, {}

    def __missing__(self, part: str) -> bytes:
        found = self.before.get(part)
        if found is None:
            found = self.function(part)
        if len(part) <= LONG:
            if len(self) >= self.most // 2:
                self.before = dict(self)
                self.clear()
            self[part] = found
        return found


class PieceModel:
    """A BPE model with byte fallback, whose normaliser changes nothing but blanks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            data = file.read()
        found, trained, normaliser = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                found.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif field == 2:
                trained = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.prefixed = bool(normaliser.get(3, 1))
        known = {NORMAL, UNKNOWN, CONTROL, BYTE}
        if trained.get(3) != BPE or not trained.get(35) or {k for _, _, k in found} - known:
            raise ValueError("only BPE models with byte fallback and without words of their own are understood")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trained.get(24):
            raise ValueError("only models that leave texts as they are but for blanks are understood")
        self.pieces = [p for p, _, _ in found]
        self.score = {p: s for p, s, k in found if k == NORMAL}
        self.byte_ids = [0] * 256
        for i, (p, _, k) in enumerate(found):
            if k == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        single = {p for p in self.score if len(p) == 1}
        if any(c not in single for p in self.score for c in p):
            raise ValueError("each character of a piece must be a piece")
        reached = [(i, p) for i, (p, _, k) in enumerate(found) if k == NORMAL and self.merged(p) == [p]]
        ids = {p: i for i, p in reached}
        self.automaton = ahocorasick.Automaton()
        for _, p in reached:
            begins = [p[:k] for k in range(len(p), 0, -1) if p[:k] in ids]  # the piece, and the pieces that it begins with
            self.automaton.add_word(p, (len(p) - 1, [(len(b), ids[b]) for b in begins]))
        self.automaton.make_automaton()
        self.raw = [(1, RAW)]
        self.rule = safe_rule({p[i : i + 2] for p in self.score for i in range(len(p) - 1)})
        self.fits: dict[int, bool] = {}
        self.parts = Remembered(lambda part: self.cut_up(part.replace(" ", SPACE)), PARTS)
        unknown = trained.get(44, b" \xe2\x81\x87 ")
        self.surface = [p.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(p[1:-1], 16)]) if k == BYTE else unknown if k == UNKNOWN else b"" for p, _, k in found]
        self.control = frozenset(i for i, (_, _, k) in enumerate(found) if k == CONTROL)
        self.spaced = frozenset(i for i, (p, _, k) in enumerate(found) if k == NORMAL and p.startswith(SPACE))

    def merged(self, text: str) -> list[str]:
        """The rule itself, for a few characters."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two stay apart when their characters are merged anew."""
        known = self.fits.get(left << 20 | right)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.fits[left << 20 | right] = self.merged(a + b) == [a, b]
        return known

    def cut_up(self, part: str) -> bytes:
        """Ids of one part of a text, as int32."""
        n = len(part)
        choices: list[list[tuple[int, int]]] = [self.raw] * n
        for end, (size, found) in self.automaton.iter(part):
            choices[end - size] = found  # of those that start here the longest ends last
        failed, holes = bytearray(n // 8 + 1), False
        fits, compatible = self.fits, self.compatible
        places: list[int] = []
        out: list[int] = []
        at, before, options = 0, RAW, choices[0]
        while True:
            for size, piece in options:
                end = at + size
                if holes and failed[end >> 3] >> (end & 7) & 1:
                    continue
                if before < 0 or piece < 0:
                    break
                fit = fits.get(before << 20 | piece)
                if fit or fit is None and compatible(before, piece):
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                holes = True
                at, last = places.pop(), out.pop()
                before = out[-1] if out else RAW
                options = [x for x in choices[at] if x[0] < len(self.pieces[last])]
                continue
            places.append(at)
            out.append(piece)
            if end == n:
                break
            at, before, options = end, piece, choices[end]
        if min(out) == RAW:
            out = [x for place, piece in zip(places, out, strict=True) for x in ([self.byte_ids[b] for b in part[place].encode()] if piece == RAW else (piece,))]
        return array("i", out).tobytes()

    def encode(self, text: str) -> list[int]:
        body = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        return self.encode_slice(np.array([0, len(body)]), body)[0].tolist()

    def encode_slice(self, offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them) of texts in UTF-8 (offsets in body)."""
        texts = [body[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        texts = [(b" " if self.prefixed and t else b"") + t.replace(SPACE.encode(), b" ") for t in texts]
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begins = (np.cumsum(size) - size)[size > 0]
        cuts = self._cuts(flat, begins)
        spans = np.append(cuts, len(flat)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(spans), pa.py_buffer(flat)]).dictionary_encode()
        known = [self.parts[p.decode("utf-8", "one_each")] for p in parts.dictionary.to_pylist()]
        of_part = np.array([len(k) // 4 for k in known], np.int64)
        first = np.cumsum(of_part) - of_part
        at = parts.indices.to_numpy()
        n = of_part[at]
        before = np.cumsum(n) - n
        ids = np.frombuffer(b"".join(known), np.int32)[np.repeat(first[at] - before, n) + np.arange(int(n.sum()))]
        ends = np.zeros(len(texts) + 1, np.int64)
        ends[1:][size > 0] = np.add.reduceat(n, np.searchsorted(cuts, begins))
        return ids, np.cumsum(ends)

    def _cuts(self, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where parts of the texts begin, in order: at texts, and where `self.rule` cuts."""
        starts = np.flatnonzero(flat & 0xC0 != 0x80) if self.rule is not None else begins
        begin = np.zeros(len(starts), bool)
        begin[np.searchsorted(starts, begins)] = True
        if self.rule is not None:
            kind = self.rule[flat[starts]]
            begin[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK)
        return starts[begin]

    def decode(self, ids: list[int]) -> str:
        if not self.control.isdisjoint(ids):  # control ids part the bytes around them
            runs = [list(run) for control, run in groupby(ids, self.control.__contains__) if not control]
            return "".join(self._surface(run, first=k == 0) for k, run in enumerate(runs))
        return self._surface(ids, first=True)

    def _surface(self, ids: list[int], first: bool) -> str:
        found = b"".join([self.surface[i] for i in ids])
        return found[first and self.prefixed and bool(ids) and ids[0] in self.spaced :].decode("utf-8", "one_each")


def first_bytes(letters: bool) -> np.ndarray:
    """A kind for each first byte of a character: a blank, or (if they are told apart) a Latin letter up to U+027F, or another one."""
    kind = np.zeros(256, np.uint8)
    kind[32] = BLANK
    if letters:
        kind[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = LETTER
    return kind


def safe_rule(inside: set[str]) -> np.ndarray | None:
    """Kinds of first bytes such that no piece has a character, not a blank, before one of another kind; None if there are none."""
    for letters in (True, False):
        kind = first_bytes(letters)
        of = {c: kind[c.replace(SPACE, " ").encode()[0]] for c in set("".join(inside))}
        if all(of[x] == BLANK or of[x] == of[y] for x, y in inside):
            return kind
    return None


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """The model, read once by each Python process."""
    return PieceModel(path)


def _encode_batches(path: str, limit: int = 2 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            offsets, body = utf8(batch.column(0))
            for a, b in runs_of_rows(offsets, limit):
                ids, ends = model.encode_slice(offsets[a : b + 1], body)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), lists], names=["doc_id", "ids"])

    return run


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs (doc_id, text), without begin or end ids; model: a file that all executors have.

    Null and empty texts have no ids. Texts are encoded whole, however long; repeated rows come out equal, as often; a null doc_id
    stays null; an empty table gives an empty result. Other columns are left out, whatever their names. Bytes that are no UTF-8
    count as U+FFFD each.
    """
    src = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return src.mapInArrow(lean(_encode_batches(model)), "doc_id long, ids array<int>")


def _decode_batches(path: str, at_once: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                part = batch.slice(a, at_once)
                texts = [model.decode(x or []).encode() for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, strings(texts)], names=["ids", "doc_id", "decoded"])

    return run


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(ids, doc_id, decoded) for each row of encoded (doc_id, ids). Null and empty ids: empty. Control ids: nothing. The blank that
    encoding puts before a text is taken away; bytes that are no UTF-8 come out as U+FFFD each."""
    src = encoded.select("ids", "doc_id")
    return src.mapInArrow(lean(_decode_batches(model)), "ids array<int>, doc_id long, decoded string")
