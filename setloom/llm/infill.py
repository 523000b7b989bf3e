"""Fill-in-middle transformation: a table-driven automaton over bytes counts units and finds sentinels, a second pass finds the cuts.

The automaton's states are pairs of what the last byte was (nothing yet, blank, word) and how much of a sentinel has been read.
Each transition emits counts, packed beside the next state: a unit begins, a character begins, a sentinel ends. Texts are cut
into lanes of `LANE` bytes that run side by side, a step of all lanes being one lookup in the table. The state of this automaton
depends on the last few bytes alone (their number is derived from the table), so a lane starts by reading the end of the one
before it. The byte 0xFF, which UTF-8 never has, pads lanes and leads to the first state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import lean, runs_of_rows, strings, utf8

SENTINELS = ("<P>", "<S>", "<M>")  # of prefix, suffix and middle
BLANKS = frozenset([0x20, *range(0x09, 0x0E)])
PAD, LANE = 0xFF, 240  # counts of a lane fit into a byte
EDGE, BLANK, WORD = range(3)


@dataclass(frozen=True)
class Scanner:
    table: np.ndarray  # at state << 8 | byte: next state << 24 | sentinels << 16 | characters << 8 | units
    memory: int  # the state depends on so many bytes before it at most


@dataclass(frozen=True)
class Lanes:
    """What the first pass leaves: the lanes, their first states and counts, and where each text's lanes begin."""

    columns: np.ndarray
    state: np.ndarray
    units: np.ndarray
    chars: np.ndarray
    sentinels: np.ndarray
    first: np.ndarray


def _progress(words: list[bytes]) -> tuple[list[bytes], dict[tuple[int, int], tuple[int, bool]]]:
    """Beginnings of words, and for each and any byte the longest beginning that is then read, and whether a word has ended."""
    begun = sorted({w[:i] for w in words for i in range(len(w))} | {b""}, key=lambda b: (len(b), b))
    at = {b: i for i, b in enumerate(begun)}
    steps = {}
    for i, b in enumerate(begun):
        for byte in range(256):
            read = b + bytes([byte])
            tails = [read[k:] for k in range(len(read) + 1)]
            steps[i, byte] = at[next(t for t in tails if t in at)], any(t in words for t in tails)
    return begun, steps


@lru_cache
def scanner(sentinels: tuple[str, ...] = SENTINELS) -> Scanner:
    words = [s.encode() for s in sentinels]
    _, steps = _progress(words)
    states, table = [(EDGE, 0)], {}
    for kind, node in states:  # grows while it is read
        for byte in range(256):
            if byte == PAD:
                after, emitted = (EDGE, 0), 0
            else:
                now = BLANK if byte in BLANKS else WORD
                begins = kind == EDGE or (kind == WORD and now == BLANK)
                to, ends = steps[node, byte]
                after, emitted = (now, to), begins | (byte & 0xC0 != 0x80) << 8 | ends << 16
            if after not in states:
                states.append(after)
            table[states.index((kind, node)), byte] = states.index(after), emitted
    packed = np.zeros(len(states) << 8, np.uint32)
    for (s, byte), (to, emitted) in table.items():
        packed[s << 8 | byte] = to << 24 | emitted
    open_sets, memory = {frozenset(range(len(states)))}, 0
    while any(len(s) > 1 for s in open_sets):
        open_sets = {frozenset(table[x, byte][0] for x in s) for s in open_sets if len(s) > 1 for byte in range(256)}
        memory += 1
        if memory > LANE:
            raise ValueError("the sentinels make a state depend on all bytes before it")
    return Scanner(packed, memory)


def _steps(scan: Scanner, columns: np.ndarray, state: np.ndarray) -> Iterator[np.ndarray]:
    """The table's entry of each lane, byte after byte."""
    at = state.astype(np.uint32) << np.uint32(8)
    for column in columns:
        entry = scan.table[at | column]
        yield entry
        at = (entry >> np.uint32(16)) & np.uint32(0xFF00)


def first_pass(scan: Scanner, body: np.ndarray, offsets: np.ndarray) -> Lanes:
    """Run all texts through the automaton; offsets (n + 1) in body."""
    size = np.diff(offsets)
    lanes = np.maximum(-(-size // LANE), 1)
    first = np.cumsum(lanes) - lanes
    flat = np.full(int(lanes.sum()) * LANE, PAD, np.uint8)
    for at, begin, end in zip((first * LANE).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        flat[at : at + end - begin] = body[begin:end]
    grid = flat.reshape(-1, LANE)
    before = np.full((len(grid), scan.memory), PAD, np.uint8)
    before[1:] = grid[:-1, LANE - scan.memory :]
    before[first] = PAD
    state = np.zeros(len(grid), np.uint32)
    for entry in _steps(scan, before.T, state):
        state = entry >> np.uint32(24)
    columns = np.ascontiguousarray(grid.T)
    counted = np.zeros(len(grid), np.uint32)
    for entry in _steps(scan, columns, state):
        counted += entry & np.uint32(0xFFFFFF)
    return Lanes(columns, state, *((counted >> np.uint32(k) & np.uint32(0xFF)).astype(np.int64) for k in (0, 8, 16)), first)


def second_pass(scan: Scanner, lanes: Lanes, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, characters) of each text before its unit number `unit`, which it has; only the lanes of the cuts are run again."""
    through = np.cumsum(lanes.units)
    before, chars_before = through - lanes.units, np.cumsum(lanes.chars) - lanes.chars
    wanted = before[lanes.first[text]] + unit
    lane = np.searchsorted(through, wanted, side="right")
    left = (wanted - before[lane]).astype(np.int64)
    chars = chars_before[lane] - chars_before[lanes.first[text]]
    at = np.full(len(text), -1, np.int64)
    for i, entry in enumerate(_steps(scan, lanes.columns[:, lane], lanes.state[lane])):
        begins = (entry & np.uint32(1)).astype(bool)
        at[begins & (left == 0) & (at < 0)] = i
        left -= begins
        chars += np.where(at < 0, entry >> np.uint32(8) & np.uint32(1), 0).astype(np.int64)
    return (lane - lanes.first[text]) * LANE + at, chars


def _transform(body: np.ndarray, offsets: np.ndarray, draws: np.ndarray, rate: int, spm: int, sentinels: tuple[str, ...]) -> tuple[list, ...]:
    """(n, form, prefix_chars, middle_chars, output) of the texts; draws (texts x 4)."""
    scan = scanner(sentinels)
    lanes = first_pass(scan, body, offsets)
    n, chars, found = (np.add.reduceat(x, lanes.first) for x in (lanes.units, lanes.chars, lanes.sentinels))
    size = np.diff(offsets)
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    plain = (size == 0) | (found > 0) | (draws[:, 2] % 100 >= rate)
    at, seen = np.repeat(size[:, None], 2, 1), np.repeat(chars[:, None], 2, 1)
    text, which = np.nonzero(~plain[:, None] & (cuts < n[:, None]))
    if len(text):
        at[text, which], seen[text, which] = second_pass(scan, lanes, text, cuts[text, which])
    form = np.where(plain, "plain", np.where(draws[:, 3] % 100 < spm, "spm", "psm"))
    p, s, m = (x.encode() for x in sentinels)
    out = []
    whole = memoryview(np.ascontiguousarray(body))
    for kind, begin, end, a, b in zip(form.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), at[:, 0].tolist(), at[:, 1].tolist(), strict=True):
        prefix, middle, suffix = whole[begin : begin + a], whole[begin + a : begin + b], whole[begin + b : end]
        out.append(bytes(whole[begin:end]) if kind == "plain" else b"".join((p, prefix, s, suffix, m, middle) if kind == "psm" else (s, suffix, p, prefix, m, middle)))
    shown = [(None, None) if x else y for x, y in zip(plain.tolist(), zip(seen[:, 0].tolist(), (seen[:, 1] - seen[:, 0]).tolist(), strict=True), strict=True)]
    return n.tolist(), form.tolist(), [x[0] for x in shown], [x[1] for x in shown], out


def _batches(rate: int, spm: int, sentinels: tuple[str, ...], limit: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, body = utf8(batch.column(0))
            draws = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5)], axis=1) if batch.num_rows else np.zeros((0, 4), np.int64)
            for a, b in runs_of_rows(offsets, limit):
                part = body[offsets[a] : offsets[b]]
                n, form, prefix, middle, out = _transform(part, offsets[a : b + 1] - offsets[a], draws[a:b], rate, spm, sentinels)
                columns = [*batch.slice(a, b - a).columns[5:], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), strings(out)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs (doc_id, text).

    A text is n units, each of white space and what follows it up to the next white space; white space at the end is one too. Two
    cuts before units (or at the end) come from the SHA-256 of seed and doc_id; `rate` per cent of the texts are rearranged, `spm`
    per cent of these with the suffix first. Texts that hold a sentinel stay plain, so that `restored` is exact. A null or empty
    text has no unit and is plain; a null doc_id is drawn for as an empty one; repeated rows come out equal, as often; a text of any
    length is taken whole; an empty table gives an empty result. Other columns are left out, whatever their names. Texts must be
    valid UTF-8, as strings are.
    """
    sentinels = tuple(sentinels)
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    src = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), *draws, F.col("doc_id").cast("long").alias("doc_id"))
    return src.mapInArrow(lean(_batches(rate, spm, sentinels)), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that `fill_in_middle` made `output` from."""
    pattern = "|".join(r"\Q" + s + r"\E" for s in sentinels)
    parts = F.split(output, pattern, -1)
    prefix = F.when(form == "psm", parts[1]).otherwise(parts[2])
    suffix = F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
