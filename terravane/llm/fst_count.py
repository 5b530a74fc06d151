"""Token counts by compiled finite-state transducers.

Two deterministic transducers are compiled from the tokenizer's description. The first reads character classes
and marks where words (letter runs, single numbers, runs of other characters, contractions) begin; its few
states make a chunk of text a map from entry state to exit state, and the chunks' maps are composed by a
parallel prefix scan, so all chunks of a block are read in lockstep. The second reads a word's characters: its
state is the sum of a number for each place and character read so far (each transition is a translation of
Z/2^64, so those of a block are composed by one prefix sum), and on the word's end it emits the word's token
count. That final output is compiled when a word is
first met, by applying the merge table to all words that are new to a block together, and kept for later blocks.

The count follows the tokenizer's own pipeline: special strings are cut out first and count one each, then NFC
and lower-casing, words, and byte-pair merges with a mark on the word's last symbol.

Defined cases: null text is empty and has no token; blank texts have none; repeated rows each get a row; texts
of any length are cut before a blank; further columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textblock as tb
from terravane.llm.bpe import Merges, lockstep_counts, pieces
from terravane.runtime import arrow_limits, ship

CHUNK = 256
#: Words whose counts a worker keeps, at most, before it starts anew.
CACHE = 1_000_000

# classes of characters
BLANK, LETTER, NUMBER, OTHER, QUOTE, ONE, RV, EL, EE = range(9)
# states: at a boundary, in letters, in others, after a lone quote, after quote + r or v, after quote + l
START, WORD, REST, QUOTED, WANT_E, WANT_L = range(6)
# outputs: a word begins at this character, at the one before
HERE, BEFORE = 1, 2


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of each state and class, for 's 't 're 've 'm 'll 'd, letter runs, single numbers, other runs."""
    letters = (LETTER, ONE, RV, EL, EE)
    go, out = np.zeros((6, 9), np.uint8), np.zeros((6, 9), np.uint8)
    for state in range(6):
        for c in range(9):
            late = BEFORE if state in (WANT_E, WANT_L) else 0
            within = WORD if late else state
            if state == QUOTED and c in (ONE, RV, EL):
                to, emit = {ONE: START, RV: WANT_E, EL: WANT_L}[c], 0
            elif state == WANT_E and c == EE or state == WANT_L and c == EL:
                to, emit = START, 0
            elif c == BLANK:
                to, emit = START, late
            elif c in letters:
                to, emit = WORD, late | (0 if within == WORD else HERE)
            elif c == NUMBER:
                to, emit = START, late | HERE
            elif within in (REST, QUOTED):
                to, emit = REST, 0
            else:
                to, emit = (QUOTED if c == QUOTE else REST), late | HERE
            go[state, c], out[state, c] = to, emit
    return go, out


def classes() -> np.ndarray:
    """The class of every code point."""
    n = 0x110000
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, n)))
    table = np.full(n, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", BLANK)):
        table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = c
    for text, c in (("stmd", ONE), ("rv", RV), ("l", EL), ("e", EE), ("'", QUOTE)):
        table[[ord(x) for x in text]] = c
    return table


def word_starts(kinds: np.ndarray, go: np.ndarray, out: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a word begins at each character, by lockstep over chunks; kinds must end with a blank."""
    n = len(kinds)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, BLANK, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    step, states = go.ravel(), go.shape[0]
    width = go.shape[1]
    # each chunk's map of entry to exit states
    maps = np.tile(np.arange(states, dtype=np.uint8), (rows, 1))
    for c in grid:
        maps = step[maps * np.uint8(width) + c[:, None]]
    # inclusive prefix scan of the maps' composition
    reach = 1
    while reach < rows:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.concatenate(([START], maps[:-1, START])).astype(np.uint8)
    marks = np.empty((chunk, rows), np.uint8)
    emit = out.ravel()
    for i, c in enumerate(grid):
        at = state * np.uint8(width) + c
        marks[i] = emit[at]
        state = step[at]
    flat = np.ascontiguousarray(marks.T).ravel()
    starts = (flat & HERE).astype(bool)
    starts[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return starts[:n]


class Counter:
    """A compiled tokenizer."""

    def __init__(self, description: dict):
        self.go, self.out = compile_splitter()
        self.table = classes()
        model = description["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        left, right = ([vocab[m[side]] for m in model["merges"]] for side in (0, 1))
        self.merges = Merges(left, right, list(range(len(left))), [vocab[a + b] for a, b in model["merges"]])
        # bytes are written as printable characters: those that print stand for themselves, the rest follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + suffix] for b in range(256)], np.int32)
        special = [t["content"] for t in description["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[int, int] = {}

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, by the merge table."""
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        symbols[bounds[1:] - 1] = self.final[data[bounds[1:] - 1]]
        return lockstep_counts(self.merges, symbols, bounds)

    def segments(self, text: str) -> tuple[list[str], int]:
        """What lies between special strings, normalised, and how many of these there are."""
        n = 0
        if self.special and "<|" in text:
            parts = self.special.split(text)
            n = len(parts) - 1
        else:
            parts = [text]
        if text.isascii():
            return [p.lower() for p in parts], n
        # lower-casing goes by single characters, so a sigma at a word's end is no special case
        return [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for p in parts], n

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                np.add.at(total, np.array(owner), self._block(held))
            held.clear()
            owner.clear()
            size = 0

        for i, t in enumerate(texts):
            parts, special = self.segments(t.decode())
            total[i] += special
            for part in parts:
                for piece in pieces(part):
                    held.append(piece)
                    owner.append(i)
                    size += len(piece)
                    if size > tb.BLOCK:
                        flush()
        flush()
        return total

    def _block(self, parts: list[str]) -> np.ndarray:
        text = "\n".join(parts) + "\n"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = self.table[points]
        starts = np.flatnonzero(word_starts(kinds, self.go, self.out))
        bounds = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        if not len(starts):
            return np.zeros(len(parts), np.int64)
        blanks = np.flatnonzero(kinds == BLANK)
        ends = np.minimum(np.append(starts[1:], len(points)), blanks[np.searchsorted(blanks, starts)])
        hashes = tb.span_hashes(points, starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = unique.tolist()
        found = [self.known.get(k, 0) for k in keys]
        new = [i for i, c in enumerate(found) if not c]
        if new:
            at = first[new]
            for i, c in zip(new, self.counts([text[a:b].encode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]).tolist(), strict=True):
                found[i] = self.known[keys[i]] = c
        run = np.concatenate(([0], np.cumsum(np.array(found, np.int64)[inverse])))
        at = np.searchsorted(starts, np.concatenate(([0], bounds)))
        if len(self.known) > CACHE:
            self.known.clear()
        return np.diff(run[at])


_counters: dict[int, Counter] = {}


def _counted(shared, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = shared.value
        key = hash(text)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(json.loads(text))
        counter = _counters[key]
        for batch, texts in tb.blocks(batches):
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, for the tokenizer that path describes."""
    spark = docs.sparkSession
    ship(spark)
    arrow_limits(spark)
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_counted(shared, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
