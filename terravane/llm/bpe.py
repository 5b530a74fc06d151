"""Byte-level BPE by corpus-level merge replay.

The words of many texts are merged together: an inverted index leads from each mergeable pair, by its rank, to
the positions where it stands in the different words; ranks are applied in ascending order, each to all its
positions at once, and only the pairs on both sides of a merge are looked up anew. Each different word is
merged once for each worker and text block, however often it occurs; texts are then put together from their
words. Nothing of this is shuffled or sent, so memory is bounded by a block and by CACHE words.

Decoding joins the tokens' bytes. Vocabularies are files in the rank format (base64 token and rank) and are
read on the driver by their path; they hold one entry for each token.

Defined cases: null text is empty and has no token; texts of any length are cut where a blank follows a
non-blank, which no word spans; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm import textblock as tb
from terravane.runtime import arrow_limits, ship

#: Words that a worker keeps with their ids, at most, before it starts anew.
CACHE = 200_000
#: Characters of text gathered before the words new among them are merged, and of a piece of a long text.
GATHER, PIECE = 8 << 20, 1 << 20

_none = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Which pairs of token ids merge, at what rank and to which id."""

    def __init__(self, left: list[int], right: list[int], rank: list[int], new: list[int]):
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.new = key[order], np.array(rank, np.int32)[order], np.array(new, np.int32)[order]
        # open addressing by one multiplication: most keys sit in their own slot
        self.bits = max(16, int(len(key)).bit_length() + 3)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.slot[self._at(self.key)] = np.arange(len(key))

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merges:
        """Any two tokens whose bytes together are a token merge, at that token's rank."""
        found: tuple[list[int], list[int], list[int]] = ([], [], [])
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    for x, v in zip(found, (a, b, rank), strict=True):
                        x.append(v)
        return cls(*found, found[2])

    def _at(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(tb.U) * tb.U(0x9E3779B97F4A7C15)) >> tb.U(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in key, or -1."""
        k = a.astype(np.int64) << 32 | b
        p = self.slot[self._at(k)]
        wrong = np.flatnonzero((p >= 0) & (self.key[p] != k))
        if len(wrong):
            q = np.minimum(np.searchsorted(self.key, k[wrong]), len(self.key) - 1)
            p[wrong] = np.where(self.key[q] == k[wrong], q, -1)
        return p

    def one(self, ids: list[int]) -> list[int]:
        """Merge a single word, lowest rank first, leftmost first."""
        x = np.array(ids, np.int64)
        while len(x) > 1:
            p = self.find(x[:-1], x[1:])
            rank = np.where(p >= 0, self.rank[p], _none)
            i = int(rank.argmin())
            if rank[i] == _none:
                break
            x[i] = self.new[p[i]]
            x = np.delete(x, i + 1)
        return x.tolist()


def replay(merges: Merges, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all words at once; symbols[bounds[i]:bounds[i + 1]] is word i. Returns symbols and bounds after all merges."""
    n = len(symbols)
    sym = symbols.astype(np.int32)
    last = np.zeros(n + 1, bool)
    last[bounds[1:] - 1] = True
    nxt = np.arange(1, n + 2, dtype=np.int32)
    nxt[:n][last[:n]] = n
    prv = np.arange(-1, n, dtype=np.int32)
    prv[bounds[:-1]] = n
    alive = np.ones(n + 1, bool)
    alive[n] = False
    rank = np.full(n + 1, _none, np.int32)
    new = np.zeros(n + 1, np.int32)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def look(at: np.ndarray) -> np.ndarray:
        """Look up the pairs that start at these positions and enter them into the index; the ranks found."""
        right = nxt[at]
        inner = right < n
        found = np.full(len(at), -1, np.int32)
        found[inner] = merges.find(sym[at[inner]], sym[right[inner]])
        ok = found >= 0
        r = np.where(ok, merges.rank[found], _none).astype(np.int32)
        rank[at] = r
        new[at[ok]] = merges.new[found[ok]]
        at, r = at[ok], r[ok]
        if len(at):
            order = np.argsort(r, kind="stable")
            at, ordered = at[order], r[order]
            cuts = np.flatnonzero(np.diff(ordered)) + 1
            for k, part in zip(ordered[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(heap, k)
        return r

    look(np.arange(n, dtype=np.int32))
    odd: list[np.ndarray] = []
    while heap:
        k = heapq.heappop(heap)
        parts = index.pop(k)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[rank[at] == k]
        if not len(at):
            continue
        if len(at) > 1:
            meets = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
            if meets.any():  # a pair whose right half is the next one's left: every second of such a run
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(meets, 0, np.arange(len(at))))
                at = at[run % 2 == 0]
        right = nxt[at]
        beyond = nxt[right]
        follow = np.flatnonzero(beyond[:-1] == at[1:])
        if len(follow):  # such a merge stands for a moment beside the next one's left half
            p = merges.find(new[at[follow]], sym[at[follow + 1]])
            if len(early := follow[(p >= 0) & (merges.rank[p] < k)]):
                odd.append(at[early])
        sym[at] = new[at]
        alive[right] = False
        rank[right] = _none
        nxt[at] = beyond
        prv[beyond] = at
        before = prv[at]
        before = before[before < n]
        touched = np.union1d(at, before) if len(before) else at
        if len(r := look(touched)) and int(r.min()) < k:  # a lower rank appears late: such words are merged one by one
            odd.append(touched[rank[touched] < k])
    prv_count = np.concatenate(([0], np.cumsum(alive[:n])))
    out, ends = sym[:n][alive[:n]], prv_count[bounds]
    if odd:
        words = np.unique(np.searchsorted(bounds, np.concatenate(odd), side="right") - 1)
        parts, sizes = [], np.diff(ends)
        for w in words.tolist():
            parts.append((w, np.array(merges.one(symbols[bounds[w] : bounds[w + 1]].tolist()), np.int32)))
        pieces = np.split(out, ends[1:-1])
        for w, p in parts:
            pieces[w], sizes[w] = p, len(p)
        out, ends = np.concatenate(pieces), np.concatenate(([0], np.cumsum(sizes)))
    return out, ends


def lockstep_counts(merges: Merges, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many symbols each word has after all its merges; every word makes its best merge in each round."""
    count = np.diff(bounds).astype(np.int64)
    sym, word = symbols.astype(np.int32), np.repeat(np.arange(len(count)), count)

    def look(a: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at a; the place in merges beside them."""
        p = np.full(len(a), -1)
        ok = a + 1 < len(sym)
        ok[ok] = word[a[ok]] == word[a[ok] + 1]
        p[ok] = merges.find(sym[a[ok]], sym[a[ok] + 1])
        return p

    place = look(np.arange(len(sym)))
    while len(sym):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        key = np.where(place >= 0, merges.rank[place].astype(np.int64), _none) << 32 | np.arange(len(sym))
        best = np.minimum.reduceat(key, first)
        go = best >> 32 < _none
        size = np.diff(np.append(first, len(sym)))
        if not go.all():
            keep = np.repeat(go, size)
            sym, word, place = sym[keep], word[keep], place[keep]
            if not len(sym):
                break
            shift = np.concatenate(([0], np.cumsum(keep)))
            at = shift[(best[go] & 0xFFFFFFFF)]
        else:
            at = best & 0xFFFFFFFF
        count[word[at]] -= 1
        sym[at] = merges.new[place[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))  # one symbol less for each word before
        sym, word, place = sym[keep], word[keep], place[keep]
        touched = np.concatenate((at, at[at > 0] - 1))
        place[touched] = look(touched)
    return count


_EDGE = regex.compile(r"(?<=\S)\s")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about size characters, cut before a blank that follows a non-blank."""
    at = 0
    while len(text) - at > size:
        found = _EDGE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Encoder:
    """Words to token ids, kept from block to block."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges.of_ranks(ranks)
        self.find = regex.compile(pattern).findall
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.decimal: list[bytes] = []
        self.plain: list[bytes] = []
        self.size: list[int] = []

    def split(self, text: str) -> list[int]:
        """Numbers of the text's words; new words get the next ones."""
        d, out = self.words, []
        for p in pieces(text):
            out += [d.setdefault(w, len(d)) for w in self.find(p)]
        return out

    def merge_new(self) -> None:
        """Replay all merges over the words that have no ids yet."""
        new = [w.encode() for w in list(self.words)[len(self.size) :]]
        if not new:
            return
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in new])))
        out, ends = replay(self.merges, self.single[np.frombuffer(b"".join(new), np.uint8)], bounds)
        ids, ends = out.tolist(), ends.tolist()
        for a, b in zip(ends, ends[1:], strict=False):
            own = ids[a:b]
            self.decimal.append(" ".join(map(str, own)).encode())
            self.plain.append(b"".join([self.bytes_of[i] for i in own]))
            self.size.append(b - a)


def _digests(enc: Encoder, rows: pa.RecordBatch, docs: list[list[int]]) -> pa.RecordBatch:
    n, coded, plain = [], [], []
    for d in docs:
        n.append(sum(map(enc.size.__getitem__, d)))
        coded.append(hashlib.sha256(b" ".join(map(enc.decimal.__getitem__, d))).hexdigest())
        plain.append(hashlib.sha256(b"".join(map(enc.plain.__getitem__, d))).hexdigest())
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=[*rows.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(enc: Encoder, rows: pa.RecordBatch, docs: list[list[int]]) -> pa.RecordBatch:
    n = [sum(map(enc.size.__getitem__, d)) for d in docs]
    text = b" ".join([enc.decimal[w] for d in docs for w in d])
    ids = np.fromstring(text, np.int32, sep=" ") if text else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n, dtype=np.int32))), pa.int32()), pa.array(ids))
    return pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, "ids"])


def _coded(shared, pattern: str, form: Callable):
    """The columns before text, and what form makes of the numbers of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared, pattern)
        waiting: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            enc.merge_new()
            for rows, docs in waiting:
                yield form(enc, rows, [d.tolist() for d in docs])
            waiting.clear()
            if len(enc.words) > CACHE:
                enc.clear()

        for batch, texts in tb.blocks(batches):
            waiting.append((batch.select(batch.schema.names[:-1]), [np.array(enc.split(t.decode()), np.int32) for t in texts]))
            size += sum(map(len, texts))
            if size > GATHER or len(enc.words) > 2 * CACHE:
                yield from flush()
                size = 0
        yield from flush()

    return run


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary, pattern: str) -> Encoder:
    """One for each worker and vocabulary; vocabulary: a broadcast (name, ranks), the name being the file's digest."""
    name, ranks = vocabulary.value
    if (key := f"{name} {pattern}") not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def _broadcast(spark: SparkSession, path: str):
    ranks = read_ranks(path)
    digest = hashlib.sha256(b" ".join(b"%b:%d" % (token, rank) for token, rank in sorted(ranks.items()))).hexdigest()
    return spark.sparkContext.broadcast((digest, ranks))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; the last from the ids, decoded."""
    spark = docs.sparkSession
    ship(spark)
    arrow_limits(spark)
    shared = _broadcast(spark, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_coded(shared, pattern, _digests), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str, pattern: str, more: list[str] | None = None) -> DataFrame:
    """(doc_id, ids): the ids themselves; between them, the further columns that more names."""
    spark = docs.sparkSession
    ship(spark)
    arrow_limits(spark)
    shared = _broadcast(spark, path)
    rows = docs.select("doc_id", *(more or []), F.col("text").cast("string"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_coded(shared, pattern, _ids), schema)


def _plain(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {i: t for t, i in shared.value[1].items()}
        for batch in batches:
            texts = [b"".join(of[i] for i in ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "plain"])

    return run


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, plain): the bytes that ids stand for."""
    spark = coded.sparkSession
    ship(spark)
    shared = _broadcast(spark, path)
    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(_plain(shared), f"doc_id {kind}, plain binary")
