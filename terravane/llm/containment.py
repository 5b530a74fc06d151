"""Size-partitioned MinHash containment search: short test items inside long documents.

An item of n distinct word shingles lies in a document if at least percent of its shingles do, so at most
n - need of them are missing, where need = ceil(n * percent / 100). The item's sketch is its n - need + 1 least
shingle hashes (a bottom-k MinHash whose k follows the item's size): a document that contains the item has at
least one of them, so the search loses nothing. Items are partitioned by size, each partition with its own k.
A document's shingle hashes are looked up among the sketches; every candidate is then verified on the exact
shingles, as words, of both texts.

A benchmark of up to ITEM_BYTES of text goes to every task as a whole. A larger one stays a table: its sketch
hashes meet the documents' by a shuffled join, documents sending only the hashes whose leading bits occur in a
sketch (a map of 2**BITS bits is what goes to the tasks), and candidate pairs are verified on both texts. Either
way documents are passed over once or twice, however many items there are.

Defined cases: null or blank texts have no shingle: such an item lies in no document, such a document holds no
item; texts shorter than a shingle count as one shingle; repeated items and rows are each reported; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm import textblock as tb
from terravane.runtime import arrow_limits, cut, discard, ship

SHINGLE, PERCENT = 5, 80
#: Bytes of item texts that are sent to the tasks, at most.
ITEM_BYTES = 32 << 20
#: Leading bits of the hashes that a large benchmark's sketches may have, as a map that is sent to the tasks.
BITS = 26

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def exact_shingles(text: bytes, k: int) -> set[bytes]:
    """The distinct k-word shingles, words joined by one blank."""
    w = _WORD.findall(text.lower())
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def need(n: int, percent: int) -> int:
    """The least number of n shingles that make the share."""
    return -(-n * percent // 100)


class Index:
    """The sketches of some items: sorted hashes, and the items of each."""

    def __init__(self, items: list[tuple[int, bytes]], k: int, percent: int):
        self.ids = [i for i, _ in items]
        self.k = k
        self.exact: list[set[bytes] | None] = [None] * len(items)
        self.texts = [t for _, t in items]
        words = tb.Words(self.texts) if items else None
        hashes, owners = [], []
        self.need = np.zeros(len(items), np.int64)
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i in range(len(items)):
            s = np.unique(words.shingles(i, k))
            if len(s):
                by_size.setdefault(len(s), []).append((i, s))
        for n, part in sorted(by_size.items()):
            size = n - need(n, percent) + 1
            for i, s in part:
                self.need[i] = need(n, percent)
                hashes.append(s[:size])
                owners.append(np.full(size, i))
        h = np.concatenate(hashes) if hashes else np.zeros(0, tb.U)
        o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.owner = o[order]
        self.hash, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        # one bit for each hash prefix spares most lookups
        self.shift = tb.U(64 - 22)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hash >> self.shift).astype(np.int64)] = True

    def item(self, i: int) -> set[bytes]:
        if self.exact[i] is None:
            self.exact[i] = exact_shingles(self.texts[i], self.k)
        return self.exact[i]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, shared shingles, the item's shingles) of every verified pair."""
        if not len(self.hash):
            return []
        words = tb.Words(texts)
        n = np.diff(words.bounds)
        found: list[tuple[int, int, int, int]] = []
        every, base = [], []
        for i in np.flatnonzero(n):
            s = words.shingles(i, self.k)
            every.append(s)
            base.append(np.full(len(s), i))
        if not every:
            return found
        h, at = np.concatenate(every), np.concatenate(base)
        ok = self.seen[(h >> self.shift).astype(np.int64)]
        h, at = h[ok], at[ok]
        p = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        ok = self.hash[p] == h
        p, at = p[ok], at[ok]
        for i in np.unique(at):
            mine: set[int] = set()
            for q in np.unique(p[at == i]):
                mine.update(self.owner[self.first[q] : self.last[q]].tolist())
            text = exact_shingles(texts[i], self.k)
            for item in sorted(mine):
                shared = len(self.item(item) & text)
                if shared >= self.need[item]:
                    found.append((int(i), item, shared, len(self.item(item))))
        return found


def _small(benchmark: DataFrame) -> list[tuple[int, bytes]] | None:
    """The items, if they may be sent to every task; else None."""
    items = benchmark.select("item_id", F.col("text").cast("string").cast("binary").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()[0] or 0
    return [(r.item_id, bytes(r.text or b"")) for r in items.collect()] if size <= ITEM_BYTES else None


def _hits(shared, k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, k, percent)
        for batch, texts in tb.blocks(batches):
            if rows := index.search(texts):
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([r[0] for r in rows])), pa.array([index.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["doc_id", "item_id", "shared", "n_item"]
                )

    return run


def _sketched(k: int, percent: int):
    """(item, h): the sketch of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tb.blocks(batches):
            words = tb.Words(texts)
            sets = [np.unique(words.shingles(i, k)) for i in range(len(texts))]
            sets = [s[: len(s) - need(len(s), percent) + 1] if len(s) else s for s in sets]
            item = np.repeat(np.array(batch.column(0)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(tb.signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64))], names=["item", "h"])

    return run


def _shared_hashes(k: int, seen):
    """(_text_1, _text_2, h): the distinct shingle hashes of each text whose leading bits a sketch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(seen.value, np.uint8)).view(bool)
        for batch, texts in tb.blocks(batches):
            words = tb.Words(texts)
            sets = []
            for i in range(len(texts)):
                s = words.shingles(i, k)
                sets.append(np.unique(s[bits[(s >> tb.U(64 - BITS)).astype(np.int64)]]))
            n = [len(s) for s in sets]
            key = [pa.array(np.repeat(np.array(batch.column(c)), n)) for c in ("_text_1", "_text_2")]
            yield pa.RecordBatch.from_arrays([*key, pa.array(tb.signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64))], names=["_text_1", "_text_2", "h"])

    return run


def _confirmed(k: int, percent: int):
    """(_text_1, _text_2, item, shared, n_item) of the candidates whose shingles, as words, make the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            texts, items = tb.texts_of(batch.column("text")), tb.texts_of(batch.column("item_text"))
            keep, shared, n = [], [], []
            for i, (t, u) in enumerate(zip(texts, items, strict=True)):
                if last[0] != t:
                    last = (t, exact_shingles(t, k))
                x = exact_shingles(u, k)
                both = len(x & last[1])
                if both >= need(len(x), percent):
                    keep.append(i)
                    shared.append(both)
                    n.append(len(x))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("_text_1", "_text_2", "item")), pa.array(shared, pa.int64()), pa.array(n, pa.int64())], names=["_text_1", "_text_2", "item", "shared", "n_item"])

    return run


def _text_key() -> list:
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("_text_1"), F.xxhash64(F.lit(1), text).alias("_text_2")]


def _searched(docs: DataFrame, benchmark: DataFrame, k: int, percent: int) -> DataFrame:
    """(_text_1, _text_2, item_id, shared, n_item) of each different text of docs and item row that it contains, by shuffled joins."""
    spark = docs.sparkSession
    items = cut(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), F.col("text").cast("string")), "items")
    sketch = cut(items.select("item", "text").mapInArrow(_sketched(k, percent), "item long, h long"), "item-sketch")
    tops = sketch.select(F.shiftrightunsigned("h", 64 - BITS).alias("top")).distinct().toArrow()["top"].to_numpy()  # at most 2**BITS
    bits = np.zeros(1 << BITS, bool)
    bits[tops] = True
    texts = docs.select(*_text_key(), F.col("text").cast("string"))
    hashes = texts.mapInArrow(_shared_hashes(k, spark.sparkContext.broadcast(np.packbits(bits).tobytes())), "_text_1 long, _text_2 long, h long")
    pairs = cut(hashes.join(sketch, "h").select("_text_1", "_text_2", "item").distinct(), "item-candidates")
    whole = cut(texts.join(pairs.select("_text_1", "_text_2").distinct(), ["_text_1", "_text_2"], "left_semi").dropDuplicates(["_text_1", "_text_2"]), "item-texts")
    both = pairs.join(items.select("item", F.col("text").alias("item_text")), "item").join(whole, ["_text_1", "_text_2"]).select("_text_1", "_text_2", "text", "item", "item_text")
    found = cut(both.mapInArrow(_confirmed(k, percent), "_text_1 long, _text_2 long, item long, shared long, n_item long").join(items.select("item", "item_id"), "item"), "contained")
    discard(items, sketch, pairs, whole)
    return found.drop("item")


def contained(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, shared, n_item) of each row of docs and item that it contains."""
    spark = docs.sparkSession
    ship(spark)
    arrow_limits(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if (items := _small(benchmark)) is not None:
        return texts.mapInArrow(_hits(spark.sparkContext.broadcast(items), k, percent), "doc_id long, item_id long, shared long, n_item long")
    found = _searched(docs, benchmark, k, percent)
    return texts.select("doc_id", *_text_key()).join(found, ["_text_1", "_text_2"]).select("doc_id", "item_id", "shared", "n_item")


def _flagged(shared, k: int, percent: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, k, percent)
        for batch, texts in tb.blocks(batches):
            hit = np.zeros(len(texts), bool)
            hit[[r[0] for r in index.search(texts)]] = True
            yield batch.filter(pa.array(~hit if keep else hit))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item."""
    spark = docs.sparkSession
    ship(spark)
    arrow_limits(spark)
    if (items := _small(benchmark)) is not None:
        return docs.mapInArrow(_flagged(spark.sparkContext.broadcast(items), k, percent, True), T.StructType(docs.schema.fields))
    found = _searched(docs, benchmark, k, percent).select(F.col("_text_1").alias("_hit_1"), F.col("_text_2").alias("_hit_2")).distinct()
    first, second = _text_key()
    own = docs.select(*docs.columns, first, second)
    return own.join(found, (F.col("_text_1") == F.col("_hit_1")) & (F.col("_text_2") == F.col("_hit_2")), "left_anti").select(docs.columns)


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], k: int, percent: int) -> set[tuple[int, int, int, int]]:
    """Every pair by comparing all: for tests."""
    out = set()
    known = [(j, exact_shingles((u or "").encode(), k)) for j, u in items]
    for i, t in docs:
        s = exact_shingles((t or "").encode(), k)
        for j, u in known:
            if u and 100 * len(s & u) >= percent * len(u):
                out.add((i, j, len(s & u), len(u)))
    return out

