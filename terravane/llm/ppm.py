"""Language-model scores: prediction by partial matching over bytes, beside a smoothed unigram base.

The model is a trie of byte contexts of up to ORDER bytes with the counts of every next byte in all training
texts (A-Z lower-cased, byte 255 before and after a text). In a context of total T with D distinct next bytes
a seen byte has probability count / (T + D) and escape has D / (T + D); after an escape the next shorter
context is used without the bytes already excluded, and last a uniform share of the bytes never seen.

Every leaf counts, whatever its order and count. A code is a context of ORDER bytes and the byte after it; each
different code of the texts, held-out texts included, gets its logarithm once. Codes are dealt by their last
three bytes of context: all longer contexts that end in these are then in one place, and with the contexts of up
to two bytes (at most 2**24 leaves, sent to every task) they settle each code's escapes and exclusions exactly.
At most 2**24 codes share three bytes of context, whatever the input. A text's code length is a sum over its codes.
Codes with more than a 2**-TRIE_BITS share of all bytes counted (hence fewer than 2**TRIE_BITS codes) are sent to
the tasks; the others are joined by code.

Words of the base are counted over all training texts. Words with more than N / 2**HEAD_BITS of the N tokens
(hence fewer than 2**HEAD_BITS words) are sent to the tasks; the others, of which no word is frequent, are
joined by fingerprint.

Defined cases: null text is empty (its end is still a token and a byte); a null doc_id counts as the empty text
in its crc32; repeated rows each count and each get a row; with no training text the base's N and V are 0 and
every byte has probability 1/256; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textblock as tb
from terravane.runtime import arrow_limits, cut, discard, ship

#: Bytes of the longest context.
ORDER = 5
HEAD_BITS, TRIE_BITS = 21, 23
#: Entries that a task keeps before it merges equal ones, and codes whose logarithms it works out at once.
MERGE, GRADE = 1 << 20, 1 << 19

_END = np.array([0x5DEECE66D], tb.U)
_tables: dict[str, Short | Lookup] = {}


def text_codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of order + 1 bytes (the context, then the byte) of all texts, and where each text's begin; a text of n bytes has n + 1."""
    edge = b"\xff" * order
    data = np.frombuffer(edge + edge.join(t.lower() for t in texts) + edge, np.uint8).astype(np.int64)
    size = len(data) - order
    out = data[:size].copy()
    for j in range(1, order + 1):
        out <<= 8
        out |= data[j : j + size]
    n = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    if order > 1:  # codes that end in the 255s between texts, after the first
        keep = np.ones(size, bool)
        ends = np.cumsum(n + order - 1)
        for j in range(1, order):
            keep[ends - j] = False
        out = out[keep]
    return out, at


class Lookup:
    """Values by integer key: one slot for most keys, a search for the rest. Keys that come last win their slots."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.bits = max(16, int(len(keys)).bit_length() + 1)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        place = np.empty(len(keys), np.int32)
        place[self.order] = np.arange(len(keys), dtype=np.int32)
        self.slot[self._at(keys)] = place

    def _at(self, k: np.ndarray) -> np.ndarray:
        return (k.view(tb.U) * tb.U(0x9E3779B97F4A7C15) >> tb.U(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Place of each key among the sorted keys, or -1."""
        if not len(self.keys):
            return np.full(len(k), -1, np.int32)
        p = self.slot[self._at(k)]
        wrong = np.flatnonzero((self.keys[p] != k) & (p >= 0))
        if len(wrong):
            q = np.minimum(np.searchsorted(self.keys, k[wrong]), len(self.keys) - 1)
            p[wrong] = np.where(self.keys[q] == k[wrong], q, -1)
        return p


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x).astype(np.float32)


class Short:
    """Contexts of up to two bytes, from sorted codes of three bytes and their counts."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        self.low = short_contexts(code, count)
        context = (code >> 8).astype(np.int64)
        total = np.bincount(context, count, 1 << 16)
        kinds = np.bincount(context, minlength=1 << 16)
        self.total2 = _log(np.maximum(total + kinds, 1))  # log10 (T + D) of each context of two bytes
        self.escape2 = np.where(total > 0, _log(np.maximum(kinds, 1)) - self.total2, 0).astype(np.float32)
        self.seen2 = np.zeros(1 << 24, bool)
        self.seen2[code] = True
        self.level = Lookup(code), count, total, kinds


class Trie:
    """leaves: for each order from 2 up, sorted codes (context bytes, then the byte) and their counts, nested.

    With short, leaves have orders from 3 up, and may be those of some contexts of three bytes only.
    """

    def __init__(self, leaves: dict[int, tuple[np.ndarray, np.ndarray]], short: Short | None = None):
        self.short = short or Short(*leaves[2])
        self.top = max(leaves)
        self.levels = {}
        shorter = self.short.level
        for k in range(3, self.top + 1):
            code, count = leaves[k]
            order = np.argsort(count, kind="stable")
            leaf = Lookup(code[order])
            count = count[order][leaf.order]
            context, first = np.unique(leaf.keys >> 8, return_index=True)
            total = np.add.reduceat(count, first) if len(first) else count
            kinds = np.diff(np.append(first, len(count)))
            # what these leaves exclude from the context without its first byte
            below, count1, total1, kinds1 = shorter
            if len(context):
                at = below.find(leaf.keys & ((1 << 8 * k) - 1))
                out = np.add.reduceat(count1[at], first)
                up = context & ((1 << 8 * (k - 1)) - 1)
                up = up if k == 3 else parents.find(up)
                rest, others = total1[up] - out, kinds1[up] - kinds
            else:
                rest, others = total, kinds
            both = np.maximum(rest + others, 1)
            parents = Lookup(context)
            level = {"leaf": leaf, "context": parents, "seen": _log(count) - np.repeat(_log(total + kinds), kinds), "count": _log(count), "total": _log(total + kinds)}
            level |= {"escape": _log(kinds) - level["total"], "rest": _log(both), "escape_rest": np.where(rest > 0, _log(others) - _log(both), 0).astype(np.float32)}
            self.levels[k] = level
            shorter = leaf, count, total, kinds

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 P(byte | context) of codes of the longest order."""
        out = np.zeros(len(codes), np.float32)
        open_ = np.arange(len(codes))  # positions not yet decided
        norm = escape = None  # of the order that comes next, where a longer context has excluded bytes; else nan
        for k in range(self.top, 2, -1):
            level, c = self.levels[k], codes[open_] & ((1 << 8 * (k + 1)) - 1)
            leaf = level["leaf"].find(c)
            hit = leaf >= 0
            at = open_[hit]
            if norm is None:
                out[at] = level["seen"][leaf[hit]]
                norm = escape = np.full(len(open_), np.nan, np.float32)
            else:
                n = norm[hit]
                out[at] += np.where(np.isnan(n), level["seen"][leaf[hit]], level["count"][leaf[hit]] - n)
            miss = ~hit
            open_, c, norm, escape = open_[miss], c[miss], norm[miss], escape[miss]
            ctx = level["context"].find(c >> 8)
            known = ctx >= 0
            i = ctx[known]
            e = escape[known]
            out[open_[known]] += np.where(np.isnan(e), level["escape"][i], e)
            norm, escape = np.full(len(open_), np.nan, np.float32), np.full(len(open_), np.nan, np.float32)
            norm[known], escape[known] = level["rest"][i], level["escape_rest"][i]
        c = codes[open_] & 0xFFFFFF
        if norm is None:
            return self.short.low[c]
        low, context = self.short.low[c], c >> 8
        fresh, seen = np.isnan(norm), self.short.seen2[c]
        out[open_] += np.where(fresh, low, np.where(seen, low + self.short.total2[context] - norm, escape + low - self.short.escape2[context]))
        return out


def short_contexts(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log10 P(byte | two bytes of context) for each of the 2**24 codes, from the counts of those seen."""
    out = np.full(1 << 24, -np.log10(256.0), np.float32)
    if not len(code):
        return out
    grid = out.reshape(256, 256, 256)
    one = np.bincount(code & 0xFFFF, count, 1 << 16).astype(np.int64).reshape(256, 256)
    zero = one.sum(0)
    middle = code >> 8 & 0xFF
    order = np.argsort(middle, kind="stable")
    ends = np.searchsorted(middle[order], np.arange(257))
    d0 = int((zero > 0).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        for b in range(256):
            own = order[ends[b] : ends[b + 1]]
            c2, c1 = np.zeros((256, 256), np.int64), one[b]
            c2[code[own] >> 16, code[own] & 0xFF] = count[own]
            s2, s1 = c2 > 0, c1 > 0
            t2, d2 = c2.sum(1), s2.sum(1)
            e2 = np.where(t2 > 0, np.log10(d2 / np.maximum(t2 + d2, 1)), 0.0)
            t1, d1 = np.where(s2, 0, c1).sum(1), int(s1.sum()) - d2
            e1 = np.where(t1 > 0, np.log10(d1 / np.maximum(t1 + d1, 1)), 0.0)
            t0, n0 = int(zero[~s1].sum()), d0 - int(s1.sum())
            escape = n0 if d0 < 256 else 0
            p0 = np.log10(np.where(zero > 0, zero, 1) / max(t0 + escape, 1))
            e0 = np.log10(escape / (t0 + escape)) if t0 and escape else 0.0
            low = np.where(zero > 0, p0, e0 - np.log10(max(256 - d0, 1)))
            first = np.log10(c2 / (t2 + d2)[:, None])
            second = e2[:, None] + np.log10(c1[None] / (t1 + d1)[:, None])
            third = (e2 + e1)[:, None] + low[None]
            grid[:, b] = np.where(s2, first, np.where(s1[None], second, third))
    return out


def _shared(name: str, kind: type, *parts: np.ndarray) -> Short | Lookup:
    """A table, built once for each worker process."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = kind(*parts)
    return _tables[name]


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inv, np.concatenate(counts), len(k)).astype(np.int64)


def _count(mod: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list]] = [([], []), ([], [])]
        size = [0, 0]

        def add(kind: int, keys: np.ndarray, counts: np.ndarray) -> None:
            held[kind][0].append(keys)
            held[kind][1].append(counts)
            size[kind] += len(keys)
            if size[kind] > MERGE:
                k, c = _merge(*held[kind])
                held[kind] = ([k], [c])
                size[kind] = len(k)

        def out(kind: int) -> pa.RecordBatch:
            k, c = _merge(*held[kind])
            held[kind], size[kind] = ([], []), 0
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(c)], names=["kind", "key", "c"])

        for batch, texts in tb.blocks(batches):
            train = tb.crc_bucket(batch.column(0).to_pylist(), mod) != 0
            held_out = [t for t, ok in zip(texts, train, strict=True) if not ok]
            texts = [t for t, ok in zip(texts, train, strict=True) if ok]
            if held_out:  # their codes need a logarithm, but count nothing
                k = np.unique(text_codes(held_out)[0])
                add(1, k, np.zeros(len(k), np.int64))
            if texts:
                words = tb.Words(texts)
                k, c = np.unique(words.hashes, return_counts=True)
                add(0, tb.signed(np.append(k, _END)), np.append(c, len(texts)))
                k, c = np.unique(text_codes(texts)[0], return_counts=True)
                add(1, k, c)
            for kind in (0, 1):
                if size[kind] > MERGE:  # many different entries even when merged: pass them on
                    yield out(kind)
        yield out(0)
        yield out(1)

    return run


def _whole(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts, at least step at once where there are, all codes of three bytes of context together as they come."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((np.array(batch.column(0).to_numpy(), np.int64), np.array(batch.column(1).to_numpy(), np.int64)))
        size += len(held[-1][0])
        if size >= step:
            key, c = (np.concatenate(x) for x in zip(*held, strict=True))
            group = key >> 8 & 0xFFFFFF
            change = np.flatnonzero(group[1:] != group[:-1])
            end = int(change[-1]) + 1 if len(change) else 0
            if end:
                yield key[:end], c[:end]
            held, size = [(key[end:], c[end:])], 0  # an open group waits for step more
    if held:
        key, c = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(key):
            yield key, c


def _grade(model, step: int = GRADE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for key, c in _whole(batches, step):
            short = _shared(m["name"], Short, *m["short"])
            seen = c > 0
            leaves = {ORDER: _merge([key[seen]], [c[seen]])}
            for k in range(ORDER - 1, 2, -1):
                code, count = leaves[k + 1]
                leaves[k] = _merge([code & ((1 << 8 * (k + 1)) - 1)], [count])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), pa.array(Trie(leaves, short).log10(key))], names=["key", "c", "value"])

    return run


def _score(model, mod: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = model.value
        codes = _shared(m["name"], Lookup, m["codes"])
        worths = np.append(m["worths"][codes.order], np.float32(0))
        head, value = m["head"], m["value"]
        seen = np.zeros(1 << 20, bool)
        seen[(head >> tb.U(44)).astype(np.int64)] = True
        nth = TaskContext.get().partitionId() << 36
        for batch, texts in tb.blocks(batches):
            words = tb.Words(texts)
            code, first = text_codes(texts)
            place = codes.find(code)
            score = np.add.reduceat(worths[place], first, dtype=np.float64)
            h, inv = np.unique(words.hashes, return_inverse=True)
            p = np.full(len(h), -1)
            maybe = np.flatnonzero(seen[(h >> tb.U(44)).astype(np.int64)])
            if len(maybe):
                q = np.minimum(np.searchsorted(head, h[maybe]), len(head) - 1)
                hit = head[q] == h[maybe]
                p[maybe[hit]] = q[hit]
            n = np.diff(words.bounds)
            doc = np.repeat(np.arange(len(texts)), n)
            worth = np.append(value, 0.0)[p]
            base = np.bincount(doc, worth[inv], len(texts)) + m["end"]
            known = np.bincount(doc, (p >= 0)[inv], len(texts)).astype(np.int64) + m["end_known"]
            row = nth + np.arange(len(texts))
            nth += len(texts)
            none = lambda t: pa.nulls(len(texts), t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(texts), np.int32)), pa.array(row), batch.column(0), pa.array(tb.crc_bucket(batch.column(0).to_pylist(), mod) == 0), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(score), none(pa.int64()), none(pa.int32())],
                names=_FIELDS,
            )
            rare, open_ = np.flatnonzero(p[inv] < 0), np.flatnonzero(place < 0)
            novel, which = np.unique(code[open_], return_inverse=True)
            for kind, keys, owner, i in ((1, tb.signed(h), doc[rare], inv[rare]), (2, novel, np.searchsorted(first, open_, side="right") - 1, which)):
                if not len(i):
                    continue
                pair, tf = np.unique(owner * len(keys) + i, return_counts=True)
                d, w = np.divmod(pair, len(keys))
                none = lambda t: pa.nulls(len(pair), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), kind, np.int32)), pa.array(row[d]), none(pa.int64()), none(pa.bool_()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), pa.array(keys[w]), pa.array(tf.astype(np.int32))], names=_FIELDS
                )

    return run


_FIELDS = ["kind", "row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "key", "tf"]
_SCHEMA = "kind int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, key long, tf int"


def scores(docs: DataFrame, mod: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    ship(spark)
    arrow_limits(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    stats = cut(docs.mapInArrow(_count(mod), "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c")), "lm-stats", by=["kind"])
    counts = stats.filter("kind = 0").select("key", "c")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    below = n + 0.1 * (v + 1)
    worth = lambda c: np.log10((c + 0.1) / below)
    head = counts.filter(F.col("c") > n / 2**HEAD_BITS).toArrow()
    key, c = np.array(head["key"].to_numpy()).view(tb.U), head["c"].to_numpy()
    order = np.argsort(key)
    graded = _graded(stats.filter("kind = 1").select("key", "c"))
    codes, worths = _frequent(graded)
    end = counts.filter(F.col("key") == int(tb.signed(_END)[0])).first()
    model = spark.sparkContext.broadcast(
        {
            "name": uuid.uuid4().hex,
            "codes": codes,
            "worths": worths,
            "head": key[order],
            "value": worth(c[order].astype(float)),
            "end": float(worth(float(end.c if end else 0))),
            "end_known": int(end is not None),
        }
    )
    found = cut(docs.mapInArrow(_score(model, mod), _SCHEMA), "lm-scores", by=["kind"])
    words = found.filter("kind = 1").select("key", "row", "tf").join(counts, "key", "left")
    words = words.select(
        "row", (F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(float(below)))).alias("rest"), F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0).alias("more"), F.lit(0.0).alias("length")
    )
    grams = found.filter("kind = 2").select("key", "row", "tf").join(graded.select("key", "value"), "key")  # every code of a text is graded
    grams = grams.select("row", F.lit(0.0).alias("rest"), F.lit(0).alias("more"), (F.col("tf") * F.col("value").cast("double")).alias("length"))
    tail = words.unionByName(grams).groupBy("row").agg(F.sum("rest").alias("rest"), F.sum("more").alias("more"), F.sum("length").alias("length"))
    result = (
        found.filter("kind = 0")
        .join(tail, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("length", F.lit(0.0))).alias("score"),
        )
    )
    result = cut(result, "lm-result")
    discard(stats, graded, found)
    return result


def _graded(grams: DataFrame) -> DataFrame:
    """(key, c, value): each code, its count and log10 P(byte | context)."""
    kept = grams.filter("c > 0").groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("c").alias("c")).toArrow()
    code, count = np.array(kept["key"].to_numpy(), np.int64), np.array(kept["c"].to_numpy(), np.int64)
    at = np.argsort(code)
    model = grams.sparkSession.sparkContext.broadcast({"name": uuid.uuid4().hex, "short": (code[at], count[at])})
    group = F.shiftright("key", 8).bitwiseAND(0xFFFFFF)
    return cut(grams.repartition(group).sortWithinPartitions(group).mapInArrow(_grade(model), "key long, c long, value float"), "lm-codes")


def _frequent(graded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes with more than a 2**-TRIE_BITS share of all bytes, the most frequent last, and their logarithms."""
    bytes_ = graded.agg(F.sum("c")).first()[0] or 0
    found = graded.filter(F.col("c") > bytes_ / 2**TRIE_BITS).toArrow()
    code, value = np.array(found["key"].to_numpy(), np.int64), np.array(found["value"].to_numpy(), np.float32)
    at = np.lexsort((code, found["c"].to_numpy()))
    return code[at], value[at]


def brute_code_length(train: list[bytes], text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text by walking the contexts byte by byte: for tests."""
    from collections import Counter, defaultdict
    from math import log10

    tries: list[dict[bytes, Counter]] = [defaultdict(Counter) for _ in range(order + 1)]
    edge = b"\xff" * order
    for t in train:
        x = edge + t.lower() + b"\xff"
        for i in range(order, len(x)):
            for k in range(order + 1):
                tries[k][x[i - k : i]][x[i]] += 1
    x, total = edge + text.lower() + b"\xff", 0.0
    for i in range(order, len(x)):
        out: set[int] = set()
        for k in range(order, -2, -1):
            if k < 0:
                total += log10(1 / (256 - len(out)))
                break
            seen = {s: c for s, c in tries[k].get(x[i - k : i], {}).items() if s not in out}
            t, d = sum(seen.values()), len(seen)
            if k == 0 and len(out) + d == 256:
                d = 0
            if x[i] in seen:
                total += log10(seen[x[i]] / (t + d))
                break
            if t:
                total += log10(d / (t + d))
            out |= set(seen)
    return total
