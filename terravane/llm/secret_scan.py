"""Secret spans: fixed patterns, and a randomness test battery for what they miss.

The patterns (assignments, access keys, long hexadecimal runs) give the base spans. The battery looks at every
run of at least SHORTEST characters of the base64 alphabets, and at what base spans leave of a run that they cut
(without one separator beside the cut). Of what does not stand, it looks at the parts without - and _, without +
and /, and without all four: a key in a path or behind a name need not share an alphabet with its surroundings.
It infers the run's encoding (hexadecimal,
base32 or base64 with or without case), maps characters to their values, and measures three statistics that are
standard normal for uniform independent characters, each compared with what prose of that length would give:

* chi-squared uniformity over the alphabet, where prose crowds on few letters;
* runs of one character class (capital, small, digit), where prose seldom changes class;
* serial correlation of neighbouring values, which encodings of random bytes lack.

A run's p-value is the chance that prose of its length looks as random as it does (the first two statistics,
combined by Stouffer's rule); a run that itself rejects uniformity, runs or correlation at LEVEL is no secret.
Within a document the p-values of whole runs, of what is left of cut ones, and of parts go each through
Benjamini-Hochberg control at rate FDR with weights that grow with the run's length (mean one), as short runs
carry little evidence. Parts that stand and overlap are one span.

Defined cases: null text is empty and has no span; texts of any length are scanned whole; spans are counted in
code points, end exclusive; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textblock as tb
from terravane.runtime import arrow_limits, ship

KINDS = ("assign", "access", "hex", "random")
SHORTEST, LEVEL, FDR = 16, 1e-3, 1e-3

# fixed patterns
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: What an assignment must contain, in small letters, for its pattern to be tried.
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_HEX, _ANY = 1, 2
_JOINS = (b"+", b"/", b"_", b"-")
_BITS = np.zeros(256, np.uint8)
_BITS[[ord(c) for c in "0123456789abcdef"]] |= _HEX
_BITS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] |= _ANY

#: Alphabets in the order they are tried, by name.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "small": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Parts of a run: without - and _, without + and /, without all four.
PARTS = [re.compile(b"[A-Za-z0-9%s]{%d,}" % (more, SHORTEST)) for more in (b"+/", b"_-", b"")]
#: Sum of squared letter shares of prose, and its share of class changes between neighbours.
CROWDING, CHANGES = 0.066, 0.05


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], mask, [False])).view(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= least
    return first[long], last[long]


def _upper(z: float) -> float:
    """P(standard normal > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(run: str) -> str | None:
    seen = set(run)
    return next((name for name, letters in ALPHABETS.items() if seen <= set(letters)), None)


def battery(run: str) -> tuple[float, float]:
    """(chance that prose looks as random, least chance that uniform characters look so regular) of a run."""
    name = infer(run)
    if name is None:
        return 1.0, 1.0
    letters = ALPHABETS[name]
    n, a = len(run), len(letters)
    value = np.array([letters.index(c) for c in run])
    expected = n / a
    chi = float(((np.bincount(value, minlength=a) - expected) ** 2).sum() / expected)
    uniform = (chi - (a - 1)) / math.sqrt(2 * (a - 1) * max(n - 1, 1) / n)
    crowd = a * CROWDING - 1
    prose = ((a - 1) + (n - 1) * crowd - chi) / math.sqrt(2 * (a - 1) + 4 * n * max(crowd, 0) * (1 + crowd))
    classes = np.array([0 if c.isdigit() else 1 if c.isupper() else 2 for c in run])
    share = np.bincount([0 if c.isdigit() else 1 if c.isupper() else 2 for c in letters], minlength=3) / a
    p = 1 - float((share**2).sum())
    changes = int((classes[1:] != classes[:-1]).sum())
    steady = ((n - 1) * p - changes) / math.sqrt(max((n - 1) * p * (1 - p), 1e-9)) if p > 0 else 0.0
    mixed = (changes - (n - 1) * CHANGES) / math.sqrt((n - 1) * CHANGES * (1 - CHANGES))
    v = value - value.mean()
    serial = abs(float((v[1:] * v[:-1]).sum()) / max(float((v * v).sum()), 1e-9)) * math.sqrt(n)
    regular = min(_upper(uniform), _upper(steady), 2 * _upper(serial))
    return _upper((prose + mixed) / math.sqrt(2)), regular


def discoveries(chances: list[float], lengths: list[int], rate: float = FDR) -> list[int]:
    """Which p-values stand under weighted Benjamini-Hochberg control, with weights by length."""
    if not chances:
        return []
    w = np.sqrt(np.array(lengths, float))
    q = np.array(chances) / (w / w.mean())
    order = np.argsort(q, kind="stable")
    good = np.flatnonzero(q[order] <= rate * np.arange(1, len(q) + 1) / len(q))
    return sorted(order[: good[-1] + 1].tolist()) if len(good) else []


def _outside(text: bytes, a: int, b: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What of a run is outside the spans, without a separator beside each cut; the run itself if none cuts it."""
    out, at = [], a
    for s, _, e in sorted(spans):
        if s < b and at < e:
            out.append((at, s))
            at = e
    out.append((at, b))
    trim = lambda x, y: (x + (x > a and text[x : x + 1] in _JOINS), y - (y < b and text[y - 1 : y] in _JOINS))
    return [(x, y) for x, y in (trim(x, y) for x, y in out if x < y) if y - x >= SHORTEST]


def _standing(text: bytes, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places that the battery takes for secrets, as one family."""
    found = [battery(text[a:b].decode()) for a, b in places]
    return [places[k] for k in discoveries([c if regular >= LEVEL else 1.0 for c, regular in found], [b - a for a, b in places])]


def _joined(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scan(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's spans in bytes, in order; kind counts into KINDS."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    bits = _BITS[data]
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    any_first, any_last = _runs(bits & _ANY > 0, SHORTEST)
    hex_first, hex_last = _runs(bits & _HEX > 0, 24)
    for a, b in zip(hex_first.tolist(), hex_last.tolist(), strict=True):
        i = int(np.searchsorted(at, a, side="right")) - 1
        out[i].append((a - int(at[i]), 2, b - int(at[i])))
    for i, t in enumerate(texts):
        if b"AKIA" in t:
            out[i] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20]
        low = t.lower()
        if any(h in low for h in HINTS):
            out[i] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if m.end(1) - m.start(1) >= 6]
    owner = np.searchsorted(at, any_first, side="right") - 1
    tested: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
    for i, a, b in zip(owner.tolist(), any_first.tolist(), any_last.tolist(), strict=True):
        a, b = a - int(at[i]), b - int(at[i])
        runs, rests = tested.setdefault(i, ([], []))
        if any(s < b and a < e for s, _, e in out[i]):
            rests += _outside(texts[i], a, b, out[i])
        else:
            runs.append((a, b))
    for i, (runs, rests) in tested.items():
        good = _standing(texts[i], runs) + _standing(texts[i], rests)
        left = {*runs, *rests} - set(good)
        parts = {m.span() for a, b in left for p in PARTS for m in p.finditer(texts[i], a, b)} - left
        out[i] += [(a, 3, b) for a, b in good + _joined(_standing(texts[i], sorted(parts)))]
    return [sorted(spans) for spans in out]


def in_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if not spans or text.isascii():
        return spans
    data = np.frombuffer(text, np.uint8)
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tb.blocks(batches):
        spans = [in_points(t, s) for t, s in zip(texts, scan(texts), strict=True)]
        n = [[sum(k == kind for _, k, _ in s) for s in spans] for kind in range(4)]
        base = [hashlib.sha256(written([x for x in s if x[1] < 3]).encode()).hexdigest() for s in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array([written(s) for s in spans], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
        )


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row."""
    ship(docs.sparkSession)
    arrow_limits(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_found, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """The text with each stretch of (overlapping) spans replaced by [SECRET]."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], b"[SECRET]"]
        at = max(at, b)
    return b"".join([*out, text[at:]])


def _clean(text: int, chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tb.blocks(batches):
            spans = scan(texts)
            if any(spans):
                null = batch.column(text).is_null().to_pylist()
                new = [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                columns = list(batch.columns)
                columns[text] = pa.array([None if n else t.decode() for t, n in zip(new, null, strict=True)], pa.string())
                if chars is not None:
                    old = columns[chars].to_pylist()
                    columns[chars] = pa.array([len(t.decode()) if s else n for t, s, n in zip(new, spans, old, strict=True)], columns[chars].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return run


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with secrets replaced in text, and n_chars of changed texts counted anew."""
    ship(docs.sparkSession)
    arrow_limits(docs.sparkSession)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(_clean(docs.columns.index("text"), chars), docs.schema)
