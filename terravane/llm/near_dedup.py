"""HyperMinHash near-duplicate components.

Each document's distinct word shingles give REGISTERS registers; a register holds the leading-zero count and
the next MANTISSA bits of the least hash under its own hash function. ROWS registers make a band; documents
that share a band are candidates. The share of equal registers, less what chance collisions of compressed
registers add, estimates the Jaccard similarity; pairs are verified on their full shingle sets unless their
estimate is so low that a pair at the threshold has it with probability 1e-9 at most.

Rows with equal sets collapse to one node first. Candidates of a band group are not paired with each other: the
members meet the group's least node, and verified links join components. Members of groups that still hold
several components go on through an exact prefix filter: two sets at the threshold share one of the first few
shingles of each, in any order of all shingles. That order begins with hashes and puts shingles last that prefixes
of too many components share, pass by pass, so that what a prefix holds is rare or one component's; a member whose
prefix groups hold no other component has no link left and goes. In the groups that remain, members first meet a
leader drawn for each group; then, in groups with up to SMALL members outside their largest component, these meet
all others, and the members of further groups (one for each set of members) are compared in pairs of bounded
chunks, whose exact intersections are matrix products that yield only the links that join components. Estimates play no part in these last two.

Before the texts of a pair meet, its sets' parities do: each shingle flips one of PARITIES bits, so two sets differ in
at least as many shingles as their parities in bits, and a pair that differs in too many for the threshold is none.

A pair at the threshold 0.8 shares no band with probability (1 - 0.8^3)^24 = 3e-8; the estimate adds 1e-9 at most.

Defined cases: null or blank text has no set and links with nothing; texts shorter than a shingle are one
shingle; rows that share a doc_id are judged each by its own text; a null doc_id forms no link (component_id
null, kept true); further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textblock as tb
from terravane.operators.graph import components
from terravane.runtime import arrow_limits, cut, discard, ship

REGISTERS, ROWS, MANTISSA = 72, 3, 10
#: Bits of the parities that a pair must pass before its texts meet.
PARITIES = 1024
#: Members of a chunk, and bytes of their packed texts, about.
CHUNK, CHUNK_BYTES = 512, 4 << 20
#: Members outside the largest component of a prefix group that meet all its others, at most; passes that put frequent shingles last.
SMALL, PASSES = 32, 4


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = tb.mix(np.arange(1, 2 * k + 1, dtype=tb.U) * tb.U(0x9E3779B97F4A7C15))
    return x[:k] | tb.U(1), x[k:]


def registers(sets: np.ndarray, starts: np.ndarray, k: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """uint16 registers [texts, k] of the concatenated non-empty sets that begin at starts."""
    out = np.empty((len(starts), k), np.uint16)
    mul, add = _seeds(k)
    for j in range(k):
        h = sets * mul[j]
        h ^= h >> tb.U(32)
        h *= add[j] | tb.U(1)
        low = np.minimum.reduceat(h, starts)
        top = (low >> tb.U(11)).astype(np.float64)
        zeros = np.minimum(53 - np.frexp(top)[1], 63).astype(tb.U)
        norm = low << zeros
        out[:, j] = (zeros << tb.U(mantissa)) | ((norm >> tb.U(63 - mantissa)) & tb.U((1 << mantissa) - 1))
    return out


@lru_cache(1)
def _chance() -> np.ndarray:
    """P(two unrelated registers are equal) by the log2 of both sets' sizes."""
    lead = np.repeat(np.arange(48), 1 << MANTISSA)
    low = 2.0 ** -(lead + 1.0) * (1 + np.tile(np.arange(1 << MANTISSA), 48) / (1 << MANTISSA))
    high = low + 2.0 ** -(lead + 1.0) / (1 << MANTISSA)
    p = [np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-12))) for n in 2.0 ** np.arange(26)]
    return np.array([[float((x * y).sum()) for y in p] for x in p])


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from register rows a, b of sets of n and m shingles, corrected for chance collisions."""
    size = lambda x: np.minimum(np.log2(np.maximum(x, 1)).round().astype(int), 25)
    e = _chance()[size(n), size(m)]
    return ((a == b).mean(axis=-1) - e) / (1 - e)


def lowest(threshold: float, k: int = REGISTERS, missed: float = 1e-9) -> float:
    """Of pairs at the threshold, at most a share missed has an estimate below this: a binomial tail of equal registers."""
    tail = 0.0
    for c in range(k):
        tail += math.comb(k, c) * threshold**c * (1 - threshold) ** (k - c)
        if tail > missed:
            return (c - 0.5) / k
    return (k - 0.5) / k


def _sketch(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tb.blocks(batches):
            words = tb.Words(texts)
            sets = [np.unique(words.shingles(i, shingle_words)) for i in range(len(texts))]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            regs: list = [None] * len(texts)
            fp = np.zeros((2, len(texts)), np.int64)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                for j, c in enumerate((0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03)):
                    fp[j, full] = tb.signed(np.add.reduceat(tb.mix(every ^ tb.U(c)), starts))
                for i, r in zip(full, registers(every, starts), strict=True):
                    regs[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(fp[0]), pa.array(fp[1]), pa.array(regs, pa.binary())], names=[*ROW, "n_shingles", "fp1", "fp2", "regs"])

    return run


#: What tells a row's text from others of its doc_id.
ROW = ["doc_id", "_text_1", "_text_2"]


def _keyed(docs: DataFrame) -> list:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_text_1"), F.xxhash64(F.lit(1), text).alias("_text_2")]


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    rows = docs.select(*_keyed(docs), F.col("text").cast("string"))
    return rows.mapInArrow(_sketch(shingle_words), "doc_id long, _text_1 long, _text_2 long, n_shingles long, fp1 long, fp2 long, regs binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, rep): the band's number and its registers, packed whole into one long."""
    for batch in batches:
        if batch.num_rows:
            r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS // ROWS, ROWS).astype(np.int64)
            key = r[..., 0] | r[..., 1] << 16 | r[..., 2] << 32 | np.arange(REGISTERS // ROWS) << 48
            rep = np.repeat(np.array(batch.column(0)), REGISTERS // ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(rep)], names=["band", "rep"])


def _near(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                keep = estimate(a, b, np.array(batch.column("na")), np.array(batch.column("nb"))) >= floor
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def parities(s: np.ndarray) -> bytes:
    """One bit for each of PARITIES classes of shingles: whether the set has an odd number of the class."""
    return np.packbits(np.bincount((tb.mix(s ^ tb.U(0xC2B2AE3D27D4EB4F)) % tb.U(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def possible(n: np.ndarray, m: np.ndarray, a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    """Whether sets of n and m shingles with parities a and b can be at the threshold; never False for those that are."""
    x, y = (np.frombuffer(b"".join(z), np.uint64).reshape(-1, PARITIES // 64) for z in (a, b))
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return 100 * (n + m - apart) >= percent * (n + m + apart)


def _possible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = possible(*(np.array(batch.column(c)) for c in ("na", "nb")), *(batch.column(c).to_pylist() for c in ("sa", "sb")), percent)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _pack(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tb.blocks(batches):
            packed = [zlib.compress(t, 1) for t in texts]
            words = tb.Words(texts)
            sets = [np.unique(words.shingles(i, shingle_words)) for i in range(len(texts))]
            more = [pa.array(list(map(len, z)), pa.int64()) for z in (packed, sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), *more, pa.array(list(map(parities, sets)), pa.binary())], names=["rep", "packed", "bytes", "n", "parities"])

    return run


def _verify(shingle_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            left, right = batch.column("ta"), batch.column("tb")
            for i, a in enumerate(batch.column("a").to_pylist()):
                if last[0] != a:
                    last = (a, _set(left[i].as_py(), shingle_words))
                x, y = last[1], _set(right[i].as_py(), shingle_words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _set(packed: bytes, shingle_words: int) -> np.ndarray:
    return np.unique(tb.Words([zlib.decompress(packed)]).shingles(0, shingle_words))


def _products(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every x with every y: shingles that both sides have, in slices of a matrix product."""
    of = lambda z: (np.concatenate(z), np.repeat(np.arange(len(z)), [len(s) for s in z]))
    (hx, ox), (hy, oy) = of(x), of(y)
    both = np.intersect1d(hx, hy)
    out = np.zeros((len(x), len(y)), np.float32)
    at = []
    for h, o in ((hx, ox), (hy, oy)):
        p = np.minimum(np.searchsorted(both, h), max(0, len(both) - 1))
        ok = both[p] == h if len(both) else np.zeros(len(h), bool)
        order = np.argsort(p[ok], kind="stable")
        at.append((p[ok][order], o[ok][order]))
    for low in range(0, len(both), 2048):
        sides = []
        for (p, o), n in zip(at, (len(x), len(y)), strict=True):
            i, j = np.searchsorted(p, (low, low + 2048))
            m = np.zeros((n, 2048), np.float32)
            m[o[i:j], p[i:j] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _inside(shingle_words: int, percent: int):
    """Verified links of a chunk pair that join different components, as few as join them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                left, right = x.as_py(), y.as_py()
                sets = [[_set(m["packed"], shingle_words) for m in z] for z in (left, right)]
                n = [np.array([len(s) for s in z]) for z in sets]
                both = _products(*sets)
                links = 100 * both >= percent * (n[0][:, None] + n[1][None] - both)
                links &= np.array([m["comp"] for m in left])[:, None] != np.array([m["comp"] for m in right])[None]
                up: dict[int, int] = {}
                found: list[tuple[int, int]] = []
                for i, j in zip(*(z.tolist() for z in np.nonzero(links)), strict=True):
                    a, b = left[i]["comp"], right[j]["comp"]
                    while a in up:
                        a = up[a]
                    while b in up:
                        b = up[b]
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        found.append((left[i]["rep"], right[j]["rep"]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _prefixes(shingle_words: int, percent: int, late):
    """(h, rep, comp): the first shingles of each set, those of late after all others, as many as a set at the threshold must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = late.value
        for batch in batches:
            out = []
            for packed in batch.column("packed"):
                s = _set(packed.as_py(), shingle_words)
                k = len(s) + 1 + -len(s) * percent // 100
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    rare = last[at] != s
                    s = np.concatenate((s[rare], s[~rare]))
                out.append(s[:k])
            if out:
                n = [len(s) for s in out]
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(np.concatenate(out))), *(pa.array(np.repeat(np.array(batch.column(c)), n)) for c in ("rep", "comp"))], names=["h", "rep", "comp"])

    return run


def _classes(docs: DataFrame, shingle_words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches of all rows; a node for each set, with its least row; of nodes that have a link: node, comp)."""
    spark = docs.sparkSession
    ship(spark)
    arrow_limits(spark)
    sketch = cut(sketches(docs, shingle_words), "sketch")
    classes = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "fp1", "fp2").agg(F.min(F.struct(*ROW)).alias("row"), F.first("regs").alias("regs"))
    # numbered as they are written, so numbers stay
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "n_shingles", "fp1", "fp2", "row.*", "regs"), "classes")
    return sketch, classes, _links(docs, classes, shingle_words, percent)


def near_components(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; documents link at Jaccard >= percent / 100."""
    sketch, classes, found = _classes(docs, shingle_words, percent)
    of = found.join(classes.select("node", "doc_id"), "node")
    of = cut(of, "linked")
    least = of.join(cut(of.groupBy("comp").agg(F.min("doc_id").alias("least")), "least"), "comp").select("node", "least")
    named = classes.join(least, "node", "left").select("n_shingles", "fp1", "fp2", F.coalesce("least", "doc_id").alias("least"))
    result = (
        sketch.select("doc_id", "n_shingles", "fp1", "fp2")
        .join(named, ["n_shingles", "fp1", "fp2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    result = cut(result, "near-components")
    discard(sketch, classes, found, of)
    return result


def _links(docs: DataFrame, classes: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Components (node, comp) of the nodes that have a verified link."""
    floor = lowest(percent / 100)
    sketch_of = classes.select(F.col("node").alias("rep"), F.col("n_shingles").cast("int").alias("n"), "regs")
    banded = sketch_of.select("rep", "regs").mapInArrow(_bands, "band long, rep long")
    # written first, so that the join has no aggregation beside it and a hot band's rows may be split
    groups = cut(banded.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("top")).filter("lead < top").select("band", "lead"), "groups")
    members = cut(banded.join(groups, "band"), "members")
    edges = members.filter("lead <> rep").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    close = cut(_estimated(edges, sketch_of, floor), "close")
    packed = cut(_texts(docs, classes.select(F.col("node").alias("rep"), *ROW).join(members.select("rep").distinct(), "rep"), shingle_words), "packed")
    links = cut(_exact(close, packed, shingle_words, percent), "links-1")
    found = components(links, "cc-1")
    # members of groups with several components
    at = cut(members.select("band", "rep").join(found, F.col("rep") == F.col("id"), "left").select("band", "rep", F.coalesce("comp", "rep").alias("comp")), "grouped")
    several = cut(at.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("band"), "several")
    apart = cut(at.join(several, "band").select("rep", "comp").distinct(), "apart")
    prefixes = _live(apart, packed, shingle_words, percent)
    for how in (_to_leaders, _in_groups):
        if prefixes is None:
            break
        more = cut(how(prefixes, sketch_of, packed, shingle_words, percent, floor), "links-2")
        if not more.isEmpty():
            old, prefixes_old = found, prefixes
            # a component is joined to others by its least member
            found = components(more.union(found.filter("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))), "cc-2")
            prefixes = cut(prefixes.drop("comp").join(found, F.col("rep") == F.col("id"), "left").select("h", "rep", F.coalesce("comp", "rep").alias("comp")), "prefixes")
            discard(old, prefixes_old)
        discard(more)
    discard(groups, members, close, packed, links, at, several, apart, *([prefixes] if prefixes is not None else []))
    out = cut(found.select(F.col("id").alias("node"), "comp"), "linked-nodes")
    discard(found)
    return out


def _texts(docs: DataFrame, ids: DataFrame, shingle_words: int) -> DataFrame:
    """(rep, packed, bytes, n, parities) of the rows of docs that ids (rep and ROW) name, one for each rep."""
    keyed = docs.select(*_keyed(docs), F.col("text").cast("string"))
    packed = cut(_picked(keyed, ids, ROW).select("rep", "text").mapInArrow(_pack(shingle_words), "rep long, packed binary, bytes long, n long, parities binary"), "texts")
    if packed.groupBy("rep").count().filter("count > 1").isEmpty():
        return packed
    return packed.dropDuplicates(["rep"])  # rows that are repeated whole


def _several(prefixes: DataFrame) -> DataFrame:
    """(h, n, main, minor, who): prefix groups that hold several components, the largest of them and how many members
    are in others; who tells sets of members apart."""
    per = prefixes.groupBy("h", "comp").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("w"))
    g = per.groupBy("h").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("comp", "c").alias("main"), F.count("*").alias("k"), F.bit_xor("w").alias("who"))
    return g.filter("k > 1").select("h", "n", "main", (F.col("n") - F.col("most")).alias("minor"), "who")


def _live(apart: DataFrame, packed: DataFrame, shingle_words: int, percent: int) -> DataFrame | None:
    """(h, rep, comp): the prefixes of those that may still have a link to another component, or None."""
    spark = apart.sparkSession
    left, late = cut(apart.join(packed.select("rep", "packed"), "rep"), "left"), np.zeros(0, tb.U)
    for i in range(PASSES):
        prefixes = cut(left.mapInArrow(_prefixes(shingle_words, percent, spark.sparkContext.broadcast(late)), "h long, rep long, comp long"), "prefixes")
        groups = cut(_several(prefixes), "prefix-groups")
        sizes = prefixes.agg(F.count("*")).first()[0]
        # fewer than 2**20 for each pass, however many prefixes there are
        wide = groups.filter(F.col("minor") > max(SMALL, sizes >> 20)).select("h").toArrow()["h"].to_numpy()
        shared = prefixes.join(groups.select("h"), "h")
        done = i == PASSES - 1 or not len(wide)
        if done:
            out = cut(shared, "live-prefixes")
            discard(prefixes, groups, left)
            return None if out.isEmpty() else out
        some = cut(shared.select("rep").distinct(), "shared")
        if 4 * some.count() <= 3 * left.count():  # else it costs more to move the texts than to leave the others among them
            old = left
            left = cut(left.join(some, "rep", "left_semi"), "left")
            discard(old)
        discard(prefixes, groups, some)
        late = np.union1d(late, np.array(wide, np.int64).view(tb.U))
    return None


def _to_leaders(prefixes: DataFrame, sketch_of: DataFrame, packed: DataFrame, shingle_words: int, percent: int, floor: float) -> DataFrame:
    """Verified links of the members of each group to one of them, drawn by hash."""
    lead = cut(prefixes.groupBy("h").agg(F.min_by("rep", F.xxhash64("h", "rep")).alias("a"), F.min_by("comp", F.xxhash64("h", "rep")).alias("c")), "prefix-leads")
    pairs = prefixes.join(lead, "h").filter("comp <> c").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    return _exact(cut(_estimated(pairs, sketch_of, floor), "close-2"), packed, shingle_words, percent)


def _in_groups(prefixes: DataFrame, sketch_of: DataFrame, packed: DataFrame, shingle_words: int, percent: int, floor: float) -> DataFrame:
    """All links between components that share a prefix group."""
    groups = cut(_several(prefixes), "prefix-groups")
    own = cut(prefixes.join(groups, "h"), "prefix-members")
    size = sketch_of.select("rep", F.col("n").alias("size"))
    few = cut(own.filter(F.col("minor") <= SMALL).select("h", "rep", "comp", "main").join(size, "rep"), "prefix-few")
    # each member meets those, at most SMALL, that are outside the group's largest component
    other = few.filter("comp <> main").select("h", F.col("rep").alias("b"), F.col("comp").alias("c"), F.col("size").alias("m"))
    pairs = few.join(other, "h").filter("comp <> c").filter(100 * F.least("size", "m") >= percent * F.greatest("size", "m")).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    links = _exact(cut(pairs, "prefix-pairs"), packed, shingle_words, percent)
    wide = groups.filter(F.col("minor") > SMALL).groupBy("n", "who").agg(F.min("h").alias("band")).select("band")
    if wide.isEmpty():
        return links
    apart = cut(own.join(wide, F.col("h") == F.col("band")).select("band", "rep", "comp").join(packed.select("rep", "bytes"), "rep"), "wide")
    parts = cut(apart.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("bytes") / CHUNK_BYTES)).alias("parts")), "parts")
    return links.union(_blocked(apart.drop("bytes").join(parts, "band"), packed, shingle_words, percent))


def _picked(docs: DataFrame, ids: DataFrame, on: list[str], bound: int = 500_000) -> DataFrame:
    """Rows of docs with the columns of ids: those are sent to every task only while they are at most bound."""
    few = ids.limit(bound + 1).count() <= bound
    return docs.join(F.broadcast(ids) if few else ids, on)


def _estimated(edges: DataFrame, sketch_of: DataFrame, floor: float) -> DataFrame:
    a = sketch_of.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = sketch_of.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    return edges.join(b, "b").join(a, "a").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_near(floor), "a long, b long")


def _exact(pairs: DataFrame, packed: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Those of the pairs that are links; texts are moved only for pairs whose parities allow it."""
    a = packed.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parities").alias("sa"))
    b = packed.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parities").alias("sb"))
    pairs = cut(pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible(percent), "a long, b long"), "possible")
    a = packed.select(F.col("rep").alias("a"), F.col("packed").alias("ta"))
    b = packed.select(F.col("rep").alias("b"), F.col("packed").alias("tb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_verify(shingle_words, percent), "a long, b long").distinct()


def _blocked(apart: DataFrame, packed: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Links between components of a group, by pairs of bounded chunks of its members."""
    chunks = apart.join(packed.select("rep", "packed"), "rep").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("parts")))
    chunks = chunks.repartition("band", "chunk").groupBy("band", "chunk", "parts").agg(F.collect_list(F.struct("rep", "comp", "packed")).alias("x"))
    left = chunks.withColumn("other", F.explode(F.sequence(F.col("chunk"), F.col("parts") - 1)))
    right = chunks.select("band", F.col("chunk").alias("other"), F.col("x").alias("y"))
    return left.join(right, ["band", "other"]).select("x", "y").mapInArrow(_inside(shingle_words, percent), "a long, b long").distinct()


def kept_documents(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one for each component, with its least doc_id; rows without an id or a word all stay.

    Rows that share a doc_id are told apart by their texts; of rows that are repeated whole one stays."""
    sketch, classes, found = _classes(docs.select("doc_id", "text"), shingle_words, percent)
    discard(sketch)
    first = cut(classes.join(found, "node", "left").groupBy(F.coalesce("comp", "node")).agg(F.min(F.struct(*ROW)).alias("row")).select("row.*"), "first-rows")
    discard(classes, found)
    keys = [c.alias(f"_near_{i}") for i, c in enumerate(_keyed(docs))]
    on = [f"_near_{i}" for i in range(len(keys))]
    free = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    judged = docs.filter(~free).select(*docs.columns, *keys)
    some = judged.join(first.toDF(*on), on, "left_semi").dropDuplicates(on)
    return some.select(docs.columns).union(docs.filter(free))


def brute_components(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, least reachable id) by comparing every pair: for tests."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}
