"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by id into shards whose bounds follow from the data alone. Ids fall into cells of equal
width, whose bytes are summed; a cell with more bytes than a shard should have is cut again between its own least
and greatest id, or by a hash of the record where all its ids are one (or null), until no cell is too heavy;
neighbouring cells are then joined into shards of about equal bytes. So neither an outlying id, nor one id or no
id on many rows, makes a heavy shard; rows that are equal altogether are counted first and dealt out by number.
Each shard is written in id order as gzip members, one for each record, rolled into a new file once it holds
ROLL compressed bytes. Headers and digests are regenerated from the payload; of records with equal payloads
the one with the largest id is the response and the others revisit it.

Files are first written by Spark under a temporary folder (whose own commit drops what failed or repeated tasks
left); then each is renamed to its shard and number, and a manifest with every file's name and bytes is
renamed into place last: a folder without a manifest is not an archive. All paths go through
Hadoop's file systems, so the archive may lie wherever Spark writes.

A file is written as a line of Spark's text writer: an empty gzip member ends it, whose last byte is the line's
end.

Defined cases: a null html is an empty payload; a null url is written as the empty target; records with a null
id are written, and never referred to unless all equal payloads have none; repeated rows are each written, and
rows that share the largest id of their payload are each a response; payloads shorter than the revisit bound are always responses; an empty table gives an archive with no file;
further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.runtime import arrow_limits, cut, discard, remove, scratch, ship

#: Compressed bytes after which a new file begins; payload bytes that a shard has, about; shards, at least.
ROLL, SHARD, LEAST = 32 << 20, 256 << 20, 64
#: Cells that a heavy cell is cut into for each shard that it would fill; cells at least, and at most.
FINER, FEWEST, MOST = 8, 64, 1 << 16

_DATE = "2000-01-01T00:00:00Z"
#: An empty gzip member.
EMPTY = bytes.fromhex("1f8b08000000000000ff" "0300" "0000000000000000")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    """One gzip member without name or time: equal data, equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record's bytes; a revisit carries no payload but keeps its digest and length."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{i}')}>"
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    digest = "sha1:" + base32_sha1(payload)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = {"WARC-Type": kind, "WARC-Record-ID": name(page_id), "WARC-Date": _DATE, "WARC-Target-URI": target, "X-Page-ID": "" if page_id is None else page_id, "X-Payload-Bytes": len(payload)}
    head |= {"WARC-Payload-Digest": digest, "WARC-Block-Digest": "sha1:" + base32_sha1(block), "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to), "X-Refers-To-Page": refers_to}
    head["Content-Length"] = len(block)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a file of gzip members, with lengths and digests checked."""
    view = memoryview(data)
    while len(view):
        z = zlib.decompressobj(31)
        raw = z.decompress(view)
        raw += z.flush()
        view = view[len(view) - len(z.unused_data) :]
        if not raw:
            continue
        top, _, rest = raw.partition(b"\r\n\r\n")
        lines = top.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record: {lines[0][:40]}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(head["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + base32_sha1(block) != head["WARC-Block-Digest"]:
            raise ValueError("a record's length or block digest differs")
        payload = block.partition(b"\r\n\r\n")[2]
        if head["WARC-Type"] == "response" and "sha1:" + base32_sha1(payload) != head["WARC-Payload-Digest"]:
            raise ValueError("a record's payload digest differs")
        yield head, payload


def _files(roll: int):
    """Sorted rows of whole shards to rolled files: one row (shard, part, data) for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, held, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            data = b"".join(held) + EMPTY
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([data[:-1]], pa.binary())], names=["shard", "part", "data"])

        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("shard", "page_id", "url", "html", "refers_to")}
            shards, ids, urls, refs = (batch.column(at[n]).to_pylist() for n in ("shard", "page_id", "url", "refers_to"))
            html = batch.column(at["html"])
            for i, s in enumerate(shards):
                if held and (s != shard or size >= roll):
                    yield out()
                    part = part + 1 if s == shard else 0
                    held, size = [], 0
                shard = s
                member = gzip_member(record(ids[i], urls[i], html[i].as_py() or b"", refs[i]))
                held.append(member)
                size += len(member)
        if held:
            yield out()

    return run


_LEVEL = "cell long, base long, first long, shift int, step long, by_id boolean"


def _placed(rows: DataFrame, levels: list[DataFrame], how: str) -> DataFrame:
    """rows (page_id, r) with the cell that all levels lead to; with how 'inner', only rows of cells that the last level cuts."""
    rows = rows.withColumn("cell", F.col("page_id").isNull().cast("long"))
    for level in levels:  # a level has a row for each cell that it cuts: fewer than there are shards
        at = F.expr("CASE WHEN by_id THEN shiftright(page_id, shift) ELSE r END")
        rows = rows.join(F.broadcast(level), "cell", how).withColumn("_at", at - F.col("first"))
        rows = rows.withColumn("cell", F.coalesce(F.col("base") + F.expr("_at div step"), F.col("cell"))).drop("base", "first", "shift", "step", "by_id", "_at")
    return rows


def shard_map(digests: DataFrame, shard_bytes: int = SHARD, least: int = LEAST) -> tuple[list[DataFrame], list[tuple], int]:
    """(levels of cells, (cell, shard, rows of a shard where equal rows fill several) of each, how many shards)
    of digests (page_id, r, n)."""
    spark = digests.sparkSession
    levels: list[DataFrame] = []
    final: list[tuple] = []  # (id, r, cell, bytes, rows, whether all rows are equal)
    base, goal = 2, 0
    while True:
        placed = _placed(digests, levels, "inner").groupBy("cell")
        sums = placed.agg(F.sum(F.col("n") + 256).alias("bytes"), F.count("*").alias("rows"), *(f(c) for c in ("page_id", "r") for f in (F.min, F.max))).collect()
        goal = goal or max(1, min(shard_bytes, sum(s.bytes for s in sums) // least + 1))
        cut_again = []
        for s in sums:
            id0, id1, r0, r1 = tuple(s)[3:]
            by_id = id0 is not None and id0 < id1
            if s.bytes <= goal or not by_id and r0 == r1:
                final.append((id0, r0, s.cell, s.bytes, s.rows, not by_id and r0 == r1))
                continue
            parts = min(MOST, max(FEWEST, FINER * s.bytes // goal))
            shift = int(by_id and id1 - id0 >= 1 << 62)
            first, last = (id0 >> shift, id1 >> shift) if by_id else (r0, r1)
            step = (last - first) // parts + 1
            cut_again.append((s.cell, base, first, shift, step, by_id))
            base += (last - first) // step + 1
        if not cut_again:
            break
        levels.append(spark.createDataFrame(sorted(cut_again), _LEVEL))
    of, shard, run = [], -1, goal
    for _, _, cell, size, rows, equal in sorted(final, key=lambda c: (c[0] is not None, c[0] or 0, c[1])):
        if equal and size > goal and rows > 1:  # whole shards of equal rows
            per = max(1, goal * rows // size)
            of.append((cell, shard + 1, per))
            shard, run = shard - (-rows // per), goal
            continue
        if run >= goal or run + size > 2 * goal:  # a shard begins with a cell, once the one before has its bytes
            shard, run = shard + 1, 0
        run += size
        of.append((cell, shard, None))
    return levels, of, max(1, shard + 1)


def _tasks(spark: SparkSession, n: int) -> list[int]:
    """For each of n numbers a key that Spark's hash partitioning into n deals to its own partition."""
    found: dict[int, int] = {}
    low, many = 0, 16 * n + 64
    while len(found) < n:
        keys = spark.range(low, low + many).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect()
        for k in keys:
            found.setdefault(k.at, k.id)
        low += many
    return [found[i] for i in range(n)]


def write(pages: DataFrame, out: str, revisit_from: int = 0, roll: int = ROLL) -> dict:
    """Write pages (page_id, url, html) as an archive at out; returns its manifest."""
    spark = pages.sparkSession
    ship(spark)
    arrow_limits(spark)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    # what tells rows of one id apart, as a number of 63 bits
    pages = pages.withColumn("r", F.shiftrightunsigned(F.xxhash64("url", "html"), 1))
    digests = cut(pages.select("page_id", "r", F.sha1("html").alias("digest"), F.length("html").alias("n")), "warc-digests")
    leads = digests.filter(F.col("n") >= revisit_from).groupBy("digest").agg(F.max("page_id").alias("lead"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "lead")
    refers = digests.filter(F.col("n") >= revisit_from).join(leads, "digest").filter("page_id < lead").select("page_id", F.col("digest").alias("d"), F.col("lead").alias("refers_to")).distinct()
    levels, shards, n = shard_map(digests)
    if refers.isEmpty():
        rows = pages.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        rows = pages.withColumn("d", F.sha1("html")).join(refers, ["page_id", "d"], "left").drop("d")
    rows = _placed(rows, levels, "left").join(F.broadcast(spark.createDataFrame(shards, "cell long, shard long, per long")), "cell")
    record_ = ["page_id", "url", "html", "refers_to"]
    if any(per for *_, per in shards):
        equal = rows.filter("per IS NOT NULL").groupBy(*record_, "shard", "per").agg(F.count("*").alias("c"))
        equal = equal.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).withColumn("shard", F.col("shard") + F.expr("copy div per"))
        rows = rows.filter("per IS NULL").select("shard", *record_).union(equal.select("shard", *record_))
    own = spark.createDataFrame(list(enumerate(_tasks(spark, n))), "shard long, task long")
    rows = rows.join(F.broadcast(own), "shard").select("task", F.col("shard").cast("int"), *record_)
    rows = rows.repartition(n, "task").drop("task").sortWithinPartitions("shard", *record_)
    files = rows.mapInArrow(_files(roll), "shard int, part int, data binary")
    temporary = f"{out}/_temporary-{uuid.uuid4().hex[:12]}"
    files.select(F.col("data").cast("string").alias("value"), F.format_string("%05d-%05d", "shard", "part").alias("name")).write.option("lineSep", "\0").partitionBy("name").text(temporary)
    discard(digests)
    return _commit(spark, temporary, out)


def _commit(spark: SparkSession, temporary: str, out: str) -> dict:
    """Rename the files to their final names, and the manifest last."""
    jvm = spark._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    names = {}
    for folder in fs.listStatus(path(temporary)):
        name = folder.getPath().getName()
        if name.startswith("name="):
            (part,) = [f for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            names[f"{name[5:]}.warc.gz"] = part

    def rename(name: str) -> None:
        if not fs.rename(names[name].getPath(), path(f"{out}/{name}")):
            raise OSError(f"{out}/{name} could not be renamed")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(rename, sorted(names)))
    fs.delete(path(temporary), True)
    manifest = {"files": [{"name": name, "bytes": part.getLen()} for name, part in sorted(names.items())]}
    stream = fs.create(path(f"{out}/_manifest.tmp"), True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if not fs.rename(path(f"{out}/_manifest.tmp"), path(f"{out}/manifest.json")):
        raise OSError("the manifest could not be renamed")
    return manifest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if x else None
    for batch in batches:
        for data in batch.column(0):
            rows, size = [], 0
            for head, payload in records(data.as_py()):
                rows.append((number(head["X-Page-ID"]), head["WARC-Target-URI"], head["WARC-Type"], int(head["X-Payload-Bytes"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), number(head.get("X-Refers-To-Page")), payload))
                size += len(payload)
                if size > 8 << 20 or len(rows) >= 2000:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])


def read(spark: SparkSession, at: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of the archive that the manifest lists."""
    ship(spark)
    jvm = spark._jvm
    manifest = spark.read.text(f"{at}/manifest.json", wholetext=True).first()
    names = {f["name"]: f["bytes"] for f in json.loads(manifest[0])["files"]}
    if not names:
        return spark.createDataFrame([], "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
    root = jvm.org.apache.hadoop.fs.Path(at)
    there = {f.getPath().getName(): f.getLen() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)}
    if missing := [n for n, size in names.items() if there.get(n) != size]:
        raise ValueError(f"the archive lacks files of its manifest, or they differ: {missing[:3]}")
    arrow_limits(spark)
    files = spark.read.format("binaryFile").load([f"{at}/{n}" for n in sorted(names)]).select("content")
    return files.mapInArrow(_read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, from an archive written and read back."""
    spark = pages.sparkSession
    out = scratch(spark, "warc")
    write(pages, out)
    result = cut(read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-read")
    remove(spark, out)
    return result
