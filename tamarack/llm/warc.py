"""Deterministic sharded WARC writer, and its reader.

Records are cut into shards by ranges of their ids (from a bounded histogram, so the cut depends on the input alone),
sorted within shards, and written as one gzip member each; a file is closed once its compressed size reaches the roll
size. Tasks write under temporary names and report manifest rows; the driver renames what the successful attempts
reported, then writes the manifest. A reader sees only files that the manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import fresh_path

#: Payloads shorter than this are never written as revisits.
MIN_REVISIT = 1000
ROLL_BYTES = 32 << 20
#: Payload bytes that a shard aims at, while the histogram has cells enough.
SHARD_BYTES = 12 << 20
CELLS = 16384
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive that the reader decompresses at a time.
CHUNK = 1 << 16
MANIFEST = "manifest.json"


def _file_system(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _record_id(*what) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, what)))}>"


def _b32(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member, the same bytes each time."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + block + b"\r\n\r\n") + gz.flush()


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, nth: int = 0) -> bytes:
    """A response with the payload, or a revisit that refers to the page which has it; the digests are worked out anew."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, nth)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Page-ID", "" if page_id is None else str(page_id))]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, 0)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    headers += [("WARC-Payload-Digest", _b32(digest)), ("WARC-Block-Digest", _b32(hashlib.sha1(block).hexdigest())), ("Content-Type", "application/http;msgtype=response")]
    return _record(headers, block)


def _info_record(name: str) -> bytes:
    block = b"software: tamarack\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """(id, sha, refers_to) of the pages whose payload, of ``least`` bytes or more, a page with a larger id has too."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    thin = pages.select(F.col(id_col).alias("id"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n")).filter(F.col("n") >= least)
    kept = thin.groupBy("sha").agg(F.max("id").alias("refers_to"), F.count("*").alias("c")).filter("c > 1").select("sha", "refers_to")
    return thin.join(kept, "sha").filter("id <> refers_to").select("id", "sha", "refers_to").distinct()


def _shards(pages: DataFrame, id_col: str, html_col: str, shard_bytes: int):
    """A function from an id column to its shard, of about ``shard_bytes``, and the number of shards. Null ids go to the first."""
    lo, hi = pages.agg(F.min(id_col), F.max(id_col)).first()
    if lo is None:
        return lambda _: F.lit(0), 1
    width = max(1, -(-(int(hi) - int(lo) + 1) // CELLS))

    def cell(col):
        return F.coalesce(F.floor((col.cast("long") - F.lit(int(lo))) / width), F.lit(0)).cast("int")

    sizes = {r["c"]: r["b"] for r in pages.groupBy(cell(F.col(id_col)).alias("c")).agg(F.sum(F.coalesce(F.octet_length(html_col), F.lit(0)) + 400).alias("b")).collect()}
    cuts, have = [], 0
    for c in sorted(sizes):
        if have and have + sizes[c] > shard_bytes:
            cuts.append(c)
            have = 0
        have += sizes[c]
    table, k = [], 0
    for c in range(CELLS):
        k += k < len(cuts) and cuts[k] == c
        table.append(k)
    lookup = F.from_json(F.lit(json.dumps(table)), "array<int>")  # a constant of CELLS numbers, folded when the plan is made
    return lambda col: F.element_at(lookup, cell(col) + 1), len(cuts) + 1


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Write a record for each row of ``pages`` to ``folder`` (a URI that executors reach) and return the manifest.

    Null html is an empty payload; a null url becomes an urn. Rows that repeat an id and a payload of MIN_REVISIT bytes
    or more are written as revisits of the first. An empty table makes a manifest without files. Ids are whole numbers.
    A folder without a manifest isn't finished: what a broken run left there is written anew; one with a manifest is
    refused.
    """
    spark = pages.sparkSession
    shard_of, n = _shards(pages, id_col, html_col, shard_bytes)
    null = F.lit(None).cast("string")
    rows = pages.select(shard_of(F.col(id_col)).alias("shard"), F.col(id_col).alias("id"), F.lit(1).alias("kind"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), null.alias("sha"), F.lit(None).cast("long").alias("refers_to"))
    seen = revisits(pages, id_col, html_col)
    marks = seen.select(shard_of(F.col("id")).alias("shard"), "id", F.lit(0).alias("kind"), null.alias("url"), null.alias("html"), "sha", F.col("refers_to").cast("long").alias("refers_to"))
    temp = f"{folder.rstrip('/')}/_temporary"

    def run(batches):
        fs, base = _file_system(temp)
        attempt = uuid.uuid4().hex
        fs.create_dir(base, recursive=True)
        shard = at = out = None
        seq = size = records = 0
        sha = hashlib.sha1()
        refers: dict = {}
        done = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((shard, seq, f"{attempt}-{shard:05d}-{seq:05d}", size, records, sha.hexdigest()))
                out = None

        def put(data: bytes):
            nonlocal size
            out.write(data)
            sha.update(data)
            size += len(data)

        for b in batches:
            for s, i, kind, url, html, digest, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard:
                    close()
                    shard, seq, at = s, -1, None
                if at is None or at[0] != i:
                    at, refers, seen_here, nth = (i,), {}, set(), 0
                if not kind:
                    refers[digest] = ref
                    continue
                if out is None or size >= roll_bytes:
                    close()
                    seq, size, records, sha = seq + 1, 0, 0, hashlib.sha1()
                    out = fs.open_output_stream(f"{base}/{attempt}-{shard:05d}-{seq:05d}", compression=None)
                    put(_info_record(f"part-{shard:05d}-{seq:05d}.warc.gz"))
                payload = html.encode()
                digest = hashlib.sha1(payload).hexdigest()
                ref = refers.get(digest)
                if ref is None and digest in seen_here and len(payload) >= MIN_REVISIT:
                    ref = i
                seen_here.add(digest)
                put(page_record(i, url, payload, digest, ref, nth))
                records, nth = records + 1, nth + 1
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)

    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string())])
    both = rows.unionByName(marks).repartition(n, "shard").sortWithinPartitions("shard", "id", "kind", "url", "html")
    files = sorted((r.asDict() for r in both.mapInArrow(run, "shard int, seq int, temp string, bytes long, records long, sha1 string").collect()), key=lambda f: (f["shard"], f["seq"]))
    return _commit(spark, folder.rstrip("/"), files)


def _commit(spark: SparkSession, folder: str, files: list[dict]) -> list[dict]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    if fs.exists(path(f"{folder}/{MANIFEST}")):
        raise FileExistsError(f"{folder} holds a finished archive")
    out = []
    for f in files:
        name = f"part-{f['shard']:05d}-{f['seq']:05d}.warc.gz"
        if fs.exists(path(f"{folder}/{name}")):  # left by a driver that died before its manifest
            fs.delete(path(f"{folder}/{name}"), False)
        if not fs.rename(path(f"{folder}/_temporary/{f['temp']}"), path(f"{folder}/{name}")):
            raise OSError(f"can't rename to {folder}/{name}")
        out.append({"name": name, "bytes": f["bytes"], "records": f["records"], "sha1": f["sha1"]})
    fs.delete(path(f"{folder}/_temporary"), True)
    stream = fs.create(path(f"{folder}/{MANIFEST}.tmp"), True)
    stream.write(bytearray(json.dumps({"version": 1, "files": out}, indent=1).encode()))
    stream.close()
    fs.rename(path(f"{folder}/{MANIFEST}.tmp"), path(f"{folder}/{MANIFEST}"))
    return out


def records(data: bytes):
    """(headers, block) of each gzip member of an archive."""
    view, at = memoryview(data), 0
    while at < len(view):
        gz, parts = zlib.decompressobj(31), []
        while at < len(view) and not gz.eof:  # a chunk at a time: what follows the member is never copied whole
            chunk = view[at : at + CHUNK]
            parts.append(gz.decompress(chunk))
            at += len(chunk) - len(gz.unused_data)
        raw = b"".join(parts) + gz.flush()
        if not gz.eof:
            raise ValueError("an archive is cut off")
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
        block = rest[: int(headers["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield headers, block


def read_warc(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the records in the manifest's files, digests verified."""
    folder = folder.rstrip("/")
    names = spark.createDataFrame([(f"{folder}/{f['name']}", f["sha1"]) for f in files], "path string, sha1 string").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism, 10_000)), "path")

    def run(batches):
        for b in batches:
            for uri, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = _file_system(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                if hashlib.sha1(data).hexdigest() != sha:
                    raise ValueError(f"{uri} doesn't match the manifest")
                rows = []
                for h, block in records(data):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    if _b32(hashlib.sha1(block).hexdigest()) != h["WARC-Block-Digest"]:
                        raise ValueError("a block doesn't match its digest")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b": ")[2])
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if h["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError("a payload doesn't match its digest")
                    ref = h.get("WARC-Refers-To-Page-ID")
                    rows.append((int(h["WARC-Page-ID"]) if h["WARC-Page-ID"] else None, h["WARC-Target-URI"], size, digest, h["WARC-Type"], int(ref) if ref else None))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return names.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_warc(spark, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> last_id THEN last_id END AS refers_to
FROM q
"""
}
