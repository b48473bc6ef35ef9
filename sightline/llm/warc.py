"""Deterministic sharded WARC archives of web pages.

* Shards are ranges of page ids cut at quantiles of a hash sample, so they depend on the rows
  alone.  Each shard is sorted by page id and rolled into files by compressed size.
* Of the pages with equal payloads the one with the largest id becomes a response record, the
  others become revisits that refer to it.  Headers, record ids and digests are made anew.
* A file is written under a temporary name and renamed when complete; equal rows give equal bytes,
  so a repeated task replaces a file by itself.  The manifest is a table beside the files, written
  when all are whole; only files that it names are read, so a folder can be read again by itself.

Files go to any file system that pyarrow opens by uri; the folder has to be shared.

Defined cases: null html is an empty payload, and empty payloads are equal too; a null url is
written as ``urn:page:<id>``; line breaks in a url become spaces; a repeated row revisits its own
id; a null id is written without one and read back as null; an empty table gives no file and an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import kernels as K
from sightline.plans.indexing import with_index
from sightline.plans.store import fresh_path, materialize

ROLL_BYTES, SHARD_BYTES, SAMPLE, STAMP = 16 << 20, 32 << 20, 20_000, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str):
    from pyarrow import fs

    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, stamp: str = STAMP) -> bytes:
    """One gzip member that holds one record."""
    target = " ".join((url or f"urn:page:{page}").split()) or f"urn:page:{page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = lambda p, k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{p}/{digest}/{k}')}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page, kind)}", f"WARC-Date: {stamp}", f"WARC-Target-URI: {target}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    head += [f"WARC-Page-ID: {page}"] if page is not None else []
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers, 'response')}", f"WARC-Refers-To-Page-ID: {refers}"]
    head += [f"Content-Length: {len(block)}"]
    return _gzip("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _gzip(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)  # a header without time or name
    return squeeze.compress(raw) + squeeze.flush()


def _info(name: str, stamp: str = STAMP) -> bytes:
    block = b"software: sightline\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {stamp}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return _gzip("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_page long, last_page long"


def _writer(folder: str, roll: int, stamp: str):
    schema = K.columns(MANIFEST)

    def run(batches):
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        out, done, now, refers, used = None, [], {}, None, False

        def close():
            nonlocal out
            if out is None:
                return None
            out.close()
            out = None
            files.move(now["temp"], f"{root}/{now['file']}")
            return (now["file"], now["shard"], now["records"], now["bytes"], now["sha"].hexdigest(), now["first"], now["last"])

        shard, seq = None, 0
        for batch in batches:
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = dict(zip(names, row, strict=True))
                key = (r["page_id"], r["digest"])
                if not r["is_page"]:
                    refers, used = (key, r["refers"]), False
                    continue
                if r["shard"] != shard or (out is not None and now["bytes"] >= roll):
                    done += [x] if (x := close()) else []
                    seq = seq + 1 if r["shard"] == shard else 0
                    shard = r["shard"]
                if out is None:
                    file = f"shard-{shard:06d}-{seq:04d}.warc.gz"
                    now = {"file": file, "temp": f"{root}/.{file}.{uuid.uuid4().hex}.tmp", "shard": shard, "records": 0, "bytes": 0, "sha": hashlib.sha256(), "first": r["page_id"], "last": None}
                    out = files.open_output_stream(now["temp"])
                    raw = _info(file, stamp)
                    out.write(raw)
                    now["sha"].update(raw)
                    now["bytes"] += len(raw)
                to = refers[1] if refers and refers[0] == key else None
                again = to is not None and (to != r["page_id"] or used)
                used = used or to is not None
                payload = (r["html"] or "").encode()
                raw = record("revisit" if again else "response", r["page_id"], r["url"], payload, base32(bytes.fromhex(r["digest"])), to, stamp)
                out.write(raw)
                now["sha"].update(raw)
                now["bytes"] += len(raw)
                now["records"] += 1
                now["last"] = r["page_id"]
        done += [x] if (x := close()) else []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 7, schema.types, strict=True)], schema=schema)

    return run


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, stamp: str = STAMP) -> DataFrame:
    """Writes (page_id, url, html) as archives and returns the manifest, kept as the folder's table ``manifest``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    light = materialize(pages.select("page_id", "digest", F.octet_length("html").alias("n")), "digests")
    rows, size = light.agg(F.count("*"), F.sum("n")).first()
    shards = max(1, -(-(size or 0) // shard_bytes))
    shard = shard_of(_cuts(light, rows, shards))
    first = light.filter("page_id is not null").groupBy("digest", "n").agg(F.max("page_id").alias("refers"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "refers")
    links = light.join(first, "digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers", F.lit(False).alias("is_page")).distinct()
    both = pages.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers"), F.lit(True).alias("is_page")).unionByName(links).withColumn("shard", shard.cast("int"))
    dealt = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "is_page")
    dealt.mapInArrow(_writer(folder, roll_bytes, stamp), MANIFEST).write.parquet(f"{folder}/manifest")
    return open_manifest(pages.sparkSession, folder)


def open_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder of archives; it is there once all files are."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _cuts(light: DataFrame, rows: int, shards: int) -> list[int]:
    """First ids of all shards but the first: 8 bytes for every SHARD_BYTES of pages."""
    if shards == 1:
        return []
    step = max(1, rows // max(SAMPLE, 16 * shards))
    ids = materialize(light.filter((F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0) & F.col("page_id").isNotNull()).select("page_id").distinct(), "sample")
    n = ids.count()
    at = F.col("at") * shards
    first = (at % n < shards) & (at >= n)  # the first place at or after each of n/shards, 2n/shards, ...
    return sorted(r[0] for r in with_index(ids, "at", "page_id").filter(first).select("page_id").collect())


def shard_of(cuts: list[int], id_: str = "page_id") -> Column:
    """How many cuts are at or below the id, found in two steps of about sqrt(cuts) comparisons."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts)) + 1
    parts = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    below = lambda of: F.coalesce(F.size(F.filter(of, lambda c: c <= F.col(id_))), F.lit(0))
    held = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")  # one literal, folded once
    firsts = F.from_json(F.lit(json.dumps([p[0] for p in parts])), "array<bigint>")
    part = below(firsts) - 1
    return F.when(part < 0, F.lit(0)).otherwise(part * k + below(F.get(held, part)))


def members(stream, chunk: int = 1 << 20):
    """(offset, content) of every gzip member; memory holds one of them."""
    raw, at = stream.read(chunk), 0
    while raw:
        open_, parts, start = zlib.decompressobj(31), [], at
        while not open_.eof:
            if not raw:
                raise EOFError("archive ends within a record")
            parts.append(open_.decompress(raw))
            at += len(raw) - len(open_.unused_data)
            raw = open_.unused_data or (stream.read(chunk) if not open_.eof else b"")
        raw = raw or stream.read(chunk)
        yield start, b"".join(parts)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises if the length or a digest is wrong."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    told = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(told["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    own = told.get("WARC-Block-Digest")
    if own and own != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError("block digest differs")
    return told, block


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long"


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each page record of the files in the manifest; digests are computed from what is read."""
    schema = K.columns(READ)

    def run(batches):
        files, root = _open(folder)
        for batch in batches:
            for file in batch["file"].to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for offset, content in members(stream):
                        told, block = parse(content)
                        if told["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size, digest = int(http.rpartition(b"Content-Length: ")[2]), told["WARC-Payload-Digest"].removeprefix("sha1:")
                        if told["WARC-Type"] == "response" and (len(payload), base32(hashlib.sha1(payload).digest())) != (size, digest):
                            raise ValueError(f"payload differs in {file} at {offset}")
                        page, to = told.get("WARC-Page-ID"), told.get("WARC-Refers-To-Page-ID")
                        rows.append((int(page) if page else None, size, digest, told["WARC-Type"], int(to) if to else None, told["WARC-Target-URI"], file, offset))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    n = max(1, manifest.count())
    return manifest.select("file").repartition(n, "file").mapInArrow(run, READ)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _oracle() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(h, {0}, 5) AS BIGINT) >> {1}) % 32, 1)"
    digits = " || ".join(digit.format(5 * g + 1, b) for g in range(8) for b in (15, 10, 5, 0))
    return f"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), m AS (SELECT h, payload_bytes, max(page_id) AS m FROM p GROUP BY ALL)
SELECT page_id, p.payload_bytes, {digits} AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN m USING (h, payload_bytes)
"""


ORACLE = _oracle()
