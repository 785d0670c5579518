"""Deterministic sharded WARC writer and reader."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm._common import discard, partitions, remove, shared_dir, small, small_batches, staged, tidy

#: Compressed bytes at which a file is rolled, and payload bytes that a shard should hold on average.
ROLL_BYTES, SHARD_BYTES = 64 << 20, 256 << 20
#: Ids sampled a shard for the range boundaries.
SAMPLE = 40
#: Date of all records: pages carry none, and reruns must agree.
DATE = "2024-01-01T00:00:00Z"


def digest32(hexed: str) -> str:
    """Bare upper-case base32 of a SHA-1 in hexadecimal."""
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _fs(uri: str):
    """(file system, path) of a folder that all executors share, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def boundaries(ids: DataFrame, shards: int, seed: int = 8) -> list[int]:
    """At most shards - 1 range boundaries of page_id: quantiles of a bounded sample that a hash of the id draws."""
    n = ids.count()
    if not n or shards < 2:
        return []
    rate = min(1.0, shards * SAMPLE / n)
    u = F.pmod(F.xxhash64(F.lit(seed), "page_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = ids.filter(u < rate).select("page_id").distinct().limit(4 * shards * SAMPLE)
    got = np.array(sorted(r[0] for r in some.collect() if r[0] is not None), np.int64)
    return sorted({int(got[len(got) * i // shards]) for i in range(1, shards)}) if len(got) else []


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "replace")


def _uri(url: str | None) -> str:
    return (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id, url: str | None, sha1: str, nth: int = 0) -> str:
    """Name of a record, from its content alone; nth tells rows apart that repeat."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{sha1}' + (f':{nth}' if nth else ''))}>"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with a record; headers that only depend on the block are added."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{digest32(hashlib.sha1(block).hexdigest())}"), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(_header(fields) + block + b"\r\n\r\n") + z.flush()


def info_record(name: str) -> bytes:
    """The warcinfo record that opens file `name`."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{name}')}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _member(fields, b"software: tessel\r\nformat: WARC File Format 1.1\r\n")


def record(page_id, url: str | None, payload: bytes, sha1: str, first, first_url: str | None, nth: int = 0) -> bytes:
    """One gzip member with a response, or a revisit of page `first`; all made from the arguments, so that reruns agree byte by byte."""
    digest = f"sha1:{digest32(sha1)}"
    revisit = first is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url, sha1, nth)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", digest),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(first, first_url, sha1)),
            ("WARC-Refers-To-Target-URI", _uri(first_url)),
            ("WARC-Refers-To-Date", DATE),
            ("WARC-Refers-To-Page-ID", str(first)),
        ]
    return _member(fields, http + (b"" if revisit else payload))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of an uncompressed record; the block digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest32(hashlib.sha1(block).hexdigest())}":
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    return fields, block


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, sha1, bytes) of every page's payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))


def write(pages: DataFrame, root: str, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Writes a record per page under root and returns the committed manifest: shard, seq, file, records, bytes, sha1.

    Records are sorted by page_id in shards whose boundaries come from a deterministic sample; each shard is a task of
    its own, and its files are rolled by compressed size. A file opens with a warcinfo record, which `records` does not
    count. Of pages with equal payloads of least_bytes or more the least page_id is the response; the others refer to
    its record. A file is written under a temporary name and then renamed; as its bytes depend only on its records, a
    task that is run again replaces it by the same file. The manifest is written last by Spark's committer: files that
    it doesn't name don't count. Rows that repeat are records of their own; pages without an id are dealt by a hash.
    A page's html is held whole by one task, longer files are streamed. Columns besides page_id, url and html are
    ignored, whatever their names.
    """
    spark = pages.sparkSession
    narrow = staged(digests(pages), "digests")
    groups = narrow.filter(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes")
    groups = groups.agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"), F.count("*").alias("n")).filter("n > 1")
    groups = small(staged(groups.select("sha1", "bytes", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")), "groups"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    rows = rows.join(groups, ["sha1", "bytes"], "left")
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    shards = shards or max(4 * partitions(spark), -(-total // SHARD_BYTES))
    cuts = boundaries(narrow.select("page_id"), shards)
    discard(narrow)
    step = max(1, int(len(cuts) ** 0.5))
    groups_of = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    shard = F.pmod(F.xxhash64("sha1", "url"), F.lit(shards)).cast("int")  # pages without an id
    if cuts:
        head = F.size(F.filter(F.array(*(F.lit(g[0]) for g in groups_of)), lambda s: s <= F.col("page_id")))
        inner = F.size(F.filter(F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups_of)), head), lambda s: s <= F.col("page_id")))
        shard = F.when(F.col("page_id").isNull(), shard).when(head == 0, 0).otherwise((head - 1) * step + inner)
    rows = rows.withColumn("shard", shard.cast("int")).repartitionById(int(shards), F.col("shard")).sortWithinPartitions("shard", "page_id", "url", "sha1")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(root)
        fs.create_dir(f"{base}/data", recursive=True)
        now, seq, out, size, records, sha = None, 0, None, 0, 0, None
        temp, name, same, nth = "", "", None, 0

        def close() -> pd.DataFrame:
            out.close()
            fs.move(temp, f"{base}/data/{name}")
            return pd.DataFrame([(now, seq, name, records, size, sha.hexdigest())], columns=["shard", "seq", "file", "records", "bytes", "sha1"])

        for part in it:
            for r in part.itertuples(index=False):
                if out and (r.shard != now or size >= roll_bytes):
                    yield close()
                    seq, out = (seq + 1 if r.shard == now else 0), None
                if not out:
                    seq = seq if r.shard == now else 0
                    now, records = r.shard, 0
                    name, temp = f"part-{now:06d}-{seq:05d}.warc.gz", f"{base}/data/_temporary-{uuid.uuid4().hex}"
                    out, data = fs.open_output_stream(temp), info_record(f"part-{now:06d}-{seq:05d}.warc.gz")
                    sha, size = hashlib.sha1(data), len(data)
                    out.write(data)
                first = None if r.first is None else int(r.first)
                page = None if r.page_id is None else int(r.page_id)
                key = page, r.url, r.sha1
                same, nth = key, nth + 1 if key == same else 0
                data = record(page, r.url, (r.html or "").encode("utf-8", "replace"), r.sha1, first if first != page else None, r.first_url, nth)
                out.write(data)
                sha.update(data)
                size += len(data)
                records += 1
        if out:
            yield close()

    text = [F.col(c).cast("string").alias(c) for c in ("page_id", "first")]  # pandas would turn null longs into doubles
    small_batches(spark)
    written = rows.select("shard", "url", "html", "sha1", "first_url", *text).mapInPandas(tidy(run), "shard int, seq int, file string, records long, bytes long, sha1 string")
    written.write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.schema(written.schema).parquet(f"{root}/manifest")


def read(manifest: DataFrame, root: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the committed files.

    Files are streamed one gzip member after another. A response's payload is hashed again and must agree with its
    header; a revisit carries its payload's size and digest in headers alone.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(root)
        for part in it:
            for name, expected in zip(part["file"], part["records"], strict=True):
                rows = []
                with fs.open_input_stream(f"{base}/data/{name}", compression=None) as f:
                    for raw in _members(f):
                        h, block = parse(raw)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(h["WARC-Payload-Length"])
                        if h["WARC-Type"] == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            if len(body) != size or digest32(hashlib.sha1(body).hexdigest()) != digest:
                                raise ValueError(f"payload differs in {name}")
                        page, to = h.get("WARC-Page-ID") or None, h.get("WARC-Refers-To-Page-ID") or None
                        url = h["WARC-Target-URI"]
                        rows.append((page and int(page), None if url == "urn:none" else url, size, digest, h["WARC-Type"], to and int(to)))
                if len(rows) != expected:
                    raise ValueError(f"{name} holds {len(rows)} of {expected} records")
                out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    spread = manifest.select("file", "records").repartition(2 * partitions(manifest.sparkSession), "file")
    return spread.mapInPandas(tidy(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _members(f: io.IOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream."""
    z, parts, data = zlib.decompressobj(31), [], f.read(chunk)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = f.read(chunk)
    if any(parts):
        raise ValueError("a record is cut off")


def round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes pages as WARC files and reads the archives back; one row per page.

    Archives stay under root if it is given. Else they are written to a fresh shared folder, which is deleted once its
    rows are read. Null html is an empty payload. Of pages with equal payloads the least page_id is the response and the
    others revisit it. A null page_id is kept; one that shares its payload with a numbered page revisits it. An empty
    table gives an empty result.
    """
    if root:
        return read(write(pages, root), root)
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    out = staged(read(write(pages, root), root), "warc")
    remove(spark, root)
    return out
