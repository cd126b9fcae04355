"""WARC archives: monolithic gzip files, normalised to one gzip member a record with a sidecar offset index.

``write_monolithic`` writes the rows of each task as one WARC file that is a single gzip stream.
``normalise`` inflates each file once, as a stream, and rewrites every record as a gzip member of its own,
with a sidecar index of record, offset and length: any record can then be read alone. ``read_records``
reads archives by their index.

Of records with equal payloads of at least 1000 bytes the one with the largest page_id is a response and
the others revisit it. Files go to a folder by its URI (any file system that pyarrow knows); each is
written under a name of its own attempt and then moved, so a task that is run again replaces it.

Defined results: a null html is an empty payload; a null url is written as an empty URI; a null page_id
counts as the smallest; rows that tie for the largest page_id of a payload are all responses; an empty
table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, small_batches

LEAST_SHARED = 1000
LEVEL = 4
_CHUNK = 1 << 20
# Fixed value: the date of records whose capture time isn't known.
_DATE = "1970-01-01T00:00:00Z"


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to) with refers_to null for responses. Only digests are shuffled for the choice."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    large = pages.where(F.octet_length("html") >= LEAST_SHARED).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response")
    revisits = large.join(first, "digest").where(
        F.coalesce(F.col("page_id") < F.col("response"), F.col("response").isNotNull())).select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("response").alias("refers_to")).distinct()
    return pages.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")


def _record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    sha = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{sha}')}>"),
        ("WARC-Date", _DATE), ("WARC-Target-URI", "".join(url.split())), ("WARC-Payload-Digest", sha), ("X-Page-ID", name),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{sha}')}>"),
            ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Sink:
    """A file that appears under its name only when whole."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.part = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def _stream(folder: str, name: str) -> Iterator[bytes]:
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/{name}", compression=None) as f:
        while chunk := f.read(_CHUNK):
            yield chunk


def _none(x):
    return None if pd.isna(x) else int(x)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """(name, n_records): a file a task, each one gzip stream. ``pages``: (page_id, url, html, refers_to)."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name, n, sink, gz = f"pages-{TaskContext.get().partitionId():05d}.warc.gz", 0, None, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for batch in batches:
            for page, url, html, refers in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"], batch["refers_to"].astype("Int64")):
                sink = sink or _Sink(folder, name)
                sink.write(gz.compress(_record(_none(page), url, html.encode("utf-8", "surrogatepass"), _none(refers))))
                n += 1
        if sink:
            sink.write(gz.flush())
            sink.close()
            yield pd.DataFrame({"name": [name], "n_records": [n]})

    return pages.select("page_id", "url", "html", "refers_to").mapInPandas(run, "name string, n_records long")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a gzip stream of one or many members, inflated once and held one at a time."""
    inflate, held, ready, need = zlib.decompressobj(31), bytearray(), 0, None
    for chunk in chunks:
        while chunk:
            held += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if chunk:
                inflate = zlib.decompressobj(31)
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", ready)
                if end < 0:
                    break
                head = bytes(held[:end]).lower()
                length = head.index(b"\r\ncontent-length:") + len(b"\r\ncontent-length:")
                need = end + 4 + int(head[length:].split(b"\r\n", 1)[0]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends within a record")


def normalise(names: DataFrame, source: str, folder: str) -> DataFrame:
    """(name, n_records): every file of ``source`` rewritten in ``folder`` with a member a record, and NAME.idx of offsets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["name"]:
                data, index, at, n = _Sink(folder, name), _Sink(folder, f"{name}.idx"), 0, 0
                for record in records(_stream(source, name)):
                    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = gz.compress(record) + gz.flush()
                    data.write(member)
                    head = dict(x.split(": ", 1) for x in record[: record.index(b"\r\n\r\n")].decode().split("\r\n")[1:])
                    index.write((json.dumps({"page_id": head["X-Page-ID"], "type": head["WARC-Type"], "offset": at, "length": len(member)}) + "\n").encode())
                    at, n = at + len(member), n + 1
                data.close()
                index.close()
                yield pd.DataFrame({"name": [name], "n_records": [n]})

    return names.select("name").mapInPandas(run, "name string, n_records long")


def read_record(folder: str, name: str, offset: int, length: int) -> bytes:
    """One record, alone, by its place in the index."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{root}/{name}") as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def read_records(names: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), each record read by its index entry and a response's digest taken from its payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for name in batch["name"]:
                index = b"".join(_stream(folder, f"{name}.idx")).decode().splitlines()
                files, root = fs.FileSystem.from_uri(folder)
                rows = []
                with files.open_input_file(f"{root}/{name}") as f:
                    for place in map(json.loads, index):
                        f.seek(place["offset"])
                        record = zlib.decompress(f.read(place["length"]), 31)
                        head, _, block = record.partition(b"\r\n\r\n")
                        own = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        http, _, payload = block[:-4].partition(b"\r\n\r\n") if own["WARC-Type"] == "response" else (block, b"", b"")
                        size = int(http.decode().split("Content-Length: ", 1)[1].split("\r\n", 1)[0])
                        said = base64.b32decode(own["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if own["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != said):
                            raise ValueError(f"{name}: the payload of page {own['X-Page-ID']} isn't what was written")
                        rows.append((own["X-Page-ID"] or None, size, said, own["WARC-Type"], own.get("X-Refers-To-Page")))
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return names.select("name").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.assign(**{c: pd.array([None if x is None else int(x) for x in out[c]], dtype="Int64") for c in ("page_id", "refers_to")})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, members = shared_path(spark, "warc-whole"), shared_path(spark, "warc")
    pages = planned(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    # a table of names, one for each file, so that a lost task of a later step doesn't write archives again
    listed = f"{members}-names"
    write_monolithic(pages, whole).write.parquet(listed)
    names = spark.read.parquet(listed)
    n = max(1, names.count())
    done = f"{members}-done"
    normalise(names.repartition(n, "name"), whole, members).write.parquet(done)
    return read_records(spark.read.parquet(done).repartition(n, "name"), members)
