"""WARC archives written and read by tasks, and an external merge of their capture runs into one globally ordered index.

Writing: each task writes its pages as gzip members, one per record, into archives of at most ``archive_bytes`` in the shared folder. Names
hold a random part per attempt and only archives in the committed manifest are read, so a repeated task does no harm. Of pages with equal
payloads of at least ``least_bytes`` the one with the largest id is a ``response``; the others are ``revisit`` records that refer to it and hold
only the HTTP head. Which copy is the response comes from one grouped maximum per digest, so a payload that fills a third of the table is
one row there.

Reading: each archive is read record by record; payloads are checked against their digests. Its captures, sorted by URL key, time and id,
are a locally sorted run, written as a table. Runs are dealt by ranges of (URL key, time, id), so a hot URL is spread over ranges too, and
every range merges its pieces of all runs with a loser tree. Ranges follow from the number of captures.

Null payloads are empty; a null URL has the empty key. Pages without an id never are the response of others while one with an id exists. Rows that
share the largest id of a payload are all responses. Repeated pages stay. Extra columns are ignored. An empty table gives no captures.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.common import Workspace
from tablecare.llm.exact import bit_exponent, bit_table, flagged

FIRST_DAY = "2024-01-01T00:00:00"
CAPTURE = ("url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
           "run string, seq long, offset long, length long")


def url_key(url: str) -> str:
    """Host labels from the top down, then path and query: sorts captures of a host together."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = host[4:] if host.startswith("www.") else host
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _head(first: str, fields: dict[str, object]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, captured: str, payload: bytes, response: int | None, revisit: bool) -> bytes:
    http = _head("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)})
    block = http if revisit else http + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{'none' if page_id is None else page_id}>",
              "WARC-Target-URI": re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url), "WARC-Date": captured, "WARC-Payload-Digest": _sha1(payload)}
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{response}>"}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    return _head("WARC/1.1", fields) + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, *,
                   least_bytes: int = 1000, archive_bytes: int = 64 << 20) -> DataFrame:
    """Plan of the manifest (archive, records, bytes); writing happens when it is evaluated, so store it once."""
    captured = F.col(time_col).cast("timestamp") if time_col else F.lit(FIRST_DAY).cast("timestamp") + F.make_dt_interval(secs=F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(100_000_000)))
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
                        payload.alias("payload"))
    marked = rows.withColumn("key", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    shared = marked.where("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL").drop("n")
    # Payloads that nothing shares, and short ones, go nowhere: a table of bits of the shared digests tells them.
    ws = Workspace(pages.sparkSession)
    shared = ws.put(shared, "shared")
    exponent = bit_exponent(shared.count())
    seen = flagged(marked, ["key"], ws.put(bit_table(shared, ["key"], exponent), "bits"), exponent).withColumn("_again", F.col("_again") & F.col("key").isNotNull())
    told = seen.where("_again").join(shared, "key", "left").unionByName(seen.where("NOT _again").withColumn("response", F.lit(None).cast("long"))).select("id", "url", "captured", "payload", "response", F.expr("response IS NOT NULL AND (id IS NULL OR id < response)").alias("revisit"))

    def run(batches):
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        task, attempt, made = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        out, name, records, size, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out:
                out.close()
                done.append((f"{folder}/{name}", records, size))
            out = None

        for batch in batches:
            for id_, url, captured, payload, response, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, records, size, made = f"{task:06d}-{made:04d}-{attempt}.warc.gz", 0, 0, made + 1
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    info = b"format: WARC File Format 1.1\r\n"
                    size += out.write(_member(_head("WARC/1.1", {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": captured or f"{FIRST_DAY}Z",
                                                                  "WARC-Filename": name, "Content-Type": "application/warc-fields", "Content-Length": len(info)}) + info + b"\r\n\r\n"))
                size += out.write(_member(record(id_, url, captured or f"{FIRST_DAY}Z", payload, response, revisit)))
                records += 1
                if size >= archive_bytes:
                    close()
        close()
        if done:
            columns = list(zip(*done))
            yield pa.record_batch([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["archive", "records", "bytes"])

    return told.mapInArrow(run, "archive string, records long, bytes long")


def members(stream, chunk: int = 1 << 18):
    """(offset, length, data) of each gzip member."""
    held, at = stream.read(chunk), 0
    while held:
        unpack, data, taken = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not held:
                raise ValueError(f"the record at {at} is cut off")
            data.append(unpack.decompress(held))
            taken += len(held)
            held = unpack.unused_data if unpack.eof else stream.read(chunk)
        taken -= len(held)
        yield at, taken, b"".join(data)
        at += taken
        held = held or stream.read(chunk)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a record: {lines[0][:40]}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def captures(stream) -> list[tuple]:
    """The sorted run of one archive."""
    out = []
    for offset, length, data in members(stream):
        fields, block = parse(data)
        if fields["WARC-Type"] not in ("response", "revisit"):
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        digest = fields["WARC-Payload-Digest"]
        if fields["WARC-Type"] == "response" and (len(payload) != size or _sha1(payload) != digest):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
        url = fields["WARC-Target-URI"]
        out.append((url_key(url), fields["WARC-Date"], _page(fields["WARC-Record-ID"]), url, fields["WARC-Type"], size,
                    base64.b32decode(digest.removeprefix("sha1:")).hex(), _page(fields.get("WARC-Refers-To")), offset, length))
    out.sort(key=_key)
    return out


def _key(row: tuple) -> tuple:
    """URL key (by code points), time, id; a null id comes first, as in Spark's order."""
    return row[0], row[1], row[2] is not None, row[2] or 0


_KINDS = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())


def _batch(rows: list[tuple], names: list[str]):
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=names)


def read_archives(manifest: DataFrame, task_bytes: int = 256 << 20) -> DataFrame:
    """All captures, each archive's as a sorted run (run = archive, seq = place in the run). ``manifest`` must be stored.

    A task reads about ``task_bytes`` of archives, or one; where there are few, each archive has a task.
    """
    archives, total = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(1, min(archives, max(manifest.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // task_bytes))))
    names = [x.split()[0] for x in CAPTURE.split(", ")]

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = _file_system(archive)
                with system.open_input_stream(path, compression=None) as stream:
                    rows = [(*r[:8], archive.rsplit("/", 1)[-1], i, *r[8:]) for i, r in enumerate(captures(stream))]
                for start in range(0, len(rows), 10_000):
                    yield _batch(rows[start : start + 10_000], names)

    return manifest.select("archive").repartition(tasks).mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of a match, so the next row costs one path from leaf to root."""

    def __init__(self, runs: list[list[tuple]], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(1, len(runs))
        for leaf in range(len(runs)):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or (x is not None and y is not None and (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + len(self.runs)) // 2
        while node:
            if self.tree[node] == -1:  # the first to come waits for its opponent
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.runs and self.heads[top := self.tree[0]] is not None:
            run, at = self.runs[top], self.at[top]
            yield run[at]
            self.at[top] = at + 1
            self.heads[top] = self.key(run[at + 1]) if at + 1 < len(run) else None
            self._play(top)


#: Runs that one tree merges.
FAN = 512


def merged(runs: list[list[tuple]], fan: int = FAN):
    """The rows of all runs in order; many runs are merged in levels."""
    while len(runs) > fan:
        runs = [list(LoserTree(runs[a : a + fan], _key)) for a in range(0, len(runs), fan)]
    return LoserTree(runs, _key)


def capture_history(runs: DataFrame, range_rows: int = 200_000) -> DataFrame:
    """The captures in order of URL key, time and id: by ``part``, then ``place``. ``runs`` must be stored, it is read twice."""
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    parts = max(1, -(-runs.count() // range_rows))

    def run(batches):
        part = TaskContext.get().partitionId()
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                pieces.setdefault(row[8], []).append(row)
        for piece in pieces.values():
            piece.sort(key=lambda r: r[9])  # a piece comes in shuffle blocks; inside the run its order is known
        rows: list[tuple] = []
        for place, row in enumerate(merged([pieces[k] for k in sorted(pieces)])):
            rows.append((part, place, *row))
            if len(rows) == 20_000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), *_KINDS))], names=["part", "place", *names])
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), *_KINDS))], names=["part", "place", *names])

    return runs.repartitionByRange(parts, "url_key", "captured", "page_id").mapInArrow(run, f"part int, place long, {CAPTURE}")


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write, read back and merge: the capture history of ``pages``. The archives and runs go when it is stored."""
    ws = Workspace(pages.sparkSession)
    manifest = ws.put(write_archives(pages, ws.folder("archives"), **options), "manifest")
    runs = ws.put(read_archives(manifest), "runs")
    return ws.finish(capture_history(runs))
