"""Web archives and their index: sorted runs of captures, merged by a loser tree into one global order.

Writing gives one gzip-per-record archive for each partition. Records with equal payloads of ``least`` bytes or more
have one response, that with the largest page_id; the others are revisits that refer to it and hold no payload, only
the HTTP header with the payload's length. Reading parses every archive from its start, checks lengths and digests,
and gives each archive's captures as a run sorted by URL key (SURT), time and page_id. The runs are dealt by ranges of
that key over the whole corpus, so one URL with very many captures spreads over several ranges by time, and each range
merges its pieces of the k runs with a loser tree: one comparison for each level on the path of the replaced run.

Archives are written under a name of the task's attempt and renamed when complete, so a repeated attempt replaces a
file by an equal one.

Defined results: a null html is the empty payload; a null url is no target and sorts first; a row without page_id is
never the response of others, refers to theirs if there is one, and sorts first among equal keys; rows with equal
page_id and payload are all responses if theirs is the largest id. Captures have no time of their own in ``pages``:
the time is ``EPOCH`` plus page_id seconds. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptwatch.llm.shared import folder, materialize, posix

EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels from the right, then path and query; lower case, no scheme or user."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    shown = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return ",".join(reversed(host.removeprefix("www.").split("."))) + shown + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    when = (EPOCH + datetime.timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ") if abs(page_id or 0) < 1 << 36 else EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {when}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def records(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed records of an archive, one gzip member each."""
    data, unzip, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(size)
            if not data:
                if parts:
                    raise ValueError("an archive ends within a record")
                return
        parts.append(unzip.decompress(data))
        if unzip.eof:
            yield b"".join(parts)
            data, unzip, parts = unzip.unused_data, zlib.decompressobj(31), []
        else:
            data = b""


def parse(raw: bytes) -> dict:
    """Fields of one record; raises where lengths or digests don't agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    declared = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != declared or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload does not match its digest")

    def page(name):
        value = fields.get(name, "<urn:page:none>")[10:-1]
        return None if value == "none" else int(value)

    return {
        "url_key": url_key(fields.get("WARC-Target-URI")), "captured": fields["WARC-Date"], "page_id": page("WARC-Record-ID"),
        "payload_bytes": declared, "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To"),
    }


def write_archives(pages: DataFrame, path: str, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives below ``path``; returns a table of their names and record counts."""
    fs, root = posix(path)
    fs.create_dir(root, recursive=True)
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1("html")))
    kept = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    chosen = rows.join(kept.select("digest", "keeper"), "digest", "left").select(
        "page_id", "url", "html",
        F.when(F.col("page_id").isNull() | (F.col("keeper") != F.col("page_id")), F.col("keeper")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = posix(path)
        name, n = f"{TaskContext.get().partitionId():010d}.warc.gz", 0
        trial = f"{root}/{uuid.uuid4().hex}.trial"
        with fs.open_output_stream(trial) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    one, address, text, refers = (batch.column(c)[i].as_py() for c in range(4))
                    payload = text.encode("utf-8", "surrogatepass")
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(zipped.compress(record(one, address, payload, digest, refers)) + zipped.flush())
                    n += 1
        if n:
            fs.move(trial, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"name": name, "records": n}], pa.schema([("name", pa.string()), ("records", pa.int64())]))
        else:
            fs.delete_file(trial)

    return materialize(chosen.mapInArrow(write, "name string, records bigint"))


class LoserTree:
    """Merges k sorted lists; each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.loser = [-1] * self.k
        self.winner = -1
        for run in range(self.k):
            self._play(run, filling=True)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's next entry goes before run b's; an exhausted run goes last, ties go to the earlier run."""
        x, y = self.runs[a], self.runs[b]
        i, j = self.at[a], self.at[b]
        if i >= len(x) or j >= len(y):
            return i < len(x) or (j >= len(y) and a < b)
        return x[i] < y[j] or (x[i] == y[j] and a < b)

    def _play(self, run: int, filling: bool = False) -> None:
        node = (run + self.k) // 2
        while node:
            if self.loser[node] < 0 and filling:
                self.loser[node] = run
                return
            if self._less(self.loser[node], run):
                self.loser[node], run = run, self.loser[node]
            node //= 2
        self.winner = run

    def __iter__(self):
        total = sum(map(len, self.runs))
        for _ in range(total):
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self._play(run)


_FIELDS = [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_DDL = "url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _key(row: dict) -> tuple:
    return row["url_key"], row["captured"], row["page_id"] is not None, row["page_id"] or 0


def read_runs(spark: SparkSession, path: str, archives: DataFrame) -> DataFrame:
    """Every archive's captures as one sorted run: run, seq and the captures' fields."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = posix(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = sorted((parse(r) for r in records(stream)), key=_key)
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    for i, row in enumerate(part):
                        row["run"], row["seq"] = int(name.split(".")[0]), lo + i
                    yield pa.RecordBatch.from_pylist(part, pa.schema([("run", pa.int64()), ("seq", pa.int64()), *_FIELDS]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize(archives.select("name").repartition(n, "name").mapInArrow(read, f"run bigint, seq bigint, {_DDL}"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order of URL key, time and page_id: (range, position) count it through."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces: list[list] = []
        fields: list[tuple] = []
        last = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["run"] != last:
                    pieces.append([])
                    last = row["run"]
                pieces[-1].append((*_key(row), len(fields)))
                fields.append(row)
        if not pieces:
            return
        part, order = TaskContext.get().partitionId(), [x[-1] for x in LoserTree(pieces)]
        for lo in range(0, len(order), 4096):
            out = [fields[i] | {"range": part, "position": lo + j} for j, i in enumerate(order[lo : lo + 4096])]
            yield pa.RecordBatch.from_pylist(out, pa.schema([*_FIELDS, ("range", pa.int32()), ("position", pa.int64())]))

    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(n, "url_key", "captured", "page_id").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(merge, f"{_DDL}, range int, position bigint")


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages as archives, read them back and merge their indexes: one row for each page."""
    spark = pages.sparkSession
    path = folder(spark, "warc")
    archives = write_archives(pages, path, least)
    return merge_runs(read_runs(spark, path, archives)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
