"""WARC archives: a writer of gzip members in the shared folder, and a splittable reader.

Writer: each task turns its rows into one archive, a gzip member per record. Of records with equal payloads of at
least ``least`` bytes the one with the largest id is stored whole; the others are revisit records that name it. Only
digests are shuffled (pre-aggregated); the table of repeated digests is written and its size known before it meets
the rows, so Spark broadcasts it if it is small and joins by shuffle, splitting hot digests, if not. Archives get
their final name after they are complete; a repeated task replaces its own file by an equal one.

Reader: each task has a range of bytes of an archive. It looks for gzip magic from the start of its range, accepts a
candidate if its first bytes inflate to a WARC version, the member inflates without error up to the end of the file or
the next magic and a blank line ends its header, however long, and owns the records that start within the range, whose
rest it reads beyond it. Where a member must begin (at the start of a file, behind another member) and none does, that
place is damage, reported once, by the task that owns the record before it; reading goes on at the next member. A
whole member that a range meets first, without another one or the file's end behind it, is reported as well: it stands
before damage, or inside the data of a member that begins in an earlier range.

Defined results: a null payload is empty; a page of a null id is a response that nothing refers to, and is read with a
null id; equal ids are separate records; damage raises, or is returned as rows of record_type ``damaged``; an empty
table gives no archive and an empty result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import arrow_schema, bounded, materialise, new_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
URN = "urn:x-page:"
#: Stated in each record, so that equal tables give equal archives.
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Layout:
    least: int = 1000
    level: int = 3
    split_bytes: int = 4 << 20
    read_bytes: int = 1 << 18


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. ``refers_to``: the id of the response that holds the payload."""
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'none' if key is None else key}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: {sha1}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write(pages: DataFrame, layout: Layout = Layout(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives now; the manifest: path and size of each."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    rows = rows.withColumns({"_sha1": F.sha1("_payload"), "_size": F.octet_length("_payload")})
    # the length and a second sum stand beside the digest: two payloads would have to agree in all three
    rows = rows.withColumn("_key", F.concat_ws("-", "_sha1", F.col("_size").cast("string"), F.crc32("_payload").cast("string")))
    again = rows.filter(F.col("_size") >= layout.least).groupBy(F.col("_key").alias("_dup")).agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = rows.join(materialise(again, "repeated"), F.col("_key") == F.col("_dup"), "left")
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name, draft = f"{base}/part-{task.partitionId():06d}.warc.gz", f"{base}/draft-{task.partitionId():06d}-{task.taskAttemptId()}"
        out: BinaryIO | None = None
        size = 0
        for keys, urls, payloads, digests, keeps in bounded(batches):
            if out is None and keys:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(draft)
            for key, url, data, digest, keep in zip(keys, urls, payloads, digests, keeps, strict=True):
                again = key is not None and keep is not None and keep != key
                got = member(record(key, url, data, digest, keep if again else None), layout.level)
                out.write(got)
                size += len(got)
        if out is not None:
            out.close()
            if files.get_file_info(name).type != pafs.FileType.NotFound:
                files.delete_file(name)
            files.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "size": [size]}, schema=manifest)

    manifest = arrow_schema(spark, "path string, size long")
    return materialise(rows.select("_id", "_url", "_payload", "_sha1", "_keep").mapInArrow(run, "path string, size long"), "manifest")


class Window:
    """A forward view of a file: bytes from ``start`` on, read as needed."""

    def __init__(self, file: BinaryIO, start: int, step: int):
        self.file, self.start, self.step, self.data, self.ended = file, start, step, b"", False
        file.seek(start)

    def fill(self, upto: int) -> bool:
        """Hold the bytes below ``upto``, if the file has them."""
        while self.start + len(self.data) < upto and not self.ended:
            more = self.file.read(self.step)
            self.ended = not more
            self.data += more
        return self.start + len(self.data) >= upto

    def drop(self, upto: int) -> None:
        if upto > self.start:
            self.data, self.start = self.data[upto - self.start :], upto


def find_member(view: Window, at: int, stop: int) -> int:
    """Where gzip magic stands next from ``at`` on, below ``stop``; -1 if nowhere."""
    while at < stop:
        view.fill(min(stop, at + view.step) + len(MAGIC) - 1)
        found = view.data.find(MAGIC, at - view.start, min(stop, at + view.step) + len(MAGIC) - 1 - view.start)
        if found >= 0:
            return view.start + found
        at = min(stop, at + view.step)
        view.drop(at)
    return -1


def inflate(view: Window, at: int) -> tuple[bytes, int] | None:
    """The record of the member at ``at`` and where the member ends; None if there is no valid one."""
    engine, parts, size, place = zlib.decompressobj(31), [], 0, at
    checked, take = False, 8192
    try:
        while not engine.eof:
            if not view.fill(place + 1):
                return None
            chunk = view.data[place - view.start : place - view.start + take]
            take *= 2
            place += len(chunk)
            got = engine.decompress(chunk)
            parts.append(got)
            size += len(got)
            if not checked and (size >= len(VERSION) or engine.eof):
                if not b"".join(parts).startswith(VERSION):
                    return None
                checked = True
    except zlib.error:
        return None
    data = b"".join(parts)
    if b"\r\n\r\n" not in data:
        return None
    return data, place - len(engine.unused_data)


def confirmed(view: Window, end: int) -> bool:
    """Whether another member or the end of the file follows."""
    return not view.fill(end + 1) or (view.fill(end + len(MAGIC)) and view.data[end - view.start :][: len(MAGIC)] == MAGIC)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


def records(file: BinaryIO, start: int, stop: int, layout: Layout = Layout()) -> Iterator[tuple[int, dict[str, str] | None, bytes]]:
    """Offset, fields and block of the records that start within the range; damage as an offset without fields."""
    view, at = Window(file, start, layout.read_bytes), start
    due = start == 0  # whether a member must begin at this place
    while True:
        if due:
            if not view.fill(at + 1):
                return
            got = inflate(view, at)
            if got is None:
                yield at, None, b""
                at, due = at + 1, False
                continue
            if at >= stop:  # the next range's own
                return
        else:
            if (at := find_member(view, at, stop)) < 0:
                return
            got = inflate(view, at)
            if got is not None and not confirmed(view, got[1]):
                # inside another member's data, or before damage: it can't be told which from here
                yield at, None, b""
                at = got[1]
                continue
            if got is None:
                at += 1
                continue
        yield at, *parse(got[0])
        at, due = got[1], True
        if at - view.start >= view.step:
            view.drop(at)


RECORD = "path string, offset long, page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, payload binary"


def read(manifest: DataFrame, layout: Layout = Layout(), payloads: bool = True, keep_damage: bool = False) -> DataFrame:
    """A row per record of the archives in ``manifest``; a response's digest is computed from the payload read.

    Damage raises; with ``keep_damage`` it is a row of record_type ``damaged`` with its path and offset.
    """
    spark = manifest.sparkSession
    step = layout.split_bytes
    archives, size = manifest.agg(F.count("*"), F.sum("size")).first()
    ranges = manifest.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(step))).alias("start"))
    # a round of small rows; each stands for split_bytes of work
    ranges = ranges.repartition(max(1, min(archives + (size or 0) // step, 20_000)), "path", "start")

    def key(text: str | None) -> int | None:
        name = text.strip("<>").removeprefix(URN) if text else "none"
        return None if name == "none" else int(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with files.open_input_file(name) as file:
                    for offset, fields, block in records(file, start, start + step, layout):
                        if fields is None:
                            if not keep_damage:
                                raise ValueError(f"{path} at {offset}: no member begins where one must")
                            rows.append((path, offset, None, "damaged", None, None, None, None, None))
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if fields["warc-type"] == "response":
                            length = len(payload)
                            if hashlib.sha1(payload).hexdigest() != stated:
                                raise ValueError(f"{path} at {offset}: the payload doesn't have the digest stated")
                        rows.append((path, offset, key(fields["warc-record-id"]), fields["warc-type"], key(fields.get("warc-refers-to")), fields.get("warc-target-uri"), stated, length, payload if payloads else None))
                        held += len(payload)
                        if held > 8_000_000 or len(rows) >= 5000:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    arrow = arrow_schema(spark, RECORD)
    return ranges.mapInArrow(run, RECORD)
