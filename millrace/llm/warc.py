"""WARC archives, and a normaliser for archives that are one gzip stream.

`write_monoliths` writes pages as WARC 1.1 records, all records of a task in one gzip stream, as many
tools do.  `normalise` inflates each such file once, rewrites every record as a gzip member of its own,
and writes a sidecar index (<archive>.idx, one JSON object a line: offset, length, record id, type), so
that any record is one seek and one inflate away.  `read_back` reads archives by that index.

Payloads of at least `least_bytes` that occur more than once are written once, as the response with the
smallest page id; the others are revisit records that name it.

Files have names of their own per task attempt and are listed only by tasks that succeeded, so a lost
executor leaves at most files that nobody reads.

Defined cases: null html is an empty payload; null url is written as urn:page:<id>; pages with null id
are responses and nobody revisits them; rows that repeat the smallest id of a payload are responses
too; payloads stream through the normaliser in pieces; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh_path, materialize, open_shared, remove_shared

PIECE = 1 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
#: Revisits are looked up in a broadcast up to this many rows, each of 60 bytes or so; beyond, by a shuffle.
BROADCAST_ROWS = 500_000


def record_id(page_id: int, digest: str, kind: str = "response") -> str:
    """Known without the other record: a revisit has the payload that it names.  Only rows equal in id and payload share one."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}:{kind}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    body = b"" if refers_to is not None else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;=%~-._") if url else f"urn:page:{page_id}"
    own = record_id(page_id, digest, "response" if refers_to is None else "revisit") if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def mark_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Pages (page_id, url, payload, digest) with refers_to.  Payloads do not move unless revisits are very many."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = materialize(full.where(F.octet_length("payload") >= least_bytes).where(F.col("page_id").isNotNull()).select("page_id", F.unhex("digest").alias("key")), "warc-digests")
    shared = narrow.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(shared, "warc-shared")
    total = shared.agg(F.count(F.lit(1))).first()[0]
    key = F.unhex("digest")
    small = F.octet_length("payload") < least_bytes
    keyed = full.withColumn("key", F.when(~small & F.col("page_id").isNotNull(), key))
    table = shared.select("key", "refers_to")
    if total <= BROADCAST_ROWS:
        marked = keyed.join(F.broadcast(table), "key", "left")
    else:
        # Payloads stay with the pages: decisions are made on narrow rows and meet the pages by id.
        decided = narrow.join(table, "key").where("page_id <> refers_to").select(F.col("page_id").alias("id"), F.col("key").alias("k"), "refers_to").distinct()
        marked = keyed.join(decided, F.col("page_id").eqNullSafe(F.col("id")) & F.col("key").eqNullSafe(F.col("k")), "left")
    refers = F.when(F.col("refers_to") != F.col("page_id"), F.col("refers_to"))
    return marked.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_monoliths(marked: DataFrame, folder: str) -> DataFrame:
    """One gzip stream per task; returns path, n_records (stored)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", None, 0
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(5)]
                out = out or open_shared(path, "wb")
                out.write(squeeze.compress(_record(*row)))
                n += 1
        if out:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n}])

    return materialize(marked.mapInArrow(write, "path string, n_records long"), "warc-monoliths")


class _Inflated:
    """A gzip file read forward as one stream of bytes, whatever its members; a piece is held at a time."""

    def __init__(self, source) -> None:
        self.source, self.state, self.held, self.rest = source, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        while True:
            if self.state.eof:
                self.rest, self.state = self.state.unused_data, zlib.decompressobj(31)
            raw = self.rest or self.source.read(PIECE)
            if not raw:
                return False
            data = self.state.decompress(raw, PIECE)
            self.rest = self.state.unconsumed_tail
            if data:
                self.held += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with `mark`; None at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                if self.held.strip():
                    raise ValueError("archive is cut short")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("archive is cut short")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n -= len(out)
            yield out


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.M)


def fields(head: bytes) -> dict[str, str]:
    return {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head)}


def normalise_file(source, out, path: str = "") -> list[dict]:
    """Rewrites one archive with a member per record; returns the index entries."""
    stream, at, entries = _Inflated(source), 0, []
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at {at} of {path}")
        known = fields(head)
        squeeze, begun = zlib.compressobj(6, zlib.DEFLATED, 31), at
        at += out.write(squeeze.compress(head)) or 0
        for piece in stream.exactly(int(known["content-length"])):
            at += out.write(squeeze.compress(piece)) or 0
        for piece in stream.exactly(4):
            at += out.write(squeeze.compress(piece)) or 0
        at += out.write(squeeze.flush()) or 0
        entries.append({"offset": begun, "length": at - begun, "id": known["warc-record-id"], "type": known["warc-type"]})
    return entries


class _Counted:
    """A file opened for writing whose write() tells how many bytes it took, in any store."""

    def __init__(self, out) -> None:
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)


def normalise(archives: DataFrame, folder: str, keep: bool = False) -> DataFrame:
    """archives: path.  Writes normalised archives and their sidecar indexes; returns path, n_records (stored).

    Files written by `write_monoliths` are not needed afterwards and go unless `keep`.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source_path in batch.column(0).to_pylist():
                path = f"{folder}/records-{uuid.uuid4().hex}.warc.gz"
                with open_shared(source_path, "rb") as source, open_shared(path, "wb") as out:
                    entries = normalise_file(source, _Counted(out), source_path)
                with open_shared(path + ".idx", "wb") as side:
                    side.write("".join(json.dumps(e) + "\n" for e in entries).encode())
                yield pa.RecordBatch.from_pylist([{"path": path, "n_records": len(entries)}])

    paths = archives.select("path")
    n = archives.count()
    done = materialize(paths.repartition(max(1, n)).mapInArrow(rewrite, "path string, n_records long"), "warc-archives")
    if not keep:
        # Only now is every archive rewritten and listed: a task lost above could still start again.
        paths.foreachPartition(lambda rows: [remove_shared(r["path"]) for r in rows])
    return done


def read_record(source, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of the record at an index entry."""
    source.seek(offset)
    data = zlib.decompress(source.read(length), 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    known = fields(head)
    block = rest[: int(known["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return known, fields(http), payload


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record, from the archives by their indexes; response payloads are checked against their digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_shared(path + ".idx", "rb") as side:
                    entries = [json.loads(x) for x in side.read().splitlines()]
                with open_shared(path, "rb") as source:
                    for at in range(0, len(entries), 1024):
                        rows = []
                        for e in entries[at : at + 1024]:
                            known, http, payload = read_record(source, e["offset"], e["length"])
                            digest, kind = known["warc-payload-digest"].removeprefix("sha256:"), known["warc-type"]
                            if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                                raise ValueError(f"payload of {e['id']} in {path} is damaged")
                            as_int = lambda name: int(known[name]) if name in known else None  # noqa: B023, E731
                            rows.append({"page_id": as_int("x-page-id"), "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": as_int("x-refers-to-page")})
                        yield pa.RecordBatch.from_pylist(rows, schema)

    paths = archives.select("path")
    return paths.repartition(max(1, archives.count())).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes every page, normalises the archives, and reads every record back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_back(normalise(write_monoliths(mark_revisits(pages, least_bytes), folder), folder))
