"""WARC archives as a PySpark Python data source, and payload de-duplication for writing.

Writing: each task writes ``.warc.gz`` files of bounded size, one gzip member a record; the
member's extra field gives its own length. A job's files count from the moment at which its
manifest, a list of them, gets its final name: one rename makes all of them visible, whatever
their number, and what a lost executor or a repeated task leaves is in no manifest.

Reading: files are planned into partitions of about FILE_BYTES. Of a record only its head is
inflated at first; predicates on the record type and on other header columns are pushed down
and decided there. Where a member tells its length (as ours do), an unwanted record, or a payload
that the schema doesn't ask for, is skipped without inflating it. Other ``.warc.gz`` files, one
member a record or not, and plain ``.warc`` files are read in sequence, bodies of unwanted
records being passed over by their Content-Length.

Files are reached through ``pyarrow.fs``, so any file system with a URI that it knows will do.

Defined cases: a null payload is the empty payload; a null target URI is left out. A null
page id is written as such and is never referred to. Of equal payloads, all rows with the
smallest page id are responses. Columns other than the three named ones are ignored. When reading,
the payload is an HTTP response's body, or else the record's block; page ids exist in archives written here only.
A file that ends within a record, or holds something else, is an error that names the place.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage

from inkfold.llm.common import columns, prepare, written

LEAST_SHARED = 100
SALTS = 16
FILE_BYTES = 64 << 20
#: What opening a file costs, in bytes read; payload bytes of a batch of rows; partitions for each core at least, if there are files enough.
OPEN_BYTES, BATCH_BYTES, WAVES = 1 << 20, 1 << 20, 4
HEAD = 2048
RECORD = "page_id long, record_type string, target_uri string, payload_digest string, payload_length long, refers_to long, payload binary"
#: What can be read besides: any archive's own ids and dates.
HEADERS = "record_id string, refers_to_id string, date string, content_type string, block_length long"
_OURS = re.compile(r"part-[0-9a-f]{12}-[0-9a-f]{32}\.warc\.gz")

_URN = "urn:x-page:"


def _member(data: bytes) -> bytes:
    """A gzip member whose extra field 'sl' has its length and that of its content."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = struct.pack("<2sHII", b"sl", 8, 12 + 12 + len(body) + 8, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    """Control characters would break a header line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, record_type, target_uri, digest, length, refers_to, payload) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(target_uri)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(urn: str | None) -> int | None:
    digits = urn.strip("<>").removeprefix(_URN) if urn and _URN in urn else ""
    return int(digits) if digits else None


def _columns(h: dict[str, str]) -> dict:
    length, block = h.get("x-payload-length"), h.get("content-length")
    plain = lambda k: h[k].strip("<>") if k in h else None
    return {
        "record_id": plain("warc-record-id"), "refers_to_id": plain("warc-refers-to"), "date": h.get("warc-date"), "content_type": h.get("content-type"), "block_length": int(block) if block else None,
        "page_id": _page(h.get("warc-record-id")),
        "record_type": h.get("warc-type"),
        "target_uri": h.get("warc-target-uri"),
        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "payload_length": int(length) if length else None,
        "refers_to": _page(h.get("warc-refers-to")),
    }


@dataclass
class _Done(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]

    def _place(self):
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator):
        system, base = self._place()
        system.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                held = {n: batch.column(n).to_pylist() for n in batch.schema.names}
                for i in range(batch.num_rows):
                    row = {n: c[i] for n, c in held.items()}
                    data = _member(record(row["page_id"], row["record_type"], row["target_uri"], row["payload_digest"], row["payload_length"], row["refers_to"], row["payload"] or b""))
                    if out is None or size + len(data) > FILE_BYTES:
                        if out:
                            out.close()
                        files.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return _Done(files)

    def commit(self, messages):
        system, base = self._place()
        system.create_dir(base, recursive=True)
        old = _manifests(system, base) if self.overwrite else {}
        names = [n for m in messages for n in (m.files if m else [])]
        hidden = f"{base}/_{self.job}.json"
        with system.open_output_stream(hidden, compression=None) as out:
            out.write(json.dumps({"files": names, "replaces": sorted(old)}).encode())
        system.move(hidden, f"{base}/manifest-{self.job}.json")  # from here on the job's files count, and those of the manifests it replaces don't
        for name, (files, _) in old.items():
            for x in [*files, name]:
                _delete(system, f"{base}/{x}")
        self._clear(system, base, set(names))

    def abort(self, messages):
        system, base = self._place()
        self._clear(system, base, set())

    def _clear(self, system, base, names):
        """Files of this job's lost or repeated tasks; no reader sees them."""
        for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.job}-") and f.base_name not in names:
                _delete(system, f.path)


def _delete(system, path: str) -> None:
    if system.get_file_info(path).type == fs.FileType.File:
        system.delete_file(path)


def _manifests(system, base: str) -> dict[str, tuple[list, list]]:
    """Manifests that hold: name to (files, manifests replaced)."""
    out = {}
    for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if re.fullmatch(r"manifest-[0-9a-f]{12}\.json", f.base_name):
            with system.open_input_file(f.path) as stream:
                held = json.loads(stream.read())
            out[f.base_name] = (held["files"], held["replaces"])
    gone = {x for _, replaced in out.values() for x in replaced}
    return {k: v for k, v in out.items() if k not in gone}


def archives(path: str) -> list:
    """The archive files of a folder (or the one file): ours only if a manifest names them, others always."""
    system, base = fs.FileSystem.from_uri(path)
    own = system.get_file_info(base)
    if own.type == fs.FileType.File:
        return [own]
    named = {x for files, _ in _manifests(system, base).values() for x in files}
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return [f for f in found if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")) and (not _OURS.fullmatch(f.base_name) or f.base_name in named)]


class _Files(InputPartition):
    def __init__(self, files: list):
        super().__init__(files)


_COMPARE = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b),
}


def _holds(f, row: dict) -> bool:
    """SQL's view of a filter on header columns: null compares as not true."""
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    return value is not None and _COMPARE[type(f)](value, f.value)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema, cores: int):
        self.path, self.names, self.cores, self.filters = path, schema.fieldNames(), cores, []
        self.arrow = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])

    def pushFilters(self, filters):
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            known = type(inner) in (*_COMPARE, IsNull, IsNotNull) and len(inner.attribute) == 1 and inner.attribute[0] in _columns({}) and not isinstance(f, Not)
            if known:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        """Files in the order of their names, together up to FILE_BYTES, or less where all cores would not have work."""
        files = sorted(archives(self.path), key=lambda f: f.path)
        most = min(FILE_BYTES, max(OPEN_BYTES, sum(f.size for f in files) // (self.cores * WAVES)))
        shares, room = [], 0
        for f in files:
            if not shares or f.size + OPEN_BYTES > room:
                shares.append([])
                room = most
            shares[-1].append(f.path)
            room -= f.size + OPEN_BYTES
        return [_Files(own) for own in shares] or [_Files([])]

    def _row(self, headers: dict, rest):
        """The record's row if the filters want it; ``rest(n)`` gives the first n bytes of its block."""
        row = _columns(headers)
        if not all(_holds(f, row) for f in self.filters):
            return None
        if "payload" in self.names:
            row["payload"] = None
            if row["record_type"] != "revisit":
                block = rest(int(headers["content-length"]))
                at = block.find(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else -1
                row["payload"] = block[at + 4 :] if at >= 0 else block
                if row["payload_length"] is None:
                    row["payload_length"] = len(row["payload"])
        return row

    def _by_length(self, stream):
        """Records of a file whose members tell their lengths."""
        while head := stream.read(24):
            if len(head) < 24 or not _tells(head):
                raise ValueError(f"no gzip member with its length at {stream.tell() - len(head)} in {self.path}")
            length, _ = struct.unpack_from("<II", head, 16)
            end = stream.tell() - 24 + length
            unpack = zlib.decompressobj(-15)
            text = b""
            while b"\r\n\r\n" not in text and not unpack.eof and (chunk := stream.read(min(HEAD, end - stream.tell()))):
                text += unpack.decompress(chunk)
            top = text.index(b"\r\n\r\n") + 4

            def rest(n, text=text, top=top, unpack=unpack, end=end):
                if len(text) < top + n:
                    text += unpack.decompress(stream.read(max(0, end - stream.tell() - 8)))
                return text[top : top + n]

            if row := self._row(_headers(text[: top - 4]), rest):
                yield row
            stream.seek(end)

    def _in_sequence(self, source):
        """Records of any archive's bytes, one after the other; no more than a block is held."""
        while head := source.upto(b"\r\n\r\n"):
            headers = _headers(head.lstrip(b"\r\n")[:-4])
            n, taken = int(headers["content-length"]), []

            def rest(n, taken=taken):
                taken.append(n)
                return source.take(n)

            row = self._row(headers, rest)
            if not taken:
                source.skip(n)
            source.skip_breaks()
            if row:
                yield row

    def _records(self, stream, path):
        head = stream.read(24)
        stream.seek(0)
        if _tells(head):
            return self._by_length(stream)
        return self._in_sequence(_Bytes(stream, path, zipped=head[:2] == b"\x1f\x8b"))

    def read(self, partition):
        system, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.value:
            rows, size = [], 0
            with system.open_input_file(path) as stream:
                for row in self._records(stream, path):
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in self.arrow], schema=self.arrow)


def _tells(head: bytes) -> bool:
    return head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl"


class _Bytes:
    """A file's bytes in order, inflated if need be, across gzip members."""

    def __init__(self, stream, path: str, zipped: bool):
        self.stream, self.path, self.zipped, self.held, self.raw, self.unpack = stream, path, zipped, b"", b"", None

    def _more(self) -> bool:
        if not self.zipped:
            raw = self.stream.read(1 << 18)
            self.held += raw
            return bool(raw)
        while True:
            self.raw = self.raw or self.stream.read(1 << 16)
            if not self.raw:
                if self.unpack is not None:
                    raise ValueError(f"{self.path} ends within a gzip member")
                return False
            self.unpack = self.unpack or zlib.decompressobj(31)
            out = self.unpack.decompress(self.raw, 4 << 20)
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data.lstrip(b"\0"), None
            else:
                self.raw = self.unpack.unconsumed_tail
            if out:
                self.held += out
                return True

    def upto(self, mark: bytes) -> bytes:
        """Up to and with ``mark``; empty at the end of the file."""
        at = 0
        while (end := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError(f"{self.path} ends within a record's head")
                return b""
        out, self.held = self.held[: end + len(mark)], self.held[end + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while True:
            parts.append(self.held[:left])
            left, self.held = left - len(parts[-1]), self.held[len(parts[-1]) :]
            if not left:
                return b"".join(parts)
            if not self._more():
                raise ValueError(f"{self.path} ends within a record")

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.take(min(n, 1 << 20)))

    def skip_breaks(self) -> None:
        """The line breaks after a record, so that a head starts with its version."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held or not self._more():
                return


class WarcSource(DataSource):
    """``spark.read.format("warc").load(uri)`` and ``df.write.format("warc").mode("append").save(uri)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return _Reader(self.options["path"], schema, int(self.options.get("cores", "64")))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def records(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """Rows to write: equal payloads of at least ``least`` bytes are kept once, others revisit it.

    The table of shared payloads holds digests only. It is written first, so the planner
    knows its size: a small one is broadcast and payloads are not moved at all. Beyond that, rows
    are dealt by digest and salt, so that the pages of one common payload meet its entry in many tasks.
    """
    row_id, uri, payload = columns([id_col, uri_col, payload_col])
    payload = F.coalesce(payload.cast("string"), F.lit("")).cast("binary")
    rows = pages.select(row_id.cast("long").alias("page_id"), uri.cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    shared = rows.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = written(shared.where("n > 1 and first is not null").select("payload_digest", "first"), "shared-payloads")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(salted, ["payload_digest", "salt"], "left").select(
        "page_id", F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload_digest", "payload_length",
        F.when(again, F.col("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of the archives below ``path``; leave ``payload`` out of the schema (of RECORD's and HEADERS' columns) to read heads only."""
    cores = spark.sparkContext.defaultParallelism
    return register(spark).read.format("warc").schema(schema).option("cores", str(cores)).load(path)


def _measured(batches):
    for batch in batches:
        payload = [p or b"" for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(p) for p in payload], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payload], pa.string())], ["page_id", "payload_bytes", "payload_digest"]
        )


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives.

    Responses are measured from the payloads read; revisits from their heads alone.
    """
    head = RECORD.removesuffix(", payload binary")
    responses = read(spark, path, "page_id long, record_type string, payload binary").where("record_type = 'response'").select("page_id", "payload")
    found = responses.mapInArrow(_measured, "page_id long, payload_bytes long, payload_digest string").withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    revisits = read(spark, path, head).where("record_type = 'revisit'")
    return found.unionByName(revisits.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
