"""WARC archives with a two-level capture index.

Writing: pages become gzip members of WARC records in ``.warc.gz`` files of about
``FILE_BYTES``, each begun by a warcinfo record. Equal payloads of at least
``min_bytes`` are stored once, the others as revisit records that refer to the
response by its record id.

Indexing: captures, keyed by reversed-host URL and page id, are sorted by range and
packed into compressed blocks of ``LINES`` lines. Every index partition has one file
of blocks and one sparse directory of them (``SEGMENT`` blocks at most on average);
a small table holds the first key of each directory. A lookup searches that table,
the directory, then the block, each by binary search and read as one range, and
gets file, offset and length of a record, which is read as a range again. No archive
or index bytes are shuffled or read whole.

Tasks open files through ``pyarrow.fs``: shared local folders, HDFS, S3, GCS and Azure.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import as_bytes, checkpoint, new_folder, salted_join

#: Size after which an archive file is closed, lines of an index block, and blocks of a directory.
FILE_BYTES, LINES, SEGMENT = 256 << 20, 3000, 1024
#: Bytes read or unpacked at once.
CHUNK = 1 << 20
#: Payload bytes that a task passes on at once.
BATCH_BYTES = 16 << 20
#: Pages have no capture time of their own.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Target of pages without a URL.
NO_URL = "urn:lathe:no-url"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def target_uri(url: str | None) -> str:
    return quote(url, safe="/:?#[]@!$&()*+,;=%~") if url else NO_URL


def surt(url: str | None) -> str:
    """Sort-friendly key of a URL: host labels reversed, then port and path; scheme and fragment dropped."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", "" if url in (None, NO_URL) else url).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].lower()
    host, colon, port = host.partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (slash + path or "/")
    return quote(key, safe="!$&'()*+,-./:;=?@_~%[]|{}^\"<>\\`")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """Record id of a page: the page's number, and a hash that tells pages of one number apart."""
    return f"urn:lathe:page:{'' if page_id is None else page_id}:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}"


def _page_of(record: str) -> str:
    """The page's number in a record id; empty in those of other writers."""
    found = re.match(r"<?urn:lathe:page:(-?\d*):", record)
    return found[1] if found else ""


def _key(target: str, page_id: str) -> str:
    return f"{surt(target)}\t{page_id}"


def _packed(headers: list[str], block: bytes) -> bytes:
    """A record as one gzip member."""
    raw = "\r\n".join(["WARC/1.1", *headers, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def info_record(name: str) -> bytes:
    block = b"software: lathe\r\nformat: WARC File Format 1.1\r\n"
    return _packed(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], block)


def page_record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes = b"", refers_to: tuple[int | None, str | None] | None = None) -> bytes:
    """A response, or a revisit of the (page id, URL) that it refers to, which has the HTTP head alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, url, digest)}>", f"WARC-Target-URI: {target_uri(url)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(*refers_to, digest)}>", f"WARC-Refers-To-Target-URI: {target_uri(refers_to[1])}", f"WARC-Refers-To-Date: {DATE}"]
    return _packed(head, block)


def parse_headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:] if ": " in line)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of an unpacked record, and its HTTP body."""
    headers = parse_headers(raw)
    block = raw.partition(b"\r\n\r\n")[2][: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to gzip WARC files in the folder ``path``.

    A null html is an empty payload, a null url a fixed urn. Of equal payloads of at
    least ``min_bytes`` bytes the largest (page_id, url) is the response, null ids
    first; the others refer to it. Rows that repeat (page_id, url, html) are the same
    capture and become equal records. An empty table writes no file. A task that is
    run again writes new files; those of failed attempts are removed in the end.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page_id, url = F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")

    def responses(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "sha", "size")]
            out = [page_record(page, address, _base32(sha), size, payload) for page, address, sha, size, payload in zip(*columns, as_bytes(batch.column("html")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "sha", "size")), pa.array(out, pa.binary())], ["page_id", "url", "sha", "size", "packed"])

    rows = pages.select(page_id, url, html.alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("bigint"))
    best = rows.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    packed = rows.mapInArrow(responses, "page_id bigint, url string, sha string, size bigint, packed binary")
    packed = salted_join(packed, best, ["sha"], F.xxhash64("page_id", "url"), how="left")
    revisit = F.col("best").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url")))
    members = packed.select("page_id", "url", "sha", "size", F.col("best.page_id").alias("to_page"), F.col("best.url").alias("to_url"), revisit.alias("revisit"), F.when(~revisit, F.col("packed")).alias("packed"))

    def store(batches):
        fs, folder = filesystem(path)
        out, name, written, names = None, "", 0, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "sha", "size", "to_page", "to_url", "revisit")]
            for (page, address, sha, size, to_page, to_url, again), member in zip(zip(*columns), batch.column("packed")):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, written = fs.open_output_stream(f"{folder}/{name}", compression=None), 0
                    out.write(info_record(name))
                    names.append(name)
                data = page_record(page, address, _base32(sha), size, refers_to=(to_page, to_url)) if again else member.as_buffer()
                out.write(data)
                written += len(data) if again else data.size
                if written >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    fs, folder = filesystem(path)
    fs.create_dir(folder)
    kept = {r.name for r in members.mapInArrow(store, "name string").collect()}  # one name a file
    for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if f.base_name.endswith(".warc.gz") and f.base_name not in kept:
            fs.delete_file(f.path)


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and first unpacked bytes (the headers, and what follows within a chunk) of each gzip member of a stream, read in chunks."""
    at, pending = 0, stream.read(CHUNK)
    while pending:
        z, head, used = zlib.decompressobj(31), b"", 0
        while not z.eof:
            part = z.decompress(pending, CHUNK)  # bounded, as a small member may unpack to much
            rest = z.unused_data if z.eof else z.unconsumed_tail
            if not (pending or part or z.eof):
                raise ValueError(f"the archive ends within the record at {at}")
            used += len(pending) - len(rest)
            if b"\r\n\r\n" not in head:
                head += part
            pending = rest or (b"" if z.eof else stream.read(CHUNK))
        yield at, used, head
        at += used
        pending = pending or stream.read(CHUNK)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(key, path, offset, length) of every page record in the archives of a folder; each file is read as a stream by one task."""

    def walk(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, file = filesystem(name)
                keys, offsets, lengths = [], [], []
                with fs.open_input_stream(file, compression=None) as stream:
                    for at, length, head in members(stream):
                        headers = parse_headers(head)
                        if headers["WARC-Type"] in ("response", "revisit"):
                            keys.append(_key(headers["WARC-Target-URI"], _page_of(headers["WARC-Record-ID"])))
                            offsets.append(at)
                            lengths.append(length)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "path", "offset", "length"])

    # Spark lists the files; their content is not asked for
    files = checkpoint(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path"))
    return files.repartition(max(1, files.count())).mapInArrow(walk, "key string, path string, offset bigint, length bigint")


def _first_keys(line: str) -> str:
    return "\t".join(line.split("\t", 2)[:2])


class BlockFile:
    """Compressed blocks of text lines, one after the other in a file; (first key, last key, offset, length) of each."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.out, self.path, self.at, self.entries = fs.open_output_stream(path, compression=None), path, 0, []

    def add(self, lines: list[str], first: str, last: str) -> None:
        data = zlib.compress("\n".join(lines).encode(), 6)
        self.out.write(data)
        self.entries.append((first, last, self.at, len(data)))
        self.at += len(data)


def build_index(spark: SparkSession, archive_path: str, index_path: str) -> None:
    """Sort the captures by key into compressed blocks and their directories, in the folder ``index_path``; ``top`` is the table of directories."""
    found = checkpoint(captures(spark, archive_path))
    blocks = max(1, -(-found.count() // LINES))
    parts = max(min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-blocks // SEGMENT))

    def pack(batches):
        fs, folder = filesystem(index_path)
        name, file, lines = uuid.uuid4().hex, None, []

        def put(lines):
            nonlocal file
            if file is None:
                fs.create_dir(folder)
                file = BlockFile(fs, f"{folder}/blocks-{name}")
            file.add(lines, _first_keys(lines[0]), _first_keys(lines[-1]))

        for batch in batches:
            lines += ["\t".join(map(str, row)) for row in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "offset", "length")))]
            while len(lines) >= LINES:
                put(lines[:LINES])
                lines = lines[LINES:]
        if lines:
            put(lines)
        if file is None:
            return
        file.out.close()
        entries = file.entries
        directory = BlockFile(fs, f"{folder}/directory-{name}")
        directory.add(["\t".join(map(str, e)) for e in entries], entries[0][0], entries[-1][1])
        directory.out.close()
        yield pa.RecordBatch.from_pylist([{"first_key": entries[0][0], "last_key": entries[-1][1], "name": name, "bytes": directory.at}])

    ordered = found.repartitionByRange(parts, "key", "path", "offset").sortWithinPartitions("key", "path", "offset")
    ordered.mapInArrow(pack, "first_key string, last_key string, name string, bytes bigint").write.parquet(f"{index_path}/top")


def read_range(uri: str, offset: int, length: int, opened: dict | None = None) -> bytes:
    """A range of a file; ``opened`` keeps the last file open."""
    opened = {} if opened is None else opened
    if uri not in opened:
        for f in opened.values():
            f.close()
        opened.clear()
        fs, path = filesystem(uri)
        opened[uri] = fs.open_input_file(path)
    return opened[uri].read_at(length, offset)


class Index:
    """Lookups in an index: ``top`` is [(first key, last key, name, bytes)] in order of the keys. Keeps the last directory and block."""

    def __init__(self, path: str, top: list[tuple[str, str, str, int]]):
        self.path, self.top, self.firsts = path, top, [t[0] for t in top]
        self.directory = self.block = (None, None)
        self.opened: dict = {}

    def _lines(self, name: str, offset: int, length: int) -> list[str]:
        return zlib.decompress(read_range(f"{self.path}/{name}", offset, length, self.opened)).decode().split("\n")

    def _entries(self, name: str, length: int) -> list[tuple[str, str, int, int]]:
        if self.directory[0] != name:
            rows = [line.rsplit("\t", 5) for line in self._lines(f"directory-{name}", 0, length)]
            # a key is a SURT, a tab and a page id
            self.directory = name, [(f"{a}\t{b}", f"{c}\t{d}", int(o), int(n)) for a, b, c, d, o, n in rows]
        return self.directory[1]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Path, offset and length of every capture of the key, also where they span blocks or directories."""
        for _, last, name, size in self._reaching(self.top, self.firsts, key):
            entries = self._entries(name, size)
            for _, _, offset, length in self._reaching(entries, [e[0] for e in entries], key):
                if self.block[0] != (name, offset):
                    self.block = (name, offset), self._lines(f"blocks-{name}", offset, length)
                lines = self.block[1]
                at = bisect_left(lines, key + "\t")
                while at < len(lines) and lines[at].startswith(key + "\t"):
                    path, start, size_ = lines[at].rsplit("\t", 3)[1:]
                    yield path, int(start), int(size_)
                    at += 1

    @staticmethod
    def _reaching(entries: list[tuple], firsts: list[str], key: str) -> list[tuple]:
        """Entries, in order, whose first to last keys include ``key``."""
        out, at = [], bisect_right(firsts, key) - 1
        while at >= 0 and entries[at][1] >= key:
            out.append(entries[at])
            at -= 1
        return out[::-1]


def lookup(spark: SparkSession, keys: DataFrame, index_path: str) -> DataFrame:
    """(key, path, offset, length) of every capture whose key is in ``keys`` (key string); repeated and null keys count once and not at all.

    Keys are sorted by range, so a task reads each directory and block it needs once.
    The table of directories, one row for some three million captures, is broadcast.
    """
    rows = spark.read.parquet(f"{index_path}/top").collect()
    shared = spark.sparkContext.broadcast(sorted((r.first_key, r.last_key, r.name, r.bytes) for r in rows))

    def search(batches):
        index = Index(index_path, shared.value)
        for batch in batches:
            out = [(k, *place) for k in batch.column("key").to_pylist() for place in index.find(k)]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "path", "offset", "length"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = keys.where(F.col("key").isNotNull()).select("key").distinct()
    return wanted.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(search, "key string, path string, offset bigint, length bigint")


def fetch(spark: SparkSession, places: DataFrame) -> DataFrame:
    """key, record_type, payload_digest (header), payload, refers_to of the records at ``places`` (path, offset, length): one range read each, in order of the files."""
    schema = pa.schema([("key", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("refers_to", pa.int64())])

    def cut(batches):
        opened: dict = {}
        for batch in batches:
            out, held = [], 0
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                headers, body = parse_record(zlib.decompress(read_range(path, offset, length, opened), 31))
                kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To")
                page = _page_of(refers) if refers else ""
                out.append({
                    "key": _key(headers["WARC-Target-URI"], _page_of(headers["WARC-Record-ID"])), "record_type": kind, "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                    "payload": body if kind == "response" else None, "refers_to": int(page) if page else None,
                })
                held += len(body)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.select("path", "offset", "length").repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(cut, "key string, record_type string, payload_digest string, payload binary, refers_to bigint")


def page_key() -> Column:
    """Index key of columns url and page_id."""

    def keys(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, pages in arrays:
            yield pa.array([_key(target_uri(u), "" if p is None else str(p)) for u, p in zip(urls.to_pylist(), pages.to_pylist())], pa.string())

    return F.arrow_udf(keys, "string")(F.col("url").cast("string"), F.col("page_id").cast("bigint"))


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages``, index them, look every page up and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are computed from the payload read; those of a revisit from
    the record it refers to. One row per row of ``pages``.
    """
    spark = pages.sparkSession
    archive, index = new_folder(spark, "warc"), new_folder(spark, "warc-index")
    write_archives(pages, archive, min_bytes)
    build_index(spark, archive, index)
    places = checkpoint(lookup(spark, pages.select(page_key().alias("key")), index))

    def digests(batches):
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            digest = [d if p is None else base64.b32encode(hashlib.sha1(p).digest()).decode() for p, d in zip(payloads, batch.column("payload_digest").to_pylist())]
            sizes = [None if p is None else len(p) for p in payloads]
            ids = [int(k.rpartition("\t")[2]) if not k.endswith("\t") else None for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digest, pa.string()), batch.column("record_type"), batch.column("refers_to")], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    got = checkpoint(fetch(spark, places).mapInArrow(digests, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"))
    sizes = got.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    full = salted_join(got, sizes, ["payload_digest"], F.coalesce("page_id", F.lit(0)), how="left")
    return full.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
