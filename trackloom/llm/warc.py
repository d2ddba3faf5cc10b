"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer gives each record its own gzip member and rolls archives at ``ARCHIVE_BYTES``.
Files are written through ``pyarrow.fs`` under a name of the attempt's own and count once their
row is in the manifest, so a task that is lost and run again leaves no record twice.

The reader takes the next record at a member's or version line's place. When a check fails
(magic, CRC, version line, length, block digest) it searches for the next place from which a
whole record can be read, goes on there and logs the bytes between as a gap. It searches inside
a member too, also in what could be decompressed of a cut or damaged one.

Of equal payloads of at least ``least`` bytes, the record with the largest id is the response
and the others are revisits of it, which carry its id, the digest and the payload's length.

Defined results: a null payload is empty; a null url is left out; rows that repeat the largest
id are all responses; a null id cannot be referred to and is always a response; an empty table
gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm._shared import fresh_path, only, settle

ARCHIVE_BYTES = 8 << 20
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION, b"WARC/0.18")
DATE = "1970-01-01T00:00:00Z"
GZIP = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4
STEP = 1 << 14
CUT = "the member does not end"


# Records


def record(kind: str, record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; digest is the payload's SHA-1 in hex, payload is left out of a revisit."""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    block = b"\r\n".join(head) + b"\r\n\r\n" + (b"" if kind == "revisit" else payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id or 'urn:uuid:' + str(uuid.uuid4())}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in fields]]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damaged(ValueError):
    pass


def number(text: str | None) -> int | None:
    """A field's number of bytes; null where it is none, or one that no archive holds."""
    return int(text) if text and re.fullmatch("[0-9]{1,18}", text) else None


def sha1_of(field: str | None) -> str | None:
    """A digest field's SHA-1 in hex, whether it is written in base 32 or in hex; null for other digests and codings."""
    algorithm, _, digest = (field or "").strip().partition(":")
    if algorithm.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", digest):
        return digest.lower()
    return base64.b32decode(digest.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", digest) else None


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record that begins at a place: its fields, block and end."""
    if data[at : at + 5] != b"WARC/":
        raise Damaged("no version line")
    version = next((v for v in VERSIONS if data.startswith(v + b"\r\n", at)), None)
    if version is None:
        raise Damaged("unknown version")
    fields, name, here = {}, "", at + len(version) + 2
    while (stop := data.find(b"\r\n", here)) != here:
        if stop < 0:
            raise Damaged("headers do not end")
        if data[here : here + 1] in (b" ", b"\t") and name:  # a folded line goes on with the last field
            fields[name] += " " + data[here:stop].strip().decode("utf-8", "replace")
            here = stop + 2
            continue
        k, colon, v = data[here:stop].partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        name = k.strip().decode("utf-8", "replace").lower()
        fields[name] = v.strip().decode("utf-8", "replace")
        here = stop + 2
    length = number(fields.get("content-length"))
    if length is None:
        raise Damaged("no length")
    end = stop + 2 + length
    block = data[stop + 2 : end]
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the record does not end where its length says")
    digest = sha1_of(fields.get("warc-block-digest"))
    if digest is not None and hashlib.sha1(block).hexdigest() != digest:
        raise Damaged("the block digest differs")
    return fields, block, end + 4


def member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What can be decompressed of the gzip member at a place, where that ends, and what is wrong with the member ("" if its CRC holds).

    A failing step is taken again from the state before it, byte by byte, so that all that comes
    before the damaged byte is returned.
    """
    if data[at : at + 3] != GZIP:
        raise Damaged("no gzip member")
    d, view, out, careful = zlib.decompressobj(31), memoryview(data), [], False
    while not d.eof:
        piece = view[at : at + (1 if careful else STEP)]
        before = None if careful else d.copy()
        try:
            got = d.decompress(piece, 1 if careful else 0)
        except zlib.error as e:
            if careful:
                return b"".join(out), at, str(e)
            d, careful = before, True
            continue
        if not len(piece) and not got and not d.eof:
            return b"".join(out), at, CUT
        out.append(got)
        at += len(piece) - len(d.unused_data if d.eof else d.unconsumed_tail)
    return b"".join(out), at, ""


def _within(whole: bytes) -> Iterator[tuple]:
    """(length, fields, block, "") of each record in decompressed bytes, and (length, None, None, reason and places) of the bytes between."""
    at, n, gap, why = 0, len(whole), -1, ""
    while at < n:
        try:
            fields, block, end = parse(whole, at)
        except Damaged as e:
            if gap < 0:
                gap, why = at, str(e)
            following = whole.find(b"WARC/", at + 1)
            at = n if following < 0 else following
            continue
        if gap >= 0:
            yield at - gap, None, None, f"{why} (decompressed bytes {gap} to {at} of the member)"
            gap = -1
        yield end - at, fields, block, ""
        at = end
    if gap >= 0:
        yield n - gap, None, None, f"{why} (decompressed bytes {gap} to {n} of the member)"


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", offset, fields, block) of each record, and ("gap", offset, length, reason) of quarantined bytes.

    A file may hold gzip members, plain records or both: each place where either kind can begin is
    tried. What a damaged member stored uncompressed would be met again in the file and is left out.
    A gap between records of one member has the member's offset; its length counts decompressed
    bytes. Records of a damaged member are kept, with a field ``:salvaged-from`` that says what is
    wrong with it, as no digest vouches for their headers. Only a lone record whose member's CRC
    differs is quarantined: what differs can be nowhere else.
    """
    at, n, gap, why = 0, len(data), -1, ""
    read, read_to, blocks = b"", 0, []
    while at < n:
        wrong = ""
        try:
            if data.startswith(GZIP, at):
                whole, end, wrong = member(data, at)
                found = list(_within(whole))
                if at < read_to and any(data[at:end] in block for block in blocks):
                    raise Damaged("given with the record around it")
                some = [block for _, fields, block, _ in found if fields]
                if wrong and some:
                    read, read_to, blocks = whole, end, some
                if (found or wrong) and not some or "incorrect" in wrong and len(found) == 1:
                    raise Damaged(wrong or found[0][3])
            else:
                fields, block, end = parse(data, at)
                found = [(end - at, fields, block, "")]
                if at < read_to and data[at:end] in read:
                    raise Damaged("read with the member around it")
        except Damaged as e:
            if gap < 0:
                gap, why = at, str(e)
        else:
            if gap >= 0:
                yield "gap", min(gap, at), max(at - gap, 0), why
                gap = -1
            for length, fields, block, reason in found:
                if fields is None:
                    yield "gap", at, length, reason
                    continue
                if wrong:
                    fields[":salvaged-from"] = wrong
                yield "record", at, fields, block
            if not wrong:
                at = end
                continue
            gap, why = end, wrong
        following = START.search(data, at + 1)
        at = following.start() if following else n
    if gap >= 0:
        yield "gap", gap, n - gap, why


# Tables


def _append(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = out = None
        size = count = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["archive", "n_records", "n_bytes"])

        for batch in batches:
            ids, urls, kinds, refs, digests = (batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to", "digest"))
            payloads = batch.column("html")
            for k in range(batch.num_rows):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = (payloads[k].as_py() or "").encode("utf-8")
                own = None if ids[k] is None else f"urn:page:{ids[k]}"
                raw = record(kinds[k], own, urls[k], payload, digests[k], f"urn:page:{refs[k]}")
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = z.compress(raw) + z.flush()
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def _uri(spark: SparkSession, folder: str) -> str:
    """The folder, made, with the scheme of the store that it is in: one without is in the cluster's
    default file system, as for all of Spark, and one of mounted file systems is resolved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    whole = store.resolvePath(path).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def write_archives(pages: DataFrame, folder: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every row as a record into archives under ``folder``; returns the manifest (archive, n_records, n_bytes)."""
    rows = only(pages, page_id=id_col, url=url_col, html=payload_col).withColumn("page_id", F.col("page_id").cast("long"))
    digest, size = F.sha1(F.coalesce("html", F.lit("")).cast("binary")), F.octet_length(F.coalesce("html", F.lit("")))
    measured = rows.select("page_id", digest.alias("digest"), size.alias("size")).where((F.col("size") >= least) & F.col("page_id").isNotNull())
    first = measured.groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "size", "first")
    first = settle(first, "first-pages")
    # Small payloads and rows without an id meet nothing; a key of their own deals them out. A large payload that
    # many rows share is a skewed key of a left join, whose rows Spark splits at run time.
    rows = rows.withColumn("digest", digest).withColumn("size", size)
    meets = (F.col("size") >= least) & F.col("page_id").isNotNull()
    rows = rows.withColumn("key", F.when(meets, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    joined = rows.join(first.select(F.col("digest").alias("key_of"), F.col("size").alias("size_of"), "first"), (F.col("key") == F.col("key_of")) & (F.col("size") == F.col("size_of")), "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") < F.col("first"))
    decided = joined.select(
        "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )
    return settle(decided.mapInArrow(_append(_uri(pages.sparkSession, folder)), "archive string, n_records long, n_bytes long"), "warc-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "offset", "kind", "length", "reason", "record_id", "url", "refers_to", "payload_bytes", "digest", "payload"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows, held = [], 0
            for what, at, *rest in salvage(content.as_py()):
                if what == "gap":
                    rows.append((path, at, "gap", *rest, *[None] * 6))
                    continue
                f, block = rest
                kind = f.get("warc-type", "")
                payload = block.partition(b"\r\n\r\n")[2] if f.get("content-type", "").startswith("application/http") else block
                if kind == "revisit":
                    payload, n, digest = None, number(f.get("payload-length")), sha1_of(f.get("warc-payload-digest"))
                else:
                    n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                rows.append((path, at, kind, len(block), f.get(":salvaged-from"), f.get("warc-record-id", "").strip("<>"), f.get("warc-target-uri"), f.get("warc-refers-to", "").strip("<>") or None, n, digest, payload))
                held += len(block)
                if held > 4 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records and gaps of all archives under a folder; with a manifest, of those it names.

    An archive is read whole, so it may have 2 GB at most; the writer's have some megabytes.

    Columns: archive, offset, kind (a record's type, or gap), length, reason (of a gap, or
    what is wrong with the member that a record was salvaged from),
    record_id, url, refers_to, payload_bytes, digest (SHA-1 in hex), payload.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    if manifest is not None:
        files = files.withColumn("archive", F.substring_index("path", "/", -1)).join(manifest.select("archive"), "archive", "left_semi").select("path", "content")
    return files.mapInArrow(_read, "archive string, offset long, kind string, length long, reason string, record_id string, url string, refers_to string, payload_bytes long, digest string, payload binary")


def write_and_read(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write a table of pages into fresh archives in the shared folder and read these back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = write_archives(pages, folder, least)
    if manifest.isEmpty():
        return spark.createDataFrame([], "archive string, offset long, kind string, length long, reason string, record_id string, url string, refers_to string, payload_bytes long, digest string, payload binary")
    return read_archives(spark, folder, manifest)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """What ``write_and_read`` gives, without payloads, held against the manifest: an archive of
    which a record is missing, or bytes lie outside records, is an error."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = write_archives(pages, folder, least)
    found = settle(read_archives(spark, folder, manifest).drop("payload"), "warc-records")
    gap = (F.col("kind") == "gap").cast("int")
    read = found.groupBy(F.substring_index("archive", "/", -1).alias("archive")).agg(F.sum(1 - gap).alias("read"), F.sum(gap).alias("gaps"))
    lost = manifest.join(read, "archive", "left").where("coalesce(read, 0) <> n_records or coalesce(gaps, 0) > 0").first()
    if lost is not None:
        raise RuntimeError(f"{lost.archive} was written with {lost.n_records} records and read with {lost.read or 0}, and {lost.gaps or 0} gaps")
    return found
