"""Texts of very many special strings, and archives whose fields are damaged or unusual."""

import base64
import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")
from trackloom.llm import _bpe, queries, token_counts, warc  # noqa: E402

SPECIAL = "<|endoftext|>"


def test_many_special_strings(spark, tmp_path):
    texts = [SPECIAL * 100_000, ("some words " + SPECIAL) * 20_000 + " end", SPECIAL, SPECIAL[:-1], SPECIAL + SPECIAL[:-2], None]
    n = len(texts)
    pq.write_table(pa.table({"doc_id": range(n), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    library = _bpe.load(P.path("byte_bpe_50k.json")).library
    got = {r.doc_id: r for r in queries.queries()["op2_token_counts"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        assert got[k].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids)
    assert got[0].n_tokens == 100_000


def test_prefixes_of_special_strings(spark):
    texts = [f"a {SPECIAL}{SPECIAL} b  {SPECIAL[:5]}{SPECIAL}é{SPECIAL}", SPECIAL * 7, f" {SPECIAL} \n {SPECIAL}  x"]
    library = _bpe.load(P.path("byte_bpe_50k.json")).library
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id int, text string")
    got = {r.doc_id: r.prefix_tokens for r in token_counts.prefix_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
    assert got[3] == [0] and got[4] == [0]


def good(k):
    body = f"body {k} ".encode() * 40
    return warc.record("response", f"urn:page:{k}", "http://u", body, hashlib.sha1(body).hexdigest(), None)


def plain(kind, body=b"", **fields):
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), b"WARC-Record-ID: <urn:x>", *[f"{k.replace('_', '-')}: {v}".encode() for k, v in fields.items()]]
    if "Content_Length" not in fields:
        lines.append(f"Content-Length: {len(body)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def read(data):
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([data], pa.binary())], names=["path", "content"])
    return [r for b in warc._read(iter([batch])) for r in b.to_pylist()]


SHA = hashlib.sha1(b"x").hexdigest()


@pytest.mark.parametrize(
    "fields, bytes_, digest",
    [
        ({"WARC_Payload_Digest": "md5:d41d8cd98f00b204e9800998ecf8427e", "Payload_Length": "12"}, 12, None),
        ({"WARC_Payload_Digest": "sha1:" + SHA, "Payload_Length": "abc"}, None, SHA),
        ({"WARC_Payload_Digest": "sha1:" + SHA.upper()}, None, SHA),
        ({"WARC_Payload_Digest": "SHA1:" + base64.b32encode(bytes.fromhex(SHA)).decode().lower(), "Payload_Length": "²"}, None, SHA),
        ({"WARC_Payload_Digest": "sha1:not a digest", "Payload_Length": "9" * 5000}, None, None),
        ({}, None, None),
    ],
)
def test_revisits_of_any_fields(fields, bytes_, digest):
    rows = read(good(1) + plain("revisit", **fields) + good(2))
    assert [r["kind"] for r in rows] == ["response", "revisit", "response"]
    assert (rows[1]["payload_bytes"], rows[1]["digest"], rows[1]["payload"]) == (bytes_, digest, None)


@pytest.mark.parametrize("length", ["²", "9" * 5000, "-1", "", "1e3", "٣"])
def test_lengths_that_are_none(length):
    rows = read(good(1) + plain("response", b"abc", Content_Length=length) + good(2))
    assert [r["kind"] for r in rows] == ["response", "gap", "response"] and rows[1]["reason"].startswith("no length")


def test_folded_headers_and_hex_digests():
    body = b"the body"
    folded = plain("resource", body, WARC_Target_URI="http://long/\r\n path\r\n\tend", WARC_Block_Digest="sha1:" + hashlib.sha1(body).hexdigest())
    wrong = plain("resource", body, WARC_Block_Digest="sha1:" + SHA)
    other = plain("resource", body, WARC_Block_Digest="sha256:00")
    rows = read(folded + wrong + other + good(3))
    assert [r["kind"] for r in rows] == ["resource", "gap", "resource", "response"]
    assert rows[0]["url"] == "http://long/ path end" and rows[0]["payload"] == body and rows[1]["reason"].startswith("the block digest differs")


def test_a_lost_record_is_an_error(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "u", "x" * 2000 + str(k)) for k in range(5)], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 5
    whole = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a: whole(*a).where("record_id <> 'urn:page:3'"))
    with pytest.raises(RuntimeError, match="was written with [0-9] records and read with [0-9], and 0 gaps"):
        warc.round_trip(pages)
