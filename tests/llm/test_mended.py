"""Broken and very long pages, and the pipeline on clashing columns, nulls, repeated rows and empty tables."""

import base64
import gzip
import hashlib
import struct
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import dedup, html, jaccard, packing, pieces, warc
from tidemark.llm.common import stored, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MANY = 100_000
BROKEN = {
    "stray closes": "<div>" * MANY + "</p>" * MANY, "open quotes": '<a x="' * MANY, "crossed quotes": "<a x='\"' y=\"" * MANY, "one bracket at the end": '<a x="' * (MANY - 1) + ">", "open tags": "<a " * MANY, "declarations": "<!" * MANY, "brackets": "<" * MANY,
    "inline inside": "<i><div>" + "<b>" * MANY + "</i>" * MANY, "paragraphs": "<p>" * MANY, "deep": "<div>" * MANY, "lists": "<li>" * MANY, "long name": '<div class="' + "list-" * MANY + '!">x', "repeated name": '<div class="' + "advert_" * MANY + '!">x',
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_pages_are_linear(kind):
    start = time.process_time()
    html.main_text(BROKEN[kind] + "<p>the text behind</p>")
    assert time.process_time() - start < 4


def test_page_texts():
    assert html.main_text("<article>" + "<div>" * 5000 + "</p>" * 5000 + "a few words</article>") == "a few words"
    assert html.main_text('<article><a title="a > b">linked</a> and <b x=\'"\'>bold</b></article>') == "linked and bold"
    assert html.main_text('<article>one</article><a href="never closed') == "one"
    for name, gone in {"advert_box": True, "advert-slot-3": True, "3-ad": False, "no-sidebar": False, "sponsored": True, "main-menu": True, "-menu": False, "list": False, "site_header": True, "related-work": False}.items():
        assert (html.main_text(f'<p>{"words " * 40}</p><div class="{name}">{"others " * 40}</div>').count("others") == 0) == gone, name


def test_extract_edges(spark):
    schema = "page_id long, html string, text string, `odd name` int"
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
    long = "<article>" + "<p>some words here</p>" * 60_000 + "</article>"
    rows = html.extract(spark.createDataFrame([(1, None, "mine", 5), (2, long, "mine", 6), (2, long, "mine", 6)], schema)).orderBy("page_id").collect()
    assert rows[0].text == "" and rows[1].text == rows[2].text == "\n".join(["some words here"] * 60_000) and rows[1]["odd name"] == 6


def test_repeated_rows_stay_once(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "other"), (None, "only here")] + [(None, "twice")] * 2 + [(7, "copy")] * 300 + [(9, "copy")] * 3 + [(None, "")] * 5 + [(None, None)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in dedup.deduplicate(df, once=True).collect())
    assert {k: n for k, n in got.items() if k not in ((1, "a b"), (1, "a  b"), (None, ""), (None, None))} == {(1, "other"): 1, (None, "only here"): 1, (None, "twice"): 1, (7, "copy"): 1}
    assert got[1, "a b"] + got[1, "a  b"] == 1 and got[None, ""] + got[None, None] == 1
    differ = spark.createDataFrame([(1, "x", k) for k in range(4)], "doc_id long, text string, k int").withColumn("m", F.create_map(F.lit("a"), "k"))
    assert dedup.deduplicate(differ, once=True).count() == 1 and dedup.deduplicate(differ).count() == 4


CLASH = ["_score", "_lang", "_copy", "score", "predicted", "pred", "copy", "_0", "_row", "_key", "row", "rep", "length", "piece", "_b", "odd name"]


def test_pipeline_on_odd_columns(spark, tmp_path):
    """Columns named like helpers come back as they were, with nulls, repeated rows and null ids among the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, c in enumerate(CLASH):
        docs = docs.withColumn(c, F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")))
    odd = spark.createDataFrame([(None, None), (None, ""), (None, None), (10**6, None)], "doc_id long, text string")
    docs = docs.unionByName(docs.where("doc_id % 5 = 0")).unionByName(odd, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.stored(stage(spark, frame, SF))
        assert frame.columns == docs.columns and dict(frame.dtypes) == dict(docs.dtypes), name
    rows = frame.collect()
    assert len(rows) > 100 and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert [r[c] for c in CLASH] == [f"{k}:{r.doc_id}" for k in range(len(CLASH))]
    packed = corpus_pipeline.pack(spark, frame, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_pipeline_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pack_with_odd_columns(spark):
    rows = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 7 + 1).alias("length"), F.col("id").alias("_b"), F.lit("x").alias("rank"), F.lit(3).alias("offset"))
    rows = corpus_pipeline.stored(rows)
    got = packing.pack(rows, 8, ranked=20).collect()
    assert len(got) == 300 and {r._b for r in got} == set(range(300)) and len({(r.sequence_id, r.offset) for r in got}) == 300


def record(kind, ident, block, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, **{k.replace("_", "-"): v for k, v in fields.items()}, "Content-Length": len(block)}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_foreign_archive(spark, tmp_path):
    """Records of another writer: all types, ids of other forms, digests of other kinds or none, several records in a member."""
    page, http = b"<p>body</p>" * 50, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha1 = hashlib.sha1(page)
    of = lambda k: f"<urn:uuid:0000-{k}>"
    records = [
        record("warcinfo", of(0), b"software: other\r\n", Content_Type="application/warc-fields"), record("request", of(1), b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        record("response", of(2), http + page, Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:" + base64.b32encode(sha1.digest()).decode(), WARC_Target_URI="http://a/"),
        record("response", of(3), http + page, Content_Type="application/http", WARC_Payload_Digest="SHA1:" + sha1.hexdigest().upper()), record("response", of(4), http + page, Content_Type="application/http", WARC_Payload_Digest="sha256:" + "0" * 64),
        record("response", of(5), http + page, Content_Type="application/http", WARC_Payload_Digest="sha1:" + "A" * 32), record("revisit", of(6), b"", WARC_Refers_To=of(2)), record("resource", None, page, Content_Type="text/html"), record("metadata", "<urn:page:x>", b"", Content_Type="text/plain"),
    ]
    members = [gzip.compress(r) for r in records[:5]] + [gzip.compress(records[5] + records[6]), gzip.compress(records[7], 0), gzip.compress(records[8])]
    (tmp_path / "other.warc.gz").write_bytes(b"".join(members))
    for split in (16 << 20, 61):
        rows = warc.read_warc(spark, f"file://{tmp_path}", split_bytes=split).collect()
        got = {r.record_id: r for r in rows}
        assert len(rows) == len(records) and Counter(r.record_type for r in rows) == Counter(["warcinfo", "request", "resource", "metadata", "revisit"] + ["response"] * 4)
        assert all(r.page_id is None and r.refers_to is None for r in rows)
        assert got[of(0)].payload == b"software: other\r\n" and got[of(0)].payload_digest is None and got[of(0)].digest_ok is None
        assert got[of(2)].payload == got[of(3)].payload == page and got[of(2)].payload_digest == got[of(3)].payload_digest == sha1.hexdigest() and got[of(2)].digest_ok and got[of(3)].digest_ok
        assert got[of(4)].payload_digest is None and got[of(5)].digest_ok is False and got[of(2)].url == "http://a/"
        assert got[of(6)].refers_to_id == of(2) and got[of(6)].payload is None and got[of(6)].payload_bytes is None and got[None].payload == page


def with_map(tmp_path):
    """The public model with a character map of its own: `a` becomes `b`, `ab` becomes `x`."""
    units = np.zeros(1024, "<u4")
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | (a ^ 512) << 10
    units[512] = 0 | 0x80000000
    b = 512 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | (b ^ 768) << 10
    units[768] = 2 | 0x80000000
    blob = struct.pack("<I", units.nbytes) + units.tobytes() + b"b\0x\0"
    size = lambda n: bytes([n & 127 | 128, n >> 7 & 127 | 128, n >> 14])
    spec = b"\x12" + size(len(blob)) + blob
    with open(public_tokenizers.path(pieces.DEFAULT_MODEL), "rb") as f:
        (tmp_path / "m.model").write_bytes(f.read() + b"\x1a" + size(len(spec)) + spec)
    return str(tmp_path / "m.model")


def test_pieces_of_a_mapped_text(spark, tmp_path):
    """Ids are the library's own for a model that maps characters, and spans lead back to the text as it was."""
    path = with_map(tmp_path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["abab cab", "a", "ab", "banana split", "  a  ab ", "é ab 中 aab", "a\tb", "aaaa " * 500, "", None]
    assert sp.normalize("abab cab banana") == "▁xx▁cx▁bbnbnb"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r, t in zip(pieces.encode(df, path).collect(), texts):
        raw = (t or "").encode()
        assert r.ids == sp.encode(t or "", add_bos=True, add_eos=True) and r.decoded == sp.decode(r.ids)
        back = b"".join(raw[b:e] for b, e in zip(r.begins, r.ends))
        assert back.replace(b" ", b"") == raw.replace(b" ", b"") or "aa" in t or "\t" in t or "é" in t


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """No step of the near stage is two Python functions in one task, and the packing sends no rows through Python workers beside those of the stages."""
    docs, plans = table(spark, SF, "documents"), []
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    told, collect = stored(jaccard.summaries(docs, "doc_id", "text")), type(docs).collect
    with monkeypatch.context() as m:
        m.setattr(type(docs), "collect", lambda self: (plans.append(plan(self)), collect(self))[1])
        m.setattr(jaccard, "FREQUENT", 2)
        m.setattr(jaccard, "TIMES", 0)
        found = jaccard.frequent_cells(told)
        m.setattr(jaccard, "ADDED", 1)  # in many groups, added up in steps
        assert found.any() and (jaccard.frequent_cells(told) == found).all()
    bits, each = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little"), found.shape[1] * 64
    rows = told.where("slice IS NOT NULL").collect()
    assert all((bits[k] == (sum(np.bincount(jaccard._unpacked(r["counts"]) & (each - 1), minlength=each) for r in rows if r["slice"] == k) > 2)).all() for k in range(3))
    assert [p.count("InArrow") for p in plans if "InArrow" in p][0] == 1
    packed = packing.pack(stored(docs.select("doc_id", (F.col("doc_id") % 8 + 1).alias("length"))), 8, ranked=3)
    assert "ExistingRDD" not in plan(packed) and packed.count() == docs.count()
