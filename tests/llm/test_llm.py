"""Each operator against brute force on small tables, and on a table of odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, dedup, html, jaccard, language, packing, pieces, quality, syncmers, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, white space alone, repeats, no letters, one very long text, and a null id."""
    long = "very long text of words " * 20_000
    texts = [None, "", " \t\n ", "One two three four five six.", "one  two\tthree four five six.", "ONE two three four five six.", "1234 !!", "é中 x\x1cy \x0b z", long, long, "ab", "ab c"]
    rows = [(i, t, None if i % 3 else "en", "s", None) for i, t in enumerate(texts)] + [(3, "One two three four five six.", "en", "s", 1), (None, "ab", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def folder(df, tmp_path, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pieces(spark, docs, odd, empty):
    import sentencepiece

    model = public_tokenizers.path(pieces.DEFAULT_MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: r for r in pieces.op1_sentencepiece(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = sp.encode(d["text"] or "", add_bos=True, add_eos=True)
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids)))
    for r, t in zip(pieces.encode(odd, model).collect(), odd.collect()):
        raw = (t.text or "").encode()
        assert r.ids == sp.encode(t.text or "", add_bos=True, add_eos=True) and r.decoded == sp.decode(r.ids)
        for i, b, e in zip(r.ids[1:-1][:1000], r.begins[1:-1], r.ends[1:-1]):
            p = sp.id_to_piece(i)
            if p.startswith("<0x"):
                assert int(p[3:5], 16) in raw[b:e]
            else:
                assert raw[b:e].decode().replace(" ", "▁") in (p, p.removeprefix("▁")) or b == 0 and p == "▁", (p, raw[b:e])
        assert not raw or (r.begins[1], r.ends[-2]) == (0, len(raw))
    assert pieces.encode(empty, model).count() == 0


def test_character_map():
    """A double array with the keys `a` -> `b` and `ab` -> `x`: the longest prefix wins, and spans point to the source."""
    units = np.zeros(1024, "<u4")
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | (a ^ 512) << 10
    units[512] = 0 | 0x80000000
    b = 512 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | (b ^ 700) << 10
    units[700] = 2 | 0x80000000
    units[a] = ord("a") | 1 << 8 | ((a ^ 512) << 10)
    blob = len(units.tobytes()).to_bytes(4, "little") + units.tobytes() + b"b\0x\0"
    n = pieces.Normaliser(b"")
    n.units, n.replacements, n.dummy_prefix, n.squeeze, n.escape = np.frombuffer(blob, "<u4", 1024, 4), blob[4 + 4096 :], False, False, False
    out, begin, end = n("aabcé".encode())
    assert out.tobytes() == "bxcé".encode() and begin.tolist() == [0, 1, 3, 4, 4] and end.tolist() == [1, 3, 4, 6, 6]


def test_warc(spark, tmp_path):
    big, small = "<p>" + "x" * 2000, "<p>tiny"
    rows = [(1, "http://a/", big), (2, None, big), (7, "http://b/ c\r\nWARC-Type: x", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (None, "u", "é" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_warc(spark, f"file://{tmp_path}/w", split_bytes=97).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        body = (h or "").encode()
        r = got[i]
        revisit = i in (1, 2)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None)
        assert r.payload == (None if revisit else body)
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def murmur3(values, seed=42):
    """Spark's hash() of long values (None is passed over; ints are tagged) and of one text."""

    def mix_k(k):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        return ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF

    def mix_h(h, k):
        h ^= mix_k(k)
        return ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF

    def fmix(h, n):
        h ^= n
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    h = seed
    for v in values:
        if isinstance(v, str):
            raw = v.encode()
            whole = len(raw) - len(raw) % 4
            for i in range(0, whole, 4):
                h = mix_h(h, int.from_bytes(raw[i : i + 4], "little"))
            for x in raw[whole:]:
                h = mix_h(h, x - 256 & 0xFFFFFFFF if x > 127 else x)
            h = fmix(h, len(raw))
        elif isinstance(v, tuple):  # an int
            h = fmix(mix_h(h, v[0] & 0xFFFFFFFF), 4)
        elif v is not None:
            h = fmix(mix_h(mix_h(h, v & 0xFFFFFFFF), v >> 32 & 0xFFFFFFFF), 8)
    return h


def closed_syncmers(text, k=syncmers.K, s=syncmers.S):
    """Places and entries, by the definition: hashes of all runs, and the windows with a least one at an edge."""
    import xxhash

    if not text:
        return [], []
    runs = []
    for i in range(len(text) - s + 1):
        h = 42
        for c in text[i : i + s]:
            h = xxhash.xxh64_intdigest(c.encode(), h)
        runs.append(h - (1 << 64) if h >> 63 else h)
    at = [i for i in range(len(text) - k + 1) if min(runs[i : i + k - s + 1]) in (runs[i], runs[i + k - s])]
    if not at:
        return [0], [murmur3([text])]
    gaps = [(b - a,) for a, b in zip(at, at[1:])] + [None]
    return at, [murmur3([(murmur3([runs[j] for j in range(i, i + k - s + 1, s)]),), g]) for i, g in zip(at, gaps)]


def dice(a, b):
    return 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))) if a or b else 1.0


def check_syncmers(got, docs):
    """got: rows of op3. docs: (id, text) in order."""
    assert len(got) == len(docs)
    of = lambda e: " ".join(f"{x:X}" for x in e)
    near = []
    for i, (d, t) in enumerate(docs):
        t, x = t or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + x[:half]
        r = got[d]
        a, b, c = (closed_syncmers(v)[1] for v in (t, e, x))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(e), of(a), of(b))
        assert abs(r.near_edited - dice(a, b)) < 1e-12 and abs(r.near_next - dice(a, c)) < 1e-12
        near.append((r.near_edited, r.near_next))
    return np.array(near)


def test_syncmers(spark, docs, odd, empty, tmp_path):
    got = {r.doc_id: r for r in syncmers.op3_syncmers(spark, SF).collect()}
    near = check_syncmers(got, [(d["doc_id"], d["text"]) for d in docs])
    assert near[:, 0].mean() > 0.4 and near[:, 1].mean() < 0.15 and (near[:, 0] > near[:, 1]).mean() > 0.97
    by_text = defaultdict(set)
    rows = syncmers.op3_syncmers(spark, folder(odd.withColumn("_bucket", F.lit("x")), tmp_path / "o")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        by_text[r.n_chars].add(r.fingerprint)
    assert len(by_text[480_000]) == 1 and by_text[0] == {""}
    assert syncmers.op3_syncmers(spark, folder(empty, tmp_path / "e")).count() == 0


def test_syncmers_order_of_ids(spark, tmp_path, monkeypatch):
    """Far-off and negative ids, several null ones, and the places of anchors."""
    monkeypatch.setattr(syncmers, "RANGES", 8)
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 3)
    ids = [-(1 << 63), -5, *range(100, 160), 1 << 40, (1 << 63) - 1]
    texts = {i: f"text number {k} with some more words, é中\U0001f600 {k * k}" for k, i in enumerate(ids)}
    got = {r.doc_id: r for r in syncmers.op3_syncmers(spark, folder(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tmp_path / "a")).collect()}
    check_syncmers(got, sorted(texts.items()))
    nulls = [(None, f"no id {k}") for k in range(9)] + [(3, "three")]
    rows = syncmers.op3_syncmers(spark, folder(spark.createDataFrame(nulls, "doc_id long, text string"), tmp_path / "b")).collect()
    assert len(rows) == 10
    t = texts[100]
    r = spark.createDataFrame([(t,)], "t string").select(syncmers.anchors(F.col("t"))["at"].alias("at"), syncmers.entries(F.col("t"), syncmers.anchors(F.col("t"))).alias("e")).first()
    assert (r["at"], [x & 0xFFFFFFFF for x in r.e]) == tuple(closed_syncmers(t))


def test_syncmers_without_spaces(spark):
    """Half of an unspaced text unchanged is half in common, at every length and on both sides of a thousand code points."""
    rng = np.random.default_rng(3)
    text = lambda n, base, size: "".join(map(chr, base + rng.integers(0, size, n)))
    pairs = []
    for base, size in ((0x4E00, 3000), (0x61, 26), (0x20000, 3000)):
        for n in (400, 1001, 6000):
            t = text(n, base, size)
            pairs.append((t, t[: n // 2] + text(n - n // 2, base, size)))
            pairs.append((t, text(n, base, size)))
    t = text(1010, 0x4E00, 3000)
    pairs.append((t, t[:990]))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a string, b string").orderBy("i")
    like = [r.x for r in df.select("i", syncmers.likeness(*(F.array_distinct(syncmers.entries(df[c], syncmers.anchors(df[c]))) for c in "ab")).alias("x")).orderBy("i").collect()]
    assert all(0.35 < x < 0.65 for x in like[:-1:2]) and max(like[1:-1:2]) < 0.05 and like[-1] > 0.9, like


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def test_jaccard(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op4_ngram_jaccard(spark, SF).collect()}
    assert got == brute_components([(d["doc_id"], d["text"]) for d in docs])


def test_jaccard_hot_groups(spark, monkeypatch):
    """Near copies in one large group, chains, and a line that many different documents share, with all paths on."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    line = [word() for _ in range(12)]
    base = [word() for _ in range(60)]
    rows = []
    for _ in range(90):
        w = list(base)
        for p in rng.choice(60, rng.integers(0, 4), replace=False):
            w[p] = word()
        rows.append(" ".join(w[: rng.integers(50, 61)]))
    for _ in range(80):
        rows.append(" ".join(line + [word() for _ in range(rng.integers(0, 25))]))
    chain = [word() for _ in range(80)]
    rows += [" ".join(chain[k : k + 50]) for k in range(0, 30, 2)] + ["a b", "A  b", "", None, "\t"]
    rows = [(int(i), t) for i, t in enumerate(rng.permutation(np.array(rows, object)))]
    monkeypatch.setattr(jaccard, "ALL_PAIRS", 3)
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for stars, block in ((2, 1024), (0, 16)):
        monkeypatch.setattr(jaccard, "STARS", stars)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
        assert got == brute_components(rows)


def test_jaccard_odd(spark, odd, empty):
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id in (3, 4, 5, 8, 9, 0, 1)} == {(3, 3), (4, 3), (5, 3), (8, 8), (9, 8), (0, 0), (1, 1)}
    assert jaccard.near_duplicates(empty).count() == 0


def test_product():
    rng = np.random.default_rng(1)
    a, b = (rng.random((n, 60)) < np.where(np.arange(60) < 5, 0.9, 0.1) for n in (70, 50))
    got = jaccard._product(np.nonzero(a)[1], np.nonzero(b)[1], np.nonzero(a)[0], np.nonzero(b)[0], 70, 50)
    assert (got == a.astype(int) @ b.T.astype(int)).all()


def test_sketches():
    """The bound is never below the overlap, and a full cell leaves the pair in."""
    rng = np.random.default_rng(4)
    full = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sketch = lambda x: np.frombuffer(jaccard._sketch(x), np.uint8)[None]
    for k in (0, 100, 299):
        a, b = full[:200], full[k:]
        common = len(np.intersect1d(a, b))
        assert jaccard._sketches_allow(sketch(a), sketch(b), np.array([common]))[0]
    assert not jaccard._sketches_allow(sketch(full[:100]), sketch(full[200:]), np.array([95]))[0]
    crowded = np.arange(300, dtype=np.uint64)
    assert jaccard._sketches_allow(sketch(crowded), sketch(crowded), np.array([300]))[0]


def test_exact_dedup(spark, docs, odd, empty):
    def brute(rows):
        groups = defaultdict(list)
        for i, t in rows:
            groups[norm(t)].append(i)
        low = lambda g: min((i for i in g if i is not None), default=None)
        return Counter((i, low(groups[norm(t)]), len(groups[norm(t)]), i == low(groups[norm(t)]), sha(norm(t))) for i, t in rows)

    assert Counter(map(tuple, dedup.op5_exact_dedup(spark, SF).collect())) == brute([(d["doc_id"], d["text"]) for d in docs])
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup.exact_groups(odd, digest="text_sha256").collect())
    assert got == brute(rows)
    assert Counter(r.doc_id for r in dedup.deduplicate(odd).collect()) == Counter(t[0] for t in got.elements() if t[3])
    assert dedup.deduplicate(empty).count() == 0
    # columns of the same names as our own
    clash = odd.withColumn("_len", F.lit(1)).withColumn("full_hash", F.lit("x")).withColumn("_cell", F.lit(2))
    assert dedup.exact_groups(clash).count() == odd.count()
    assert dedup.deduplicate(clash).columns == clash.columns


def test_exact_dedup_levels(spark, monkeypatch):
    """Each level leaves out what is unique already, also with so few cells that keys share them; a hot group is whole."""
    rows = [(i, "x" * (i % 50) + "y" * (i == 49)) for i in range(50)] + [(100 + i, "a" * 70 + str(i % 10)) for i in range(30)] + [(200, "b" * 70 + "1"), (201, "b" * 70 + "2"), (202, "c" * 500)] + [(300 + i, "hot text") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cells in (1 << 20, 3):
        monkeypatch.setattr(dedup, "CELLS", cells)
        got = {r.doc_id: r for r in dedup.exact_groups(df).collect()}
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        assert all((got[i].keep_id, got[i].group_size) == (min(groups[t]), len(groups[t])) for i, t in rows)
        if cells > 3:
            # lengths settle these, and a prefix the one as long as the hot text; the rest meets at the full hash
            assert {i for i, r in got.items() if r.full_hash is None} == {*range(50), 202}


def test_deduplicate_decides_by_row(spark):
    """One id, or none, for a copy and for other texts: only the copy goes."""
    rows = [(1, "a copy"), (None, "a  copy"), (None, "only here"), (None, "and here"), (2, "a copy"), (2, "its own"), (3, "its own"), (4, None), (None, "")]
    got = corpus_pipeline.drop_copies(spark, spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, "a copy"), (None, "only here"), (None, "and here"), (2, "its own"), (4, None)])


def test_quality(spark, docs, odd, empty, tmp_path):
    got = {r.doc_id: r for r in quality.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93
    model = quality.train(odd, spark.createDataFrame([(3, 1), (6, 0), (None, 1), (77, 1), (8, None)], "doc_id long, quality int"))
    assert quality.classify(odd, model).count() == odd.count()
    assert quality.classify(empty, quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    clash = odd.selectExpr("*", "'x' AS score")
    assert quality.classify(clash, model).columns == [*odd.columns, "score", "predicted"]


def test_gam_finds_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, rounds=60, pairs=1)
    assert m.pairs[0][:2] == (1, 0) and ((m.score(x) > 0.5) == y).mean() > 0.95


def test_chat(spark, tmp_path):
    got = {r.conv_id: r for r in chat.op7_chat(spark, SF).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(turns)
    for c, t in turns.items():
        t.sort()
        loss = "".join(x for _, role, x in t if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(t), sha("".join(f"{a}\n{b}\n" for _, a, b in t)), len(loss), sha(loss)) and r.formatted_chars > 0
    hard = "a\\b</s>[INST]\\n<|end|><|turn|>\\<\\\\s><<s>>\n\\"
    assert chat.unescape(chat.escape(hard)) == hard and not any(c in chat.escape(hard) for c in chat.CONTROL)
    text, mask = chat.render([("assistant", hard), ("", "")])
    assert chat.parse(text) == [("assistant", hard), ("", "")] and [chat.unescape(text[a:b]) for a, b in mask] == [hard]
    log = [(1, 0, 2, "delta", None, "b"), (1, 0, 0, "open", "assistant", None), (1, 0, 1, "delta", None, "a"), (1, 0, 1, "delta", None, "a"), (1, 1, 0, "open", "user", ""), (1, 1, 1, "delta", "", "x"), (1, 1, 2, "regenerate", "", ""), (1, 1, 3, "delta", "", "y"), (1, 1, 4, None, None, None), (None, 0, 0, "edit", None, "z")]
    events = spark.createDataFrame(log, "conv_id long, message int, seq int, kind string, role string, text string")
    assert {(r.conv_id, r.message, r.role, r.text) for r in chat.fold(events).collect()} == {(1, 0, "assistant", "ab"), (1, 1, "user", "y"), (None, 0, "", "z")}
    assert chat.formatted(chat.fold(events.limit(0))).count() == 0
    # the conversation's sequence orders messages, whatever their keys; a turn's place follows the turns before it
    log = [(1, 7, 0, "open", "user", ""), (1, 7, 1, "edit", "", "a</s>"), (1, 3, 2, "open", "assistant", ""), (1, 3, 4, "delta", "", "bc"), (1, 7, 5, "edit", "", "d</s>"), (None, 1, 0, "open", "user", "")]
    events = spark.createDataFrame(log, "conv_id long, message int, seq int, kind string, role string, text string")
    turns = chat.formatted(chat.fold(events)).orderBy("conv_id", "begin").collect()
    assert [(r.conv_id, r.message) for r in turns] == [(None, 1), (1, 7), (1, 3)]
    whole, mask = chat.render([("user", "d</s>"), ("assistant", "bc")])
    assert turns[1].piece + turns[2].piece == whole and [(turns[2].loss_begin, turns[2].loss_end)] == mask and turns[1].loss_begin is None and turns[2].begin == len(turns[1].piece)


def test_html(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div id="cookie-notice">We use cookies</div><!-- ad <p>no</p> -->
    <article><h1>Head &amp; title</h1><p><b>First  line<br>goes
    on.<p>Short.</p><aside>Side</aside><p>2 &lt; 3 &#233;&nbsp;x</p><form><input><p>Sign up</p></form><section class="comments"><p>Reader says</p></section></article>
    <div class="ad">Buy</div><footer>&copy; end</footer></body></html>"""
    assert html.main_text(page) == "Head & title\nFirst line goes on.\nShort.\n2 < 3 é x"
    plain = f"<body><div class=menu><a href=x>One</a></div><div><p>{'word ' * 40}</p><p>Yes.</p></div><div class='reader-comments'>{'bla ' * 90}</div><p><a href=y>{'link ' * 30}</a></p>"
    assert html.main_text(plain) == ("word " * 40).strip() + "\nYes."
    assert [html.main_text(x) for x in (None, "", "<p>", "<article>")] == ["", "", "", ""]
    got = {r.page_id: r for r in html.op8_html(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        from html import unescape

        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [norm(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split("</?(?:p|h1)>", inside)]
        text = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)
    assert html.extract(spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")).collect() == [Row(page_id=1, url="u", text="")]


def test_html_names():
    body = "<h1>Title</h1><p>First paragraph.</p><p>Second one.</p>"
    text = "Title\nFirst paragraph.\nSecond one."
    menu = "<nav><a href=x>Menu</a></nav><div class='site-footer'>Contact</div>"
    # a wrapper's name doesn't blank the article inside it
    for name in ("content no-sidebar", "has-sidebar", "page-with-sidebar", "left-sidebar", "sidebar", "widget", "comments"):
        for tag in ("article", "main"):
            assert html.main_text(f"<body>{menu}<div class='{name}'><{tag}>{body}</{tag}></div>") == text, name
    assert html.main_text(f"<form id=aspnet><article>{body}</article></form>") == text
    assert html.main_text(f"<div class='page-with-sidebar'>{body}</div>{menu}") == text
    # parts of names, heading ids and link targets inside an article
    inner = "<div class='entry-header header'><h1>Title</h1></div><section id='related-work'><h2 id='share-prices'>Share prices</h2><p>Text.</p></section><section id=comments><h2 id=comments class=header>Comments on it</h2></section>"
    assert html.main_text(f"<article>{inner}<div class='social-share-buttons'>Share</div><div id=comments>Me too</div></article>") == "Title\nShare prices\nText.\nComments on it"
    # articles of others stay only where there is none besides
    assert html.main_text(f"<article>{body}</article><div class='related'><article>Teaser</article></div><div id='comments'><article>Me too</article></div>") == text
    # an article that is empty or a teaser doesn't take the page's text away
    assert html.main_text(f"<main></main><div>{body}</div><aside><article>Teaser</article></aside>") == text
    # short articles without a mark
    assert html.main_text(f"<body>{menu}<div>{body}</div><footer>End</footer>") == text
    assert html.main_text("<p>Yes.</p>") == "Yes."


def packed_well(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_packing(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.DEFAULT_TOKENIZER))
    rows = packing.op9_packing(spark, SF).collect()
    n, total = packed_well(rows, 2048)
    assert n <= -(-total // 2048) * 1.01 + 1
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for d in docs:
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            x = ids[at : at + 2048]
            want[d["doc_id"], p] = (at, len(x), zlib.crc32(x.tobytes()))
    assert got == want and len(rows) == len(want)
    texts = [t.text or "" for t in odd.collect() if len(t.text or "") < 1000] + ["<|endoftext|> á b\r\nc\x85d Σ ΑΣ ΣΑ", "it's 12 don't!?x", "x<|startoftext|>Y", "ÉCOLE ×÷ß2é", "e\u0301t\u00e9 \"'s \u2028z"]
    rng = np.random.default_rng(5)
    letters = [*"abXYstvmldr'\"!?,<|>01 \t\n\x1c\x85\xa0éÀÿß×÷ŸİǅſΣ²½ª«“”…\u200b\u0301\u0323Я中\U0001f600ﬁⅧ٣", "<|endoftext|>", "'s", "'LL"]
    texts += ["".join(rng.choice(letters, rng.integers(0, 25))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    ids, cuts = packing.WordEncoder(public_tokenizers.path(packing.DEFAULT_TOKENIZER))(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])), 0)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    packed_well(packing.pack_documents(odd).collect(), 2048)
    assert packing.pack_documents(empty).count() == 0
    # pieces as long as a sequence, null and repeated ids, and buckets of a few rows
    rows = spark.createDataFrame([(i if i % 7 else None, 0, [8, 3, 5, 2, 8][i % 5]) for i in range(200)] + [(4, 0, 5)] * 5, "doc_id long, piece int, length long")
    for ranked in (2, 1000):
        got = packing.pack(rows, 8, ranked=ranked).collect()
        assert len(got) == 205 and packed_well(got, 8) == (134, 1065)


def optimum(items, capacity):
    """The fewest bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for i, room in enumerate(bins):
            if room >= items[k] and room not in seen:
                seen.add(room)
                bins[i] -= items[k]
                go(k + 1, bins)
                bins[i] += items[k]
        bins.append(capacity - items[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_packing_plan():
    rng = np.random.default_rng(2)
    for _ in range(300):
        items = rng.integers(1, 21, rng.integers(1, 11)).tolist()
        p = packing.plan(dict(Counter(items)), 20)
        assert Counter(x for q, n in p.patterns for x in q * n) == Counter(items) and all(sum(q) <= 20 for q, _ in p.patterns)
        # what the reduction fixes is part of an optimal packing
        rest = Counter(items)
        for q, n in p.patterns[: p.fixed]:
            rest -= Counter(q * n)
        best = optimum(items, 20)
        assert sum(n for _, n in p.patterns[: p.fixed]) + optimum(list(rest.elements()), 20) == best
        assert sum(n for _, n in p.patterns) <= best * 11 / 9 + 1


def test_language(spark, docs, odd, empty):
    rows = language.op10_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.9

    def brute(text):
        n = Counter()
        for g in _runs([ord(x.lower()[0]) if x.isalpha() else 0 for x in text]):
            p = [0, *g, 0]
            n.update((x,) for x in g)
            n.update((p[i], p[i + 1], p[i + 2]) for i in range(len(g)))
            n.update((p[i], p[i + 1]) for i in range(len(g) + 1))
        return n

    def fields(code):
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return {language.ONE: (c,), language.TWO: (b, c)}.get(a, (a, b, c))

    for t in ("Hello, wörld! x", "...", "a", "Ab-cd  Éa中", "מה אב Привет, 東京都 𠀀𠀁 \U00031350\U00032000\U00033000"):
        u, n = language.counts(language.grams(t))
        assert {fields(x): y for x, y in zip(u.tolist(), n.tolist())} == dict(brute(t))
    learned = language.profiles(odd)
    got = language.identify(odd, learned).collect()
    assert len(got) == odd.count() and all((r.lang_pred == "und") == (not any(ch.isalpha() for ch in r.text or "")) for r in got)
    assert language.identify(empty, language.profiles(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}


def _runs(c):
    run = []
    for x in [*c, 0]:
        if x:
            run.append(x)
        elif run:
            yield run
            run = []


def test_pipeline(spark, docs):
    ids = {d["doc_id"] for d in docs}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stored(stage(spark, frame, SF))
        if name != "packing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen[name] = {r.doc_id: r.text for r in frame.collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & seen["quality"].keys()) <= 0.1 * len(bad) and seen["quality"].keys() <= ids
    assert len(seen["language"]) >= 0.95 * len(seen["quality"])
    first = {}
    for i, t in sorted(seen["language"].items()):
        first.setdefault(norm(t), i)
    assert seen["exact_dedup"].keys() == set(first.values())
    roots = brute_components(list(seen["exact_dedup"].items()))
    assert seen["near_dedup"].keys() == {i for i, (_, r) in roots.items() if i == r}
    rows = frame.collect()
    assert {r.doc_id for r in rows} == seen["near_dedup"].keys()
    packed_well(rows, 2048)
