"""Operators 11 to 13 against plain versions, on the given tables and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import credentials, infill, manifest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n", "Ab", "Ab", "é中x\U0001f600" * 30, "holds <P> already", "A" * 300_000, "a<", "P>", "<S", "deadbeef" * 3, "no letters 12"]
    rows = [(i, t, [None, "en", "de"][i % 3], "s", None) for i, t in enumerate(texts)] + [(3, "Ab", None, "s", None), (3, "other", None, "t", 1), (None, "x", None, None, None), (None, None, "only", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def folder(df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# --- 11


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return sha("".join(field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def climbed(digests):
    """Root of a list of digests and, for each, its siblings as (left, right) by level."""
    paths, of = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for p, i in enumerate(of):
            run = digests[i // 8 * 8 : i // 8 * 8 + 8]
            paths[p].append((run[: i % 8], run[i % 8 + 1 :]))
        of = [i // 8 for i in of]
        digests = [sha("".join(digests[k : k + 8])) for k in range(0, len(digests), 8)]
    return digests[0], paths


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {g: sorted(by[g], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text))) for g in langs}
    trees = {g: climbed([leaf_of(r, r.text) for r in ordered[g]]) for g in langs}
    root, above = climbed([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for r, path in zip(ordered[g], trees[g][1]):
            path = path + above[k]
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            lower = None if r.text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
            acc = leaf_of(r, lower if tampered else r.text)
            for left, right in path:
                acc = sha("".join([*left, acc, *right]))
            out.append((r.doc_id, leaf_of(r, r.text), trees[g][0], root, sha("".join(x for a, b in path for x in [*a, *b])), acc, acc == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest(spark, odd, empty, tmp_path):
    got = manifest.op11_manifest(spark, SF)
    assert tuple(got.columns) == COLUMNS
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == brute_manifest(rows) and {x[-1] for x in found} == {True, False}
    assert sorted(map(tuple, manifest.op11_manifest(spark, folder(odd, tmp_path)).collect()), key=str) == brute_manifest(odd.collect())
    assert manifest.op11_manifest(spark, folder(empty, tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_manifest_sizes(spark, tmp_path, n):
    """Whole and broken runs, lone nodes on several levels, one group that holds nearly all rows, and many groups."""
    groups = F.when(F.col("id") < n, "hot").otherwise(F.concat(F.lit("g"), F.col("id")))
    df = spark.range(n + 70).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), F.col("id")).alias("text"), groups.alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert sorted(map(tuple, manifest.op11_manifest(spark, folder(df.repartition(7), tmp_path)).collect()), key=str) == brute_manifest(df.collect())


def test_manifest_columns(spark):
    """Columns with the names of outputs or helpers don't disturb it."""
    df = spark.range(20).select("id", F.lit("a").alias("_group"), (F.col("id") % 3).alias("_i"), F.lit(7).alias("row"), F.lit(1).alias("root"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    got = manifest.manifest(df, "_i", "id").collect()
    assert len(got) == 20 and {r.row for r in got} == {7} and len({r.root for r in got}) == 1 and {r._i for r in got} == {0, 1, 2}


# --- 12


def brute_infill(doc_id, t):
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if t == "" or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_infill(spark, odd, empty, tmp_path):
    for df, path in ((spark.read.parquet(f"{SF}/documents.parquet"), SF), (odd, folder(odd, tmp_path))):
        want = []
        for r in df.collect():
            n, form, p, m, out = brute_infill(r.doc_id, r.text or "")
            want.append((r.doc_id, n, form, p, m, sha(out), sha(r.text or "")))
        got = infill.op12_infill(spark, path)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {x[2] for x in want} >= {"plain", "psm"}
    assert infill.op12_infill(spark, folder(empty, tmp_path / "none")).count() == 0


def test_infill_restores_what_looks_like_sentinels(spark):
    """Every cut of texts whose parts end or begin like a sentinel."""
    texts = ["<P<S<M", "><>P>S>M>", "<<P<<S", "a<Pb>S<"]
    for t in texts:
        for a in range(len(t) + 1):
            for b in range(a, len(t) + 1):
                h = (a, b, 0, 99)
                n, form, p, m, out = infill.infill(t, h, re.compile(infill.CODE_POINT))
                assert (n, form, p, m) == (len(t), "psm", a, b - a) and out == f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "doc_id long, text string")
    out = infill.transform(df, changed=100, suffix_first=50)
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text for r in got) and {r.form for r in got} == {"psm", "spm"}


def test_infill_by_words(spark):
    """Units are a parameter; clashing columns give way, others stay."""
    text = "  one two\nthree  four five "
    df = spark.createDataFrame([(i, text, "mine", i) for i in range(50)], "doc_id long, text string, FORM string, kept long")
    got = infill.transform(df, unit=infill.WORD, changed=100).collect()
    units = re.findall(infill.WORD, text)
    assert got[0].__fields__ == ["doc_id", "text", "kept", "n", "form", "prefix_units", "middle_units", "output"]
    for r in got:
        a, b = r.prefix_units, r.prefix_units + r.middle_units
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        assert r.n == len(units) == 6 and r.output in (f"<P>{pre}<S>{suf}<M>{mid}", f"<S>{suf}<P>{pre}<M>{mid}")


# --- 13

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def text_of(spans):
    return ",".join(f"{credentials.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def signed(prefix, body):
    crc, digits = zlib.crc32(body.encode()), ""
    while crc:
        crc, d = divmod(crc, 62)
        digits = credentials.BASE62[d] + digits
    return f"{prefix}_{body}{digits.rjust(6, '0')}"


def extended(payload):
    n = int.from_bytes(payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4], "big")
    digits = ""
    while n:
        n, d = divmod(n, 58)
        digits = credentials.BASE58[d] + digits
    return digits


GITHUB = signed("ghp", "0123456789abcdefghijABCDEFGHIJ")
NPM = signed("npm", "Z" * 30)
XPRV = extended(bytes.fromhex("0488ade4") + bytes(range(74)))


def odd_texts():
    rng = random.Random(7)
    texts = [None, "", "token=abc", "token=abcdef", "toKen : 'abcdef' secret=\"x/y+z==\"", "toKen=abcdef ſecret=abcdef", "secretoken=abcdef", "password=passwd=secret=token", "api_key=api-key=apikey:abcdef", "İİ passwd = éabcdef token=abcdefé"]
    texts += ["AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 16, "akia" + "A" * 16, "0" * 23, "é" + "f" * 24 + "g" + "0" * 24, "中" * 7 + "0123456789abcdef" * 3, "f" * 24, "0123456789ABCDEF" * 2]
    texts += [f"a {GITHUB} b", f"a {GITHUB[:-1]}0 b", f"token={GITHUB} {NPM}", f"{NPM}x", f"é{XPRV}.", XPRV[:-1] + ("2" if XPRV[-1] != "2" else "3"), "ghp_" + "_" * 40, "token" * 2000 + "=abcdef", "token" + " " * 50_000, ("hex " + "a1" * 13 + " ") * 9000]
    pieces = ["token", "=", " ", "'", "abc", "AKIA", "0a1b2c3d" * 3, "é", "passwd", ":", "API_KEY", "apikey", "\n", "ZZZZZZZZ", "secret", GITHUB, "中"]
    texts += ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(400)]
    return texts


def test_credentials(spark, empty, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = odd_texts()
    odd = spark.createDataFrame([(i % 300 or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df, path in ((docs, SF), (odd, folder(odd.coalesce(1), tmp_path))):
        want = sorted(((r.doc_id, *(sum(k == x for _, k, _ in brute_base(r.text or "")) for x in range(3)), sha(text_of(brute_base(r.text or "")))) for r in df.collect()), key=str)
        got = credentials.op13_secrets(spark, path).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert sum(x[1] + x[3] for x in want) > 100
    assert credentials.op13_secrets(spark, folder(empty, tmp_path / "none")).count() == 0


def test_checksums(spark):
    df = spark.createDataFrame([(t, 1) for t in odd_texts()], "text string, SECRETS int")
    rows = credentials.find(df).collect()
    assert rows[0].__fields__ == ["text", "secrets"]
    found = {r.text: [(s.kind, r.text[s.start : s.end]) for s in r.secrets if s.checksum] for r in rows if r.text and len(r.text) < 200}
    assert found[f"a {GITHUB} b"] == [("github", GITHUB)] and found[f"a {GITHUB[:-1]}0 b"] == []
    assert found[f"token={GITHUB} {NPM}"] == [("github", GITHUB), ("npm", NPM)] and found[f"{NPM}x"] == []
    assert found[f"é{XPRV}."] == [("xprv", XPRV)] and len(XPRV) == 111 and sum(map(bool, found.values())) >= 3


def test_masked(spark):
    df = spark.createDataFrame([(t,) for t in odd_texts()], "text string")
    for r in credentials.find(df).withColumn("out", credentials.masked(F.col("text"), F.col("secrets"))).collect():
        if r.text is None:
            assert r.out is None
            continue
        out, at = "", 0
        for s in r.secrets:
            if s.start > at or s.start == 0 and at == 0:
                out += r.text[at : s.start] + "*"
            at = max(at, s.end)
        assert r.out == out + r.text[at:]
