"""Secrets in texts: keyword prefilter, anchored patterns near its hits, embedded checksums.

One Aho-Corasick pass over a text with its ASCII letters in lower case finds every keyword of every rule. Only where a
keyword begins is the rule's pattern tried, anchored there; a hit inside what the rule has matched already is passed
over, so a rule's matches are the leftmost non-overlapping ones of its pattern. Then the rule's test decides: a least
length, or, for credentials that carry a checksum, whether it holds. A match that fails its test is dropped, but its
text stays used up.

Runs of hexadecimal digits have no keyword; a probe of every 24th byte takes its place: no run of 24 or more slips
between probes, and only around probes that hit are a run's ends looked up.

Null counts as empty. Rows stand alone: rows that repeat, or repeat an id, each have their own result; an empty table
gives an empty one. A very long text is scanned whole, as one row of work, in linear time. Spans count code points. Other
columns stay; one named like the output gives way to it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import cache
from hashlib import sha256
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, table, text_chunks

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
HEX_RUN = 24


def crc_holds(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the others behind the underscore, in base 62."""
    body, told = m[1][:-6], m[1][-6:]
    crc, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = BASE62[d] + digits
    return digits == told


def base58_holds(m: re.Match) -> bool:
    """An extended key: 78 bytes and the first four of their double SHA-256, in base 58."""
    n = 0
    for c in m[0]:
        n = n * 58 + BASE58.index(c)
    if n >= 1 << 8 * 82:
        return False
    raw = n.to_bytes(82, "big")
    return sha256(sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


class Rule(NamedTuple):
    kind: str
    keywords: tuple[str, ...]  # in lower case; none holds another one of its rule
    pattern: re.Pattern | None
    holds: Callable[[re.Match], bool] | None
    checksum: bool = False


#: In the order in which kinds are listed.
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), lambda m: len(m[1]) >= 6),
    Rule("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Rule("hex", (), None, None),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), crc_holds, True),
    Rule("npm", ("npm_",), re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), crc_holds, True),
    Rule("xprv", ("xprv",), re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"), base58_holds, True),
)
KINDS = [r.kind for r in RULES]
HEX = KINDS.index("hex")
SECRETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("checksum", T.BooleanType())]))


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, rule in enumerate(RULES):
        for word in rule.keywords:
            a.add_word(word, (k, len(word)))
    a.make_automaton()
    return a


def keyed(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) of what the rules with keywords find. Only ASCII letters change case, so places stay the same."""
    text, free, out = None, [0] * len(RULES), []
    for last, (k, length) in automaton().iter(raw.lower().decode()):
        start = last + 1 - length
        if start < free[k]:
            continue
        if text is None:
            text = raw.decode()
        if m := RULES[k].pattern.match(text, start):
            free[k] = m.end()
            if RULES[k].holds(m):
                out.append((start, k, m.end()))
    return out


_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def hex_runs(data: np.ndarray, offsets: np.ndarray, least: int = HEX_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, in bytes of data, of all longest runs of at least so many hexadecimal digits within a row."""
    is_hex = _IS_HEX[data]
    probes = np.flatnonzero(is_hex[::least]) * least
    if not len(probes):
        return probes, probes
    # ends of runs: bytes that aren't digits, and the rows' borders
    others = np.flatnonzero(~is_hex)
    after, row = np.searchsorted(others, probes), np.searchsorted(offsets, probes, "right")
    begin = np.maximum(np.where(after > 0, others[after - 1] + 1, 0) if len(others) else 0, offsets[row - 1])
    end = np.minimum(np.append(others, len(data))[after], offsets[row])
    begin, first = np.unique(begin, return_index=True)
    end = end[first]
    long = end - begin >= least
    return begin[long], end[long]


def scan(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """For each text the spans (start, rule, end), in order."""
    out = []
    for lo, hi, data, offsets in text_chunks(texts):
        raw = data.tobytes()
        found = [keyed(raw[offsets[i] : offsets[i + 1]]) for i in range(hi - lo)]
        begins, ends = hex_runs(data, offsets)
        rows, first = np.unique(np.searchsorted(offsets, begins, "right") - 1, return_index=True)
        for row, a, b in zip(rows.tolist(), first.tolist(), [*first[1:].tolist(), len(begins)]):
            base = offsets[row]
            # code points before each byte of this row
            before = np.concatenate(([0], np.cumsum((data[base : offsets[row + 1]] & 0xC0) != 0x80)))
            found[row] += [(s, HEX, e) for s, e in zip(before[begins[a:b] - base].tolist(), before[ends[a:b] - base].tolist())]
        out += [sorted(x) for x in found]
    return out


def find(df: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """df with an array of (kind, start, end, checksum), by start, then by kind as listed; checksum: one was there and holds."""

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([[{"kind": KINDS[k], "start": s, "end": e, "checksum": RULES[k].checksum} for s, k, e in x] for x in scan(texts)], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("checksum", pa.bool_())])))]

    return appended(df, [text_col], [T.StructField(out_col, SECRETS)], run)


def masked(text: Column, secrets: Column, by: str = "*") -> Column:
    """text with every span that find gave replaced by one `by`; spans that meet or overlap become one."""
    empty = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def between(a: Column, b: Column) -> Column:
        return F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        more = F.when(s["start"] > acc["at"], F.concat(between(acc["at"], s["start"]), F.lit(by))).when((s["start"] == 0) & (acc["at"] == 0), F.lit(by)).otherwise("")
        return F.struct(F.concat(acc["done"], more).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(secrets, empty, step, lambda acc: F.concat(acc["done"], between(acc["at"], F.length(text))))


def listed(secrets: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.concat_ws(",", F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, base = find(table(spark, sf_dir, "documents").select("doc_id", "text")), ("assign", "access", "hex")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, base), F.sha2(listed(F.filter("secrets", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
