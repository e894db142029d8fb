"""Chat formatting from an event log: fold streamed deltas, edits and regenerations into messages, then render.

An event is (conv_id, message, seq, kind, role, text), with seq ascending through the conversation. Of a message's
events in order of seq, `open` gives the role, `delta` appends its text, `edit` replaces the text, `regenerate` drops it.
A message's turn is where its first event stands in the sequence; of equal ones the smaller message key comes first.
Events are partitioned by conversation and message first, so a hot conversation is folded and rendered in many tasks.
Only then do turns meet by conversation, sorted by sequence: they stream through a running sum of lengths, one row a
turn, so no task holds a conversation. Its formatted string is its turns' pieces in order.

The template is `<|turn|>` role `<|text|>` text `<|end|>` for each turn. Inside roles and texts a backslash is doubled
and one is put behind the first character of each control string, so none stands there whole; taking every backslash
off that precedes a character gives the text back. The loss mask is the list of spans (code points of the formatted
string) that hold assistant texts.

Null text, role and kind count as empty (a null kind does nothing). Events that repeat all fields count once. Rows that
repeat conversation and turn are turns of their own, in order of role, then text. A null conversation or turn is a key
like any other, nulls first. An empty table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that this template or a model's tokenizer may treat as control; fixed values.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<unk>"]
_CONTROL = re.compile("|".join(f"(?<={re.escape(c[0])}){re.escape(c[1:])}" for c in CONTROL))
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of assistant texts."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURNS.finditer(formatted)]


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, place (seq of its first event), role and text of each message."""
    log = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_set(F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("log"))

    def step(acc, e):
        text = F.when(e["kind"] == "delta", F.concat(acc["text"], e["text"])).when(e["kind"] == "edit", e["text"]).when(e["kind"] == "regenerate", F.lit("")).otherwise(acc["text"])
        role = F.when(e["kind"] == "open", e["role"]).otherwise(acc["role"])
        return F.struct(role.alias("role"), text.alias("text"))

    start = F.struct(F.lit("").alias("role"), F.lit("").alias("text"))
    return log.select("conv_id", "message", F.element_at("log", 1)["seq"].alias("place"), F.aggregate("log", start, step).alias("m")).select("conv_id", "message", "place", "m.role", "m.text")


def formatted(messages: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, message, place, piece of the formatted string, begin (code points before it), and the
    loss mask's span in the conversation's string (loss_begin, loss_end; null where the turn isn't the assistant's).

    Rows of a conversation lie together in a partition, in order."""
    keys = messages.select("conv_id", "message", "place")

    def run(batches):
        for batch in batches:
            done = [render([turn]) for turn in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            spans = [mask[0] if mask else (None, None) for _, mask in done]
            made = [pa.array([v for v, _ in done], pa.string()), *(pa.array(v, pa.int64()) for v in ([len(v) for v, _ in done], [x for x, _ in spans], [y for _, y in spans]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=[*batch.schema.names[:3], "piece", "length", "from", "to"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    pieces = messages.select("conv_id", "message", "place", "role", "text").mapInArrow(run, f"{kinds}, piece string, length long, from long, to long")
    order = ["place", "message"]
    through = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("begin", F.sum("length").over(through) - F.col("length"))
    spans = (F.col("begin") + F.col("from")).alias("loss_begin"), (F.col("begin") + F.col("to")).alias("loss_end")
    return placed.select("conv_id", "message", "place", "piece", "begin", *spans).sortWithinPartitions("conv_id", *order)


def as_events(conversations: DataFrame, piece: int = 64) -> DataFrame:
    """Conversation rows as the log of a client that streamed them.

    Users' texts come as deltas and one edit that restates the text; assistants' as a draft, its regeneration, then deltas."""
    text = F.coalesce("text", F.lit(""))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = conversations.select("conv_id", F.struct("turn", nth.alias("nth")).alias("message"), "role", text.alias("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    cut = F.length("text") - F.least(F.length("text"), F.lit(piece))
    deltas = [event("delta", F.substring("text", F.lit(1), cut)), event("delta", F.substring("text", cut + 1, F.lit(piece)))]
    told = F.when(F.col("role") == "assistant", F.array(event("open", F.lit("")), event("delta", F.lit("draft")), event("regenerate", F.lit("")), *deltas)).otherwise(F.array(event("open", F.lit("")), event("delta", F.substring("text", 1, piece)), event("edit", F.col("text"))))
    return rows.select("conv_id", "message", "role", F.posexplode(told).alias("nth", "e")).select("conv_id", "message", F.struct("message.turn", "message.nth", F.col("nth").alias("event")).alias("seq"), "e.kind", "role", "e.text")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -1L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = formatted(fold(as_events(rows))).select("conv_id", "piece", "begin", "loss_begin", "loss_end")

    def read_back(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state = None  # of the conversation that the rows are in: key, turns, digest, loss characters, loss digest, characters

        def batch_of(ended):
            rows = [(key, n, told.hexdigest(), m, loss.hexdigest(), chars) for key, n, told, m, loss, chars in ended]
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            ended = []
            for key, piece, begin, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != key:
                    if state is not None:
                        ended.append(state)
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if first is not None:
                    loss = unescape(piece[first - begin : last - begin])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] = begin + len(piece)
            if ended:
                yield batch_of(ended)
        if state is not None:
            yield batch_of([state])

    return done.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
