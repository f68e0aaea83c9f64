"""Chat formatting: whole conversations through a compiled template, with the spans to learn from.

Spark gathers each conversation's turns (a conversation becomes one string, so its turns have to
meet; conversations are independent of each other) and Arrow batches go through the closures that
`templates` compiles once a task.

Cases: null role, text: empty; turns are ordered by turn (null first), ties by role, then text, and
repeated rows stay repeated turns; a null conv_id is a conversation; roles that the template doesn't
know are written with their name; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylot.llm.templates import Template

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'system' %}<<SYS>>\n{{ m.text | escape }}\n<</SYS>>\n"
    "{% elif m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %} {% generation %}{{ m.text | escape }}{% endgeneration %} </s>"
    "{% else %}<|role|>{{ m.role | escape }}<|text|>{{ m.text | escape }}<|end|>{% endif %}"
    "{% endfor %}"
)
_TURN = re.compile(
    r"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>"
    r"|<\|role\|>(?P<role>.*?)<\|text\|>(?P<text>.*?)<\|end\|>", re.S)

SCHEMA = "conv_id long, formatted string, generation array<struct<start:long, stop:long>>"


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a conversation that TEMPLATE has formatted."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m["role"] is not None:
            turns.append((Template.unescape(m["role"]), Template.unescape(m["text"])))
        else:
            turns.append((m.lastgroup, Template.unescape(m[m.lastgroup])))
        at = m.end()
    return turns


def formatted(conversations: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, turn, role, text) -> SCHEMA, one row a conversation; generation: the spans under the
    loss mask, in code points of formatted."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("messages"))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, controls)
        for batch in batches:
            out = [compiled.render(messages=m) for m in batch.column("messages").to_pylist()]
            spans = [[{"start": a, "stop": b} for a, b in s] for _, s in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").cast(pa.int64()), pa.array([t for t, _ in out], pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                ["conv_id", "formatted", "generation"])

    return gathered.mapInArrow(rendered, SCHEMA)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: DIGEST."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns, sha, loss = read_back(text), hashlib.sha256(), hashlib.sha256()
                for role, said in turns:
                    sha.update(f"{role}\n{said}\n".encode())
                n = 0
                for s in spans:
                    learned = Template.unescape(text[s["start"]:s["stop"]])
                    n += len(learned)
                    loss.update(learned.encode())
                rows.append((conv, len(turns), sha.hexdigest(), n, loss.hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [f.split()[0] for f in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return chats.mapInArrow(digested, DIGEST)
