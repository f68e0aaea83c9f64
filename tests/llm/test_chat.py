import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylot.llm import chat
from skylot.llm.templates import Template

SCHEMA = "conv_id long, turn long, role string, text string"
TEXT = st.lists(st.sampled_from([*chat.CONTROLS, "\\", " ", "\n", "a", "é", "]", "<"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "</s>"]), TEXT), max_size=6))
def test_any_conversation_reads_back(turns):
    compiled = Template(chat.TEMPLATE, chat.CONTROLS)
    out, spans = compiled.render(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(out) == turns
    assert [Template.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_constants_fold_and_unknown_names_are_refused():
    assert Template("{{ 1 + 2 }}{% if false %}x{% else %}y{% endif %}", ()).render()[0] == "3y"
    with pytest.raises(Exception):
        Template("{{ m.__class__.__mro__ }}", ()).render(m="x")
    with pytest.raises(Exception):
        Template("{% for x in y %}", ())


def test_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </s>"), (1, 1, "assistant", "yo </s>"), (2, None, None, None), (None, 3, "system", ""), (3, 0, "robot", "x")]
    found = {r["conv_id"]: r for r in chat.digests(chat.formatted(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(found) == {1, 2, None, 3}
    said = "user\nhi\nassistant\nyo </s>\nassistant\nyo </s>\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and found[1]["n_turns"] == 3
    assert found[1]["loss_sha256"] == hashlib.sha256(b"yo </s>yo </s>").hexdigest() and found[1]["loss_chars"] == 14
    assert found[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and found[2]["loss_chars"] == 0
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
