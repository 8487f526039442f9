import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyworks.llm import chat_format as c


@given(st.text(alphabet="<[|a␛]>\n", max_size=30))
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(text):
    out = c.escaped(text)
    assert c.unescaped(out) == text
    assert not any(x in out for x in ("<|", "[I", "[/", "</"))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("{{ 'a' + 'b' | upper }}-{% if 1 == 2 %}x{% elif not false %}y{% else %}z{% endif %}", "aB-y"),
        ("{% for x in xs %}{{ x.n }}{% if not loop.last %}, {% endif %}{% endfor %}", "1, 2"),
        ("{% set y = xs %}{% for x in y %}{% if loop.first %}{{ loop.index }}{% endif %}{% endfor %}", "1"),
        ("{{ nothing }}", ""),
    ],
)
def test_templates(source, want):
    assert c.Template(source).render(xs=[{"n": 1}, {"n": 2}])[0] == want


def test_constants_are_folded():
    assert c.Template("a{{ 'b' + 'c' }}{% if true %}d{% endif %}").nodes == [("text", "abcd")]


@pytest.mark.parametrize("source", ["{{ x() }}", "{% import os %}", "{{ x | nofilter }}", "{% for x in y %}", "{{ 'a }}"])
def test_bad_templates_are_refused(source):
    with pytest.raises(c.TemplateError):
        c.Template(source)


def test_sandbox_reads_dictionaries_only():
    with pytest.raises(c.TemplateError):
        c.Template("{{ x.__class__ }}").render(x=object())


def test_spans_hold_assistant_texts():
    text, spans = c.Template(c.TEMPLATE).render(messages=[{"role": "user", "text": "hi"}, {"role": "assistant", "text": "<ok>"}])
    assert [c.unescaped(text[a:b]) for a, b in spans] == ["<ok>"]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -(10**9), r or "", x or "") for k, t, r, x in rows if k == conv))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_against_brute_force(spark):
    rows = [(1, 0, "user", "a<|end|>\n"), (1, 1, "assistant", "[INST]␛<"), (2, 1, "assistant", None), (2, 0, None, "x"), (3, 0, "assistant", "e"), (3, 0, "assistant", "e"), (4, None, "assistant", "é<" * 5000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in c.op4(df).collect()}
    assert got.pop(-7)[0] == 2
    assert got == brute(rows)


def test_empty_table(spark):
    got = c.op4(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [r["conv_id"] for r in got] == [-7]


def test_formatted_keeps_text_and_spans(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "q")], "conv_id long, turn long, role string, text string")
    row = c.formatted(df).first()
    assert row["text"][row["spans"][0]["start"] : row["spans"][0]["end"]] == "q"
