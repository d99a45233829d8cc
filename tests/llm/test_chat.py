from hashlib import sha256

import pytest
from hypothesis import given
from hypothesis import strategies as st

from featspark.llm.chat import chat_digest, chat_renderer, escape, format_chats, read_back, unescape
from featspark.llm.template import Node, TemplateError, compile_template, fold, parse

PIECES = st.lists(st.sampled_from(["### ", "</turn>", "#", "<", "/", "turn>", "\\", " ", "\n", "x", "é", "😀"]), max_size=12).map("".join)
RENDER = chat_renderer()


@given(st.lists(st.tuples(st.one_of(st.just("assistant"), PIECES), PIECES), max_size=4))
def test_round_trip(turns):
    text, spans = RENDER([{"role": r, "text": t} for r, t in turns])
    assert read_back(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@given(PIECES)
def test_escape(text):
    assert unescape(escape(text)) == text and "### " not in escape(text) and "</turn>" not in escape(text)


def check(spark, turns):
    convs = {}
    for r in turns.collect():
        key = (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")
        convs.setdefault(r["conv_id"], []).append(key)
    got = chat_digest(format_chats(turns)).collect()
    assert len(got) == len(convs)
    for r in got:
        rows = sorted(convs[r["conv_id"]])
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in rows)
        loss = "".join(text for _, _, role, text in rows if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(rows), sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha256(loss.encode()).hexdigest())


def test_tables(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    schema = "conv_id long, turn long, role string, text string, formatted string"
    check(spark, spark.createDataFrame([], schema))
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "### ", "x"), (None, None, "assistant", "b" * 200_000, "x"), (None, 3, "a\nb", "\\", "x"),
            (1, 1, "assistant", None, "x"), (2, 0, "user", "", None), (3, 0, "assistant", "</turn>", None)]
    check(spark, spark.createDataFrame(rows, schema))


def test_template_language():
    run = compile_template("{% for m in ms %}{% if loop.first %}<{% elif m.x == 'b' and not m.y %}b{% else %}{{ m['x'] | upper }}{% endif %}{% endfor %}{{ 1 + 2 }}")
    assert run({"ms": [{"x": "q"}, {"x": "b"}, {"x": "c", "y": 1}]}) == ("<bC3", [])
    tree = fold(parse("a{% if 'x' == 'x' %}{{ 'b' | upper }}{% else %}{{ name }}{% endif %}c"), {"upper": str.upper})
    assert tree == Node("block", None, (Node("write", None, (Node("constant", "aBc"),)),))
    assert compile_template("{{ b.c }}{{ 'x' if a.__class__ }}")({"a": "x", "b": {"c": None}}) == ("", [])


def test_tags_as_in_common_templates():
    def run(source, **given):
        return compile_template(source)(given)[0]
    assert run("a {%- if true -%} b {%- endif %} c") == "ab c"
    assert run("x{# no {{ y }} #}z {{- 'q' -}}  w") == "xzqw"
    assert run("{% for m in ms %}{{ loop.index0 }}{{ m[0] }}{{ ',' if not loop.last }}{% endfor %}", ms=[["a"], ["b"]]) == "0a,1b"
    assert run("{% set x = 'a' + 'b' %}{{ x }}{{ 'y' if z is defined else 'n' }}{{ 'k' if x is not defined else 'l' }}") == "abnl"
    assert run("{{ '%}' + \"}}\" }}") == "%}}}"
    assert run("{% if no %}x{% endif %}{{ 1 if no == 'a' else 2 }}") == "2"


@pytest.mark.parametrize("source", ["{{ y }}", "{{ m.k }}", "{{ m[3] }}", "{{ m.__class__ }}", "{{ y | upper }}", "{{ y + 'a' }}", "{% for a in y %}{% endfor %}", "{{ y.z }}"])
def test_what_is_not_there_is_not_written(source):
    with pytest.raises(TemplateError):
        compile_template(source)({"m": {"a": 1}})


@pytest.mark.parametrize("source", ["{% for x %}", "{% if a %}", "{% endif %}", "{{ }}", "{{ a | nope }}", "{{ a b }}", "{{ f(1) }}", "{% generation %}x"])
def test_bad_templates(source):
    with pytest.raises(TemplateError):
        compile_template(source)
