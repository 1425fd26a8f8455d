import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import chat, templates
from caseflow.llm.templates import TemplateError, compile_template

HOSTILE = st.text(alphabet="<|\\im_startend>\nnassistant ok", max_size=40) | st.text(max_size=20)


@given(HOSTILE)
@settings(max_examples=500, deadline=None)
def test_escapes_are_reversible_and_leave_no_mark(text):
    assert templates.unescape(templates.escape(text)) == text
    assert "<|" not in templates.escape(text)
    line = templates.header(text)
    assert templates.unheader(line) == text and "\n" not in line and "<|" not in line


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]) | HOSTILE, HOSTILE), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_output_reads_back(turns):
    template = compile_template(chat.TEMPLATE, start=chat.START, end=chat.END)
    pieces = [
        template.message({"role": role, "text": text}, i, i + 1 == len(turns)) for i, (role, text) in enumerate(turns)
    ]
    assert chat.read_turns("".join(p for p, _ in pieces)) == turns
    for (role, text), (piece, spans) in zip(turns, pieces, strict=True):
        assert [templates.unescape(piece[a:b]) for a, b in spans] == ([text] if role == "assistant" else [])


def rendered(source, turns, **constants):
    template = compile_template(source, **constants)
    found = [template.message({"role": r, "text": t}, i, i + 1 == len(turns)) for i, (r, t) in enumerate(turns)]
    return "".join(p for p, _ in found), [s for _, s in found]


TURNS = [("system", "be"), ("user", " hi "), ("assistant", "yo")]


def test_statements_and_expressions():
    source = """{# a comment #}{% set open = '[' ~ tag ~ ']' -%}
    {% for m in messages -%}
      {{ open if loop.first else '' }}{% if m.role == 'system' %}S{% elif m['role'] != 'user' and not loop.last %}?{% else %}{{ m.role | upper }}{% endif -%}
      {% set t = m.text | trim %}{{ loop.index ~ ':' }}{% generation %}{{ t + '.' }}{% endgeneration %}
    {%- endfor %}{{ 1 + 2 }}"""
    text, spans = rendered(source, TURNS, tag="x")
    assert text == "[x]S1:be.USER2:hi.ASSISTANT3:yo.3"
    assert spans == [[(6, 9)], [(6, 9)], [(11, 14)]]


def test_names_set_in_branches():
    source = "{% set a = 'x' %}{% for m in messages %}{% if m.role == 'user' %}{% set a = m.text %}{% endif %}({{ a }}){% endfor %}"
    assert rendered(source, TURNS)[0] == "(x)( hi )(x)"
    source = "{% for m in messages %}{% set a = 'p' %}{{ a }}{% set a = m.role %}{{ a }}{% endfor %}"
    assert rendered(source, TURNS[:1])[0] == "psystem"


def test_and_or_in():
    source = "{% for m in messages %}{{ (m.text in 'be yo' and 'in') or 'out' }} {{ 'y' not in m.text }} {% endfor %}"
    assert rendered(source, TURNS)[0] == "in True out True in False "


def test_constants_are_folded():
    template = compile_template(
        "{% for m in messages %}{% if debug %}{{ m.role }}{% else %}{{ '<' ~ mark ~ '>' }}{{ '!' }}{% endif %}{{ mark | upper }}{{ m.text ~ 'a' ~ 'b' }}{% endfor %}end",
        debug=False,
        mark="x",
    )
    assert template.after == "end" and template.before == ""
    assert template.tree == (
        templates.Output(templates.Const("<x>!X")),
        templates.Output(templates.Binary("~", templates.Field("m", "text"), templates.Const("ab"))),
    )


@pytest.mark.parametrize(
    "source",
    [
        "no loop",
        "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}",
        "{% for m in others %}{% endfor %}",
        "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}",
        "{% if true %}{% for m in messages %}{% endfor %}{% endif %}",
        "{% for m in messages %}{{ m.__class__ }}{% endfor %}",
        "{% for m in messages %}{{ m }}{% endfor %}",
        "{% for m in messages %}{{ unknown }}{% endfor %}",
        "{% for m in messages %}{{ loop.length }}{% endfor %}",
        "{% for m in messages %}{{ m.text | eval }}{% endfor %}",
        "{% for m in messages %}{{ m.text() }}{% endfor %}",
        "{% for m in messages %}{{ 1 + 'a' }}{% endfor %}",
        "{% for m in messages %}{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}{% endfor %}",
        "{% generation %}a{% endgeneration %}{% for m in messages %}{% endfor %}",
        "{% for m in messages %}{% if m.role %}{% endfor %}",
        "{% for m in messages %}{% if m.role %}{% set a = m.role %}{% endif %}{{ a }}{% endfor %}",
        "{% for m in messages %}",
        "{% import os %}{% for m in messages %}{% endfor %}",
        "{% for m in messages %}{{ 'open }}{% endfor %}",
        "{% for loop in messages %}{% endfor %}",
    ],
)
def test_what_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def conversation_rows():
    r = random.Random(8)
    marks = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "\n", "é漢🙂", "word ", "<", "|", "\\"]
    rows = []
    for conv in [*range(12), None]:
        for turn in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant", "assistant", "system", None, "odd\nrole<|\\"])
            rows.append((conv, turn, role, r.choice([None, "", "".join(r.choice(marks) for _ in range(30))])))
    rows += [(50, i, "assistant" if i % 2 else "user", f"t{i} <|") for i in range(300)]  # many slices
    rows += [(51, None, "user", "last"), (51, 3, "user", "b"), (51, 3, "user", "a"), (51, 3, "user", "a"), (51, -7, "assistant", "first")]
    rows += [(52, 0, "assistant", "x" * 3_000_000)]
    return rows


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        turns = [(role, text) for _, _, role, text in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(
            chat.START + templates.header(r) + "\n" + templates.escape(t) + chat.END + "\n" for r, t in turns
        )
        out[conv] = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
            len(whole),
        )
    return out


def test_conversations_come_back(spark):
    rows = conversation_rows()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, position int")
    pieces = chat.format_turns(turns.repartition(5), slice_turns=7)
    found = chat.digests(chat.read_back(pieces)).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == brute(rows)
    assert len(found) == len({r[0] for r in rows})


def test_pieces_joined_are_the_formatted_text(spark):
    source = "<s>{% for m in messages %}{{ loop.index0 }}{{ m.role }}={{ m.text }};{% if loop.last %}end{% endif %}{% endfor %}</s>"
    turns = spark.createDataFrame([("c", i, "r", str(i)) for i in range(40)], "conv_id string, turn long, role string, text string")
    pieces = chat.format_turns(turns, source, slice_turns=4).orderBy("position").collect()
    assert "".join(p["piece"] for p in pieces) == "<s>" + "".join(f"{i}r={i};" for i in range(40)) + "end</s>"
    assert [p["position"] for p in pieces] == list(range(40))


def test_empty_table_and_faulty_template(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.read_back(chat.format_turns(turns))).count() == 0
    with pytest.raises(TemplateError):
        chat.format_turns(turns, "{{ x }}")


def test_foreign_output_is_refused():
    with pytest.raises(ValueError):
        chat.read_turns("<|im_start|>user\nhi")
