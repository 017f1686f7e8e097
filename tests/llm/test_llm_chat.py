import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from caserank.llm import chat

ODD = st.text(alphabet=st.sampled_from("ab<|>\\end/s[INST] \nassistant"), max_size=30)


@given(ODD)
def test_escape_round_trip(t):
    assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t) and "|>" not in chat.escape(t)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), ODD), ODD), max_size=6))
def test_turns_are_read_back(turns):
    messages = [{"role": r, "text": t} for r, t in turns]
    pieces = list(chat.TEMPLATE.pieces(iter(messages)))
    assert [chat.read_back(p) for p, _ in pieces] == turns
    text, spans = chat.TEMPLATE.render(messages)
    assert text == "".join(p for p, _ in pieces)
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


def test_language():
    run = lambda s, **m: chat.Template(s).render(m.get("m", []))[0]
    ms = [{"role": "user", "text": " Hi "}, {"role": "x", "text": None}]
    assert run("{% for m in messages %}{{ loop.index }}{% if loop.last %}!{% elif loop.first %}?{% else %}-{% endif %}{% endfor %}", m=ms * 2) == "1?2-3-4!"
    assert run("{% for m in messages %}{{ m['text'] | trim | upper }}{% endfor %}{# note #}.", m=ms) == "HI."
    assert run("{% set a = 'x' + 1 %}{{ a }}{{ a == 'x1' and not false or none }}") == "x1True"
    assert run("{{ 'ab' in 'cabd' }}{{ 1 + 2 }}{{ m.nothing }}{{ '\\n' }}") == "True3\n"


def test_constants_are_folded():
    t = chat.Template("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}no{% else %}d{% endif %}{% if true and x %}e{% endif %}")
    assert t.tree[0] == chat.Output(chat.Const("abCd")) and len(t.tree) == 2 and t.tree[1].branches[0][0] == chat.Name("x")


@pytest.mark.parametrize("bad", ["{{ m.__class__ }}", "{{ m['_x'] }}", "{{ f(1) }}", "{% import os %}", "{% if x %}", "{{ 'a' | eval }}", "{% endfor %}", "{{ }}", "{{ a ; b }}"])
def test_sandbox_and_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_objects_are_closed():
    assert chat.Template("{{ messages.append }}").render([1])[0] == ""


def _digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    by[-7] = [("user", said), ("assistant", said)]
    got = {r.conv_id: r for r in chat.query(spark, sf).collect()}
    assert got.keys() == by.keys()
    for k, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (
            len(turns), _digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k].formatted_chars == len(chat.TEMPLATE.render([{"role": r, "text": t} for r, t in turns])[0])


def test_edge_rows(spark):
    rows = [(1, 0, None, None, 5), (1, 1, "assistant", "a<|end|>\nb", 5), (1, 1, "assistant", "a<|end|>\nb", 5), (None, None, "user", "", 5), (2, 0, "user", "x" * 300_000 + "|", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, part int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 20 and got[1].turns_sha256 == _digest([("", ""), ("assistant", "a<|end|>\nb"), ("assistant", "a<|end|>\nb")])
    assert got[None].n_turns == 1 and got[2].turns_sha256 == _digest([("user", "x" * 300_000 + "|")])
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_values_without_an_order_are_refused():
    import pytest

    from caserank.llm import chat

    assert chat._OPS["<"](1, 2) and chat._OPS[">"]("b", "a") and not chat._OPS["<"]("a", "a")
    for a, b in ((1, "1"), ("x", None), (None, 2), (None, None)):
        for op in "<>":
            with pytest.raises(chat.TemplateError):
                chat._OPS[op](a, b)
