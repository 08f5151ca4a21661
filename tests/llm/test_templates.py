import hashlib

import pytest

from tidemark.llm.templates import CHAT, Reader, TemplateError, compiled, conversation_digests, escape, format_conversations, parse, unescape


def text_of(source, messages=()):
    return "".join(t for t, _ in compiled(source)(messages))


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|end|>\n", "</s>[INST] ok [/INST]", "a < b | c", "[\\INST] [\\\\INST]", "<s><|user|>\n", "\\<|\\", "<<||>>", "<|>", "[|>", "a|>\nb", "|\\>|\\\\>", "||>", "<\\|\\>", "<|\\>"])
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"))


def test_language():
    assert text_of("a{{ 'b' + \"c\" | upper }}{# no #}{% if 1 == 2 %}x{% elif not false %}y{% else %}z{% endif %}") == "abCy"
    assert text_of("{% set q = 'k' %}{% for m in messages %}{{ m[q] }}{{ m.none }}{% endfor %}", [{"k": 1}, {"k": 2}]) == "12"


def test_constants_fold():
    assert parse("{% if 'a' == 'a' %}{{ 'x' + 'y' | upper }}{% else %}{{ nothing }}{% endif %}z") == ("block", [("out", ("const", "xYz"))])


@pytest.mark.parametrize("source", ["{% for x in %}", "{% if a %}", "{{ a b }}", "{{ a | system }}", "{% endfor %}", "{{ __import__('os') }}", "{{ 'a }}"])
def test_refuses(source):
    with pytest.raises(TemplateError):
        text_of(source)


def test_sandbox():
    with pytest.raises(TemplateError):
        text_of("{{ messages.__class__ }}")


def test_digests(spark):
    rows = [(1, 1, "assistant", "b<|end|>\n"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", "é\n<|user|>\n"), (2, 0, "assistant", "é\n<|user|>\n"), (None, None, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: r for r in conversation_digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\nb<|end|>\n\n\n\n") and got[1]["n_turns"] == 3
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (9, sha("b<|end|>\n"))
    assert (got[2]["n_turns"], got[2]["loss_sha256"]) == (2, sha("é\n<|user|>\n" * 2))
    assert (got[None]["loss_chars"], got[None]["loss_sha256"]) == (0, sha(""))
    full = {r["conv_id"]: r for r in format_conversations(df).collect()}
    for key, r in full.items():
        assert len(r["formatted"]) == got[key]["formatted_chars"]
        cut = [unescape(r["formatted"][a:b]) for a, b in zip(r["loss_spans"][::2], r["loss_spans"][1::2], strict=True)]
        assert sha("".join(cut)) == got[key]["loss_sha256"]


@pytest.mark.parametrize("role", ["", "|", "a|", "<", "<|", ">", "|>", "a|>\nb", "<|>\n", "a|\\>\nb", "|>\nx<|end|>\n", "assistant|>\n", "\\"])
def test_any_role_reads_back(role):
    turns = [{"role": role, "text": "t|>\n"}, {"role": "assistant", "text": role}]
    reader = Reader()
    for piece, loss in compiled(CHAT)(turns):
        reader.feed(piece, loss)
    n, turns_sha, chars, loss_sha, _ = reader.close()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (n, turns_sha) == (2, sha(f"{role}\nt|>\n\nassistant\n{role}\n"))
    assert (chars, loss_sha) == (len(role), sha(role))


def test_strings_hold_tags():
    assert text_of("{{ '}}' }}{{ \"%}\" }}{% if '%}' == '%}' %}a{% endif %}{{ '\\'}}' }}") == "}}%}a'}}"


@pytest.mark.parametrize("items", ["5", "'abc'", "none", "true"])
def test_loops_over_lists_only(items):
    with pytest.raises(TemplateError):
        text_of("{% for x in " + items + " %}{{ x }}{% endfor %}")


def test_reader_pieces():
    r = Reader()
    for c in "<|user|>\nhello<|end|>\n":
        r.feed(c, False)
    assert r.close()[:1] == (1,)
    assert CHAT


def test_empty(spark):
    assert conversation_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_values_that_do_not_go_together():
    for source in ("{{ 'a' + 1 }}", "{{ 1 | upper }}"):
        with pytest.raises(TemplateError):
            text_of(source)
    with pytest.raises(TemplateError):
        text_of("{% for m in messages %}{{ m.k + 'a' }}{% endfor %}", [{"k": 1}])
