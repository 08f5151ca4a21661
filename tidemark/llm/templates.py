"""Operator 6: chat formatting by a small template language.

A template is parsed to a syntax tree, constants are folded, and each node becomes a Python closure that yields pieces of
text with a flag, whether they lie in a generation block. There are no calls, imports or attributes of Python objects:
a name is a loop variable or an input, and `a.b` reads a field of a mapping.

    {{ expr }}   {% for x in xs %} ... {% endfor %}   {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set x = expr %}   {% generation %} ... {% endgeneration %}   {# note #}

Expressions: strings, numbers, true, false, none, names, fields, + == != and or not, parentheses, and the filters escape,
trim, upper, lower and length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import deploy, partitions

CHAT = (
    "{% for m in messages %}<|{{ m.role | escape }}|>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"
)
#: Control strings without their first characters, < or [; |> ends a role. Strings may share a character, as in <|>.
_TAILS = r"(?=\||/s>|s>|INST\]|/INST\])"
_ESCAPE = re.compile(rf"([<\[])(\\*){_TAILS}|(\|)(\\*)(?=>)")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*){_TAILS}|(\|)\\(\\*)(?=>)")


def escape(text: str) -> str:
    """Puts a backslash into each control string, and one more into each that has some already."""
    return _ESCAPE.sub(r"\1\2\3\4\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3\4", text)


FILTERS: dict[str, Callable] = {"escape": lambda x: escape(str(x)), "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}
_WORD = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+|.()\[\],=]))")
_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_PART = re.compile(rf"(\{{\{{(?:{_STRING}|.)*?\}}\}}|\{{%(?:{_STRING}|.)*?%\}}|\{{#.*?#\}})", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.words, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _WORD.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at : at + 20]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] != "str" else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.words) or (want and self.peek() != want):
            raise TemplateError(f"expected {want or 'more'}")
        self.at += 1
        return self.words[self.at - 1]

    def whole(self):
        node = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.peek() == "or":
            self.take()
            node = fold(("or", node, self.both()))
        return node

    def both(self):
        node = self.negated()
        while self.peek() == "and":
            self.take()
            node = fold(("and", node, self.negated()))
        return node

    def negated(self):
        if self.peek() == "not":
            self.take()
            return fold(("not", self.negated()))
        node = self.sum()
        while self.peek() in ("==", "!="):
            kind = self.take()[1]
            node = fold((kind, node, self.sum()))
        return node

    def sum(self):
        node = self.filtered()
        while self.peek() == "+":
            self.take()
            node = fold(("+", node, self.filtered()))
        return node

    def filtered(self):
        node = self.field()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = fold(("filter", node, name))
        return node

    def field(self):
        kind, value = self.take()
        if kind == "str":
            node = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "num":
            node = ("const", float(value) if "." in value else int(value))
        elif value == "(":
            node = self.either()
            self.take(")")
        elif value in ("true", "false", "none"):
            node = ("const", {"true": True, "false": False, "none": None}[value])
        elif kind == "name":
            node = ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                node = ("get", node, ("const", self.take()[1]))
            else:
                node = ("get", node, self.either())
                self.take("]")
        return node


def fold(node):
    """Computes an operation whose operands are constants."""
    if all(isinstance(x, str) or x[0] == "const" for x in node[1:]):
        return ("const", expression(node)({}))
    return node


def expression(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":

        def read(env, name=node[1]):
            if name not in env:
                raise TemplateError(f"no value for {name!r}")
            return env[name]

        return read
    if kind == "get":
        of, key = expression(node[1]), expression(node[2])

        def look(env):
            box = of(env)
            if not isinstance(box, dict):
                raise TemplateError("only fields of mappings can be read")
            return box.get(key(env), "")

        return look
    if kind == "filter":
        return _typed(lambda env, f=FILTERS[node[2]], x=expression(node[1]): f(x(env)))
    x = expression(node[1])
    if kind == "not":
        return lambda env: not x(env)
    y = expression(node[2])
    if kind == "and":
        return lambda env: x(env) and y(env)
    if kind == "or":
        return lambda env: x(env) or y(env)
    if kind == "==":
        return lambda env: x(env) == y(env)
    if kind == "!=":
        return lambda env: x(env) != y(env)
    return _typed(lambda env: x(env) + y(env))


def _typed(f: Callable[[dict], object]) -> Callable[[dict], object]:
    """Values that do not go together are the template's fault."""

    def run(env):
        try:
            return f(env)
        except (TypeError, AttributeError) as e:
            raise TemplateError(str(e)) from e

    return run


def parse(source: str) -> tuple:
    """The syntax tree: ("block", nodes), with adjacent constant texts merged."""
    stack: list[tuple[str, list, list]] = [("", [], [])]
    for part in _PART.split(source):
        here = stack[-1][1]
        if part.startswith("{#") or not part:
            continue
        if part.startswith("{{"):
            here.append(("out", _Expression(part[2:-2]).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                if not (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                    raise TemplateError("for x in xs")
                stack.append(("for", [], [m[1], _Expression(m[2]).whole()]))
            elif word in ("if", "generation"):
                stack.append((word, [], [_Expression(rest).whole()] if word == "if" else []))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                kind, body, about = stack.pop()
                stack.append((kind, [], [*about, body, _Expression(rest).whole() if word == "elif" else ("const", True)]))
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq or not name.strip().isidentifier():
                    raise TemplateError("set x = value")
                here.append(("set", name.strip(), _Expression(value).whole()))
            elif word.startswith("end") and len(stack) > 1 and stack[-1][0] == word[3:]:
                kind, body, about = stack.pop()
                stack[-1][1].append({"for": lambda: ("for", *about, _merge(body)), "generation": lambda: ("generation", _merge(body)), "if": lambda: _branch([*about, body])}[kind]())
            else:
                raise TemplateError(f"unexpected {word!r}")
        else:
            here.append(("out", ("const", part)))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} has no end")
    return _merge(stack[0][1])


def _branch(parts: list) -> tuple:
    """(if, [(condition, block)]) without branches that constants rule out."""
    out = []
    for cond, body in zip(parts[::2], parts[1::2], strict=True):
        if cond[0] == "const" and not cond[1]:
            continue
        out.append((cond, _merge(body)))
        if cond[0] == "const":
            break
    return out[0][1] if out and out[0][0][0] == "const" else ("if", out)


def _merge(nodes: list) -> tuple:
    out: list = []
    for x in nodes:
        if x[0] == "block":
            out += x[1]
        elif x[0] == "out" and x[1][0] == "const" and out and out[-1][0] == "out" and out[-1][1][0] == "const":
            out[-1] = ("out", ("const", str(out[-1][1][1]) + str(x[1][1])))
        else:
            out.append(x)
    return ("block", out)


def _closure(node, loss: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    kind = node[0]
    if kind == "block":
        steps = [_closure(x, loss) for x in node[1]]

        def block(env):
            for s in steps:
                yield from s(env)

        return block
    if kind == "out":
        value = expression(node[1])

        def out(env):
            yield str(value(env)), loss

        return out
    if kind == "set":
        value = expression(node[2])

        def put(env):
            env[node[1]] = value(env)
            return
            yield

        return put
    if kind == "for":
        items, body = expression(node[2]), _closure(node[3], loss)

        def loop(env):
            of = items(env)
            if isinstance(of, str) or not isinstance(of, Iterable):
                raise TemplateError(f"cannot go over {of!r}")
            for x in of:
                yield from body({**env, node[1]: x})

        return loop
    if kind == "generation":
        return _closure(node[1], True)
    ways = [(expression(c), _closure(b, loss)) for c, b in node[1]]

    def choose(env):
        for cond, body in ways:
            if cond(env):
                yield from body(env)
                return

    return choose


def compiled(source: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages, which may be a stream, to pieces of (text, under the loss mask)."""
    run = _closure(parse(source), False)
    return lambda messages: run({"messages": messages})


class Reader:
    """Reads the output of CHAT back, piece by piece, and holds no more than a turn of it."""

    TURN = re.compile(r"<\|((?:(?!\|>\n).)*)\|>\n(.*?)<\|end\|>\n", re.S)

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.rest: list[str] = []
        self.span: list[str] = []

    def feed(self, text: str, loss: bool) -> None:
        self.formatted_chars += len(text)
        self.rest.append(text)
        if loss:
            self.span.append(text)
        elif self.span:
            self._close_span()
        if text.endswith("<|end|>\n") or "<|end|>\n" in text:
            self._take()

    def _take(self) -> None:
        whole, at = "".join(self.rest), 0
        while m := self.TURN.match(whole, at):
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            self.n_turns, at = self.n_turns + 1, m.end()
        self.rest = [whole[at:]]

    def _close_span(self) -> None:
        text = unescape("".join(self.span))
        self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(text)
        self.span = []

    def close(self) -> tuple[int, str, int, str, int]:
        self._close_span()
        self._take()
        if "".join(self.rest):
            raise TemplateError("text after the last turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of rows that come in their order; each one's messages are a stream."""
    rows = _rows(batches)
    held = next(rows, None)
    while held is not None:
        conv = held[0]

        def messages():
            nonlocal held
            while held is not None and held[0] == conv:  # noqa: B023
                now, held = held, next(rows, None)
                yield {"role": now[2] or "", "text": now[3] or ""}

        yield conv, messages()


def _digest(source: str):
    def run(batches):
        render, out = compiled(source), []
        for conv, messages in _conversations(batches):
            reader = Reader()
            for text, loss in render(messages):
                reader.feed(text, loss)
            out.append((conv, *reader.close()))
            if len(out) >= 5000:
                yield _record(out)
                out = []
        yield _record(out)

    return run


def _record(rows: list[tuple]) -> pa.RecordBatch:
    types = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], names=list(types))


def _format(source: str):
    def run(batches):
        render = compiled(source)
        for conv, messages in _conversations(batches):
            parts, spans, at = [], [], 0
            for text, loss in render(messages):
                if loss and text:
                    if spans and spans[-1] == at:
                        spans[-1] = at + len(text)
                    else:
                        spans += [at, at + len(text)]
                parts.append(text)
                at += len(text)
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([spans], pa.list_(pa.int64()))], names=["conv_id", "formatted", "loss_spans"])

    return run


def _in_order(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """conv_id, formatted and loss_spans (start, stop, ... in code points of `formatted`) of each conversation.

    Turns come by turn, then role and text; null roles and texts are empty, rows of null conv_id are one conversation,
    repeated rows are repeated turns, and an empty table gives no rows. A conversation's output is one value, so it must
    fit a task; conversation_digests() has no such bound."""
    parse(template)
    deploy(conversations.sparkSession)
    return _in_order(conversations).mapInArrow(_format(template), "conv_id bigint, formatted string, loss_spans array<bigint>")


def conversation_digests(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """Renders each conversation, reads the output back and returns counts and digests of what was read.

    Turns stream through rendering and reading, so a conversation of any length takes the memory of a turn."""
    parse(template)
    deploy(conversations.sparkSession)
    return _in_order(conversations).mapInArrow(_digest(template), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


PROBE = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return conversation_digests(rows.unionByName(extra))


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), wide AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '[<\[]\\*(\||/s>|s>|INST\]|/INST\])')) + len(regexp_extract_all(role, '\|\\*>')) AS role_chars,
            length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/s>|s>|INST\]|/INST\])')) + len(regexp_extract_all(text, '\|\\*>')) AS text_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(role_chars + text_chars + 13) AS BIGINT) AS formatted_chars
FROM wide GROUP BY conv_id
"""
