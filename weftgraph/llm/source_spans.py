"""Spans of functions, documentation comments and other code in one source text.

Small helpers that run inside an Arrow task, one text at a time. They work on tokens, not on a
syntax tree, so that a text which a parser rejects still gives the spans that are readable in it.
Each span is (at, kind, name, line, end_line, text); kinds are ``function``, ``doc`` and ``code``,
where ``code`` stands once for a whole run of other tokens. Positions are such that the
documentation of a function is the span just before it in the order of ``at``: Python, whose
docstrings follow the header, gets negative positions.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple


class Span(NamedTuple):
    at: int
    kind: str
    name: str | None
    line: int
    end_line: int
    text: str | None


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


_LINE_END = re.compile(r"\r\n|\r|\n")

# Blanks before a token are part of its match. Names that operators join are one token, as only their being code matters.
_PY_TOKEN = re.compile(
    r"""[ \t\f﻿]*(?:(?P<comment>\#[^\r\n]*)
    |(?P<string>(?:\b[rRbBuUfFtT]{1,2})?(?:\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|"(?:\\(?:\r\n|.)|[^"\\\r\n])*"|'(?:\\(?:\r\n|.)|[^'\\\r\n])*'))
    |(?P<name>[^\W\d]\w*(?:[ \t]*[.,=+*/%<>|&^~-]+[ \t]*[^\W\d]\w*(?![\w"']))*)
    |(?P<joined>\\(?:\r\n|\r|\n))
    |(?P<newline>\r\n|\r|\n)
    |(?P<op>->|:=|[\w.,=+*/%<>|&^~-]+|.))""",
    re.X | re.S,
)

_JS_TOKEN = re.compile(
    r"""[\s﻿]*(?:(?P<comment>//[^\r\n]*|/\*(?:.*?\*/|.*\Z))
    |(?P<string>"(?:\\(?:\r\n|.)|[^"\\\r\n])*"|'(?:\\(?:\r\n|.)|[^'\\\r\n])*')
    |(?P<name>\#?[^\W\d][\w$]*|\#?\$[\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<op>=>|\?\.|\.\.\.|[=!]==?|&&|\|\||\?\?|\+\+|--|.))""",
    re.X | re.S,
)
_JS_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?P<stop>`|\$\{|\Z)", re.S)
_JS_REGEX = re.compile(r"/(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n*])(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])*/[a-z]*")

_OPEN, _CLOSE = set("([{"), set(")]}")


class Lines:
    """Line numbers, from 1, of positions in a text with any mix of line ends."""

    def __init__(self, text: str) -> None:
        self.ends = [m.end() for m in _LINE_END.finditer(text)]

    def __call__(self, at: int) -> int:
        return bisect.bisect_right(self.ends, at) + 1


def python_spans(text: str) -> list[Span]:
    """Spans of a Python text. Functions lie at the end of their header, docstrings at their start."""
    tokens = [Token(kind, m[kind], m.start(kind), m.end()) for m in _PY_TOKEN.finditer(text) if (kind := m.lastgroup) not in ("comment", "joined")]
    line, spans, n = Lines(text), [], len(tokens)

    def starts_line(i: int) -> bool:
        return i == 0 or tokens[i - 1].kind == "newline"

    def statement_end(i: int) -> int:
        """The token that ends the statement at ``i``: its line end or semicolon, or a line that can only begin anew."""
        depth, first = 0, i
        while i < n:
            t = tokens[i]
            if t.text in _OPEN:
                depth += 1
            elif t.text in _CLOSE:
                depth = max(0, depth - 1)
            elif depth == 0 and (t.kind == "newline" or t.text == ";"):
                return i
            elif i > first and t.text in ("def", "class", "async") and starts_line(i):
                return i
            i += 1
        return n

    def header_end(i: int) -> int | None:
        """The colon that ends the header whose name is at ``i``."""
        depth = 0
        while i < n:
            t = tokens[i]
            if t.text in _OPEN:
                depth += 1
            elif t.text in _CLOSE:
                depth -= 1
            elif t.text == ":" and depth == 0:
                return i
            elif depth == 0 and t.kind == "newline" or t.text in ("def", "class") and starts_line(i):
                return None
            i += 1
        return None

    def code(at: int) -> None:
        if not spans or spans[-1].kind != "code":
            spans.append(Span(-at, "code", None, line(at), line(at), None))

    i = 0
    while i < n:
        t = tokens[i]
        if t.kind == "newline" or t.text == ";":
            i += 1
            continue
        if t.text == "@":
            i = statement_end(i)
            continue
        j = i + 1 if t.text == "async" and i + 1 < n and tokens[i + 1].text == "def" else i
        if tokens[j].text == "def" and j + 2 < n and tokens[j + 1].kind == "name" and tokens[j + 2].text in ("(", "["):
            colon = header_end(j + 2)
            if colon is not None:
                at = tokens[colon].end
                signature = re.sub(r"\s+", " ", text[tokens[j + 1].start : tokens[colon].start])
                spans.append(Span(-at, "function", tokens[j + 1].text, line(tokens[j].start), line(at - 1), signature))
                i = colon + 1
                continue
        end = statement_end(i)
        if end == i:  # a line that begins anew but is no function
            end = i + 1
        literals = tokens[i:end]
        if all(x.kind == "string" and _is_text(x.text) for x in literals):
            words = " ".join(map(_literal, (x.text for x in literals)))
            spans.append(Span(-t.start, "doc", None, line(t.start), line(literals[-1].end - 1), words))
        else:
            code(t.start)
            colon = next((k for k in range(i, end) if tokens[k].text == ":"), None)
            if t.text == "class" and colon is not None:
                end = colon + 1
        i = end
    return spans


def _is_text(literal: str) -> bool:
    return literal[0] in "\"'rRuU" and literal[:2].lower() not in ("rb", "rf", "rt")


def _literal(literal: str) -> str:
    try:
        return str(ast.literal_eval(literal))
    except (ValueError, SyntaxError, MemoryError):
        return re.sub(r"^[rRuU]?(\"{3}|'{3}|\"|')(.*)\1$", r"\2", literal, flags=re.S)


def _js_tokens(text: str) -> Iterator[Token]:
    """Tokens of a JavaScript or TypeScript text, white space left out; templates come as strings."""
    at, braces, before, end = 0, [], None, len(text)
    while at < end and (m := _JS_TOKEN.match(text, at)):
        kind = m.lastgroup
        token = Token(kind, m[kind], m.start(kind), m.end())
        at = token.end
        if kind == "op":
            mark = token.text
            if mark == "/" and _regex_may_follow(before) and (r := _JS_REGEX.match(text, token.start)):
                token = Token("string", r.group(), token.start, r.end())
            elif mark == "`" or mark == "}" and braces and braces[-1] == "template":
                if mark == "}":
                    braces.pop()
                r = _JS_TEMPLATE.match(text, at)
                if r["stop"] == "${":
                    braces.append("template")
                token = Token("string", text[token.start : r.end()], token.start, r.end())
            elif mark == "{":
                braces.append("plain")
            elif mark == "}" and braces:
                braces.pop()
            at = token.end
        yield token
        if kind != "comment":
            before = token


def _regex_may_follow(before: Token | None) -> bool:
    if before is None:
        return True
    if before.kind == "name":
        return before.text in ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield")
    return before.kind == "op" and before.text not in (")", "]", "}", "++", "--")


_MODIFIERS = {"export", "default", "async", "declare", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "accessor", "*"}
#: Words before ``(`` that begin statements and never name a method.
_NO_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "with", "super", "import", "await", "typeof", "new", "else", "do", "throw", "yield", "delete", "void", "case"}


def javascript_spans(text: str) -> list[Span]:
    """Spans of a JavaScript or TypeScript text. Functions lie at their first modifier or decorator, comments at their end."""
    every = list(_js_tokens(text))
    line, tokens = Lines(text), [t for t in every if t.kind != "comment"]
    n = len(tokens)
    closer, angle = _closers(tokens)
    opener = {b: a for a, b in closer.items()}

    def skip_generics(i: int) -> int:
        return angle.get(i, i - 1) + 1

    def skip_type(i: int, stop: str) -> int | None:
        """Past a type annotation at ``i``, if there is one, to the token ``stop``."""
        if i < n and tokens[i].text == ":":
            i += 1
            while i < n and (tokens[i].text != stop or stop == "{" and tokens[i - 1].text in (":", "|", "&", "<", ",")):
                if tokens[i].text in (";", "=", ")") or tokens[i].text == "}":
                    return None
                i = closer.get(i, i) + 1
        return i if i < n and tokens[i].text == stop else None

    def is_function(i: int) -> bool:
        """Does a function expression begin at ``i``?"""
        if i < n and tokens[i].text == "async":
            i += 1
        if i >= n:
            return False
        if tokens[i].text == "function":
            return True
        i = skip_generics(i)
        if i >= n:
            return False
        if tokens[i].text == "(" and i in closer:
            return skip_type(closer[i] + 1, "=>") is not None
        return tokens[i].kind == "name" and i + 1 < n and tokens[i + 1].text == "=>"

    def member(i: int) -> bool:
        """Is ``i`` the name of a method, that is, followed by parameters and a body?"""
        k = skip_generics(i + 1)
        return k < n and tokens[k].text == "(" and k in closer and skip_type(closer[k] + 1, "{") is not None

    def top(i: int, low: int) -> int:
        """The first modifier or decorator that belongs to the declaration at ``i``."""
        while i > low and tokens[i - 1].text in _MODIFIERS:
            i -= 1
        while True:
            k = i - 1
            if k >= low and tokens[k].text == ")":
                k = opener.get(k, 0) - 1
            while k - 1 >= low and tokens[k].kind == "name" and tokens[k - 1].text == ".":
                k -= 2
            if k - 1 >= low and tokens[k].kind == "name" and tokens[k - 1].text == "@":
                i = k - 1
                while i > low and tokens[i - 1].text in _MODIFIERS:
                    i -= 1
            else:
                return i

    found: dict[int, tuple[str, int, int]] = {}  # first token -> name, token of the line, last token of the declaration's run
    blocks: list[str] = []
    next_block, low = "", 0
    for i, t in enumerate(tokens):
        before = tokens[i - 1].text if i else ""
        if t.text == "{":
            blocks.append(next_block or ("object" if before in ("=", "(", ",", "[", "return", "?", "||", "&&", "??") or before == ":" else "block"))
            next_block = ""
            low = i + 1
        elif t.text == "}":
            if blocks:
                blocks.pop()
            low = i + 1
        elif t.text in (";",):
            low = i + 1
        elif t.kind == "name" and before not in (".", "?."):
            here = blocks[-1] if blocks else "block"
            if t.text == "class" and i + 1 < n and (tokens[i + 1].kind == "name" or tokens[i + 1].text == "{"):
                next_block = "class"
            elif t.text == "function" and i + 1 < n:
                k = i + 2 if tokens[i + 1].text == "*" else i + 1
                if k + 1 < n and tokens[k].kind == "name" and tokens[k + 1].text in ("(", "<"):
                    start = top(i, low)
                    if start == 0 or tokens[start - 1].text != "=":
                        found[start] = (tokens[k].text, i, k)
            elif t.text in ("const", "let", "var") and i + 2 < n and tokens[i + 1].kind == "name" and here != "class":
                k = i + 2
                if tokens[k].text == ":":
                    k = skip_type(k, "=") or k
                if k < n and tokens[k].text == "=" and is_function(k + 1):
                    found[top(i, low)] = (tokens[i + 1].text, i, i + 1)
            elif here == "class" and t.text not in _NO_NAMES and (i == low or before in _MODIFIERS or before in (")", "}") or tokens[i - 1].kind == "name" or tokens[i - 1].end < t.start):
                if member(i) or i + 1 < n and tokens[i + 1].text == "=" and is_function(i + 2):
                    found[top(i, low)] = (t.text, i, i)
            elif here == "object" and t.text not in _NO_NAMES and (before in ("{", ",") or before in ("async", "get", "set", "*")) and (member(i) or i + 1 < n and tokens[i + 1].text == ":" and is_function(i + 2)):
                found[top(i, low)] = (t.text, i, i)

    spans = [
        Span(tokens[a].start, "function", name, line(tokens[k].start), line(tokens[a].start), re.sub(r"\s+", " ", text[tokens[a].start : _signature_end(tokens, closer, angle, last)]))
        for a, (name, k, last) in found.items()
    ]
    spans += [Span(t.end, "doc", None, line(t.start), line(t.end - 1), t.text) for t in every if t.kind == "comment" and re.match(r"/\*\*[^*/]", t.text) and t.text.endswith("*/")]
    covered = {k for a, (_, k, last) in found.items() for k in range(a, last + 1)}
    starts, docs, previous = set(found), sorted(s.at for s in spans if s.kind == "doc"), -1
    in_run, passed = False, 0
    for i, t in enumerate(tokens):
        seen = bisect.bisect_right(docs, t.start)
        if i in covered:
            in_run = in_run and i not in starts
            passed = seen
            continue
        if not in_run or seen != passed or i - 1 != previous:
            spans.append(Span(t.start, "code", None, line(t.start), line(t.start), None))
        in_run, passed, previous = True, seen, i
    return spans


def _closers(tokens: list[Token]) -> tuple[dict[int, int], dict[int, int]]:
    """The token that closes each bracket, of those that are closed by their own kind; and the same for angle brackets, which end where a bracket around them does."""
    pairs, stack, angles, closes, ends = {"(": ")", "[": "]", "{": "}"}, [], [], {}, {}
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text == "<":
            angles.append(i)
        elif t.text == ">":
            if angles and (not stack or angles[-1] > stack[-1]):
                ends[angles.pop()] = i
        elif t.text in pairs:
            stack.append(i)
        elif t.text in _CLOSE:
            while stack and pairs[tokens[stack[-1]].text] != t.text:
                if t.text != "}":
                    break
                stack.pop()
            if stack and pairs[tokens[stack[-1]].text] == t.text:
                start = stack.pop()
                closes[start] = i
                while angles and angles[-1] > start:
                    angles.pop()
    return closes, ends


def _signature_end(tokens: list[Token], closer: dict[int, int], angle: dict[int, int], last: int) -> int:
    """The end of the parameters of the function whose name is at ``last``."""
    k = last + 1
    while k < len(tokens) and tokens[k].text not in ("{", "}", ";", "=>"):
        if tokens[k].text == "(" and k in closer:
            return tokens[closer[k]].end
        k = angle.get(k, k) + 1
    return tokens[last].end
