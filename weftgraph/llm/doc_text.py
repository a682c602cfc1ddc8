"""What a documentation comment says once its markup is taken off, and whether that is trivial."""

from __future__ import annotations

import re

# Words that add nothing to a name, and openings of notes that documentation is still to come.
EMPTY_WORDS = {"a", "an", "the", "this", "function", "method", "will", "to", "of", "for", "it", "is"}
#: A note that a text is still to be written: a marker, or a bare request to document.
_NOTE = re.compile(
    r"""^\W*(?:
        (?:todo|fixme|tbd|tbc|xxx|wip|hack)\b.*
      | (?:add|write|insert|put|fill\s+in|needs?|missing|no|pending|awaiting|undocumented|placeholder)\b[^.]*\b(?:docs?|docstrings?|documentation|descriptions?|comments?|here|later)\b.*
      | (?:docs?|docstrings?|documentation|descriptions?|comments?)\b[^.]*\b(?:here|later|missing|pending|todo|tbd|to\s+(?:be|come|follow)|needed|soon|goes?)\b.*
      | (?:to\s+be|still\s+to\s+be|not\s+yet)\s+(?:written|documented|described|done|added|filled\s+in|completed|defined|determined)\b.*
      | (?:document|describe)\s+(?:me|this|it)\b.*
    )$""",
    re.X | re.I | re.S,
)
_DESCRIPTION = re.compile(r"^@(?:description|desc|summary|remarks|classdesc|fileoverview|brief)\b:?", re.I)
_TAG = re.compile(r"^(?:@\w+|:[A-Za-z]\w*(?:\s[^:\n]*)?:(?!`))")
_SECTION = re.compile(
    r"^(?:args?|arguments?|params?|parameters?|other parameters|keyword args|keyword arguments|returns?|return|yields?|receives?|raises?|throws?|exceptions?|errors?|warns?|attributes|examples?|see also|references|todo|methods?)\s*:?\s*$",
    re.I,
)
_INLINE_SECTION = re.compile(r"^(?:args?|arguments|params?|parameters|returns?|yields?|raises?|throws?)\s*:\s+\S", re.I)


def description(comment: str) -> str:
    """The running text of a docstring or ``/** */`` comment, without tags, sections and markup."""
    if comment.startswith("/**"):
        comment = comment[3:].removesuffix("*/")
        lines = [re.sub(r"^\s*\*+(?: ?)", "", x) if i else x.strip() for i, x in enumerate(re.split(r"\r\n|\r|\n", comment))]
    else:
        lines = re.split(r"\r\n|\r|\n", comment)
    kept, skip, depth = [], False, 0
    for i, line in enumerate(lines):
        body = line.strip()
        indent = len(line) - len(line.lstrip())
        if not body:
            skip = skip and depth >= 0  # a blank line ends the text of a tag, not an indented section
            continue
        if d := _DESCRIPTION.match(body):
            skip, body = False, body[d.end() :]
        elif _TAG.match(body):
            skip, depth = True, -1
            continue
        elif i + 1 < len(lines) and re.fullmatch(r"[-=~]{3,}", lines[i + 1].strip()) and _SECTION.match(body):
            skip, depth = True, 10**6
            continue
        elif _SECTION.match(body) and body.endswith(":"):
            skip, depth = True, indent
            continue
        elif _INLINE_SECTION.match(body):
            skip, depth = True, -1 if not body.endswith(":") else indent
            continue
        elif skip and 0 <= depth < 10**6 and indent <= depth:
            skip = False
        if not skip:
            kept.append(body)
    text = "\n".join(kept)
    text = re.sub(r"\{@\w+\s+([^}|]*)(?:\|([^}]*))?\}", lambda m: m[2] or m[1], text)
    text = re.sub(r":[\w:]+:`([^`]*)`", r"\1", text)
    text = re.sub(r"</?[A-Za-z][^<>]*>|&\w+;", " ", text)
    return re.sub(r"[`*_]{2,}|`|^[-=~#]+$", " ", text, flags=re.M)


def words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_][\w'’]*|\d+[\w.]*", text)


def name_words(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    return {x for p in map(str.lower, parts) for x in (p, p + "s", p + "es")} | {name.lower()}


def is_trivial(comment: str, name: str) -> bool:
    """Absent, under four words, only a note that it is to be written, or only the name in other words."""
    text = description(comment)
    sentences = [x for x in re.split(r"\n|(?<=[.!?])\s+", text) if x.strip()]
    said = words(" ".join(x for x in sentences if not _NOTE.match(x.strip())))
    if len(said) < 4 or len(words(text)) < 4:
        return True
    known = EMPTY_WORDS | name_words(name)
    return all(w.lower() in known for w in said)
