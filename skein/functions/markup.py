"""A tokenizer of HTML start and end tags, in one pass and in time linear in the page.

It follows the standard's tokenizer as far as tags and their attributes need it: comments and their
odd ends, elements whose contents are text, scripts that hold comments and scripts, attributes in all
quotes, character references in their values. Nothing is ever read again from an earlier place: a tag
or comment that isn't closed ends the page, as the standard says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
_ATTRIBUTE = re.compile(r"([^\t\n\f\r />][^\t\n\f\r />=]*)[\t\n\f\r ]*(=?)[\t\n\f\r ]*")
_SPACE = re.compile(r"[\t\n\f\r /]*")
_UNQUOTED = re.compile(r"[^\t\n\f\r >]*")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]{0,40};?)")
#: Fixed values of the standard: elements whose contents are text up to their end tag.
TEXT_ONLY = ("title", "textarea", "style", "xmp", "iframe", "noembed", "noframes")
_END = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I) for name in TEXT_ONLY}
_SCRIPT = re.compile(r"<!--|</script(?=[\t\n\f\r />])", re.I)
_ESCAPED = re.compile(r"-->|<(/?)script(?=[\t\n\f\r />])", re.I)
_COMMENT_END = re.compile(r"--!?>")


def _named(m: re.Match) -> str:
    """A character reference in an attribute's value: without its semicolon it counts only if no letter, digit or '=' follows."""
    text = m[0]
    if text[1] == "#" or text.endswith(";"):
        if text[1] == "#" or text[1:] in html5:
            return unescape(text)
    for n in range(len(text), 1, -1):
        if text[1:n] in html5 and not text[1:n].endswith(";"):
            after = m.string[m.start() + n : m.start() + n + 1]
            return text if after == "=" or (after.isascii() and after.isalnum()) else html5[text[1:n]] + text[n:]
    return text


def value(raw: str) -> str:
    return _REFERENCE.sub(_named, raw) if "&" in raw else raw


def _script_end(html: str, at: int) -> int:
    """Where a script's end tag begins; -1 if it has none."""
    while True:
        m = _SCRIPT.search(html, at)
        if m is None:
            return -1
        if m[0][1] == "/":
            return m.start()
        at, inside = m.start() + 2, False  # "<!-->" ends the comment it begins
        while True:
            m = _ESCAPED.search(html, at)
            if m is None:
                return -1
            at = m.end()
            if m[0] == "-->":
                break
            if m[1] and not inside:
                return m.start()
            inside = not m[1]


def _attributes(html: str, at: int) -> tuple[int, list[tuple[str, str]]]:
    """The place after the tag's end, and its attributes; -1 if it isn't closed."""
    found, size = [], len(html)
    while True:
        at = _SPACE.match(html, at).end()
        if at >= size:
            return -1, found
        if html[at] == ">":
            return at + 1, found
        m = _ATTRIBUTE.match(html, at)
        at = m.end()
        if not m[2]:
            found.append((m[1].lower(), ""))
            continue
        quote = html[at : at + 1]
        if quote in ('"', "'") and quote:
            end = html.find(quote, at + 1)
            if end < 0:
                return -1, found
            found.append((m[1].lower(), value(html[at + 1 : end])))
            at = end + 1
        else:
            end = _UNQUOTED.match(html, at).end()
            found.append((m[1].lower(), value(html[at:end])))
            at = end


def tags(html: str) -> Iterator[tuple[str, list[tuple[str, str]] | None]]:
    """(name, attributes) of start tags, (name, None) of end tags, in lower case and in their order."""
    at = 0
    while True:
        at = html.find("<", at)
        if at < 0:
            return
        m = _NAME.match(html, at + 1)
        if m:
            name = m[0].lower()
            at, attributes = _attributes(html, m.end())
            if at < 0:
                return
            yield name, attributes
            if name == "plaintext":
                return
            if name == "script":
                at = _script_end(html, at)
            elif name in _END:
                end = _END[name].search(html, at)
                at = end.start() if end else -1
        elif html.startswith("</", at):
            m = _NAME.match(html, at + 2)
            if m:
                at, _ = _attributes(html, m.end())
                if at >= 0:
                    yield m[0].lower(), None
            else:
                at = html.find(">", at + 2) + 1 or -1
        elif html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                at = html.index(">", at) + 1
            else:
                end = _COMMENT_END.search(html, at + 4)
                at = end.end() if end else -1
        elif html.startswith(("<!", "<?"), at):
            at = html.find(">", at + 2) + 1 or -1
        else:
            at += 1
        if at < 0:
            return


class Head:
    """What a crawl reads of a page: anchors' hrefs, the first base and the first canonical link; templates' contents don't count."""

    def __init__(self, html: str):
        self.hrefs: list[str] = []
        self.base = self.canonical = None
        has_base = has_canonical = False
        templates = 0
        for name, attributes in tags(html):
            if name == "template":
                templates = max(0, templates + (1 if attributes is not None else -1))
            if templates or attributes is None:
                continue
            if name not in ("a", "base", "link"):
                continue
            first: dict[str, str] = {}
            for key, text in attributes:
                first.setdefault(key, text)
            if name == "a":
                if first.get("href", "").strip():
                    self.hrefs.append(first["href"])
            elif name == "base" and not has_base:
                has_base, self.base = True, first.get("href")
            elif name == "link" and not has_canonical and "canonical" in first.get("rel", "").lower().split():
                has_canonical, self.canonical = True, first.get("href")
