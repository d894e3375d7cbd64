"""URL parsing by the WHATWG URL Standard, for the special schemes a crawl meets.

It covers what the Column functions leave out: dot segments, percent-encode sets, backslashes, tabs
and newlines, numeric IPv4 hosts, hosts beyond ASCII.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from encodings.idna import nameprep
from urllib.parse import quote_plus, unquote_to_bytes

PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
#: Fixed values of the standard: characters that each part percent-encodes, besides controls and non-ASCII.
_QUERY = set(" \"#<>'")
_PATH = set(' "#<>?`{}^')
_FORBIDDEN = set("\x00\t\n\r #/:<>?@[\\]^|%\x7f") | {chr(c) for c in range(0x20)}


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str | None
    host: str
    port: int | None
    path: str
    query: str | None

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + ("" if self.port is None else f":{self.port}")

    def __str__(self) -> str:
        if self.scheme not in PORTS:
            return f"{self.scheme}:{self.path}" + ("" if self.query is None else f"?{self.query}")
        at = f"{self.user}@" if self.user else ""
        port = "" if self.port is None else f":{self.port}"
        return f"{self.scheme}://{at}{self.host}{port}{self.path}" + ("" if self.query is None else f"?{self.query}")


def _encoded(text: str, unsafe: set) -> str:
    return "".join(c if 0x20 <= ord(c) < 0x7F and c not in unsafe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _number(part: str) -> int | None:
    try:
        if len(part.lstrip("0xX")) > 12:
            return 1 << 48  # beyond any address, however many digits follow
        if part[:2] in ("0x", "0X"):
            return int(part[2:] or "0", 16)
        return int(part, 8) if len(part) > 1 and part[0] == "0" else int(part)
    except ValueError:
        return None


#: Letters that the URL standard's mapping keeps, where the older one changes or drops them.
_KEPT = re.compile("([\u00df\u1e9e\u03c2\u200c\u200d])")


def _label(text: str) -> str:
    """A label of a host name in ASCII."""
    parts = (("\u00df" if p == "\u1e9e" else p) if _KEPT.fullmatch(p) else nameprep(p) for p in _KEPT.split(text))
    mapped = "".join(parts)
    return mapped if mapped.isascii() else "xn--" + mapped.encode("punycode").decode()


def _host(text: str) -> str | None:
    if text.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(text[1:-1])}]" if text.endswith("]") else None
        except ValueError:
            return None
    try:
        name = unquote_to_bytes(text).decode("utf-8")
        name = name.lower() if name.isascii() else ".".join(map(_label, re.split("[.\u3002\uff0e\uff61]", name)))
    except UnicodeError:
        return None
    if not name or any(c in _FORBIDDEN for c in name):
        return None
    parts = name.rstrip(".").split(".") if name.endswith(".") else name.split(".")
    last = parts[-1]
    if last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last):
        numbers = [_number(p) for p in parts]
        if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
            return None
        value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    return name


def _path(text: str, base: list[str]) -> str:
    out = list(base)
    parts = text.replace("\\", "/").split("/")
    for i, part in enumerate(parts):
        dots = part.lower().replace("%2e", ".")
        final = i == len(parts) - 1
        if dots == "..":
            out = out[:-1]
        if dots in (".", ".."):
            if final:
                out.append("")
        else:
            out.append(_encoded(part, _PATH))
    return "/" + "/".join(out)


def parse(text: str, base: Url | None = None) -> Url | None:
    """The URL without its fragment, or None where the standard reports failure."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    text = text.split("#", 1)[0]
    m = _SCHEME.match(text)
    scheme = m[1].lower() if m else None
    rest = text[m.end() :] if m else text
    if scheme is not None and scheme not in PORTS:
        body, _, query = rest.partition("?")
        return Url(scheme, None, "", None, body, query if "?" in rest else None)
    if scheme is None and (base is None or base.scheme not in PORTS):
        return None
    body, mark, query = rest.partition("?")
    query = _encoded(query, _QUERY) if mark else None
    slashed = body.replace("\\", "/")
    relative = scheme is None or (base is not None and scheme == base.scheme and not slashed.startswith("//"))
    if relative and base is not None and not slashed.startswith("//"):
        if slashed.startswith("/"):
            return replace(base, path=_path(slashed[1:], []), query=query)
        if not slashed:
            return replace(base, query=query if mark else base.query)
        return replace(base, path=_path(slashed, base.path.split("/")[1:-1]), query=query)
    scheme = scheme or base.scheme
    authority, slash, tail = slashed.lstrip("/").partition("/")
    user, at, place = authority.rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", place)
    host = _host(m[1]) if m and m[1] else None
    if host is None:
        return None
    digits = (m[2] or "").lstrip("0")
    if len(digits) > 5 or int(digits or 0) > 65535:
        return None
    port = int(digits or 0) if m[2] else None
    return Url(scheme, user if at and user not in ("", ":") else None, host, None if port == PORTS[scheme] else port, _path(tail, []), query)


def resolve(raw: str, base: str) -> str | None:
    own = parse(base)
    out = parse(raw, own) if own else None
    return None if out is None else str(out)


def _decoded(text: str) -> str:
    return unquote_to_bytes(text.replace("+", " ")).decode("utf-8", "replace")


def sorted_query(query: str | None) -> str:
    pairs = [p.partition("=") for p in (query or "").split("&") if p]
    decoded = sorted(((_decoded(n), _decoded(v)) for n, _, v in pairs), key=lambda p: tuple(x.encode("utf-16-be", "surrogatepass") for x in p))
    return "&".join(f"{_form(n)}={_form(v)}" for n, v in decoded)


def _form(text: str) -> str:
    return quote_plus(text, safe="*-._").replace("~", "%7E")


def key_of(url: Url) -> str | None:
    if url.scheme not in ("http", "https") or url.user:
        return None
    query = sorted_query(url.query)
    return url.origin + (url.path.rstrip("/") or "/") + (f"?{query}" if query else "")


def canonical_key(text: str | None) -> str | None:
    url = None if text is None else parse(text)
    return None if url is None else key_of(url)
