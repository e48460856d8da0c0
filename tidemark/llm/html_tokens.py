"""A linear scan of HTML into tags and text, shared by extraction and the WARC derivatives."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_TOKEN = re.compile(r"<!--|<!|<\?|</?(?=[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose content is not markup.
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: Elements that begin a new line of text.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
pre section select summary table tbody td tfoot th thead title tr ul""".split())


class Tag:
    __slots__ = ("name", "closing", "source")

    def __init__(self, name: str, closing: bool, source: str):
        self.name, self.closing, self.source = name, closing, source

    @property
    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for key, value in _ATTRIBUTE.findall(self.source):
            out.setdefault(key.lower(), unescape(value.strip("\"'") if value[:1] in "\"'" else value))
        return out


def _tag_end(html: str, at: int) -> int:
    """Place after the '>' that ends a tag begun before ``at`` (quoted values may hold one)."""
    n = len(html)
    while at < n:
        gt = html.find(">", at)
        if gt < 0:
            return n
        quote = min((q for q in (html.find('="', at, gt), html.find("='", at, gt)) if q >= 0), default=-1)
        if quote < 0:
            return gt + 1
        close = html.find(html[quote + 1], quote + 2)
        if close < 0:
            return gt + 1
        at = close + 1
    return n


def tokens(html: str) -> Iterator[Tag | str]:
    """Tags, and the text between them with character references decoded; comments are left out.

    The content of a raw element (script, style, title ...) comes as one text between its tags.
    """
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            yield unescape(html[at:])
            return
        if m.start() > at:
            yield unescape(html[at:m.start()])
        if m[0] == "<!--":
            end = html.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m[0] in ("<!", "<?"):
            end = html.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        name = _NAME.match(html, m.end())
        end = _tag_end(html, name.end())
        tag = Tag(name[0].lower(), m[0] == "</", html[name.end():end])
        yield tag
        at = end
        if not tag.closing and tag.name in RAW:
            close = re.compile(rf"</{tag.name}(?=[\s/>])", re.IGNORECASE).search(html, at)
            stop = n if close is None else close.start()
            if stop > at:
                raw = html[at:stop]
                yield raw if tag.name in ("script", "style", "xmp") else unescape(raw)
            at = stop


class Lines:
    """Collects text into blocks: white space inside one becomes a single space, empty blocks vanish."""

    def __init__(self):
        self.done: list[str] = []
        self.open: list[str] = []

    def text(self, s: str) -> None:
        self.open.append(s)

    def cut(self) -> None:
        if self.open:
            line = " ".join("".join(self.open).split())
            if line:
                self.done.append(line)
            self.open = []

    def result(self) -> str:
        self.cut()
        return "\n".join(self.done)
