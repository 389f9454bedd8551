"""Text lines of a web page and what its markup says about them; a small helper of page differencing."""

from __future__ import annotations

import html
import re

#: what the markup says of a line: not the article, unknown, the article, unknown on a page that has an article
NO, MAYBE, YES, BESIDE = 0, 1, 2, 3

# fixed values: element names of HTML by their role
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody tfoot thead title tr ul caption".split()
)
_NOT_ARTICLE = frozenset(
    "head nav footer aside script style noscript template textarea title iframe svg math canvas object audio video button "
    "select dialog menu noembed noframes xmp".split()
)
_MAIN = frozenset(["article", "main"])
# fixed values: words in class, id and role that name parts of a page other than the article
_ROLES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside complementary banner contentinfo notice cookie cookies consent gdpr "
    "popup modal newsletter subscribe subscription comment comments respond disqus reply replies discussion share sharing "
    "social related recommended teaser teasers widget toolbar pagination pager login signup search form alert".split()
)
#: an element that is closed by the start of one of these
_CLOSED_BY = {
    "p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"}, "head": {"body"},
}
_SCOPE = frozenset("article aside body div footer form header main nav section table td th ul ol blockquote".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
#: names that tell what a page has and not what an element is
_STATE = re.compile(r"\b(?:has|no|with|without)[-_][\w-]+|\bcomments?[-_](?:open|closed)\b")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


#: what an element says of its text: plainly not the article, named by roles alone, by roles among others or a form, the article
_STRICT, _NAMED, _WEAK, _ARTICLE = range(4)


def _says(name: str, attributes: str, in_main: bool) -> int | None:
    if name in _NOT_ARTICLE or (name == "header" and not in_main):
        return _STRICT
    if name == "form":
        return _WEAK if not _HIDDEN.search(attributes) else _STRICT
    if attributes and name not in ("main", "body", "html"):
        if name not in _MAIN and _HIDDEN.search(attributes):
            return _STRICT
        roles = [w in _ROLES for value in _NAMES.findall(attributes) for w in _WORD.findall(_STATE.sub(" ", value.lower()))]
        if any(roles):
            return _NAMED if all(roles) else _WEAK
    return _ARTICLE if name in _MAIN else None


def _verdicts(says: list[tuple[int, int | None]], lengths: list[int]) -> list[int]:
    """The kind of the lines right below each node; says: the parent and the word of every node, parents first.

    Forms and elements named by a role are not the article, unless one holds more than half of the text that no plain
    element rules out. Then, and if nothing else is left of the page, its text is unknown, but an article inside is one.
    Beside an article, an element named by roles alone stays out at any length: an advert may be longer than a short text.
    """
    held = list(lengths)
    for k in range(len(says) - 1, 0, -1):
        if says[k][1] == _STRICT:
            held[k] = 0
        held[says[k][0]] += held[k]

    def judged(lift: list[bool]) -> set[int]:
        kinds[:] = [MAYBE]
        for (parent, word), lifted in zip(says[1:], lift[1:], strict=True):
            out = kinds[parent] == NO or word == _STRICT or (word in (_NAMED, _WEAK) and not lifted)
            kinds.append(NO if out else YES if word == _ARTICLE else MAYBE)
        return {k for n, k in zip(lengths, kinds, strict=True) if n}

    kinds: list[int] = []
    most = [2 * n > held[0] for n in held]
    if YES not in judged([m and word == _WEAK for m, (_, word) in zip(most, says, strict=True)]) and judged(most) <= {NO}:
        judged([True] * len(says))
    return kinds


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The blocks of text in page order, white space collapsed, and what the markup says of each.

    Where a page has an article, unknown lines outside it are ``BESIDE``.
    """
    lines: list[str] = []
    places: list[int] = []
    parts: list[str] = []
    # elements that say something of their text, as (parent, word), and the length of the lines right below them
    says: list[tuple[int, int | None]] = [(0, None)]
    lengths = [0]
    # open elements with their node in ``says`` and whether they are in an article
    stack: list[tuple[str, int, bool]] = [("", 0, False)]

    def text(piece: str) -> None:
        if piece:
            parts.append(html.unescape(piece))

    def flush() -> None:
        if parts:
            line = " ".join("".join(parts).split())
            parts.clear()
            if line:
                lines.append(line)
                places.append(stack[-1][1])
                lengths[stack[-1][1]] += len(line)

    at = 0
    while m := _MARKUP.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "br" or name in ("td", "th"):
            text(" ")
        if closing:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if k:
                if name in _BLOCK or stack[k - 1][1] != stack[-1][1]:
                    flush()
                del stack[k:]
            elif name == "p":
                flush()
            continue
        if name in _VOID:
            if name in _BLOCK:
                flush()
            continue
        if name in _BLOCK or name in _NOT_ARTICLE:
            flush()
        for k in range(len(stack) - 1, 0, -1):
            if name in _CLOSED_BY.get(stack[k][0], ()):
                if stack[k - 1][1] != stack[-1][1]:
                    flush()
                del stack[k:]
                break
            if stack[k][0] in _SCOPE:
                break
        _, node, in_main = stack[-1]
        word = _says(name, attributes, in_main)
        if word is not None:
            flush()
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not attributes.endswith("/") or name in _BLOCK:
            if word is not None:
                says.append((node, word))
                lengths.append(0)
                node = len(says) - 1
            stack.append((name, node, in_main or name in _MAIN))
    text(page[at:])
    flush()
    verdicts = _verdicts(says, lengths)
    kinds = [verdicts[p] for p in places]
    if YES in kinds:
        kinds = [BESIDE if k == MAYBE else k for k in kinds]
    return lines, kinds
