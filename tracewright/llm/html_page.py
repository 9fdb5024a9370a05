"""Pages as token sequences: a lenient reader of HTML in time linear in the page.

A page becomes a list of tokens in page order: the start of an element, its end (also where HTML implies it)
and blocks of text. A token's number is a hash of the path of elements it stands in; a block has a hash of its
text besides. Paths hold tags and class names, without names that hold a digit, which tend to number the page. The start
of an element has an even number, and its end the next odd one.

Text: character references decoded, white space inside a block one space, trimmed. Inline tags neither part
nor join; br is white space. Scripts, styles and the like, comments and markup are no text.

Tags end at the first > outside of quotes. Once a quote that nothing closes has been found, quotes no longer
count in the rest of the page, so that no part of it is searched over and over.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import xxhash

_QUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")

# Fixed values of HTML: elements by how their tags are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math canvas audio video object select".split())
#: Raw elements that a slash closes, and those of which an unclosed one is skipped by its tag only.
_FOREIGN = frozenset(("svg", "math"))
_SKIPPED = _FOREIGN | frozenset("object audio video canvas select".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html head li main menu nav ol p pre section summary table caption thead tbody tfoot tr td th ul button label legend".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
_P = ("p",)
_SCOPE = frozenset("ul ol menu dl table article section div body main".split())

# What marks boilerplate, and what marks the main text.
_BOILER_TAGS = frozenset("nav header footer aside form button head dialog menu label legend fieldset".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup login popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead topbar toolbar footer copyright legal disclaimer comment comments disqus reply replies respond share sharing social "
    "related recommended recommendations widget widgets pagination pager search skip tagcloud".split()
)
#: Behind a boilerplate word these say that the element holds such things; a name that ends in a boilerplate word needs none.
_HOLDERS = frozenset(
    "area bar block box body button buttons container content count field footer form group head header heading icons inner item items link links "
    "list message outer panel post posts region row section slot stories strip text thread title top unit wrap wrapper zone".split()
)
_MAIN = frozenset(("main", "article"))
#: A class with such a part says what an element has or lacks.
_STATES = frozenset("no not non without with has have".split())
#: Elements of these words hold lists of articles.
_LISTS = frozenset("comment comments disqus replies reply respond related recommended recommendations".split())
_WORD = re.compile(r"[a-z]+")


def marking(name: str) -> frozenset[str]:
    """The boilerplate words by which a class or id marks its element; none for names such as no-sidebar or share-price."""
    parts = _WORD.findall(name)
    if not parts or not _STATES.isdisjoint(parts):
        return frozenset()
    if parts[-1] in BOILER_WORDS:
        return frozenset(parts) & BOILER_WORDS
    if parts[0] in BOILER_WORDS and _HOLDERS.issuperset(parts[1:]):
        return frozenset(parts[:1])
    return frozenset()


@dataclass(slots=True)
class Token:
    """text is None for tags. opens: the start of an element with an end, but html and body. hard: boilerplate by element, role or hidden; soft: by class or id; rank: how many
    such marks an article or main has ended; linked: the characters of text that stand in links."""

    number: int
    text: str | None = None
    hash: int = 0
    hard: bool = False
    soft: bool = False
    main: bool = False
    article: bool = False
    rank: int = 0
    linked: int = 0
    opens: bool = False
    ends: bool = False


@dataclass(slots=True)
class _Open:
    """inner: the elements opened inside, by tag and attributes. An element isn't changed once it is open, so that siblings alike are
    one, with one token for their start and one for their end."""

    tag: str
    path: int
    block: _Open | None = None
    hard: bool = False
    soft: bool = False
    lists: bool = False
    rank: int = 0
    main: bool = False
    article: bool = False
    link: bool = False
    marks: int = 0
    inner: dict | None = None
    start: Token | None = None
    end: Token | None = None


def _hash(*parts: int | str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


_paths: dict[tuple, int] = {}


def _path(parent: int, tag: str, names: str) -> int:
    key = (parent, tag, names)
    found = _paths.get(key)
    if found is None:
        if len(_paths) > 50_000:
            _paths.clear()
        _paths[key] = found = _hash(*key) & ~1
    return found


def _entered(top: _Open, tag: str, attrs: str) -> _Open:
    """The element that a start tag opens inside top."""
    found: dict[str, str] = {}
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    elif tag not in _MAIN:
        # most tags have no attributes and keep what their element stands in
        out = _Open(tag, _path(top.path, tag, ""), top.block, top.hard or tag in _BOILER_TAGS, top.soft, top.lists, top.rank, top.main, top.article, top.link or tag == "a", top.marks)
        if tag in _BLOCK:
            out.block = out
        return out
    classes = found.get("class", "").lower()
    names = f"{classes} {found.get('id', '').lower()}".split() if tag not in ("html", "body") else ()
    marks = [w for n in names if (w := marking(n))]
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    hard = top.hard or tag in _BOILER_TAGS or hidden or role in _BOILER_ROLES
    is_main, is_article = tag == "main" or role == "main", tag == "article"
    kept = " ".join(sorted({n for n in classes.split() if not any(map(str.isdigit, n))})) if classes else ""
    out = _Open(tag, _path(top.path, tag, kept), top.block, hard, top.soft, top.lists, top.rank, top.main, top.article, top.link or tag == "a", top.marks + bool(marks))
    if tag in _BLOCK:
        out.block = out
    whole = not _LISTS.isdisjoint(names)
    if (is_main and not top.main) or (is_article and not top.article and not top.lists and not whole):
        out.soft, out.rank = False, out.marks
        out.lists = out.lists and not is_main
    else:
        out.soft = top.soft or bool(marks)
        out.lists = top.lists or any(not _LISTS.isdisjoint(w) for w in marks)
    if (is_main or is_article) and not hard and not out.soft:
        out.main, out.article = True, out.article or is_article
    return out


def read(page: str) -> list[Token]:
    """The tokens of a page."""
    root = _Open("", 0)
    root.block = root
    stack, opened, out = [root], {}, []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join((parts[0] if len(parts) == 1 else "".join(parts)).split())
            if text:
                inner = stack[-1]
                own = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                out.append(Token(inner.block.path, text, own, inner.hard, inner.soft, inner.main, inner.article, inner.rank, min(linked, len(text))))
            parts.clear()
        linked = 0

    def cut(i: int) -> None:
        """Ends all elements from the i-th of the stack on."""
        if parts and any(x.tag in _BLOCK for x in stack[i:]):
            flush()
        while len(stack) > i:
            x = stack.pop()
            out.append(x.end)
            opened[x.tag] -= 1

    def close(names: tuple[str, ...], scope: frozenset = frozenset()) -> None:
        for n in names:
            if opened.get(n):
                break
        else:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                cut(i)
                return
            if stack[i].tag in scope:
                return

    # the next end tag of each raw element, -1 if there is none: unclosed ones don't search the page again
    at, ends, tag_of = 0, {}, _QUOTED
    while at < len(page):
        upto = page.find("<", at)
        m = None
        while upto >= 0:
            m = tag_of.match(page, upto)
            if m:
                break
            after = page[upto + 1 : upto + 2]
            if after in "!?" and after:
                break
            if after == "/" or after.isalpha():
                if tag_of is _QUOTED and (m := _PLAIN.match(page, upto)):
                    tag_of = _PLAIN
                    break
                if page.find(">", upto) < 0:
                    upto = -1  # no tag ends any more
                    break
            upto = page.find("<", upto + 1)
        stop = upto if upto >= 0 else len(page)
        if stop > at:
            piece = page[at:stop]
            if "&" in piece:
                piece = _html.unescape(piece)
            parts.append(piece)
            if stack[-1].link:
                linked += len(piece.strip())
        if upto < 0:
            break
        if not m:  # a comment, a declaration or an instruction
            comment = page.startswith("<!--", upto)
            end = page.find("-->" if comment else ">", upto + 2)
            if end < 0 and not comment:
                parts.append(page[upto:])
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if parts and tag in _BLOCK:
                flush()
            if stack[-1].tag == tag:
                out.append(stack.pop().end)
                opened[tag] -= 1
                continue
            # an inline end tag doesn't close the block around it
            close((tag,), frozenset() if tag in _BLOCK else _BLOCK)
            continue
        if tag in _BLOCK:
            if parts:
                flush()
            if opened.get("p"):
                close(_P, _SCOPE)
        if tag in _CLOSES:
            close(_CLOSES[tag], _SCOPE)
        if tag in _RAW:
            out.append(Token(_path(stack[-1].path, tag, "")))
            if tag in _FOREIGN and m[3].endswith("/"):
                continue
            if tag not in ends or 0 <= ends[tag][0] < at:
                end = re.compile(f"</{re.escape(tag)}\\s*+>", re.I).search(page, at)
                ends[tag] = end.span() if end else (-1, -1)
            if ends[tag][0] >= 0:
                at = ends[tag][1]
            elif tag not in _SKIPPED:
                at = len(page)
            continue
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            out.append(Token(_path(stack[-1].path, tag, "")))
            if tag == "br":
                parts.append(" ")
            continue
        top = stack[-1]
        if top.inner is None:
            top.inner = {}
        entered = top.inner.get((tag, m[3]))
        if entered is None:
            top.inner[tag, m[3]] = entered = _entered(top, tag, m[3])
            entered.start, entered.end = Token(entered.path, opens=tag not in ("html", "body")), Token(entered.path | 1, ends=True)
        out.append(entered.start)
        stack.append(entered)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    cut(1)
    return out
