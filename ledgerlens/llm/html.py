"""Main-text extraction from raw HTML by scoring the element tree.

A page is read into a tree of block and inline elements (unclosed and misplaced tags as
browsers treat them, roughly). Chrome - scripts, styles, menus, headers, footers, sidebars, forms,
notices, adverts, reader comments - is recognised by tag, role or class and left out. A class or
id is a hint only, and so are a form, a dialog and a header: an article, a main element and what holds most of the page's points (with no
article's text outside) stay, and a name of several words must begin or end with a word of chrome,
without has-, no- or the like, and its element have few points or many links. Of a header inside an article its headings stay. Each
paragraph passes points, one and more for its length and commas, to its ancestors: all to the
parent, less with each level; a container's points are discounted by the share of its
text inside links. The best container is kept with those siblings that read like its text;
inside an article (or main) element the whole element is the container. Beside it stay, unless mostly links, other articles that are not
named as chrome, and, in a main element or where there is no article at all, paragraphs, lists, tables, sections and
whatever has enough points. Of containers of equal worth the first is the best.

The text has one line per block, in page order; character references are decoded and white
space inside a block becomes one space. Null, empty and textless pages give the empty text; repeated rows give the same
text each; an empty table gives an empty one; other columns are ignored.
Pages are read whole; nesting of any depth is handled without recursion.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.llm.batches import arrow_udf

# Possessive repeats: an unpaired quote must not make the match try all pairings.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|</?[a-zA-Z][^>]*+\Z|[^<]++|<""", re.S)
#: Attribute by attribute, so that a value is never read as an attribute; an unpaired quote reaches to the end.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]++))?+""")

#: Fixed values of the HTML language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag closes an open element of these, looking up to a scope end.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "option": {"select"}}

#: What is never main text: by tag, by role, by a word of class or id.
CHROME_TAGS = set("script style noscript template head title nav footer aside button select textarea input iframe svg canvas object menu noembed noframes xmp".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search alert menu menubar toolbar".split())
#: Chrome, unless most of the page's text is in it.
MOSTLY_TAGS, MOSTLY_ROLES = set("form dialog header".split()), set("form dialog".split())
CHROME_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent notice popup modal overlay subscribe newsletter signup login share sharing social related recommended widget comment comments commentlist disqus replies respond".split())
#: A name with one of these speaks of chrome that is elsewhere or absent.
ABOUT = set("has no not with without".split())
WHOLE = ("article", "main")

#: Points: each paragraph gives one, one per comma, one per so many characters up to a limit.
PER_CHARS, MOST_FOR_LENGTH = 100, 3
#: Blocks that give no points.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "th", "dt")
TITLES = HEADINGS[:6]
#: Siblings that stay whatever their points.
RUNNING = {*TITLES, "p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure", "section", "hgroup"}
#: Share of the best container's points from which a sibling is kept.
SIBLING_SHARE = 0.2
MAX_LINK_SHARE = 0.5
#: Share of the page's points over which a class does not make chrome, and points up to which a part of a name does: those of one long paragraph.
MOST_SHARE, FEW = 0.5, 1 + MOST_FOR_LENGTH
#: An ancestor gets half of what the one below gets, down to this part.
MOST_LEVELS = 64


class Node:
    __slots__ = ("tag", "parent", "items", "chrome", "hint", "points", "chars", "linked", "article", "named")

    def __init__(self, tag: str, parent: Node | None, chrome: bool):
        self.tag, self.parent, self.chrome, self.hint = tag, parent, chrome, ""
        self.items: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.article = tag if tag in WHOLE else None
        self.named = ""


def named_chrome(value: str) -> str:
    """Whether a class or id has a word of chrome as a "whole" name, or as the first or last "part" of one."""
    found = ""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if not words or not ABOUT.isdisjoint(words):
            continue
        if len(words) == 1 and words[0] in CHROME_WORDS:
            return "whole"
        if words[0] in CHROME_WORDS or words[-1] in CHROME_WORDS:
            found = "part"
    return found


def chrome_of(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is chrome whatever it holds, and else what its names hint at."""
    if tag in CHROME_TAGS:
        return True, ""
    hint = "whole" if tag in MOSTLY_TAGS else ""
    if tag in ("html", "body") or not attributes.strip():
        return False, hint
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, ""
        if name == "role" and value in CHROME_ROLES:
            return True, ""
        if name == "role" and value in MOSTLY_ROLES:
            hint = "whole"
        if name in ("class", "id"):
            hint = max(hint, named_chrome(value))  # "whole" is the greater
    return False, hint


def is_chrome(tag: str, attributes: str) -> bool:
    """Whether an element's tag or attributes speak of chrome."""
    sure, hint = chrome_of(tag, attributes)
    return sure or (hint != "" and tag not in WHOLE)


def parse(page: str) -> Node:
    """The element tree; text inside chrome is dropped right away."""
    root = here = Node("html", None, False)
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if (s[0] != "<" or s == "<") and not here.chrome:
                here.items.append(s)
            continue
        tag = tag.lower()
        if m[1]:
            node = here
            while node is not None and node.tag != tag:
                # an inline end tag reaches no further than its block
                node = None if node.tag in BLOCKS and tag not in BLOCKS else node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS:  # closes an open paragraph with whatever is open in it
            node = here
            while node is not None and node.tag not in BLOCKS:
                node = node.parent
            if node is not None and node.tag == "p":
                here = node.parent
        if tag in CLOSES:
            node = here
            while node is not None and node.tag not in CLOSES[tag] and node.tag not in SCOPE[tag]:
                node = node.parent
            if node is not None and node.tag in CLOSES[tag] and node.parent is not None:
                here = node.parent
                if tag == "tr" and here.tag == "tr":
                    here = here.parent
        if tag in VOID:
            if not here.chrome:
                here.items.append(Node(tag, here, False) if tag == "hr" else " " if tag == "br" else "")
            continue
        sure, hint = chrome_of(tag, m[3] or "")
        node = Node(tag, here, here.chrome or sure)
        node.hint, node.named = ("", hint) if tag in WHOLE else (hint, hint)
        here.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if not (m[3] or "").endswith("/") or tag in BLOCKS:
            here = node
    return root


def blocks(root: Node, apart: bool = False) -> list[tuple[Node, str, int]]:
    """(block element, text, its characters inside links) in page order; with ``apart`` each hinted element is a block."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0

    def end(owner: Node) -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                out.append((owner, text, min(linked, len(text))))
        parts, linked = [], 0

    owner = root
    stack: list[tuple[Node, int, Node, int]] = [(root, 0, root, 0)]  # element, next item, its block, links around it
    while stack:
        node, i, block, links = stack.pop()
        if i == len(node.items):
            if node.tag in BLOCKS or (apart and node.hint):
                end(node)
            continue
        stack.append((node, i + 1, block, links))
        item = node.items[i]
        if isinstance(item, str):
            parts.append(item)
            linked += len(item) if links else 0
        elif not item.chrome:
            if item.tag in BLOCKS or (apart and item.hint):
                end(block)
                stack.append((item, 0, item, links + (item.tag == "a")))
            else:
                stack.append((item, 0, block, links + (item.tag == "a")))
    end(owner)
    return out


def below(tops: list[Node]) -> set[int]:
    """Identities of the elements and all inside them."""
    out, stack = set(), [*tops]
    while stack:
        node = stack.pop()
        out.add(id(node))
        stack += [i for i in node.items if isinstance(i, Node)]
    return out


def points_of(text: str) -> int:
    return 1 + text.count(",") + min(MOST_FOR_LENGTH, len(text) // PER_CHARS)


def within(node: Node, tags: tuple[str, ...]) -> bool:
    """Whether an element stands inside one of these."""
    up = node.parent
    while up is not None and up.tag not in tags:
        up = up.parent
    return up is not None


def titles(top: Node) -> list[Node]:
    """Headings inside an element that no chrome holds, in page order."""
    out, stack = [], [*reversed(top.items)]
    while stack:
        node = stack.pop()
        if isinstance(node, Node) and not node.chrome:
            if node.tag in TITLES:
                out.append(node)
            else:
                stack += reversed(node.items)
    return out


def settle(root: Node) -> None:
    """Mark the elements that their names make chrome, as their points and links allow."""
    sums: dict[int, list] = {}  # element, points, those in articles, characters, those inside links
    above: dict[int, tuple[Node | None, bool]] = {}  # the next hinted element from here up, and whether an article is
    total = in_articles = 0
    for block, text, linked in blocks(root, apart=True):
        points = 0 if block.tag in HEADINGS else points_of(text)
        path, up = [], block
        while up is not None and id(up) not in above:
            path.append(up)
            up = up.parent
        hinted, article = above[id(up)] if up is not None else (None, False)
        for node in reversed(path):
            hinted, article = node if node.hint else hinted, article or node.article == "article"
            above[id(node)] = hinted, article
        total += points
        in_articles += points if article else 0
        while hinted is not None:
            s = sums.setdefault(id(hinted), [hinted, 0, 0, 0, 0])
            s[1:] = s[1] + points, s[2] + (points if article else 0), s[3] + len(text), s[4] + linked
            hinted = above[id(hinted.parent)][0] if hinted.parent is not None else None
    for node, points, inside, chars, linked in sums.values():
        if points > total * MOST_SHARE and inside == in_articles:
            continue
        node.chrome = node.hint == "whole" or points <= FEW or linked > MAX_LINK_SHARE * chars
        if node.chrome and node.tag == "header" and within(node, WHOLE):
            node.items, node.chrome = titles(node), False


def extract(page: str) -> str:
    """Main text of one page."""
    root = parse(page)
    settle(root)
    found = blocks(root)
    scored: dict[int, Node] = {}
    for block, text, linked in found:
        points = points_of(text)
        # text directly in a container speaks for the container itself
        node, level = (block.parent if block.tag in ("p", "pre", "blockquote", "td", "li", "dd") and block.parent else block), 1
        up: Node | None = block
        while up is not None:
            up.chars += len(text)
            up.linked += linked
            up = up.parent
        if block.tag in HEADINGS:
            continue
        while node is not None and level <= MOST_LEVELS:
            node.points += points / level
            scored[id(node)] = node
            node, level = node.parent, 2 * level
    if not scored:
        return "\n".join(text for _, text, _ in found)

    def worth(node: Node) -> float:
        return node.points * (1 - node.linked / max(1, node.chars))

    best = max(scored.values(), key=worth)
    top, up = None, best
    while up is not None:
        if up.article == "article" or (up.article and top is None):
            top = up
        up = up.parent
    base = top or best
    kept = [base]
    beside = top is None or (base.tag == "article" and within(base, ("main",)))
    for item in base.parent.items if base.parent is not None else []:
        if not isinstance(item, Node) or item is base or item.chrome or not item.chars or item.linked > MAX_LINK_SHARE * item.chars:
            continue
        if item.tag in WHOLE:
            keep = not item.named
        else:
            keep = beside and (item.tag in RUNNING or worth(item) >= SIBLING_SHARE * worth(best))
        if keep:
            kept.append(item)
    inside = below(kept)
    return "\n".join(text for block, text, _ in found if id(block) in inside)


def main_text(page: Column) -> Column:
    """The main text of each whole page."""

    @arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py() or "") for p in pages], pa.string())

    return texts(page)
