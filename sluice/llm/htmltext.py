"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks.  A linear classifier gives each block a
cost for being called content and one for boilerplate: the capacities of its
edges to the two terminals.  Smoothness edges join blocks that follow each
other and blocks near each other in the DOM.  The blocks on the source side of a
minimum cut are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import release

#: Comments, declarations and tags as HTML reads them: a quote opens a value only behind an equals sign; ``<!-->`` is a
#: whole comment, ``--!>`` ends one; what else begins with ``<!``, ``<?`` or ``</`` and no letter is a comment up to the next ``>``.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+|(?=>)))*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are never text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title xmp noembed noframes".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
#: What may lie in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split()
)
#: What an open tag of the same kind ends when another begins.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "p": ("p",), "tbody": ("thead", "tbody"), "thead": ("tbody",), "tfoot": ("tbody",),
}
#: Containers that an implied end does not cross.
SCOPE = frozenset("table ul ol dl body html article section div main aside nav footer header form blockquote".split())

OUTSIDE_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
OUTSIDE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promos promotion
    cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup share sharing
    social related recommend recommended recommendations sidebar sidenav aside comment comments commentlist disqus reply
    replies respond discussion breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer masthead topbar
    copyright popup modal overlay widget widgets login search toolbar skip outbrain taboola toc""".split()
)
#: Names of lists whose items may be articles of their own.
LIST_NAMES = frozenset(
    "related recommend recommended recommendations sidebar sidenav aside comment comments commentlist disqus reply replies respond discussion outbrain taboola".split()
)
#: What a name adds to an outside word to say where or how it stands.
PLACING_NAMES = frozenset(
    """area bar block bottom box button buttons center col column container content global group head holder inner item items
    left link links list main one outer panel primary right row secondary section site slot text top two unit wrap wrapper""".split()
)
#: A class that tells a page's state ("has-sidebar", "noComments"), not what the element is.
_STATE = re.compile(r"(?:has|with|without|no|is|not)(?:[-_]|(?=[A-Z]))")
INSIDE_TAGS = frozenset(("article", "main"))
INSIDE_NAMES = frozenset("article articlebody post entry story content main maincontent body text".split())
_BOILER = re.compile(
    r"©|all rights reserved|cookies?\b|privacy policy|terms of (?:use|service)|subscribe|sign up|log ?in|read more|share this|click here|advertis"
    r"|alle rechte vorbehalten|datenschutz|impressum|nutzungsbedingungen|weiterlesen|abonnieren|jetzt anmelden|anzeige\b"
    r"|tous droits réservés|mentions légales|politique de confidentialité|lire la suite|s'abonner|partager sur|publicité"
    r"|todos los derechos reservados|aviso legal|política de privacidad|leer más|suscr[ií]b|compartir en|publicidad", re.I
)

#: Classifier weights as log-odds towards content.  What an element is (a footer, hidden) outweighs
#: all smoothness that a block can have; every other feature is of smoothness' own order.
WEIGHTS = {
    "bias": -0.6, "long": 2.2, "sentence": 0.7, "links": -3.0, "heading": 0.4, "phrase": -1.0,
    "inside": 1.6, "elsewhere": -2.5, "hinted": -1.6, "named": -4.5, "against": -9.0,
}
#: Smoothness.  Blocks in a row: of one parent and kind (tag and class), of one parent, any; and a block and
#: the last one before it of the same parent and kind, of the same grandparent.
ROW_KIND, ROW_PARENT, ROW, SAME_KIND, SAME_GRANDPARENT = 1.2, 0.4, 0.2, 0.8, 0.2


class Block:
    __slots__ = ("parts", "linked", "size", "outside", "inside", "heading", "parent", "grandparent", "kind")

    def __init__(self, outside, inside, heading, parent, grandparent, kind):
        self.parts, self.linked, self.size = [], 0, 0
        self.outside, self.inside, self.heading, self.parent, self.grandparent, self.kind = outside, inside, heading, parent, grandparent, kind


def _name_words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name)]


#: How an element speaks against its text: not; by a word in a longer name; by its name, or as a form; by the
#: name of a list; by what it is.
FOR, HINTED, NAMED, LISTED, AGAINST = range(5)


def _named(words: list[str]) -> int:
    """What a class or id says: a name counts in full if it ends in an outside word or only adds where or how to one."""
    known = [w for w in words if w in OUTSIDE_NAMES]
    if not known:
        return FOR
    if words[0] in LIST_NAMES or words[-1] in LIST_NAMES:
        return LISTED
    if words[-1] in OUTSIDE_NAMES or (words[0] in OUTSIDE_NAMES and all(w in OUTSIDE_NAMES or w in PLACING_NAMES for w in words)):
        return NAMED
    return HINTED


def _signals(tag: str, attrs: str, in_article: bool) -> tuple[int, bool, str]:
    """(outside, inside, class): how does the element speak against its text, and does it speak for it?"""
    out = NAMED if tag == "form" else AGAINST if tag in OUTSIDE_TAGS or (tag == "header" and not in_article) else FOR
    into, own = tag in INSIDE_TAGS, ""
    if attrs and tag not in ("html", "body"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "role":
                role = value.strip().lower()
                out = AGAINST if role in OUTSIDE_ROLES else out
                into |= role in ("main", "article")
            elif name in ("class", "id"):
                own = value if name == "class" else own
                for one in value.split():
                    if _STATE.match(one) or not (words := _name_words(one)):
                        continue
                    out = max(out, _named(words))
                    into |= bool(INSIDE_NAMES.intersection(words)) or one.lower() in INSIDE_NAMES
                    if "header" in words and tag != "h1" and not in_article:
                        out = max(out, NAMED)
            elif name == "itemprop":
                out = max(out, LISTED if value.lower() == "comment" else FOR)
                into |= value.lower() == "articlebody"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                out = AGAINST
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out = AGAINST
    return out, into and out <= HINTED, own


class _Open:
    """An open element, with all that its text needs to know of those around it."""

    __slots__ = ("tag", "number", "out", "into", "body", "in_article", "links", "hosts", "kinds")

    def __init__(self, tag: str, number: int, attrs: str, around: _Open | None):
        self.tag, self.number = tag, number
        if around is None:
            self.out, self.into, self.body, self.in_article, self.links = FOR, False, False, False, 0
            self.hosts, self.kinds = (0, 0, 0), (("", ""), ("", ""))
            return
        against, speaks, own = _signals(tag, attrs, around.in_article)
        out, self.body = around.out, around.body
        if speaks and tag in INSIDE_TAGS:
            # An article or main overrules names farther out, but not a list's name, nor any within an article or main.
            out = FOR if not self.body and out in (HINTED, NAMED) else out
            self.body = True
        self.out, self.into = max(out, against), around.into or speaks
        self.in_article = around.in_article or tag == "article"
        self.links = around.links + (tag == "a")
        if tag in INLINE:
            self.hosts, self.kinds = around.hosts, around.kinds
        else:
            self.hosts, self.kinds = (number, *around.hosts[:2]), ((tag, own), around.kinds[0])


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; broken markup is read as far as it goes."""
    found: list[Block] = []
    stack, is_open = [_Open("", 0, "", None)], Counter()
    number, at, now = 0, 0, None
    in_head = False
    # Raw elements that no end tag follows: looked for once a page.
    endless: set[str] = set()

    def text(raw: str) -> None:
        nonlocal now, in_head
        in_head = in_head and (not raw or raw.isspace())
        if in_head or not raw:
            return
        top = stack[-1]
        if now is None:
            if raw.isspace():
                return
            heading = top.kinds[0][0] in _HEADINGS or top.kinds[1][0] in _HEADINGS
            now = Block(top.out, top.into and top.out <= HINTED, heading, top.hosts[1], top.hosts[2], top.kinds[0])
            found.append(now)
        now.parts.append(raw)
        n = len(raw)
        now.size += n
        if top.links:
            now.linked += n

    def end(ends, barrier) -> None:
        """Close the innermost of ``ends``, if no barrier is met first."""
        if not any(is_open[t] for t in ends):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                is_open.subtract(e.tag for e in stack[i:])
                del stack[i:]
                return
            if barrier and stack[i].tag in SCOPE:
                return

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "head":
            in_head = not close
            now = None
            continue
        if not close and tag not in IN_HEAD:
            in_head = False
        if tag == "br":
            text(" ")
            continue
        if tag in RAW:
            if not close and not attrs.rstrip().endswith("/"):
                stop = None if tag in endless else _END[tag].search(page, at)
                if stop is None:
                    endless.add(tag)
                # Without its end tag only a script or a style has no text behind it.
                at = stop.end() if stop else len(page) if tag in ("script", "style") else at
            if tag not in ("svg", "math"):
                now = None if tag not in INLINE else now
            continue
        if tag not in INLINE:
            now = None
        if close:
            end((tag,), tag in INLINE)
            continue
        if tag in CLOSES:
            end(CLOSES[tag], True)
        elif tag not in INLINE:
            end(("p",), True)
        if tag in VOID:
            continue
        number += 1
        is_open[tag] += 1
        stack.append(_Open(tag, number, attrs, stack[-1]))
    return found


def _clean(b: Block) -> str:
    return " ".join(html.unescape("".join(b.parts)).split())


def _score(b: Block, t: str, has_inside: bool) -> float:
    w, n = WEIGHTS, len(t)
    score = w["bias"] + w["long"] * min(1.0, n / 120)
    if b.outside:
        score += w["against" if b.outside == AGAINST else "hinted" if b.outside == HINTED else "named"]
    if b.inside:
        score += w["inside"]
    elif has_inside and b.outside <= HINTED:
        score += w["elsewhere"]
    if t[-1] in ".!?…:;\"'”’»)":
        score += w["sentence"]
    score += w["links"] * (b.linked / b.size if b.size else 0) * (0.3 if b.inside else 1)
    if b.heading:
        score += w["heading"]
    if n < 200 and not b.inside and _BOILER.search(t):
        score += w["phrase"]
    return score


def min_cut(n: int, towards: list[int], against: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source side of a minimum cut (Dinic's maximum flow).

    ``towards``/``against``: capacities from the source and to the sink;
    ``edges``: undirected (node, node, capacity).
    """
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, c: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        # What both terminals pull alike changes no cut.
        same = min(towards[i], against[i])
        if towards[i] > same:
            join(s, i, towards[i] - same, 0)
        elif against[i] > same:
            join(i, t, against[i] - same, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for a in queue:
            for e in out[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if not cap[e])
                del path[k:]
                a = to[path[-1]] if path else s
                continue
            edges_of = out[a]
            while turn[a] < len(edges_of):
                e = edges_of[turn[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(edges_of):
                path.append(edges_of[turn[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
            else:
                break


def labelled(page: str) -> list[tuple[str, float, bool]]:
    """(text, classifier's score, is it content by the cut) of each block of a page that has text."""
    pairs = [(b, t) for b in blocks(page) if (t := _clean(b))]
    has_inside = any(b.inside for b, _ in pairs)
    scores = [round(100 * _score(b, t, has_inside)) for b, t in pairs]
    if scores and max(scores) <= 0:
        # Nothing on the page is better: words that nothing speaks against are its text, however few.
        plain = [not b.outside and 2 * b.linked < b.size and any(map(str.isalnum, t)) and not _BOILER.search(t) for b, t in pairs]
        scores = [100 if ok else x for x, ok in zip(scores, plain)]
    edges, last_kind, last_grand = [], {}, {}
    for i, (b, _) in enumerate(pairs):
        if i:
            before = pairs[i - 1][0]
            row = ROW if b.parent != before.parent else ROW_KIND if b.kind == before.kind else ROW_PARENT
            edges.append((i - 1, i, round(100 * row)))
        for key, seen, weight in (((b.parent, b.kind), last_kind, SAME_KIND), (b.grandparent, last_grand, SAME_GRANDPARENT)):
            if key in seen:
                edges.append((seen[key], i, round(100 * weight)))
            seen[key] = i
    side = min_cut(len(pairs), [max(0, x) for x in scores], [max(0, -x) for x in scores], edges)
    return [(t, x / 100, keep) for (_, t), x, keep in zip(pairs, scores, side)]


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks, joined by a line feed."""
    return "\n".join(t for t, _, keep in labelled(page) if keep) if page else ""


def extract_text(page: Column) -> Column:
    """Main text of an HTML column; null and empty pages give an empty text.

    Pages may be of any length and depth; repeated rows give the same text each;
    an empty table gives no rows.
    """

    def extract(pages: pd.Series) -> pd.Series:
        texts = pages.map(main_text).astype(str)
        release()
        return texts

    return F.pandas_udf(extract, "string")(F.coalesce(page, F.lit("")))
