"""Main text of web pages by tree scoring.

A page is read once into a tree of block elements. Every run of inline text (a paragraph) earns points for its
length and its commas, which go to the element it stands in and, in shrinking shares, to the next ancestors (``SHARES``).
Points of an element are discounted by its link density. The best container and those siblings that score or read like
text are kept; menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never
enter.

What stands around an article is told by element names, roles, and words of classes and ids, but a word alone never
empties a page: all text is read, and the tree decides. A class that names nothing but such things (``cookie-banner``,
``comments``) takes the element out, unless it wraps the page's only article and half of its text. One that begins or
ends with a telling word (``sidebar-right``, ``comments-open``, ``login-guide``), and a form, take it out unless most of
the page's text or of its article elements is in it, and no larger article is elsewhere; readers' comments stay out
wherever there is an article or a first heading beside them. One that only holds such a word (``share-price``,
``search-results``) takes it out outside an article, unless most of the page's text is in it; inside an article or main,
paragraphs and the like stay, and others stay if they hold a paragraph and are not mostly links. Ids of paragraphs,
headings and sections are places to link to and say nothing there. Elements whose names, roles or attributes say that
they are no text or are hidden (``nav``, ``aside``, ``footer``, ``script``) are never read. Links in lists are text
inside an article element; elsewhere a list of links is a menu. A button inside a paragraph is part of its sentence,
elsewhere it is a control. Mathematics is text.

Reading and scoring take time in proportion to the page, however deep or broken its tree is.

Defined results: null, empty and text-free html give the empty string; a tag that is never completed ends the page, as
in a browser; character references decode as in HTML5; white space of any kind inside a block becomes one space;
``n_chars`` counts code points. Nulls in other columns pass through, repeated rows stay repeated; further columns are
carried, but for the html and those named like text or n_chars in any case, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp select".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav noscript object ol optgroup option"
    " p pre search section summary svg table tbody td template tfoot th thead tr ul canvas audio video".split()
)
DROPPED = frozenset(
    "aside audio button canvas dialog dir footer legend menu nav noscript object option optgroup search svg"
    " template video".split()
)
CLOSES_P = BLOCK - frozenset("button caption tbody td tfoot th thead tr option optgroup object svg canvas".split())
SCOPE = frozenset("table td th caption button object template svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text counts for the parent, not for themselves.
LEAVES = HEADINGS | frozenset("p pre li dd dt td th figcaption blockquote summary caption address".split())
#: Pairs of the elements that some start tags end, and the elements that keep them from doing so.
WATCHED = (
    (frozenset(["p"]), SCOPE),
    (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir", "td", "th", "table"])),
    (frozenset(["dd", "dt"]), frozenset(["dl", "td", "th", "table"])),
    (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    (frozenset(["tr"]), frozenset(["table"])),
)
#: The pair that a start tag minds, beside the paragraph's.
MINDS = {"li": 1, "dd": 2, "dt": 2, "td": 3, "th": 3, "tr": 4}
IN_PAIRS = {name: tuple(k for k, pair in enumerate(WATCHED) if name in pair[0] | pair[1]) for name in BLOCK}
#: What the element a paragraph stands in and the ancestors above it get of its points.
SHARES = (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15)
# Words in class names and ids, and roles, of what is not the article.
CHROME = frozenset(
    "nav navbar navigation navi menu menubar header masthead topbar footer foot sidebar sidenav aside ad ads advert"
    " adverts advertisement advertising adsense adslot adbox adsbygoogle banner sponsor sponsored sponsors promo"
    " promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay lightbox newsletter"
    " subscribe subscription signup login signin register social share sharing related recommend recommended"
    " recommendations comment comments commentlist disqus respond reply replies breadcrumb breadcrumbs pagination"
    " pager toolbar widget widgets skip skiplink form search outbrain taboola copyright disclaimer toc hidden"
    " invisible".split()
)
# Of these, the words that tell even beside others.
TELLING_WORDS = frozenset(
    "nav navbar navigation navi menu menubar masthead topbar footer sidebar sidenav ad ads advert adverts advertisement"
    " advertising adsense adslot adbox adsbygoogle sponsor sponsored sponsors promo promotion promoted cookie cookies"
    " consent gdpr popup modal lightbox newsletter subscribe subscription signup login signin comment comments commentlist"
    " disqus breadcrumb breadcrumbs pagination pager outbrain taboola".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words that say nothing of what an element holds, and words of readers' comments.
STRUCTURE = frozenset("list section area thread box wrap wrapper container block slot unit item items panel bar button buttons link links count icon label toggle close".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
NEGATED = frozenset("no has with without not is".split())

SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)>")
TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+)*+)>"
)
ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
TELLING = re.compile(r"class|id|role|hidden|style|aria", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
COMMENT_END = re.compile(r"--!?>")
RAW_ENDS: dict[str, re.Pattern[str]] = {}
COMMAS = str.maketrans({c: "," for c in "،，、"})


#: What a label says of its element.
NOTHING, HOLDS, TELLS, NAMES, HIDDEN = range(5)


def _label(label: str) -> tuple[int, bool]:
    """What a class or id says: it names something around the article, tells of it at an end, or holds such a word; whether of readers' comments."""
    parts = [p.lower() for p in PARTS.findall(label)]
    if not parts or parts[0] in NEGATED:
        return NOTHING, False
    first, last = parts[0], "" if NEGATED.intersection(parts[:-1]) else parts[-1]
    readers = not READERS.isdisjoint(parts)
    if not CHROME.isdisjoint(parts) and all(p in CHROME or p in STRUCTURE or p.isdigit() for p in parts):
        return NAMES, readers
    if first not in CHROME and last not in CHROME:
        return NOTHING, False
    return TELLS if first in TELLING_WORDS or last in TELLING_WORDS else HOLDS, readers


def chrome(attributes: str, place: bool = False) -> tuple[int, bool]:
    """What an element's attributes say of it, the most of all labels, and whether one speaks of readers' comments.

    ``place``: its id is a place to link to.
    """
    found, readers = NOTHING, False
    if not attributes or not TELLING.search(attributes):
        return found, readers
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HIDDEN, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HIDDEN, False
        if name == "role" and value.strip().lower() in ROLES:
            return HIDDEN, False
        if name == "class" or name == "id" and not place:
            for level, own in map(_label, value.split()):
                found, readers = max(found, level), readers or own
    return found, readers


class Page:
    """The block tree of one page; parents come before their children."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent = ["#"], [-1]
        self.doubtful: list[tuple[int, int, bool, bool]] = []  # elements with words of things around articles, what these say, whether of readers, whether in an article
        self.blocks: list[tuple[int, str, int, int]] = []  # owner, text, characters in links, links
        self._read(html)

    def _read(self, html: str) -> None:
        tags, parents, blocks = self.tag, self.parent, self.blocks
        stack, inline = [0], []  # inline: names of dropped inline elements that are open
        is_open: Counter[str] = Counter()  # open elements by name; headings count as one name
        watched: list[list[int]] = [[] for _ in WATCHED]  # depths of the open elements of each pair
        text: list[str] = []
        linked = links = pressed = 0  # pressed: characters in buttons
        anchor = -1  # depth at which the open link began
        button = False
        inline_at = 0  # depth at which the first of inline began
        dropped = 0  # depth of the outermost dropped element; 0: none

        def flush() -> None:
            nonlocal linked, links, pressed
            if text:
                joined = " ".join("".join(text).split())
                if joined and not (pressed and pressed >= len(joined)):
                    blocks.append((stack[-1], joined, linked, links))
                text.clear()
            linked = links = pressed = 0

        def cut_to(depth: int) -> None:
            nonlocal anchor, dropped, button
            if depth < inline_at:
                inline.clear()
            for node in stack[depth:]:
                is_open["h" if tags[node] in HEADINGS else tags[node]] -= 1
            for depths in watched:
                while depths and depths[-1] >= depth:
                    depths.pop()
            del stack[depth:]
            button = False
            if anchor >= depth:
                anchor = -1
            if dropped >= depth:
                dropped = 0

        def end(pair: int) -> None:
            """Ends the nearest open element of a pair, if nothing between keeps it open."""
            if watched[pair] and tags[stack[watched[pair][-1]]] in WATCHED[pair][0]:
                cut_to(watched[pair][-1])

        pos, size = 0, len(html)
        while pos < size:
            at = html.find("<", pos)
            if at < 0:
                at = size
            if at > pos and not dropped and not inline:
                piece = unescape(html[pos:at])
                text.append(piece)
                if anchor >= 0:
                    linked += len(piece.strip())
                if button:
                    pressed += len(piece.strip())
            if at == size:
                break
            m = SIMPLE.match(html, at)
            if m is None:
                nxt = html[at + 1 : at + 2]
                if html.startswith("<!--", at):
                    if html.startswith(("<!-->", "<!--->"), at):
                        pos = html.index(">", at) + 1
                    else:
                        close = COMMENT_END.search(html, at + 4)
                        pos = close.end() if close else size
                    continue
                if nxt in ("!", "?") or nxt == "/" and not html[at + 2 : at + 3].isalpha():
                    close = html.find(">", at)
                    pos = size if close < 0 else close + 1
                    continue
                if not (nxt.isascii() and nxt.isalpha() or nxt == "/"):
                    if not dropped and not inline:
                        text.append("<")
                    pos = at + 1
                    continue
                m = TAG.match(html, at)
                if m is None:  # the tag is never completed
                    break
                attributes = m[3]
            else:
                attributes = ""
            pos = m.end()
            name = m[2].lower()
            kind = "h" if name in HEADINGS else name
            if m[1]:
                if button and name == "button":
                    button = False
                elif name in BLOCK:
                    if name == "body":
                        continue
                    flush()
                    if is_open[kind]:
                        depth = len(stack) - 1
                        while tags[stack[depth]] != name and not (kind == "h" and tags[stack[depth]] in HEADINGS):
                            depth -= 1
                        cut_to(depth)
                elif name == "a":
                    anchor = -1
                elif inline and name == inline[-1]:
                    inline.pop()
                continue
            if name in RAW:
                if name not in RAW_ENDS:
                    RAW_ENDS[name] = re.compile(rf"</{name}(?=[\s/>])", re.I)
                close = RAW_ENDS[name].search(html, pos)
                pos = close.start() if close else size
                if close:
                    at = html.find(">", pos)
                    pos = size if at < 0 else at + 1
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    flush()
                continue
            if name == "button" and not dropped and not inline and tags[stack[-1]] in LEAVES and chrome(attributes)[0] < NAMES:
                button = True
                continue
            if name not in BLOCK:
                if name == "a":
                    anchor = len(stack)
                    links += 1
                if inline:
                    if name == inline[-1]:
                        inline.append(name)
                elif not dropped and attributes and chrome(attributes)[0] >= NAMES:
                    inline.append(name)
                    inline_at = len(stack)
                continue
            flush()
            if name == "body":
                if len(stack) == 1:
                    tags.append(name)
                    parents.append(0)
                    stack.append(len(tags) - 1)
                continue
            if name in CLOSES_P:
                end(0)
                if name in HEADINGS and tags[stack[-1]] in HEADINGS:
                    cut_to(len(stack) - 1)
            if name in MINDS:
                end(MINDS[name])
            within = is_open["article"] + is_open["main"] > 0
            tags.append(name)
            parents.append(stack[-1])
            stack.append(len(tags) - 1)
            is_open[kind] += 1
            for pair in IN_PAIRS[name]:
                watched[pair].append(len(stack) - 1)
            if not dropped:
                place = within and (name in LEAVES or name == "section")
                mark, readers = chrome(attributes, place) if attributes and name != "main" else (NOTHING, False)
                if name in DROPPED or name == "header" and not within or mark == HIDDEN:
                    dropped = len(stack) - 1
                elif name == "form" or mark >= TELLS:
                    self.doubtful.append((len(tags) - 1, max(mark, TELLS), readers, within))
                elif mark == HOLDS and name != "article" and not (within and name in LEAVES):
                    self.doubtful.append((len(tags) - 1, mark, readers, within))
        flush()

    def _doubts(self) -> None:
        """Takes out what doubtful elements hold, unless it reads like the article: those that surely name something else first."""
        tags, parents = self.tag, self.parent
        marked = {i for i, level, _, _ in self.doubtful if level >= TELLS}
        for level in (NAMES, TELLS, HOLDS):
            asked = [d for d in self.doubtful if d[1] == level]
            if not asked:
                continue
            size, linked, told, heads = [0] * len(tags), [0] * len(tags), [False] * len(tags), [0] * len(tags)
            for owner, text, in_links, _ in self.blocks:
                size[owner] += len(text)
                linked[owner] += in_links
                told[owner] = told[owner] or tags[owner] in LEAVES and (len(text) >= 25 or text[-1] in ".!?")
                heads[owner] += tags[owner] == "h1"
            articles = [0] * len(tags)  # characters in article elements
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] in ("article", "main") and i not in marked:
                    articles[i] = size[i]
                if i:
                    for held in (size, linked, heads, articles):
                        held[parents[i]] += held[i]
                    told[parents[i]] = told[parents[i]] or told[i]
            whole, out = size[0], [False] * len(tags)
            for i, _, readers, within in asked:
                elsewhere = articles[0] - articles[i]
                if level == HOLDS:
                    stays = 2 * size[i] >= whole or within and told[i] and 2 * linked[i] < size[i]
                elif readers:
                    stays = level == TELLS and 2 * size[i] >= whole and not elsewhere and heads[i] == heads[0]
                elif level == NAMES:
                    stays = 2 * size[i] >= whole and articles[i] > 0 and not elsewhere
                else:
                    stays = (2 * size[i] >= whole or 2 * articles[i] > articles[0]) and 2 * elsewhere <= size[i]
                out[i] = not stays
            for i in range(1, len(tags)):
                out[i] = out[i] or out[parents[i]]
            self.blocks = [b for b in self.blocks if not out[b[0]]]

    def text(self) -> str:
        """The kept blocks in page order."""
        if self.doubtful:
            self._doubts()
        tags, parents, blocks = self.tag, self.parent, self.blocks
        if not blocks:
            return ""
        n = len(tags)
        points, size, linked, links = [0.0] * n, [0] * n, [0] * n, [0] * n
        for owner, text, in_links, many in blocks:
            size[owner] += len(text)
            linked[owner] += in_links
            links[owner] += many
            earned = len(text) / 25 if len(text) < 25 else 1 + min(len(text) // 100, 3)
            earned += text.translate(COMMAS).count(",")
            node = parents[owner] if tags[owner] in LEAVES else owner
            for share in SHARES:
                if node < 0:
                    break
                points[node] += earned * share
                node = parents[node]
        for i in range(n - 1, 0, -1):
            size[parents[i]] += size[i]
            linked[parents[i]] += linked[i]
            links[parents[i]] += links[i]
        density = [min(1.0, linked[i] / size[i]) if size[i] else 0.0 for i in range(n)]
        bonus = {"article": 5.0, "main": 3.0, "div": 1.0, "section": 1.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "table": -1.0}
        score = [(points[i] + bonus.get(tags[i], 0.0)) * (1 - density[i]) if points[i] else 0.0 for i in range(n)]
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[parents[i]].append(i)
        best = max(range(n), key=lambda i: (score[i], -i))
        up, around = best, -1
        while up > 0:
            if tags[up] == "article" or tags[up] == "main" and around < 0:
                around = up
            up = parents[up]
        if around > 0:
            best = around
        if tags[best] not in ("article", "main"):
            while parents[best] > 0 and tags[parents[best]] != "body":
                near = (i for i in children[parents[best]] if i != best and tags[i] not in LEAVES)
                if not any(score[i] >= max(1.0, 0.2 * score[best]) and density[i] < 0.5 for i in near):
                    break
                best = parents[best]
        kept = {best}
        for i in children[parents[best]] if best else ():
            if i == best:
                continue
            if tags[i] in ("h1", "h2") and i < best and density[i] < 0.5:
                kept.add(i)
            elif tags[i] in ("p", "blockquote", "pre"):
                if size[i] > 80 and density[i] < 0.25:
                    kept.add(i)
            elif tags[i] not in LEAVES and score[i] >= max(5.0, 0.2 * score[best]) and density[i] < 0.5:
                kept.add(i)
        state, article = [0] * n, [False] * n  # state 1: kept, 2: a menu
        for i in range(n):
            above = state[parents[i]] if i else 0
            article[i] = tags[i] == "article" or i > 0 and article[parents[i]]
            state[i] = above or (1 if i in kept else 0)
            if state[i] == 1 and i not in kept and not article[i] and links[i] >= 3 and density[i] > 0.6 and tags[i] in ("ul", "ol", "div", "section", "table", "dl"):
                state[i] = 2
        return " ".join(text for owner, text, _, _ in blocks if state[owner] == 1)


def main_text(html: str | None) -> str:
    """The article of one page."""
    return Page(html).text() if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html; map-only, in Arrow batches."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def article(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    kept = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    return pages.select(*[F.col(f"`{c}`") for c in kept], article(F.col(html)).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
