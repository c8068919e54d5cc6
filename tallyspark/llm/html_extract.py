"""Main-text extraction with consensus paths of each host.

First pass: every page's containers are scored (text that is not links, in blocks of its own, with hints from tag and class
names), and the page votes for the generalised path of its best one: the tags from the body down, with class names whose
digits are blotted out. An article, main or content element around the best one stands for it if what else it holds is mostly not
links. Votes are counted by host in Spark. Second pass: a page is cut at all elements that have its host's
winning path, so that one odd page follows the other pages of its host; a page without such an element, or a host without a
majority, falls back on the page's own best container. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments inside the container are left out; the page's headline and lead are taken along where they stand
beside it.

What is left out is told by tag, role and hidden attribute, and by whole class names and ids (``ad-slot``, ``site-footer``, not
``overflow-hidden``); neither judges the elements with the winning path or those around them. Reading a page is linear in
its length: an element is looked for among open ones only if it is known to be open, and no end is searched for twice.
"""

from __future__ import annotations

import html
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, prepare
from .url_filter import host_of

#: Bytes of hosts and winning paths that are broadcast at most; beyond, pages are joined to them by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Share of a host's votes that its winning path needs, and of the best container's worth that another one under the body needs.
MAJORITY, BESIDE = 0.5, 0.25

# Element names by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_MUTE = frozenset("annotation annotation-xml audio canvas datalist noscript object select svg template video".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article body center div main section td".split())
_DROPPED = frozenset("aside button dialog footer head menu nav search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption"}, "td": {"td", "th", "caption"}, "th": {"td", "th", "caption"}, "option": {"option"}}
_SCOPES, _TABLE_PARTS = frozenset("caption table td th".split()), frozenset("caption tbody td tfoot th thead tr".split())
_LEFT_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

# Class names and ids of what is not the article. They count as a whole name, and as the first or last part of a compound whose other parts
# say where or in what shape it is (a sidebar's box, the site's footer), unless one end only states a condition. In other compounds they are a hint only.
_LEFT_OUT = frozenset(
    "ad ads advert advertisement advertisements adverts adsense advertising banner breadcrumb breadcrumbs captcha comment commentlist comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notification notifications outbrain pager pagination paywall popup promo promos promotion recommendations recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription taboola toc toolbar widget widgets".split()
)
_LEFT_OUT_LAST = _LEFT_OUT | frozenset("disclaimer notice notices overlay teaser teasers".split())
_LEFT_OUT_WHOLE = frozenset("hidden is-hidden d-none display-none invisible visually-hidden visuallyhidden sr-only screen-reader-text contact-form login-form mailing-form search-form searchform signup-form subscribe-form feedback".split())
_SHAPES = frozenset(
    "account all archive area article articles author back bar base big block blocks blog body bottom box btn bubble bundle button buttons callout card cards carousel cell center col column columns component compact container content copy count counter cta custom dark default desktop drawer dropdown embed end entry external featured feed field fixed flex floating follow frame full fullwidth global grid group header heading hero holder home horizontal icon icons image img inline inner item items label large latest layer leaderboard left level light line link links list lists live local locale logo main message middle mini mobile modern module more multi native news online optin outer page pane panel partner placeholder placement popular post posts pre primary print prompt reader readers recent rectangle region right row sec secondary section side simple site skyscraper slide slider slot small source spot sticky stories story stream strip sub submenu switcher tab tablet tabs tag tags target template this thread threads tile title tool tools top trigger txt unit unsubscribe us upper user vertical video view widgetized wide wp wrap wrapped wrapper zone".split()
)
_CONDITIONS = frozenset("active closed collapsed count disabled enabled expanded free has hide is layout long no not off on open opened overflow page show visible with without".split())
_LIKELY = frozenset("article articles blog body content entry main post posts story text".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++))?+|=)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""(=?+[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]++)))?+|[\s/=]""")
_LETTERS = frozenset(string.ascii_letters)
_DIGITS, _PARTS = re.compile(r"\d+"), re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_APART = str.maketrans("/|", "::")
_ZEROS, _LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}")


class Node:
    __slots__ = ("tag", "path", "parent", "own", "mute", "owner", "container", "hint", "label", "headers", "heading", "first", "holds", "outs", "top", "text", "links", "kept", "kept_links", "inner")

    def __init__(self, tag: str, parent: Node | None, path: int, label: str, own: int, hint: float):
        self.tag, self.parent, self.path, self.label, self.own, self.hint = tag, parent, path, label, own, hint
        self.mute = tag in _MUTE or parent is not None and parent.mute
        self.owner = parent.owner if self.mute and parent is not None else self
        self.container = self if parent is None or tag in _CONTAINER else parent.container
        self.headers = (parent.headers if parent is not None else 0) + (tag == "header")
        self.heading = tag in _HEADINGS or parent is not None and parent.heading
        self.first = tag == "h1" or parent is not None and parent.first
        self.holds, self.outs, self.top = tag in ("h1", "main") or tag == "article" and not own, 0, None
        self.text = self.links = self.kept = self.kept_links = self.inner = 0.0


#: Why an element is left out: by its tag; by its role or for being hidden; by its class or id; for being a form; by its class or id, unless it is prose.
TAG, ROLE, NAMED, FORM, HINTED = 1, 2, 3, 4, 5
#: Elements that are text of an article by themselves: their ids, which are often made from their own words, say nothing, and compounds neither.
_PROSE = _HEADINGS | {"p", "blockquote", "pre"}
#: Characters outside of links, and how many times those in links, that make an element with a doubtful name prose.
PROSE, UNLINKED = 80, 2


def _named_out(name: str, tag: str) -> int:
    """Whether a class name or id says (NAMED) or hints (HINTED) that an element is not part of an article; 0 if neither."""
    if name.lower() in _LEFT_OUT_WHOLE:
        return NAMED
    parts = [x.lower() for x in _PARTS.findall(name)]
    if not parts:
        return 0
    first, last = parts[0], parts[-1]
    if not (first in _LEFT_OUT and (len(parts) == 1 or last not in _CONDITIONS) or last in _LEFT_OUT_LAST and (len(parts) == 1 or first not in _CONDITIONS)):
        return 0
    if tag in _PROSE and (len(parts) > 1 or last in ("teaser", "teasers")):
        return 0
    return NAMED if all(x in _LEFT_OUT_LAST or x in _SHAPES for x in parts) else HINTED


def attributes(text: str) -> dict[str, str]:
    """The attributes in a start tag, names in lower case; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        if m[1]:
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _look(tag: str, attrs: str) -> tuple[str, int, float]:
    """An element's label in paths, why it is left out by itself (0: it isn't), and the weight of its text."""
    names, own, hint = "", TAG if tag in _DROPPED else FORM if tag == "form" else 0, 1.0
    if "=" in attrs or "idden" in attrs or "IDDEN" in attrs:
        found = attributes(attrs)
        classes = html.unescape(found["class"]).split() if "class" in found else []
        marks = classes + ([found["id"]] if found.get("id") and tag not in _PROSE else [])
        if "hidden" in found and found["hidden"].lower() != "until-found" or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").strip().lower() in _LEFT_OUT_ROLES:
            own = own or ROLE
        elif not own and tag != "main":
            said = {_named_out(x, tag) for x in marks}
            own = NAMED if NAMED in said else HINTED if HINTED in said else 0
        if any(not _LIKELY.isdisjoint(_PARTS.findall(x.lower())) for x in marks):
            hint = 1.3
        if classes:
            names = "." + ".".join(sorted(_DIGITS.sub("#", x).translate(_APART) for x in classes))
    if tag in ("article", "main"):
        hint = 1.5
    return tag + names, own, hint


def _decode(text: str) -> str:
    if "&" in text:
        if "&#" in text:  # numbers of any length, none of which Python should have to read whole
            text = _LARGE.sub("&#1114112", _ZEROS.sub("&#", text))
        text = html.unescape(text)
    return " ".join(text.split())


def _closes(attrs: str) -> bool:
    """Whether a start tag's last stroke closes the element, and isn't the end of a value without quotes."""
    m = None
    for m in _ATTR.finditer(attrs):  # noqa: B007
        pass
    return m is not None and not m[4]


class Page:
    """A page's text blocks in order (element, text, length of its links), and all its block elements, parents first."""

    def __init__(self, page: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.root = Node("body", None, 0, "body", 0, 1.0)
        self.nodes, self.blocks = [self.root], []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, nodes, blocks, paths = [self.root], self.nodes, self.blocks, self.paths
        scopes: list[dict[str, int]] = [{}]  # open elements by name since each of _SCOPES that is open
        tables: list[dict[str, int]] = [{}]  # open parts of each open table
        words: list[str] = []
        ends: dict[str, int] = {}  # where the next end of an element that hides its content is known to be; -1 if there is none any more
        link = linked = at = 0
        n, last, tag_at = len(page), page.rfind(">"), _TAG.match

        def flush(owner: Node | None = None) -> None:
            nonlocal words, linked
            if words:
                if text := _decode("".join(words)):
                    blocks.append((owner or stack[-1].owner, text, min(len(text), linked)))
                words, linked = [], 0

        def pop() -> None:
            node = stack.pop()
            if node.tag in _SCOPES:
                scopes.pop()
            if node.tag == "table":
                tables.pop()
            scopes[-1][node.tag] -= 1
            if node.tag in _TABLE_PARTS:
                tables[-1][node.tag] -= 1

        def push(node: Node) -> None:
            stack.append(node)
            scopes[-1][node.tag] = scopes[-1].get(node.tag, 0) + 1
            if node.tag in _TABLE_PARTS:
                tables[-1][node.tag] = tables[-1].get(node.tag, 0) + 1
            if node.tag in _SCOPES:
                scopes.append({})
            if node.tag == "table":
                tables.append({})

        def opened(tag: str, attrs: str) -> Node:
            label, own, hint = _look(tag, attrs)
            parent = stack[-1]
            return Node(tag, parent, paths.setdefault((parent.path, label), len(paths) + 1), label, own, hint)

        def ending(tag: str) -> int:
            if 0 <= ends.get(tag, 0) < at:
                m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                ends[tag] = m.start() if m is not None else -1
            return ends[tag]

        def is_open(tag: str) -> bool:
            if tag == "table":
                return len(tables) > 1
            return bool((tables[-1] if tag in _TABLE_PARTS else scopes[-1]).get(tag))

        while at < n:
            spot = page.find("<", at)
            piece = page[at : spot if spot >= 0 else n]
            if piece and not stack[-1].mute:
                words.append(piece)
                if link:
                    linked += len(piece)
            if spot < 0:
                break
            follows = page[spot + 1 : spot + 2]
            if follows in ("!", "?") or follows == "/" and page[spot + 2 : spot + 3] not in _LETTERS:
                comment = page.startswith("<!--", spot)
                end = page.find("-->", spot + 2) if comment else page.find(">", spot) if spot < last else -1
                if end < 0 and not comment:  # no tag can end any more
                    break
                at = end + (3 if comment else 1) if end >= 0 else n
                continue
            if follows not in _LETTERS and follows != "/":
                if not stack[-1].mute:
                    words.append("<")
                at = spot + 1
                continue
            if spot >= last:
                break
            m = tag_at(page, spot)
            if m is None:  # a quote that never ends: from here on every tag ends at the next sign for it
                tag_at = _PLAIN_TAG.match
                m = tag_at(page, spot)
            at, closing, tag, attrs = m.end(), bool(m[1]), m[2].lower(), m[3]
            empty = attrs.endswith("/") and _closes(attrs)
            if tag in _RAW:
                if closing or empty:
                    continue
                if (end := ending(tag)) >= 0:
                    stop = page.find(">", end)
                    at = stop + 1 if stop >= 0 else n
                elif tag in ("script", "style"):
                    break
                continue
            if tag == "a":
                link = max(0, link - 1) if closing else link + (not empty)
            elif tag == "br":
                if not stack[-1].mute:
                    words.append(" ")
            elif tag in _MUTE:
                if closing:
                    if scopes[-1].get(tag):
                        while stack[-1].tag != tag:
                            pop()
                        pop()
                elif not empty and ending(tag) >= 0:
                    push(opened(tag, ""))
            elif tag in _BLOCK:
                muted = stack[-1].mute
                if closing and is_open(tag):
                    owner = stack[-1].owner
                    while stack[-1].tag != tag:
                        pop()
                    if not stack[-1].mute:
                        flush(owner)
                        link = 0
                    pop()
                    continue
                if not muted:
                    flush()
                if closing or tag == "html":
                    continue
                if not muted:
                    if stack[-1].tag in ("p", "head"):
                        pop()
                    if stack[-1].tag in _SAME_ENDS.get(tag, ()):
                        pop()
                        if tag == "tr" and stack[-1].tag == "tr":
                            pop()
                if tag == "body":
                    continue
                node = opened(tag, attrs)
                nodes.append(node)
                if tag not in _VOID and not empty:
                    push(node)
        flush()

    def score(self, lenient: int = 0) -> None:
        """outs: elements that are left out from an element upwards. inner: what a container's own blocks are worth, with a part of what its
        children hold. kept and kept_links: of all that stands in an element and is not left out.

        A form that holds more than half of the page's text is the page, and so is an element that does and has the headline, a main element or an
        article's tag, whatever its names; one whose name only hints is left out unless it holds prose. lenient: 1 if class names and ids don't count, 2 if roles and hidden attributes don't either."""
        nodes, whole = self.nodes, 0.0
        for x in nodes:
            x.text = x.links = x.kept = x.kept_links = x.inner = 0.0
        for node, text, linked in self.blocks:
            node.kept += len(text) - linked
            node.kept_links += linked
            whole += len(text) - linked
        for x in reversed(nodes):
            if x.parent is not None:
                x.parent.kept += x.kept
                x.parent.kept_links += x.kept_links
                x.parent.holds = x.parent.holds or x.holds
        for x in nodes:
            most = 2 * x.kept > whole
            counts = x.own == TAG or x.own == ROLE and lenient < 2 or x.own == NAMED and not lenient and not (most and x.holds) or x.own == FORM and not most
            counts = counts or x.own == HINTED and not lenient and not (most and x.holds) and (x.kept < PROSE or x.kept < UNLINKED * x.kept_links)
            x.outs = counts + (x.parent.outs if x.parent is not None else 0)
        for x in nodes:
            x.kept = x.kept_links = 0.0
        for node, text, linked in self.blocks:
            if not node.headers or node.heading:
                node.container.text += len(text)
                node.container.links += linked
            if not node.outs:
                node.kept += len(text)
                node.kept_links += linked
        for x in reversed(nodes):
            up = x.parent
            if up is not None:
                up.kept += x.kept
                up.kept_links += x.kept_links
            if not x.outs:
                if x.container is x:
                    x.inner += max(0.0, x.text - 2 * x.links) * x.hint
                    if up is not None:
                        up.inner += 0.6 * x.inner
                elif up is not None:
                    up.inner += x.inner

    def best(self) -> Node | None:
        """The best container, or the outermost article, main or content element around it whose other text is mostly not links. A page
        without text in any container that counts is judged without its class names and ids, then without roles and hidden attributes."""
        for lenient in (0, 1, 2):
            self.score(lenient)
            usable = [x for x in self.nodes if x.container is x and not x.outs and x.inner > 0]
            if usable:
                best = up = max(usable, key=lambda x: x.inner)
                while (up := up.parent) is not None:
                    if up.container is up and up.tag != "body" and not up.outs and up.hint > 1 and up.kept - best.kept >= 2 * (up.kept_links - best.kept_links):
                        best = up
                return best
        return None

    def tops(self) -> list[Node]:
        """The best container, and those beside it right under the body, in page order, that hold prose of at least ``BESIDE`` of its worth: an article need not have
        one element of its own."""
        best, root = self.best(), self.root
        if best is root and not any(node.container is root and not node.outs and (node.heading or not node.headers) for node, _, _ in self.blocks):
            best = max((x for x in self.nodes if x.container is x and x.parent is root and not x.outs), key=lambda x: x.inner, default=root)  # the body has no text of its own
        if best is None or best.parent is not root:
            return [best] if best is not None else []
        beside = lambda x: x.parent is root and not x.outs and x.inner >= BESIDE * best.inner and x.kept >= UNLINKED * x.kept_links
        return [x for x in self.nodes if x is best or x.container is x and beside(x)]

    def path_of(self, node: Node) -> str:
        labels = []
        while node is not None:
            labels.append(node.label)
            node = node.parent
        return "/".join(reversed(labels))

    def at(self, paths: str) -> list[Node]:
        """The elements with one of the paths, which strokes divide."""
        spots = set()
        for path in paths.split("|"):
            spot, labels = 0, path.split("/")
            for label in labels[1:]:
                spot = self.paths.get((spot, label), -1)
            if labels[0] == "body" and spot >= 0:
                spots.add(spot)
        return [x for x in self.nodes if x.path in spots]

    def cut(self, tops: list[Node]) -> str:
        """The text in ``tops``, without what is left out below them, and with the headline beside them."""
        ends = set(map(id, tops))
        for x in self.nodes:
            x.top = x.parent.top if x.parent is not None and x.parent.top is not None else x if id(x) in ends else None
        found = [i for i, (node, _, _) in enumerate(self.blocks) if (top := node.top) is not None and node.outs == top.outs and (node.headers == top.headers or node.heading)]
        return "\n".join(self.blocks[i][1] for i in [*self._headline(tops[0], found), *found])

    def _headline(self, top: Node, found: list[int]) -> list[int]:
        """Blocks that stand right before the article and begin with a first-order heading, if it has none itself."""
        if not found or any(self.blocks[i][0].first for i in found):
            return []
        around, up = set(), top
        while up is not None:
            around.add(id(up))
            up = up.parent
        out: list[int] = []
        for i in range(found[0] - 1, -1, -1):
            node, text, linked = self.blocks[i]
            if node.outs > top.outs:
                continue
            if id(node.container) not in around or node.headers > top.headers or 2 * linked > len(text):
                return []
            out.append(i)
            if node.first:
                return out[::-1]
            if node.tag not in ("p", "h2", "h3"):
                return []
        return []


def best_container(page: str) -> tuple[str, float]:
    """The generalised path of the best container (paths, if the article has several under the body) and its score; an empty path for a page without text."""
    read = Page(page)
    tops = read.tops()
    return "|".join(dict.fromkeys(map(read.path_of, tops))), max((x.inner for x in tops), default=0.0)


def extract(page: str, path: str | None) -> str:
    """The main text of a page whose host's articles stand at ``path`` (None: by the page's own best container): of all elements
    with that path."""
    read = Page(page)
    best = read.tops()
    tops = [x for x in read.at(path) if x.own not in (TAG, ROLE)] if path else []
    text = read.cut(tops) if tops else ""
    if not text and best:
        paths = {x.path for x in best}
        text = read.cut([x for x in read.nodes if any(x is b for b in best) or x.path in paths and x.inner > 0])
    return text


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES, majority: float = MAJORITY) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, path (the host's winning path, null if it has none).

    Null and empty pages have an empty text. Pages without a host in their url take no part in votes; of paths with equally many votes of a host
    that with the larger sum of scores wins, then the last in order; of equally good containers of a page the first. Broken markup is read as far as it
    goes: unclosed elements end with what holds them, a cut-off page ends with its last character, a page in which a quote swallows all
    that follows is read without quotes from there. Very long pages take time in proportion to their length, one at a time. Repeated
    pages are pages of their own, with a vote each. Other columns play no part. Pages are sent through a shuffle by host only if the winning
    paths have more than ``broadcast_bytes``; the result is the same.
    """
    spark = prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, scores = zip(*(best_container(x or "") for x in batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    votes = rows.where("host != ''").select("host", "html").mapInArrow(vote, "host string, path string, score double").where("path != ''")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    winners = counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("best"), F.sum("votes").alias("all")).where(F.col("best.votes") >= majority * F.col("all"))
    winners = keep(winners.select("host", F.col("best.path").alias("path")), "paths")
    few = (winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0) <= broadcast_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x or "", p) for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)], names=["page_id", "url", "text", "n_chars", "path"])

    named = rows.join(F.broadcast(winners) if few else winners.hint("merge"), "host", "left").select("page_id", "url", "html", "path")
    return named.mapInArrow(cut, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long, path string")


#: The same in DuckDB's SQL for pages whose article is one element of its own, of headings and paragraphs, as in the test tables.
SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:h1|p)>') AS b FROM pages),
t AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) FOR x IN b] AS b FROM a),
j AS (SELECT page_id, url, array_to_string([x FOR x IN b IF x <> ''], chr(10)) AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j
"""
