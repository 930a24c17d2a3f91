"""Main text of web pages by consensus paths of each host.

Every page scores its containers (text of their blocks, less what is linked)
and votes for the tag and class path of the best one, with digits taken out so
that pages of one layout agree.  Spark adds the votes by host; then each page
is read again and the container on its host's winning path is its article.

Elements that are hidden or named like a side part are left out, unless they hold
most of the unlinked text in the page's article and main elements or, where there is none,
of the page.  A header in an article or main element, or one named as that of an
article, holds its title and stays.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import broadcast_if_small, stored

_TAG = re.compile(r"</?[a-zA-Z]")
_TAG_NAME = re.compile(r"[^\s/>]+")
_STOPS = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
_CONTAINER = frozenset("article body center div main section td".split())
#: Elements that are never part of an article, and words of class, id and role that say so.
_ASIDE = frozenset("button dialog head menu nav select".split())
_OFTEN_ASIDE = frozenset("aside footer form header".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer form header masthead menu nav navbar navigation newsletter notice popup promo promoted related reply"
    " replies respond search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Those that can be longer than an article and yet are none.
_NEVER = frozenset(
    "ad ads advert adverts advertisement comment comments consent cookie cookies disqus popup promo promoted replies"
    " respond sponsor sponsored".split()
)
#: Behind one of the words above they say what kind of box the side part is in; a widget or form is too general for that.
_BOXES = frozenset(
    "area bar block bottom box button buttons container inner item items left link links list outer panel posts right section"
    " thread top wrap wrapper".split()
)
_BOXED = _NAMES - {"form", "widget"}
#: Before the last part of a name they say that the page has such a part or not, not that this is one.
_TELLING = frozenset("has have hide is no not show with without".split())
#: An open one is closed by the next of its kind, or by what cannot stand in it.
_CLOSES = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
           "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
           "option": frozenset(["option"])}
_ENDS_SEARCH = frozenset(["table", "ul", "ol", "dl", *_CONTAINER])
#: A header with one of them before its last part is an article's own.
_OF_ARTICLE = frozenset("article content entry post story".split())
#: Names of what leads into an article and may stand beside its container, as its h1 may.
_LEADS = frozenset("dek headline intro introduction lead lede standfirst subtitle summary teaser title".split())
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: A path of more characters goes on as a digest of itself.
LONGEST_PATH = 2_000


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, rest) in one pass: text, cdata, open (rest: attributes) and close.

    A tag ends at the first > outside quotes; a quote that is never closed is
    a character like others.  A tag, comment or declaration that is not closed
    takes the rest of the page, as in browsers.  Of elements whose content is no
    markup, such as script, nothing comes out.
    """
    at, end = 0, len(page)
    unclosed = {'"': end + 1, "'": end + 1}  # from here on the quote does not occur again

    def tag_end(i: int) -> int:
        while m := _STOPS.search(page, i):
            i = m.end()
            quote = m[0]
            if quote == ">":
                return i
            if i < unclosed[quote]:
                close = page.find(quote, i)
                if close < 0:
                    unclosed[quote] = i
                else:
                    i = close + 1
        return -1

    while at < end:
        less = page.find("<", at)
        if less < 0:
            yield "text", "", page[at:]
            return
        if less > at:
            yield "text", "", page[at:less]
        at = less
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            at = close + 3 if close >= 0 else end
        elif page.startswith("<![CDATA[", at):
            close = page.find("]]>", at + 9)
            yield "cdata", "", page[at + 9 : close if close >= 0 else end]
            at = close + 3 if close >= 0 else end
        elif page.startswith(("<!", "<?"), at):
            close = page.find(">", at)
            at = close + 1 if close >= 0 else end
        elif _TAG.match(page, at):
            closes = page[at + 1] == "/"
            name = _TAG_NAME.match(page, at + 1 + closes)
            at = tag_end(name.end())
            if at < 0:
                return
            tag, attributes = name[0].lower(), page[name.end() : at - 1]
            if closes:
                yield "close", tag, ""
                continue
            if tag in _RAW and not (tag == "svg" and _SELF_CLOSED.search(attributes)):
                m = _RAW[tag].search(page, at)
                at = m.end() if m else end
                continue
            yield "open", tag, attributes
        else:
            yield "text", "", "<"
            at += 1


class _Node:
    """An open element; `owner` is the innermost element around its text that a name or tag may leave out."""

    __slots__ = ("tag", "path", "out", "linked", "never", "main", "lead", "owner", "container", "depth", "up", "stop", "begin", "end", "score")

    def __init__(self, tag: str, path: str, up: _Node | None, depth: int = 0):
        self.tag, self.path, self.depth, self.up, self.score, self.begin, self.end = tag, path, depth, up, 0.0, 0, 0
        self.lead = False
        # the innermost element, itself included, that another can close or that ends the search for one
        self.stop = self if tag in _CLOSES or tag in _ENDS_SEARCH or up is None else up.stop
        self.out = self.linked = self.never = self.main = False
        self.owner, self.container = -1, None  # the next container around it
        if up is not None:
            self.out, self.linked, self.never, self.main, self.owner = up.out, up.linked, up.never, up.main, up.owner
            self.container = up if up.tag in _CONTAINER else up.container


def _attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag by their names in lower case; the first of a name counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), a or b or c)
    return found


def _parts(token: str) -> list[str]:
    """Words of a class, id or role: cut at capitals, hyphens, digits and the like."""
    return _WORDS.findall(_CAMEL.sub("-", token).lower())


def _named_aside(names: dict[str, str], in_main: bool) -> tuple[bool, bool]:
    """Whether class, id or role name a side part, and whether one that is never an article."""
    tokens = f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}".split()
    aside = never = False
    for token in tokens:
        parts = _parts(token)
        bare = len(parts)
        while bare and parts[bare - 1] in _BOXES:
            bare -= 1
        boxed = 0 < bare < len(parts)
        parts = parts[:bare]
        if not parts or parts[-1] not in (_BOXED if boxed else _NAMES) or len(parts) > 1 and parts[-2] in _TELLING:
            continue
        if parts[-1] == "header" and (in_main or len(parts) > 1 and parts[-2] in _OF_ARTICLE):
            continue
        aside = True
        never |= len(parts) == 1 and parts[0] in _NEVER
    return aside, never


def read_page(page: str) -> tuple[list[str], list[_Node], list[_Node]]:
    """The text blocks of a page in order, its containers with their blocks (begin to end) and scores, and where each block stands.

    A page that has no text but that of elements left out by name or tag gives
    theirs.  Time and memory are linear in the page, however its tags nest.
    """
    top = _Node("", "", None)
    stack, open_tags, containers = [top], Counter(), []
    raw: list[tuple[list[tuple[str, bool, int]], _Node]] = []  # of each block: (text, linked, owner) and where it stands
    held: list[tuple[str, bool, int]] = []
    around, sizes, mains = [], [], []  # of each element that may be left out: the one around it, its unlinked text, of that in main
    whole = in_main = 0

    def flush() -> None:
        if held:
            raw.append((held.copy(), stack[-1]))
            held.clear()

    def close(depth: int) -> None:
        for node in stack[depth:]:
            open_tags[node.tag] -= 1
            node.end = len(raw)
        del stack[depth:]

    for kind, tag, rest in pieces(page):
        inner = stack[-1]
        if kind in ("text", "cdata"):
            if not inner.out:
                held.append((rest if kind == "text" else rest.replace("&", "&amp;"), inner.linked, inner.owner))
            if not inner.never and not inner.linked:
                size = len(rest.strip())
                whole += size
                in_main += size * inner.main
                if inner.owner >= 0:
                    sizes[inner.owner] += size
                    mains[inner.owner] += size * inner.main
            continue
        if kind == "close":
            if open_tags[tag] > 0:
                depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                if tag in _BLOCK or any(n.tag in _BLOCK for n in stack[depth:]):
                    flush()
                close(depth)
            continue
        if tag in _BLOCK:
            flush()
            at = stack[-1].stop  # there are few between two that end the search
            while at.up is not None:
                if tag in _CLOSES.get(at.tag, ()):
                    close(at.depth)
                    break
                if at.tag in _ENDS_SEARCH:
                    break
                at = at.up.stop
        elif tag == "br":
            held.append((" ", False, -1))
        if tag in _VOID:
            continue
        names = _attributes(rest) if rest else {}
        up = stack[-1]
        step = ".".join([tag, *sorted(set(_WORDS.findall(names.get("class", "").lower())))])
        path = up.path if tag in ("html", "body") else f"{up.path}>{step}"  # either may be left out
        node = _Node(tag, path if len(path) <= LONGEST_PATH else f"#{xxhash.xxh64_hexdigest(path.encode('utf-8', 'surrogatepass'))}", up, len(stack))
        out = tag in _ASIDE
        aside, never = _named_aside(names, up.main) if names and tag not in ("html", "body") else (False, False)
        aside |= "hidden" in names or bool(_UNSEEN.search(names.get("style", "").lower()))
        node.lead = tag == "h1" or up.lead or bool(names) and any(w in _LEADS for x in ("class", "id") for w in _parts(names.get(x, "")))
        node.out, node.never = up.out or out, up.never or out or never
        node.main, node.linked = up.main or tag in ("article", "main"), up.linked or tag == "a"
        if aside or tag in _OFTEN_ASIDE and not (tag == "header" and up.main):
            node.owner = len(around)
            around.append(up.owner)
            sizes.append(0)
            mains.append(0)
        stack.append(node)
        open_tags[tag] += 1
        if tag in _CONTAINER and not node.out:
            node.begin = len(raw)
            containers.append(node)
    flush()
    close(1)

    for i in range(len(around) - 1, -1, -1):
        if around[i] >= 0:
            sizes[around[i]] += sizes[i]
            mains[around[i]] += mains[i]
    held_by, of = (mains, in_main) if in_main else (sizes, whole)
    off: list[bool] = []
    for i, up in enumerate(around):
        off.append(2 * held_by[i] <= of or up >= 0 and off[up])
    blocks, places = _blocks(raw, containers, off)
    if not blocks:
        off = [False] * len(off)
        blocks, places = _blocks(raw, containers, off)
    return blocks, [n for n in containers if n.owner < 0 or not off[n.owner]], places


def _blocks(raw: list, containers: list[_Node], off: list[bool]) -> tuple[list[str], list[_Node]]:
    """Texts of the blocks without what is left out, and their elements; sets the blocks and scores of the containers.

    A container's score is the weight of its own blocks and half the score of each container in it.
    """
    blocks, places, upto = [], [], [0]
    for parts, node in raw:
        kept = [(text, linked) for text, linked, owner in parts if owner < 0 or not off[owner]]
        block = " ".join(entities.unescape("".join(text for text, _ in kept)).split())
        if block:
            at = node if node.tag in _CONTAINER else node.container
            if at is not None:
                at.score += max(0, len(block) - 2 * sum(len(text) for text, linked in kept if linked))
            blocks.append(block)
            places.append(node)
        upto.append(len(blocks))
    for node in reversed(containers):  # those inside come first
        if node.container is not None:
            node.container.score += node.score / 2
    for node in containers:
        node.begin, node.end = upto[node.begin], upto[node.end]
    return blocks, places


def best_path(page: str) -> tuple[str, float] | None:
    """The generalised path and the score of the page's best container."""
    _, containers, _ = read_page(page)
    best = max(containers, key=lambda n: n.score, default=None)
    return (best.path, best.score) if best is not None and best.score > 0 else None


def _lead(node: _Node, places: list[_Node]) -> Iterator[int]:
    """Blocks before a container, within the one around it, that are headed or named as an article's lead."""
    if node.container is not None:
        for b in range(node.container.begin, node.begin):
            if places[b].lead:
                yield b


def article(page: str, path: str | None) -> str:
    """Text on the path; a page that has nothing there gives its own best container's.

    A title (h1) or lead that stands before the container, within the one around it, belongs to the text.
    """
    blocks, containers, places = read_page(page)
    own = [n for n in containers if n.path == path and n.begin < n.end]
    if not own:
        own = [n for n in (max(containers, key=lambda n: n.score, default=None),) if n is not None and n.begin < n.end]
    chosen = sorted({b for n in own for b in (*_lead(n, places), *range(n.begin, n.end))})
    return "\n\n".join(blocks[b] for b in chosen or range(len(blocks)))


def _votes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pages: Counter = Counter()
        scores: Counter = Counter()
        for host, page in zip(batch["host"], batch["html"]):
            if found := best_path(page):
                pages[host, found[0]] += 1
                scores[host, found[0]] += found[1]
        yield pd.DataFrame([(*k, n, scores[k]) for k, n in pages.items()], columns=["host", "path", "pages", "score"])


def _extract(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [article(page, path) for page, path in zip(batch["_html"], batch["_path"])]
        yield batch.drop(columns=["_html", "_path"]).assign(text=texts, n_chars=[len(t) for t in texts])


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; '' for none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def consensus_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path) with the path that most pages of the host vote for."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("html is not null")
    votes = rows.mapInPandas(_votes, "host string, path string, pages long, score double")
    votes = votes.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.sum("score").alias("score"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("pages", F.round("score", 3), "path")).alias("path"))


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per page with its main text.

    Blocks are joined by two line feeds, white space inside a block is one
    space.  A null or empty page gives an empty text.  A null or malformed url
    votes and is read under the empty host.  Of tied paths the one with the
    higher score, then the later in order, wins.  Repeated rows stay; other
    columns are not read.  An empty table gives no rows.

    Returns page_id, url, text, n_chars.
    """
    paths = stored(consensus_paths(pages, html, url), "paths").select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("_html")
    ).withColumn("_own", host_of(F.col("url")))
    found = rows.join(broadcast_if_small(paths), F.col("_own") == F.col("_host"), "left")
    found = found.select("page_id", "url", "_html", "_path")
    kind = rows.schema["page_id"].dataType.simpleString()
    return found.mapInPandas(_extract, f"page_id {kind}, url string, text string, n_chars long")
