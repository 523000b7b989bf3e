"""Main text of web pages by consensus container paths of each host.

First pass: each page's containers are scored by the running text in them, and the best ones vote for their generalised
path (tags and classes, numbers masked). Every path that has text blocks is voted on as well: it is counted on how many pages it
stands, and how often its texts come again on other pages. Spark sums the votes by host. Paths whose texts mostly recur, and
which hold little of the host's text, are furniture, whatever their names or language.

Second pass: each page is read again without its host's furniture, and the containers on its host's winning path give the text,
with what stands around them in the same article, or, without one, on the page: headings and paragraphs, but nothing that has
as much text as a rival to the container, and nothing that is mostly links. A page without that path, or with hardly any text on
it, falls back on its own best container.

Tags and roles decide what furniture is in the first place. A class or id does so only if all its words are names of furniture
or of places, never for an article, a main element or the body, and, but for reader comments, not for what holds most of a page's
running text and all that stands in its articles.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import discard, lean, staged

# Names of HTML and common names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("nav footer aside form script style noscript iframe svg math canvas button select textarea template object embed audio video dialog menu head title xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
FURNITURE = frozenset(
    "nav navbar navigation menu topbar footer sidebar aside ad ads advert adverts advertisement advertising promo promotion sponsor sponsored banner cookie cookies consent gdpr notice notices notification popup modal overlay comment comments disqus respond replies share sharing social related recommended breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login widget widgets toolbar masthead form search".split()
)
PLACES = frozenset("site page main top bottom left right primary secondary global box bar block wrapper wrap container inner outer section area list links link buttons button icons posts post article content text message panel thread form media item items".split())
COMMENTS = frozenset("comment comments disqus respond replies".split())
CONTENT = frozenset("article content post entry story main text body articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body center blockquote".split())
KEPT = frozenset("html body main".split())
#: A start tag of one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PART = re.compile(r"[a-z]+|\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def onward(trail: int, step: str) -> int:
    return xxhash.xxh64_intdigest(step.encode(), trail) >> 1


@dataclass
class Page:
    """Elements in page order, parents first, and text blocks."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    hard: list[bool] = field(default_factory=list)  # furniture by tag, role or style
    soft: list[bool] = field(default_factory=list)  # furniture by name, unless most of the page's text is in it
    comment: list[bool] = field(default_factory=list)
    step: list[str] = field(default_factory=list)
    bonus: list[bool] = field(default_factory=list)
    trail: list[int] = field(default_factory=list)  # hash of the path, 63 bits
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # (node, text, characters in links)

    def add(self, tag: str, parent: int, hard: bool, soft: bool, comment: bool, step: str, bonus: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.hard.append(hard or (parent >= 0 and self.hard[parent]))
        self.soft.append(soft)
        self.comment.append(comment)
        self.step.append(step)
        self.bonus.append(bonus)
        self.trail.append(onward(self.trail[parent], step) if parent >= 0 else 0)
        return len(self.tag) - 1

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.step[node])
            node = self.parent[node]
        return ">".join(reversed(steps))

    def on_path(self, path: str) -> set[int]:
        trail = 0
        for step in path.split(">"):
            trail = onward(trail, step)
        return {n for n, t in enumerate(self.trail) if n and t == trail and self.path(n) == path}

    def under(self, roots: set[int]) -> list[bool]:
        """Whether each element is one of the roots or stands in one."""
        inside: list[bool] = []
        for n, up in enumerate(self.parent):
            inside.append(n in roots or (up >= 0 and inside[up]))
        return inside


def furniture_name(value: str) -> tuple[bool, bool, bool]:
    """Whether one of the names in a class or id stands for page furniture, for reader comments, and for a site's header."""
    found = said = header = False
    for name in value.split():
        words = set(PART.findall(CAMEL.sub("-", name).lower()))
        words = {w for w in words if not w.isdigit()}
        if words & FURNITURE and words <= FURNITURE | PLACES:
            found = True
            said |= bool(words & COMMENTS)
        header |= "header" in words and words <= {"header"} | PLACES - CONTENT
    return found, said, header


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t") else {}


def parse(source: str) -> Page:
    """Elements and text blocks of a page, with the end tags that HTML implies; broken and cut-off markup is read as far as it goes."""
    page = Page()
    stack = [page.add("#", -1, False, False, False, "", False)]
    text: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                node = stack[-1]
                while page.tag[node] in INLINE and page.parent[node] >= 0:
                    node = page.parent[node]
                page.blocks.append((node, words, linked))
            linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    def pop_to(depth: int) -> None:
        nonlocal in_link
        for node in stack[depth:]:
            in_link -= page.tag[node] == "a"
        del stack[depth:]

    at, end = 0, len(source)
    lower = None
    while at < end:
        m = TAG.search(source, at)
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, raw = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if page.tag[stack[i]] == name), 0)
            if name not in INLINE:
                flush()
            if depth and (name not in INLINE or all(page.tag[n] in INLINE for n in stack[depth:])):
                pop_to(depth)
            continue
        if name in VOID:
            if name == "br":
                text.append(" ")
            elif name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
            wanted = SIBLINGS.get(name, ())
            stop = SCOPE.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                t = page.tag[stack[i]]
                if t in wanted or (t == "p" and name in ENDS_P):
                    pop_to(i)
                    break
                if t in stop or t not in INLINE and t not in SIBLINGS and not wanted:
                    break
                if t in ("table", "td", "th", "div", "section", "article", "button", "blockquote") and t not in wanted:
                    break
        known = _attributes(raw)
        named = (known.get("class", ""), known.get("id", ""))
        words = [x for v in named for x in PART.findall(CAMEL.sub("-", v).lower())]
        hard = name in DROPPED and name != "form" or known.get("role", "").lower() in ROLES or "hidden" in known or known.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(known.get("style", "").lower()))
        soft, comment, header = name == "form", False, False
        if name not in KEPT and name not in INLINE and name not in HEADINGS:
            for found, said, top in map(furniture_name, named):
                soft, comment, header = soft or found, comment or said, header or top
        if name == "article" and not comment:
            soft = header = False
        if (header or name == "header") and not any(page.tag[n] in ("article", "main") or page.bonus[n] for n in stack):
            hard, soft = hard or name == "header", True
        classes = sorted({re.sub(r"\d+", "#", c) for c in known.get("class", "").lower().split()})
        bonus = name in ("article", "main") or not CONTENT.isdisjoint(words) and name in CONTAINERS - {"body"}
        node = page.add(name, stack[-1], hard, soft, comment, ".".join([name, *classes]), bonus)
        if raw.rstrip().endswith("/") and name in ("svg", "math", "path", "use"):
            continue
        if name in RAW:
            lower = lower if lower is not None else source.lower()
            to = lower.find(f"</{name}", at)
            at = end if to < 0 else to
            close = source.find(">", at)
            at = end if close < 0 else close + 1
            continue
        stack.append(node)
        in_link += name == "a"
    flush()
    return page


def _worth(words: str, linked: int) -> int:
    return max(len(words) - 2 * linked, 0) + 20 * words.count(",")


def kept_blocks(page: Page) -> list[tuple[int, str, int]]:
    """Blocks outside page furniture; of a header inside an article its headings and paragraphs."""
    total, stated = [0] * len(page.tag), [0] * len(page.tag)  # text in an element, and what of it stands in an article
    in_article = page.under({n for n, t in enumerate(page.tag) if t in ("article", "main") and not page.comment[n]})
    for node, words, linked in page.blocks:
        if not page.hard[node]:
            total[node] += _worth(words, linked)
            stated[node] += len(words) if in_article[node] else 0
    for n in range(len(total) - 1, 0, -1):
        total[page.parent[n]] += total[n]
        stated[page.parent[n]] += stated[n]

    def kept(by_name: bool) -> list[tuple[int, str, int]]:
        bad, heading, header = [False], [False], [False]
        for n in range(1, len(page.tag)):
            up = page.parent[n]
            named = by_name and page.soft[n] and (page.comment[n] or 2 * total[n] <= total[0] or stated[n] < stated[0])
            bad.append(bad[up] or page.hard[n] or named)
            heading.append(heading[up] or page.tag[n] in HEADINGS or page.tag[n] == "p")
            header.append(header[up] or page.tag[n] == "header")
        return [x for x in page.blocks if not bad[x[0]] and (heading[x[0]] or not header[x[0]])]

    return kept(True) or kept(False)


def container_scores(page: Page, blocks: list[tuple[int, str, int]]) -> dict[int, float]:
    """Running text in each container: in full for what stands in it directly, less for each container in between."""
    inner = [0.0] * len(page.tag)
    some = [False] * len(page.tag)
    for node, words, linked in blocks:
        inner[node] += _worth(words, linked)
        some[node] = True
    scores: dict[int, float] = {}
    for n in range(len(inner) - 1, 0, -1):
        if some[n]:
            within = page.tag[n] in CONTAINERS
            if within:
                scores[n] = inner[n] * (1.5 if page.bonus[n] else 1.0)
            inner[page.parent[n]] += inner[n] * (0.6 if within else 1.0)
            some[page.parent[n]] = True
    return scores


def widened(page: Page, node: int) -> int:
    """The outermost article or main element around a container, or else the outermost element of the page."""
    best = top = node
    while node > 0:
        top = node
        if page.tag[node] in ("article", "main"):
            best = node
        node = page.parent[node]
    return best if page.tag[best] in ("article", "main") else top


def best_container(page: Page, scores: dict[int, float]) -> int:
    return max(scores, key=lambda n: (scores[n], -n), default=0)


def without(page: Page, blocks: list[tuple[int, str, int]], furniture: frozenset[int]) -> list[tuple[int, str, int]]:
    """The blocks that are not on the host's furniture paths; all of them, if nothing else has text."""
    left = [x for x in blocks if page.trail[x[0]] not in furniture] if furniture else blocks
    return left if any(_worth(words, linked) for _, words, linked in left) else blocks


def main_text(source: str, path: str | None, furniture: frozenset[int] = frozenset()) -> str:
    """The text of a page, given its host's winning path and furniture (hashes of paths), if it has any."""
    page = parse(source)
    blocks = without(page, kept_blocks(page), furniture)
    scores = container_scores(page, blocks)
    core = best_container(page, scores)
    own = widened(page, core)
    # articles side by side on one path count together
    roots = page.on_path(page.path(own)) & scores.keys() if page.tag[own] in ("article", "main") else {own}
    agreed = page.on_path(path) & scores.keys() if path else set()
    theirs = page.under(agreed)
    worth = sum(_worth(words, linked) for node, words, linked in blocks if theirs[node])
    if agreed and 4 * worth >= scores.get(core, 0) / (1.5 if page.bonus[core] else 1.0):
        around = {widened(page, n) for n in agreed}
        roots = around if all(page.tag[n] in ("article", "main") for n in around) else {min(around)}
        blocks = without_rivals(page, blocks, roots, agreed, theirs, worth)
        core = min(agreed)
    inside = page.under(roots or {0})
    if page.tag[min(roots, default=0)] not in ("article", "main"):
        # beside the container, what is mostly links isn't article
        near = theirs if core in agreed else page.under({core})
        return "\n".join(words for node, words, linked in blocks if inside[node] and (near[node] or 2 * linked <= len(words)))
    return "\n".join(words for node, words, _ in blocks if inside[node])


def without_rivals(page: Page, blocks: list[tuple[int, str, int]], roots: set[int], agreed: set[int], theirs: list[bool], worth: int) -> list[tuple[int, str, int]]:
    """The blocks but those in branches beside the agreed containers that have at least half as much running text as these.

    A branch is what stands beside a container, or beside something that holds one.
    """
    holds = set()
    for n in agreed:
        while n >= 0 and n not in holds:
            holds.add(n)
            n = page.parent[n]
    branch: list[int] = []
    for n, up in enumerate(page.parent):
        branch.append(n if up in holds and n not in holds and up not in agreed else branch[up] if up >= 0 else -1)
    size: dict[int, int] = {}
    for node, words, linked in blocks:
        if not theirs[node] and branch[node] >= 0:
            size[branch[node]] = size.get(branch[node], 0) + _worth(words, linked)
    # paragraphs beside a container are text of their own, not rivals
    return [x for x in blocks if theirs[x[0]] or branch[x[0]] < 0 or page.tag[branch[x[0]]] not in CONTAINERS | {"ul", "ol", "dl", "table"} or 2 * size[branch[x[0]]] < worth]


VOTES = "host string, path string, place long, text long, n long, worth long, low long, high long"


def page_votes(source: str, most: int) -> list[tuple]:
    """Rows (path, place, text, n, worth, low, high): for the page (place 0), its best containers (path), each path with blocks (place),
    and each different text on such a path. low and high: a hash of the page's longest block, by which pages are told apart."""
    page = parse(source)
    blocks = kept_blocks(page)
    scores = container_scores(page, blocks)
    top = sorted(scores, key=lambda n: (-scores[n], n))[:most]
    out: list[tuple] = [(page.path(n), None, None, round((1000 if n == top[0] else 200) * scores[n] / scores[top[0]]), 0, 0, 0) for n in top if scores[n] > 0]
    longest = max((words for _, words, _ in blocks), key=len, default="")
    whole = xxhash.xxh64_intdigest(longest.encode("utf-8", "replace")) >> 1
    places: dict[int, int] = {}
    texts = set()
    article = page.under({n for n, t in enumerate(page.tag) if t in ("article", "main")})
    for node, words, linked in blocks:
        if page.tag[node] == "h1" and article[node]:
            continue  # an article's title is no furniture, though others have it too
        place = page.trail[node]
        places[place] = places.get(place, 0) + _worth(words, linked)
        texts.add((place, xxhash.xxh64_intdigest(words.encode("utf-8", "replace")) >> 1))
    out.append((None, 0, None, 1, sum(places.values()), whole, whole))
    out += [(None, place, None, 1, worth, whole, whole) for place, worth in places.items() if place]
    out += [(None, place, text, 1, 0, whole, whole) for place, text in texts if place]
    return out


def _vote_batches(most: int):
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 6]
    names = [x.split()[0] for x in VOTES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [(h, *v) for h, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for v in page_votes(source, most)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            columns = [part.column(k).to_pylist() for k in (2, 3, 4)]
            texts = [main_text(s, p, frozenset(f or ())) for s, p, f in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    """Host of an absolute URL in small letters, without user and port; else empty."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def host_paths(pages: DataFrame, most: int = 3, least_pages: int = 4, support: float = 0.05, recurring: float = 0.6, small: float = 0.4) -> DataFrame:
    """(host, path, furniture): the container path with the most votes of each host's pages, and the hashes of its furniture paths.

    A path is furniture if at least `least_pages` pages, and the share `support` of the host's pages, have it, the share `recurring`
    of its texts stands on it on other pages too (pages with the same longest block are one page here: copies don't make
    furniture), and it holds at most the share `small` of the host's running text. By `support` a host has at most
    1 / support times as many of them as its mean page has paths.
    """
    own = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    votes = own.mapInArrow(lean(_vote_batches(most)), VOTES)
    votes = votes.groupBy("host", "path", "place", "text").agg(F.sum("n").alias("n"), F.sum("worth").alias("worth"), (F.min("low") < F.max("high")).alias("again"))
    votes = staged(votes, "extract-votes")
    best = votes.where("path is not null").groupBy("host").agg(F.max(F.struct("n", "path")).alias("best")).select("host", "best.path")
    whole = votes.where("place = 0").select("host", F.col("n").alias("pages"), F.col("worth").alias("all"))
    texts = votes.where("text is not null").groupBy("host", "place").agg(F.sum("n").alias("texts"), F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)).alias("again"))
    seen = votes.where("place <> 0 and text is null").select("host", "place", "n", "worth").join(texts, ["host", "place"]).join(whole, "host")
    bad = seen.where((F.col("n") >= least_pages) & (F.col("n") >= support * F.col("pages")) & (F.col("again") >= recurring * F.col("texts")) & (F.col("worth") <= small * F.col("all")))
    out = staged(best.join(bad.groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("furniture")), "host", "left"), "extract-paths")
    discard(votes)
    return out


def extract_text(pages: DataFrame, salts: int = 16) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Blocks are joined by one newline, white space inside a block is one space, references are decoded. Null html counts as
    empty, pages without text give an empty string, pages without a host vote together; of containers with equal scores the
    first wins, of paths with equal votes the last by code points; very long pages are read whole; repeated rows come out as
    often as they went in; an empty table gives an empty result; further columns, whatever their names, are left out. A host of
    fewer than four pages has no furniture paths of its own.
    """
    paths = host_paths(pages).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = own.join(paths, ["host", "salt"], "left").select("page_id", "url", "html", "path", "furniture")
    return joined.mapInArrow(lean(_text_batches), "page_id long, url string, text string, n_chars long")
