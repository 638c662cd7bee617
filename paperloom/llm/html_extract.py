"""Main text of web pages by consensus container paths of each host.

Every page is read into blocks: runs of text between block tags, each with the path of its
container. A path is made of the enclosing tags with their classes, digits left out, down to the
nearest container (article, main, section, div, td, body), or to the article around it; it is written as
its last step and a hash of all steps. Blocks in menus, headers, footers, asides,
forms, notices, adverts, scripts, styles and reader comments are dropped. A page gives each of its
paths its share of the page's text outside links (of all text if all is links), and a part of that to
enclosing containers while it is LEAST_VOTE or more; a host's votes are added in Spark, and the path
with most of them wins (ties: the first path by code point). Pages are then read again: their text is
that of all blocks under the host's path; a page without such text uses its own best path.

Character references are decoded, white space within a block becomes one space, blocks are joined
by one space in page order. Null and empty pages give the empty text. The host is that of the url
without a port, lower-cased; pages without one form one host. Rows that repeat an id each get a row,
and each one votes; other columns are ignored, whatever their names; an empty table gives an empty
result. Broken mark-up never fails: unclosed tags end with their parents, and time and memory are in
proportion to the page, however deep its tags are nested.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, cut, released, small_batches

CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "blockquote"}
DROPPED = {"head", "title", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe", "svg", "button", "select", "textarea", "object", "canvas", "menu", "dialog"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Tags that a start tag ends if they are open in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role values that mark what isn't the article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "contentinfo", "complementary", "search", "alert"}

#: Of these, what tells a reader comment or a teaser that is an article of its own.
ARTICLE_MARKS = {"comment", "comments", "reply", "related", "recommended", "sponsored", "promo", "ad"}
#: First words of class names that tell about the layout only.
LAYOUT = {"no", "has", "with", "without"}
FADE = 0.6
#: Votes are counted in millionths; smaller shares are none.
LEAST_VOTE = 1e-6
#: Characters of a path's last step that are written before its hash.
STEP_CHARS = 80
LISTS = {"ul", "ol", "dl", "table"}

#: Hosts whose paths are broadcast (of some 100 bytes each), and parts of a host's pages beyond that.
MAX_BROADCAST = 200_000
PARTS = 64

_TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", regex.S)
_LABEL = regex.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", regex.I)
_WORD = regex.compile(r"[a-z]+")
_CAMEL = regex.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = regex.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", regex.I)
_DIGITS = regex.compile(r"\d+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or tag in ("body", "html", "main"):
        return False
    for m in _LABEL.finditer(attrs):
        value = _CAMEL.sub(" ", m[2] or m[3] or m[4] or "")
        for name in value.split():
            words = _WORD.findall(name.lower())
            if not words or words[0] in LAYOUT:
                continue
            if words[0] in ARTICLE_MARKS if tag == "article" else words[0] in MARKS or words[-1] in MARKS:
                return True
    return bool(_HIDDEN.search(attrs))


def _step(tag: str, attrs: str) -> str:
    names = ""
    for m in _LABEL.finditer(attrs):
        if m[1].lower() == "class":
            names = "".join("." + x for x in sorted(set(_DIGITS.sub("", m[2] or m[3] or m[4] or "").split())))
    return tag + names


class Container:
    """A place for text: its path, the container around it, and whether it lies in the container looked for."""

    __slots__ = ("path", "around", "wanted")

    def __init__(self, path: str, around: Container | None, target: str | None):
        self.path, self.around = path, around
        self.wanted = path == target or around is not None and around.wanted


class _Open:
    """An open tag: hash of its path, container of its text, whether its text is dropped, whether in an article; the places of the nearest container and of the nearest one that ends list items."""

    __slots__ = ("tag", "hash", "home", "dropped", "inside", "bound", "item_bound")


def blocks(page: str, target: str | None = None) -> Iterator[tuple[Container, str, int]]:
    """(container, text, characters within links) of each wanted block, in page order."""
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of the open tags of a name
    parts: list[str] = []
    linked = links = 0
    root = Container("", None, target)

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        done = (stack[-1].home if stack else root, text, linked) if text else None
        parts, linked = [], 0
        return done

    def take(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1].dropped):
            text = entities.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())

    def shut(tag: str) -> None:
        """End the nearest open tag of the name, with all within it."""
        nonlocal links
        if places.get(tag):
            first = places[tag][-1]
            while len(stack) > first:
                gone = stack.pop()
                places[gone.tag].pop()
                links -= gone.tag == "a"

    at, low = 0, None
    for m in iter(lambda: _TOKEN.search(page, at), None):
        take(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag, attrs = m["tag"].lower(), m["attrs"]
        block = tag not in INLINE
        if block and (done := flush()):
            yield done
        if m["end"]:
            shut(tag)
            continue
        if tag in VOID:
            continue
        if block and tag not in ENDS and places.get("p") and places["p"][-1] > stack[-1].bound:
            shut("p")
        near = max((places[t][-1] for t in ENDS.get(tag, ()) if places.get(t)), default=-1)
        if near >= 0 and near >= stack[-1].item_bound:
            shut(stack[near].tag)
        above = stack[-1] if stack else None
        new = _Open()
        new.tag, step = tag, _step(tag, attrs)
        new.hash = xxhash.xxh64_intdigest(f"{above.hash if above else ''}>{step}".encode("utf-8", "surrogatepass"))
        in_article = bool(places.get("article"))
        new.home = above.home if above else root
        if tag in CONTAINERS and not in_article:
            new.home = Container(f"{step[:STEP_CHARS]}#{new.hash:016x}", new.home, target)
        new.inside = above is not None and above.inside or tag in ("article", "main")
        new.dropped = above is not None and above.dropped or _unwanted(tag, attrs) or (tag == "header" and not (above and above.inside))
        here = len(stack)
        new.bound = here if tag in CONTAINERS else above.bound if above else -1
        new.item_bound = here if tag != "td" and (tag in CONTAINERS or tag in LISTS) else above.item_bound if above else -1
        stack.append(new)
        places.setdefault(tag, []).append(here)
        links += tag == "a"
        if tag in RAW:
            low = low if low is not None else page.lower()
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
    take(page[at:])
    if done := flush():
        yield done


def scores(page: str) -> dict[str, float]:
    """Share of the page's text outside links by container path; FADE of it counts for the next enclosing container."""
    own: dict[str, list] = {}
    for home, text, linked in blocks(page):
        sums = own.setdefault(home.path, [home, 0, 0])
        sums[1] += max(0, len(text) - linked)
        sums[2] += len(text)
    plain = sum(x[1] for x in own.values())
    total = plain or sum(x[2] for x in own.values())
    out: dict[str, float] = {}
    for home, n, n_all in own.values():
        share = (n if plain else n_all) / total if total else 0.0
        while home is not None and share >= LEAST_VOTE:
            out[home.path] = out.get(home.path, 0.0) + share
            share *= FADE
            home = home.around if home.around is not None and home.around.path else None
    return {p: v for p, v in out.items() if v > 0}


def best(votes: dict[str, float]) -> str | None:
    return min(votes, key=lambda p: (-votes[p], p)) if votes else None


def text_under(page: str, path: str | None) -> str:
    """Text of the blocks whose container is at the path or inside it."""
    if path is None:
        return ""
    return " ".join(t for home, t, _ in blocks(page, path) if (home.wanted if path else not home.path))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, str], float] = {}
        for host, page in zip(column(batch, "host"), column(batch, "html")):
            for path, share in scores(page or "").items():
                sums[host, path] = sums.get((host, path), 0.0) + share
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array([round(v * 1_000_000) for v in sums.values()], pa.int64())], names=["host", "path", "vote"])
    released()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, path in zip(column(batch, "html"), column(batch, "path")):
            page = page or ""
            out.append(text_under(page, path) or text_under(page, best(scores(page))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winning path, from rows (host, html)."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, vote long").groupBy("host", "path").agg(F.sum("vote").alias("vote"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("vote"), "path"))
    return votes.withColumn("_n", first).where("_n = 1").select("host", "path")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    small_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    paths = cut(host_paths(slim), "html-paths")
    # A row for each host: beyond the bound texts are dealt out by host, a large one in several parts.
    if paths.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        joined = slim.join(F.broadcast(paths), "host", "left")
    else:
        part = F.pmod(F.xxhash64("id", "url"), F.lit(PARTS)).cast("int")
        copies = paths.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = slim.withColumn("part", part).join(copies, ["host", "part"], "left")
    joined = joined.select("id", "url", "html", "path")
    types = dict(pages.dtypes)
    found = joined.mapInArrow(_texts, f"id {types[id_col]}, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
