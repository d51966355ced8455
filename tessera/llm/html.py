"""Main text of web pages by equivalence classes of template tokens.

1. Each page becomes tokens: elements, told apart by their path from the root with class and id and by their place among
   like siblings, and texts of blocks outside articles, told apart by path and wording.
2. Over the pages of a host, a token's occurrence vector (its count in each page) is summed up as a fingerprint, an
   exclusive or of hashes of (page, count). Tokens with equal fingerprints are an equivalence class. Classes that are
   frequent (in SUPPORT of the host's pages, MIN_PAGES at least) and large (MIN_TOKENS tokens) are valid: what a template
   writes comes together, what the data brings comes alone. (html and body, which any page has, may be alone.)
3. Valid classes are nested into a tree, the template: an element stays only if the element around it does, a text only
   inside such an element and, page by page, only where it keeps its class's order; what breaks the order is data.
4. What is left are slots. How much text each element's slots hold over all pages tells which of them is the article:
   from the root down, as long as one element inside holds nearly all of the text (SHARE), so that no second part of an
   article is lost on the way; less is enough if HTML calls what lies there an article, which also counts more. Template texts and links don't count, nor do
   elements that HTML or the words of class, id and role call menus, headers, footers, sidebars, notices, adverts, forms
   or comments: none of these, and nothing inside one, is ever the article, however much it holds (but what is only so
   called by its class or is a form, and stands around an article with a title, is the page).
5. A page's main text is what stands in the article's slots, less parts named as such inside it. Inside an article
   wording never counts as template, so copies of an article stay whole. If no element of the template holds most of the
   text, all slots are main text, less template texts and named parts. A page without text in those slots, or whose host
   has too few pages for a template, is read by its own elements: its articles, else all that isn't named as another part.

Counting pre-aggregates in each task, so a host with a third of all pages is some rows from each task. Of a host's
template, only the article's path and, without one, template texts go to the pages; they are broadcast below a checked
size, else joined by a shuffle that AQE splits where skewed. Pages are parsed twice and never collected by host.

Nulls: a null html is an empty page; a null URL's host is ''. Repeated rows are rows of their own. Pages of any length
and depth are read whole. Ties between elements go to the first on the page. Broken markup is read as browsers do in the
main: stray ends are dropped, open elements end where their parents do. Empty tables give empty results; columns that
clash with the added ones are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import slices, small_side, table, written

MIN_PAGES = 3
MIN_TOKENS = 2
SUPPORT = 0.8
#: Share of an element's text that one inside must hold to be the article's place instead, so that what stands beside it is
#: known to be short; and the share if HTML says that an article lies there.
SHARE, ARTICLE_SHARE = 0.85, 0.6
#: What a character counts for that in articles; those in links or in parts named as no main text count nothing.
ARTICLE = 4.0

#: Fixed names of HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
OUT = frozenset("nav header footer aside form head button select dialog menu fieldset object canvas audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for an element that a start tag ends stops.
FENCES = frozenset("ul ol dl table select article section main div body html".split())
#: Elements that hold parts of pages, of which an article can be one; others hold text itself.
TOP = frozenset("html body".split())
CONTAINERS = frozenset("div section article main center table tbody tr td form".split()) | TOP
#: Words in class, id or role by which an element is not main text, if it has no others but those of the second set.
HINTS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo "
    "notice notices cookie cookies consent alert popup modal overlay newsletter subscribe signup login form search comment comments reply replies disqus "
    "share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar complementary contentinfo".split()
)
PLAIN = frozenset(
    "main page site top bottom left right middle inner outer upper lower first last col column row grid box block area section sections zone region panel pane wrap wrapper container holder "
    "list lists item items link links button buttons bar strip content contents body text group set global primary secondary slot unit fixed sticky large small mobile desktop".split()
)
MAIN = frozenset(("article", "main"))

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Names:
    """Paths of elements and what is known of them, kept between pages."""

    def __init__(self):
        self.paths: dict[tuple[int, str, str], int] = {}
        self.hints: dict[str, bool] = {}

    def path(self, parent: int, name: str, sign: str) -> int:
        key = (parent, name, sign)
        out = self.paths.get(key)
        if out is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            out = self.paths[key] = hashed(f"{parent}/{name}.{sign}")
        return out

    def hinted(self, sign: str) -> bool:
        """Whether a name in the sign is made of hints (and plain words): ad, main-menu, cookieNotice, but not social-science."""
        out = self.hints.get(sign)
        if out is None:
            if len(self.hints) > 100_000:
                self.hints.clear()
            names = [{w.lower() for w in WORD.findall(name)} | {w for w in re.split(r"[^a-z]+", name.lower()) if w in HINTS} for name in sign.split()]
            out = self.hints[sign] = any(words & HINTS and words <= HINTS | PLAIN for words in names)
        return out


def signs(attributes: str) -> str:
    """The values of class, id and role."""
    if "=" not in attributes:
        return ""
    return " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)).strip()


@dataclass
class Page:
    """The elements of a page in order: parent (the root is 0), path, name and whether named as no main text; and its

    blocks: text, the element that each stands in, and how many of its characters are in links."""

    parent: list[int]
    path: list[int]
    name: list[str]
    named: list[bool]
    blocks: list[tuple[str, int, int]]

    def around(self) -> list[bool]:
        """Whether each element is, or stands in, a part named as no main text."""
        out = [False]
        for k in range(1, len(self.parent)):
            out.append(out[self.parent[k]] or self.named[k])
        return out

    def inside(self, which: Callable[[int], bool]) -> list[int]:
        """For each element 1 inside an element that which() picks, 2 if also inside a named part in there, else 0."""
        out = [0]
        for k in range(1, len(self.parent)):
            around = out[self.parent[k]]
            if around == 0:
                out.append(int(which(k)))
            else:
                out.append(2 if around == 2 or self.named[k] and self.name[k] != "header" else 1)
        return out

    def weights(self) -> list[float]:
        """How much the text in each element counts for."""
        named = self.around()
        articles = self.inside(lambda k: self.name[k] == "article" and not named[k])
        held = [0.0] * len(self.parent)
        for text, k, linked in self.blocks:
            if not named[k]:
                held[k] += (len(text) - min(linked, len(text))) * (ARTICLE if articles[k] == 1 else 1.0)
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        return held


def parsed(page: str, names: Names) -> Page:
    out = Page([0], [0], [""], [False], [])
    stack = [0]
    parts: list[str] = []
    seen: Counter = Counter()  # like siblings so far
    opened: Counter = Counter()  # names on the stack
    at, block, linked, links, n = 0, 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = unescape(text)
            text = " ".join(text.split())
            if text:
                out.blocks.append((text, block, linked))
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            opened[out.name[e]] -= 1
        links = opened["a"]
        del stack[k:]

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:  # an end tag
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                own = out.name[stack[k]]
                if own == name:
                    close(k)
                    break
                if name in INLINE and own not in INLINE:
                    break
        else:
            attributes = m[3] if m[2] else m[6]
            if name not in INLINE:
                flush()
                if name not in VOID:
                    ends = CLOSES.get(name, ())
                    for k in range(len(stack) - 1, 0, -1) if opened["p"] or any(opened[x] for x in ends) else ():
                        own = out.name[stack[k]]
                        if own == "p" or own in ends:
                            close(k)
                            break
                        if own in FENCES:
                            break
            sign, up = signs(attributes), stack[-1]
            seen[up, name, sign] += 1
            out.parent.append(up)
            out.path.append(names.path(out.path[up], name, f"{sign}.{seen[up, name, sign]}"))
            out.name.append(name)
            out.named.append(name in OUT or bool(sign) and name != "main" and names.hinted(sign))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else n
                continue
            if name in MAIN or name == "h1":  # what stands around an article with a title is the page, not a part of it
                inner = max((k for k, e in enumerate(stack) if out.name[e] in MAIN), default=0) if name == "h1" else 0
                for k, e in enumerate(stack):
                    if out.name[e] == "form" or k < inner and out.name[e] not in OUT:
                        out.named[e] = False
            if name not in VOID and not attributes.endswith("/"):
                stack.append(len(out.parent) - 1)
                opened[name] += 1
                links = opened["a"]
        if name not in INLINE or not parts:
            block = stack[-1]
    flush()
    return out


def text_token(text: str, path: int) -> int:
    return hashed(f"{path}\t{text}")


TOKEN = "token: long, n: long, text: boolean, up: long, holds: double, place: long, part: int"


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its tokens: their counts, whether texts, the element around, how much text they hold, their place,

    and whether the article can stand in them (1), be one of them (2) or surely goes no deeper (3). Elements of text lines are none."""
    names = Names()
    kind = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64()), ("text", pa.bool_()), ("up", pa.int64()), ("holds", pa.float64()), ("place", pa.int64()), ("part", pa.int32())]))
    for batch in slices(batches, "html"):
        rows: list[list[dict]] = []
        for html in batch.column("html").to_pylist():
            page = parsed(html or "", names)
            holds, named = page.weights(), page.around()
            seen: dict[int, dict] = {}
            base = [0]  # the element of each that is none of a line
            for k in range(1, len(page.path)):
                name, up = page.name[k], base[page.parent[k]]
                base.append(up if name in INLINE else k)
                if name not in INLINE:
                    seen[page.path[k]] = {"token": page.path[k], "n": 1, "text": False, "up": page.path[up], "holds": holds[k], "place": k, "part": 0 if named[k] else 3 if name == "article" else (name in CONTAINERS) + (name in CONTAINERS and name not in TOP)}
            articles = page.inside(lambda k: page.name[k] in MAIN)
            for j, (text, k, linked) in enumerate(page.blocks):
                if not articles[k]:
                    t = text_token(text, page.path[k])
                    have = seen.setdefault(t, {"token": t, "n": 0, "text": True, "up": page.path[base[k]], "holds": 0.0, "place": j, "part": 0})
                    have["n"] += 1
                    have["holds"] += 0.0 if named[k] else len(text) - min(linked, len(text))
            rows.append(list(seen.values()))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rows, kind)], ["host", "tokens"])


def classes(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """host, token, class (fingerprint of its occurrence vector), pages, size (of the class) and what else is known of

    the tokens of valid classes of pages (host, html)."""
    rows = pages.mapInArrow(tokens_of, f"host string, tokens array<struct<{TOKEN}>>").withColumn("_row", F.monotonically_increasing_id())
    tokens = rows.select("host", "_row", F.explode("tokens").alias("t")).select("host", "_row", "t.*")
    by_token = tokens.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("_row", "n")).alias("class"), F.first("text").alias("text"), F.first("up").alias("up"), F.first("part").alias("part"),
        F.sum("holds").alias("holds"), F.sum("place").alias("places"),
    )
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).where(F.col("host_pages") >= min_pages)
    frequent = by_token.where(F.col("pages") >= min_pages)
    frequent = frequent.join(hosts, "host").where(F.col("pages") >= support * F.col("host_pages"))
    size = Window.partitionBy("host", "class", "pages")
    return frequent.withColumn("size", F.count(F.lit(1)).over(size)).where((F.col("size") >= min_tokens) | (F.col("part") == 1))


def nested(tokens: list[dict]) -> dict[int, dict]:
    """The template's elements by path: those of valid classes with an unbroken line to the root."""
    elements = {t["token"]: t for t in tokens if not t["text"]}
    out: dict[int, dict] = {}
    for path in elements:
        line = []
        while path in elements and path not in out:
            line.append(path)
            path = elements[path]["up"]
        if path == 0 or path in out:
            out |= {p: elements[p] for p in line}
    return out


def article(elements: dict[int, dict], texts: Iterable[dict] = ()) -> int | None:
    """The path of the element that holds the text that is no template's; None if no element of the template does."""
    inner: dict[int, list[int]] = {}
    holds = {p: t["holds"] for p, t in elements.items()}

    def up(p: int) -> Iterator[int]:
        while p in elements:
            yield p
            p = elements[p]["up"]

    for t in texts:
        for p in up(t["up"]):
            holds[p] -= t["holds"]
    with_article = {q for p, t in elements.items() if t["part"] == 3 for q in up(p)}
    for p, t in elements.items():
        if t["part"]:
            inner.setdefault(t["up"], []).append(p)
    at, held = 0, sum(holds[p] for p in inner.get(0, []))
    while (own := inner.get(at)) and not (at and elements[at]["part"] == 3):
        best = max(own, key=lambda p: (holds[p], -elements[p]["place"], p))
        if holds[best] <= 0 or holds[best] < (ARTICLE_SHARE if best in with_article else SHARE) * held:
            break
        at, held = best, holds[best]
    return at if at and elements[at]["part"] >= 2 else None


CHOSEN = "host string, article long, template array<struct<token: long, class: long, place: double>>"


def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host's template the article's path or, without one, the texts (class and mean place)."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("class", pa.int64()), ("place", pa.float64())]))
    for batch in batches:
        found, texts = [], []
        for tokens in batch.column("tokens").to_pylist():
            elements = nested(tokens)
            own = [t for t in tokens if t["text"] and t["up"] in elements]
            found.append(article(elements, own))
            texts.append([{"token": t["token"], "class": t["class"], "place": t["place"]} for t in own])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.int64()), pa.array(texts, kind)], ["host", "article", "template"])


def templates(pages: DataFrame, **limits) -> DataFrame:
    """CHOSEN for each host with a template."""
    place = (F.col("places") / F.col("pages")).alias("place")
    rows = classes(pages, **limits).groupBy("host").agg(F.collect_list(F.struct("token", "class", "text", "up", "part", "holds", place)).alias("tokens"))
    return rows.mapInArrow(chosen, CHOSEN)


def increasing(values: list[float]) -> set[int]:
    """Places of a longest run of values in order."""
    ends: list[float] = []
    last: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        at = bisect_left(ends, v)
        back.append(last[at - 1] if at else -1)
        ends[at : at + 1] = [v]
        last[at : at + 1] = [k]
    out, k = set(), last[-1] if last else -1
    while k >= 0:
        out.add(k)
        k = back[k]
    return out


@dataclass
class Template:
    """The path of the host's article, or its texts (class and place)."""

    article: int | None
    texts: dict[int, tuple[int, float]]


def template_texts(page: Page, template: Template) -> set[int]:
    """Places of blocks that are the template's texts in their class's order."""
    found: dict[int, list[tuple[int, float]]] = {}
    for j, (text, k, _) in enumerate(page.blocks):
        if template.texts and (t := template.texts.get(text_token(text, page.path[k]))):
            found.setdefault(t[0], []).append((j, t[1]))
    return {places[j][0] for places in found.values() for j in increasing([p for _, p in places])}


def main_text(html: str, template: Template, names: Names) -> str:
    """The page's slots that are main text, joined by one blank."""
    page = parsed(html, names)
    named = page.around()
    for which in (lambda k: page.path[k] == template.article, lambda k: page.name[k] in MAIN and not named[k]):
        held = page.inside(which)
        if text := " ".join(text for text, k, _ in page.blocks if held[k] == 1):
            return text
    dropped = template_texts(page, template)
    return " ".join(text for j, (text, k, _) in enumerate(page.blocks) if not named[k] and j not in dropped)


def extractor(keep: list[str]) -> Callable:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = Names(), {}
        for batch in slices(batches, "html"):
            texts = []
            for page, host, path, template in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "article")), batch.column("template")):
                if host not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[host] = Template(path, {t["token"]: (t["class"], t["place"]) for t in template.as_py() or []})
                texts.append(main_text(page or "", known[host], names))
            sizes = pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), sizes], [*keep, "text", "n_chars"])

    return extract


def host_column(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def extract(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", **limits) -> DataFrame:
    """keep, with text (the main text) and n_chars."""
    keep = [c for c in keep if c not in ("text", "n_chars")]
    source = pages.select(host_column(url).alias("host"), F.col(f"`{html}`").alias("html"))
    found = written(templates(source, **limits), "templates")
    rows = pages.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(keep)], host_column(url).alias("host"), F.col(f"`{html}`").alias("html"))
    rows = rows.join(small_side(found, 20_000), "host", "left")
    held = [f"_{k}" for k in range(len(keep))]
    schema = rows.select(*held).schema.add("text", "string").add("n_chars", "long")
    out = rows.mapInArrow(extractor(held), schema)
    return out.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(keep)], "text", "n_chars")


def op3_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {"op3_template_text": op3_template_text}
SQL: dict[str, str] = {}
