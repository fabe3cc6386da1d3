"""Main-text extraction by equivalence-class template deduction.

1. Every page is read as tokens: its elements, told apart by role (the chain of open elements with class and id names,
   digits removed, kept as a hash over the parent's), and its blocks of text, told apart by role and wording. Spark folds
   the counts of a host's pages: a token's occurrence vector is kept as two sums of hashes of page and count, so rows
   that occur twice only weigh twice, and no host is ever gathered, whatever its size.
2. Tokens of one host with equal occurrence vectors are an equivalence class. Classes in at least half of a host's rows
   (SUPPORT) and on two different pages are frequent; they are valid if they nest: each element's parent is in the same
   class or in a class already placed. Nested from the root they are the host's template.
3. Text tokens belong to the template as well: wording that is on every page of a template element, as often on each,
   in an element that each of these pages has equally often, on three different pages at least (two that share a passage
   may be copies of one another). A template element all of whose text is such wording is no slot. Wording that stands
   among text of the page's own (a sentence that each article has) is part of that slot.
4. What is left are slots. Elements that HTML itself names as no content (nav, aside, footer, form, header outside the
   article, ...) are none. A template element that its class or id names as furniture, or that is mostly links, is none
   either, unless it holds the main slot or most of the host's text. The main slot is the template's article or main
   element; a page without it has its own articles, main or body. The text is what the main slot holds, without the
   elements that are no slots.

Names count as evidence only together with the template, but for the few of SURE. Pages of hosts without two different
pages are read with the template of all hosts together.

Defined results: null and empty html give an empty text; a page without host belongs to the host ''; text cut off in
the middle of a tag is dropped with the tag; repeated rows each give a row; other columns are not read. Nesting of any
depth takes linear time and memory."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

# fixed values: element and role names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe select title canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html"}
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WITHIN = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
SKIP_TAG = frozenset("nav aside footer form head button menu dialog".split()) | RAW
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CONTENT = frozenset("html body main article".split())
CONTAINER = frozenset("div section ul ol dl table center fieldset details".split())
#: Class and id names that tell of no content wherever they stand.
SURE = frozenset(
    "ad ads advert adverts advertisement adsbygoogle sponsored comments comment-list commentlist comments-area disqus_thread respond "
    "cookie-notice cookie-banner cookie-consent cookiebar newsletter sidebar site-header site-footer navbar breadcrumb breadcrumbs pagination share-buttons".split()
)
#: Names that tell of no content if they stand on an element of the template.
TOLD = SURE | frozenset(
    "nav navigation menu header masthead footer side-bar aside banner promo sponsor cookies cookie consent gdpr notice notices alert popup modal overlay subscribe "
    "signup login share sharing social related recommended comment disqus replies pager widget toolbar search form skip-link".split()
)
SUPPORT = 0.5
#: Templates with more entries than this are not broadcast.
BROADCAST_ENTRIES = 1_000_000
SALTS = 32

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?|=)*+)(>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_DIGITS = re.compile(r"\d+")


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) >> 1


class Page:
    """A page's elements (element 0 is the page itself) and its text: runs of (element, block, raw text)."""

    __slots__ = ("tag", "label", "role", "up", "noise", "named", "link", "block", "runs")

    def __init__(self, html: str):
        self.tag, self.label, self.role, self.up, self.noise, self.named, self.link, self.block = [""], [""], [0], [0], [False], [False], [False], [0]
        self.runs: list[tuple[int, int, str]] = []
        inside = [False]
        stack = [0]
        open_at: dict[str, list[int]] = {}
        blocks: list[int] = [0]
        number = at = 0
        n = len(html)

        def close(depth: int) -> int:
            shut = 0
            while len(stack) > depth:
                tag = self.tag[stack.pop()]
                open_at[tag].pop()
                if tag in BLOCK:
                    blocks.pop()
                    shut = 1
            return shut

        def deepest(tags: Iterable[str]) -> int:
            return max((d[-1] for t in tags if (d := open_at.get(t))), default=0)

        for m in _TAG.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                self.runs.append((stack[-1], number, html[at : m.start()]))
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                depth = deepest((tag,))
                if depth and (tag in BLOCK or blocks[-1] < depth):
                    number += close(depth)
                continue
            if tag in CLOSES_P and (depth := deepest(("p",))):
                number += close(depth)
            if tag in CLOSES and (depth := deepest(CLOSES[tag])) > deepest(WITHIN[tag]):
                # all that are open inside the nearest list, row or table
                while (depth := deepest(CLOSES[tag])) > deepest(WITHIN[tag]):
                    number += close(depth)
            attrs: dict[str, str] = {}
            if m[3]:
                for a, x, y, z in _ATTR.findall(m[3]):
                    attrs.setdefault(a.lower(), x or y or z)
            names = [*attrs.get("class", "").split(), *attrs.get("id", "").split()] if attrs else []
            up, i = stack[-1], len(self.tag)
            label = f"{tag}.{' '.join(_DIGITS.sub('', x) for x in names)}" if names else tag
            self.tag.append(tag)
            self.label.append(label)
            self.up.append(up)
            self.role.append(_hash(label, self.role[up]))
            skip = tag not in CONTENT and (tag in SKIP_TAG or tag == "header" and not inside[up] or attrs.get("role", "").lower() in SKIP_ROLE)
            self.noise.append(skip)
            self.named.append(not skip and tag in CONTAINER and any(x.lower() in SURE for x in names))
            self.link.append(self.link[up] or tag == "a")
            self.block.append(i if tag in BLOCK else self.block[up])
            inside.append(inside[up] or tag in ("article", "main"))
            if tag in BLOCK:
                number += 1
            if tag in VOID:
                if tag == "br":
                    self.runs.append((up, number, " "))
                number += tag in BLOCK
            elif tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else n
            else:
                open_at.setdefault(tag, []).append(len(stack))
                if tag in BLOCK:
                    blocks.append(len(stack))
                stack.append(i)
        if at < n:
            self.runs.append((stack[-1], number, html[at:]))
        arts = [i for i, t in enumerate(self.tag) if t == "article"]
        for i in [i for i, t in enumerate(self.tag) if t == "main"] + (arts if len(arts) == 1 else []):
            while i:  # a wrapper of the main element or the only article is content, whatever it is called
                self.named[i] = False
                i = self.up[i]

    def kept(self, names: bool = False, drops: Iterable[int] = ()) -> list[bool]:
        """Whether each element is content: by HTML's own elements, by SURE names, by a template's roles."""
        keep = [True] * len(self.tag)
        for i in range(1, len(keep)):
            keep[i] = keep[self.up[i]] and not self.noise[i] and not (names and self.named[i]) and self.role[i] not in drops
        return keep

    def blocks(self, keep: list[bool]) -> Iterator[tuple[int, str]]:
        """(block element, text) in page order: references decoded, white space single, empty ones left out."""
        held, parts, owner = -1, [], 0
        for el, number, text in self.runs:
            if not keep[el]:
                continue
            if number != held:
                if parts and (done := " ".join(entities.unescape("".join(parts)).split())):
                    yield owner, done
                held, parts, owner = number, [], self.block[el]
            parts.append(text)
        if parts and (done := " ".join(entities.unescape("".join(parts)).split())):
            yield owner, done


class Role(NamedTuple):
    n: int
    own: int
    skip: int
    whole: int
    linked: int
    parent: int
    label: str
    texts: int


def _tokens(html: str) -> tuple[dict[int, Role], dict[tuple[int, int], int]]:
    page = Page(html)
    keep = page.kept()
    own, linked, texts_below = [0] * len(page.tag), [0] * len(page.tag), [0] * len(page.tag)
    for el, _, text in page.runs:
        if keep[el]:
            (linked if page.link[el] else own)[page.block[el]] += len(text.strip())
    texts: dict[tuple[int, int], int] = {}
    for owner, text in page.blocks(keep):
        texts_below[owner] += 1
        key = (page.role[owner], _hash(text, page.role[owner]))
        texts[key] = texts.get(key, 0) + 1
    whole, links = own.copy(), linked.copy()
    for i in range(len(whole) - 1, 0, -1):
        for sums in (whole, links, texts_below):
            sums[page.up[i]] += sums[i]
    found: dict[int, list] = {}
    for i, tag in enumerate(page.tag):
        if i and tag not in BLOCK:
            continue
        r = found.setdefault(page.role[i], [0, 0, 1, 0, 0, page.role[page.block[page.up[i]]], page.label[i], 0])
        r[0] += 1
        r[1] += own[i]
        r[2] &= not keep[i]
        r[3] += whole[i]
        r[4] += links[i]
        r[7] += texts_below[i]
    return {k: Role(*r) for k, r in found.items()}, texts


def roles(html: str) -> dict[int, Role]:
    """Per role: count, unlinked text of its own and inline, whether it is no content, unlinked and linked text below it,
    the element around it, its name, and the blocks of text below it."""
    return _tokens(html)[0]


class Template(NamedTuple):
    main: int | None = None
    drops: frozenset[int] = frozenset()


def extract(html: str, template: Template | tuple = ()) -> str:
    """The blocks of a page's main slot without the template's elements that are no slots."""
    template = template or Template()
    page = Page(html)
    for keep in (page.kept(True, template.drops), page.kept()):  # where names alone would leave nothing they don't count
        if found := list(page.blocks(keep)):
            return "\n\n".join(t for _, t in _slot(page, found, keep, template.main))
    return ""


def _slot(page: Page, found: list[tuple[int, str]], keep: list[bool], main: int | None) -> list[tuple[int, str]]:
    def within(roots: set[int]) -> list[tuple[int, str]]:
        inside = [False] * len(page.tag)
        for i in range(1, len(inside)):
            inside[i] = i in roots or inside[page.up[i]]
        return [(b, t) for b, t in found if inside[b]]

    for roots in ({i for i, r in enumerate(page.role) if r == main and i}, _articles(page, found), {i for i, t in enumerate(page.tag) if t == "main"}):
        if roots and (got := within(roots)):
            return got
    return found


def _articles(page: Page, found: list[tuple[int, str]]) -> set[int]:
    """The outermost articles of the role that holds most text."""
    outer: list[int] = [0] * len(page.tag)
    for i in range(1, len(outer)):
        outer[i] = outer[page.up[i]] or (i if page.tag[i] == "article" else 0)
    sizes: dict[int, int] = {}
    for b, t in found:
        if outer[b]:
            role = page.role[outer[b]]
            sizes[role] = sizes.get(role, 0) + len(t)
    best = max(sizes, key=sizes.get, default=None)
    return {i for i in set(outer) if i and page.role[i] == best}


def deduce(found: pd.DataFrame) -> tuple[str | None, int | None, list[int]] | None:
    """The template of one host from its frequent tokens: (path of the main slot, its role, roles that are no slots).

    Columns: kind (0 element, 1 text), token, parent, label, rows, least, most, v1, v2, p1, p2, pages, whole, linked, skip,
    fewest and many (blocks of text below it on one page)."""
    elements = {r.token: r for r in found[found["kind"] == 0].itertuples()}
    if 0 not in elements or elements[0].pages < 2:
        return None
    classes: dict[tuple, list] = {}
    for r in elements.values():
        classes.setdefault((r.rows, r.v1, r.v2), []).append(r)
    placed = {0: elements[0]}
    waiting = sorted(classes.values(), key=lambda c: (-c[0].rows, min(r.token for r in c)))
    while True:  # a class is placed once what its members stand in is
        valid = [c for c in waiting if all(r.parent in placed or r.parent in {x.token for x in c} for r in c)]
        if not valid:
            break
        placed |= {r.token: r for c in valid for r in c}
        waiting = [c for c in waiting if c not in valid]

    def chain(token: int) -> list[int]:
        out = []
        while token:
            out.append(token)
            token = placed[token].parent
        return out

    def tag(r) -> str:
        return r.label.partition(".")[0]

    once = [r for r in placed.values() if r.token and r.most == 1 and not r.skip and r.whole + r.linked > 0]
    named = {t: max((r for r in once if tag(r) == t), key=lambda r: (r.whole, -r.token), default=None) for t in ("article", "main")}
    main = named["article"] or named["main"]
    if named["article"] and named["main"] and 2 * named["article"].whole < named["main"].whole:
        main = named["main"]
    holding = set(chain(main.token)) if main else set()
    everything = placed[0].whole
    fixed: dict[int, int] = {}  # by element, blocks of the template's wording below it on each page
    for r in found[found["kind"] == 1].itertuples():
        box = placed.get(r.parent)
        if box is not None and r.pages > 2 and r.least == r.most and box.least == box.most and (r.rows, r.p1, r.p2) == (box.rows, box.p1, box.p2):
            for t in chain(r.parent):
                fixed[t] = fixed.get(t, 0) + r.most
    alike = {t for t, n in fixed.items() if placed[t].fewest == placed[t].many == n}
    if main and main.token in alike:  # one article on all pages: not template, but copies
        alike = {t for t in alike if main.token not in chain(t)}
    drops = []
    for r in placed.values():
        if not r.token or r.skip or r.token in holding:
            continue
        told = any(x.lower() in TOLD for x in r.label.partition(".")[2].split())
        listed = main is None and r.linked > 2 * r.whole
        if r.token in alike or tag(r) in CONTAINER and 2 * r.whole <= everything and (told or listed):
            drops.append(r.token)
    path = "".join(f"/{placed[t].label}" for t in reversed(chain(main.token))) if main else None
    return path, main.token if main else None, sorted(drops)


def _host():
    return F.coalesce(F.regexp_extract(F.lower(F.col("url")), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))


def tokens(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Folded tokens by host: every element role, and the texts in at least SUPPORT of the host's rows. Written."""
    bounded_batches(pages.sparkSession)
    schema = "host string, page long, kind int, token long, parent long, label string, n long, whole long, linked long, skip int, texts long"
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for host, page, html in zip(b["host"].to_pylist(), b["page"].to_pylist(), b["html"].to_pylist(), strict=True):
                elements, texts = _tokens(html or "")
                out += [(host, page, 0, k, r.parent, r.label, r.n, r.whole, r.linked, int(r.skip), r.texts) for k, r in elements.items()]
                out += [(host, page, 1, k, role, None, n, 0, 0, 0, 0) for (role, k), n in texts.items()]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    rows = pages.select(_host().alias("host"), F.xxhash64(F.coalesce(html_col, F.lit(""))).alias("page"), F.col(html_col).alias("html"))
    low = lambda c: F.sum(c.bitwiseAND(F.lit(0xFFFFFFFF)))  # noqa: E731  sums of 32 bits hold for 2^31 pages of a host
    high = lambda c: F.sum(F.shiftrightunsigned(c, 32))
    bit = lambda c: F.bit_or(F.expr(f"shiftleft(1L, int({c} & 63))"))
    vector, page = F.xxhash64("page", "n"), F.col("page")
    folded = (
        rows.mapInArrow(run, schema)
        .groupBy("host", "kind", "token", "parent", "label")
        .agg(
            F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"),
            low(vector).alias("v1"), high(vector).alias("v2"), low(page).alias("p1"), high(page).alias("p2"),
            bit("page").alias("b1"), bit("shiftright(page, 6)").alias("b2"),
            F.sum("whole").alias("whole"), F.sum("linked").alias("linked"), F.min("skip").alias("skip"),
            F.min("texts").alias("fewest"), F.max("texts").alias("many"),
        )
        .filter("kind = 0 or rows > 2")
    )
    counts = rows.groupBy("host").agg(F.count("*").alias("host_rows"))
    return written(folded.join(counts, "host").filter(f"kind = 0 or rows >= {SUPPORT} * host_rows"), "tokens")


def templates(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(host, main, role, drops) by deduction; the host '*' stands for all hosts together."""
    by_host = tokens(pages, html_col)
    sums = [F.sum(c).alias(c) for c in ("rows", "v1", "v2", "p1", "p2", "whole", "linked")]
    extremes = [F.min("least").alias("least"), F.max("most").alias("most"), F.bit_or("b1").alias("b1"), F.bit_or("b2").alias("b2"), F.min("skip").alias("skip"), F.min("fewest").alias("fewest"), F.max("many").alias("many")]
    all_rows = by_host.filter("kind = 0 and token = 0").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    everywhere = by_host.filter("kind = 0").groupBy("kind", "token", "parent", "label").agg(*sums, *extremes)
    everywhere = everywhere.withColumn("host", F.lit("*")).withColumn("host_rows", F.lit(all_rows))
    # only tokens of half of a host's rows reach its group: it is bounded by the size of two pages, whatever the host's
    kept = by_host.unionByName(everywhere).withColumn("pages", F.greatest(F.bit_count("b1"), F.bit_count("b2"))).filter(f"rows >= {SUPPORT} * host_rows")

    def by_group(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        got = deduce(found)
        return pd.DataFrame([(key[0], *got)] if got else [], columns=["host", "main", "role", "drops"]).astype({"role": "Int64"})

    return written(kept.groupBy("host").applyInPandas(by_group, "host string, main string, role long, drops array<long>"), "templates")


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = templates(pages, html_col)
    star = found.filter("host = '*'").first()  # one row
    common = Template(star["role"], frozenset(star["drops"])) if star else Template()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for html, known, role, drops in zip(*(b[c].to_pylist() for c in ("html", "known", "role", "drops")), strict=True):
                texts.append(extract(html or "", Template(role, frozenset(drops)) if known else common))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _host().alias("host"), F.col(html_col).alias("html"))
    own = found.filter("host <> '*'").select("host", "role", "drops", F.lit(True).alias("known"))
    entries = own.agg(F.coalesce(F.sum(F.size("drops") + 4), F.lit(0))).first()[0]
    if entries <= BROADCAST_ENTRIES:
        joined = rows.join(F.broadcast(own), "host", "left")
    else:  # too many to broadcast: a hot host's pages are dealt over SALTS keys
        salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "known", "role", "drops").mapInArrow(run, "page_id long, url string, text string, n_chars long")
