"""HTML extraction by template deduction over the pages of a host.

A token is an element with its path of enclosing elements (tag, class and role
of each), or the text of a whole block with its path.  Over the pages of a host
each token has an occurrence vector: how often it occurs in each page.  Tokens
with the same vector form an equivalence class; classes of two or more tokens
that most pages hold are the host's template, and an element nests in the
classes of the elements around it.  Text that is a template token is furniture
wherever it stands.  What is left between template tokens are slots.

The main element is chosen from the template: an element that occurs once a
page, inside such elements only, and whose slots hold most of the host's free
text and its headings; of these the deepest.  Names decide only ties: an
``article`` or ``main`` element among them comes first.  Its slots, without what
HTML itself calls furniture (``nav``, ``footer``, ``form`` ...), are the page's
text.  Class and id values mark furniture only where they say nothing else
("cookie-notice", not "related-work"), and not on an element that holds the
page's heading and more than half of its text.

Vectors are never built: a token's vector is known by two sums, over pages, of
hashes of (page, count), so a host of any size costs one mergeable aggregate.
A template lists tokens that at least half of a host's pages hold, so it has at
most twice as many as a page.  Paths are chained 64-bit hashes, so depth costs
nothing.  Text counts by whole blocks, not by single words, so that words which
all pages of a small host happen to share stay; a block that only copies of one
page hold is no template.

Pages on hosts too small for evidence, and pages that lack the template's main
element, use their own first article or main element, else their body.

Defined results: a null or empty html gives an empty text; a page with a null
url counts as of one host without name; repeated rows give their text each;
pages of any length and depth are taken whole; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import common

#: Pages of a host, and share of them, that must hold a class's tokens.
PAGES, SHARE = 3, 0.5
#: Tokens of a class that make it large enough.
TOKENS = 2
#: Share of the host's free text, and of its pages with a heading, that the
#: main element must hold; share of text that a named main element must hold.
WEIGHT, HEADINGS, NAMED = 0.6, 0.8, 0.25
#: Elements by their role.
FURNITURE = frozenset("nav header footer aside form script style noscript template head title button select option iframe svg canvas dialog menu object video audio".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset({"article", "main"})
HOLDERS = frozenset("body div section td center main article".split())
#: Never furniture by name.
PLAIN = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role values that name furniture, and words that such
#: values may hold besides.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation "
    "newsletter notice overlay pagination popup promo promotion recommended related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
BESIDES = frozenset("area bar block bottom box container content fixed form global group header inner item items left list main module outer page panel primary reader right row secondary section site slot top unit user wrap wrapper".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}

#: Kinds of tokens, and how an element is marked as furniture.
ELEMENT, HOLDER, MAIN_ELEMENT, TEXT = range(4)
FREE, BY_NAME, BY_TAG = range(3)


def named(attributes: str) -> tuple[str, bool, bool]:
    """(label from class and role; whether class, id and role name furniture;
    whether the role is main)."""
    if "=" not in attributes:
        return "", False, False
    values = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in ATTRIBUTE.finditer(attributes)]
    furniture = False
    for _, value in values:
        for name in value.split():
            words = set(WORDS.findall(name))
            furniture |= bool(words & MARKS) and words <= MARKS | BESIDES
    label = ".".join(sorted(DIGITS.sub("#", " ".join(v.split())) for k, v in values if k in ("class", "role")))
    return label, furniture, ("role", "main") in values


_children: dict[tuple[int, str], int] = {}


def child(parent: int, name: str) -> int:
    """The token of an element ``name`` in that of ``parent``."""
    found = _children.get((parent, name))
    if found is None:
        if len(_children) > 200_000:
            _children.clear()
        found = _children[parent, name] = xxhash.xxh3_64_intdigest(f"{parent}/{name}".encode("utf-8", "surrogatepass")) >> 1 or 1
    return found


class Page:
    """Tokens and slots of one page.  ``parent``, ``tag``, ``mark`` and ``kind``
    describe each token, parents first (the page itself is 0); ``slots`` lists
    (token, block number, text) in page order."""

    def __init__(self, source: str):
        self.parent: dict[int, int] = {0: 0}
        self.tag, self.mark, self.kind, self.depth = {0: ""}, {0: FREE}, {0: ELEMENT}, {0: 0}
        self.times: Counter = Counter()
        self.slots: list[tuple[int, int, str]] = []
        self.parse(source)
        self.free = self.freed()

    def parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = []
        opened: Counter = Counter()
        block, at, own = 0, 0, 0
        while True:
            m = TAG.search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text:
                self.slots.append((own, block, text))
            if not m:
                return
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag or tag == "br":
                if tag:
                    self.slots.append((own, block, " "))
                continue
            if m[1]:
                if opened[tag]:
                    while True:
                        t, _ = stack.pop()
                        opened[t] -= 1
                        if t == tag:
                            break
                    own = stack[-1][1] if stack else 0
                block += tag not in INLINE
                continue
            label, by_name, is_main = named(m[3]) if m[3] else ("", False, False)
            if tag in INLINE and not by_name and not opened[tag]:
                continue
            block += tag not in INLINE
            shut = CLOSES.get(tag, ()) or ({"p"} if tag in ENDS_P else ())
            while shut and stack and stack[-1][0] in shut:
                opened[stack.pop()[0]] -= 1
            up = stack[-1][1] if stack else 0
            own = child(up, f"{tag} {label}!" if by_name else f"{tag} {label}")
            if own not in self.parent:
                self.parent[own], self.tag[own], self.depth[own] = up, tag, self.depth[up] + 1
                self.mark[own] = BY_TAG if tag in FURNITURE else BY_NAME if by_name and tag not in PLAIN else FREE
                self.kind[own] = MAIN_ELEMENT if is_main or tag in MAIN else HOLDER if tag in HOLDERS else ELEMENT
            self.times[own] += 1
            if tag in VOID or m[3].endswith("/"):
                own = up
                continue
            if tag in RAW:
                end = ENDS[tag].search(source, at)
                at = end.start() if end else len(source)
            stack.append((tag, own))
            opened[tag] += 1

    def weights(self, free: dict[int, bool]) -> Counter:
        """Characters of free text under each token."""
        weight: Counter = Counter()
        for token, _, text in self.slots:
            if free[token]:
                weight[token] += len(text)
        for token in reversed(self.parent):
            if token and token in weight:
                weight[self.parent[token]] += weight[token]
        return weight

    def freed(self) -> dict[int, bool]:
        """Whether each token stands outside furniture."""

        def under(marks: dict[int, int]) -> dict[int, bool]:
            free: dict[int, bool] = {}
            for token, up in self.parent.items():
                free[token] = marks[token] == FREE and (token == 0 or free[up])
            return free

        if BY_NAME in self.mark.values():
            weight = self.weights(under({t: m if m == BY_TAG else FREE for t, m in self.mark.items()}))
            headed = {0}
            for token, tag in self.tag.items():
                while tag == "h1" and token not in headed:
                    headed.add(token)
                    token = self.parent[token]
            for token, m in self.mark.items():
                if m == BY_NAME and 2 * weight[token] > weight[0] and (token in headed or len(headed) == 1):
                    self.mark[token] = FREE  # a name does not outweigh a page's heading and most of its text
        return under(self.mark)

    def blocks(self) -> Iterator[tuple[int, str]]:
        """(token, line) of each block with text outside furniture."""
        for _, group in groupby((x for x in self.slots if self.free[x[0]]), lambda x: x[1]):
            slots = list(group)
            if line := " ".join(htmllib.unescape("".join(text for *_, text in slots)).split()):
                yield slots[0][0], line

    def main(self) -> int:
        """The shallowest, then first, named main element, or the page itself."""
        found = [t for t in self.parent if self.kind[t] == MAIN_ELEMENT and self.free[t]]
        return min(found, key=lambda t: self.depth[t], default=0)

    def under(self, top: int) -> dict[int, bool]:
        inside: dict[int, bool] = {}
        for token, up in self.parent.items():
            inside[token] = token == top or (token != 0 and inside[up])
        return inside


def text_token(token: int, line: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{token}\0{line}".encode("utf-8", "surrogatepass")) >> 1 or 1


def extract(source: str | None, mains: Collection[int] = (), repeated: Collection[int] = ()) -> str:
    """Main text of a page, given the main elements of its host's template
    (best first) and the template's tokens of text: one line per block.  Where
    all blocks are template, the pages are copies and keep them."""
    if not source:
        return ""
    page = Page(source)
    top = next((t for t in mains if t in page.parent), None)
    inside = page.under(page.main() if top is None else top)
    lines = [(token, line) for token, line in page.blocks() if inside[token]]
    slots = [x for x in lines if text_token(*x) not in repeated] if repeated else lines
    return "\n".join(line for _, line in slots or lines)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


SUMS = ("h1", "h2", "pages", "times", "weight", "heads")


def evidence(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Per batch, host and token: two sums that identify the occurrence vector,
    pages that hold it, occurrences, characters of free text under it and pages
    with a heading under it; the least and largest hash of a page that holds it;
    its parent, kind, depth and whether it is free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "html", 8 << 20):
            found: dict[tuple[str, int], list[int]] = {}
            for host, name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                page = Page(source)
                content = xxhash.xxh32_intdigest(source.encode("utf-8", "surrogatepass"))
                weight = page.weights(page.free)
                lines = list(page.blocks())
                heads: set[int] = set()
                texts: dict[int, tuple[int, int, int]] = {}
                for token, line in lines:
                    own = text_token(token, line)
                    n, size, _ = texts.get(own, (0, 0, 0))
                    texts[own] = n + 1, size + len(line), token
                    at = token
                    while page.tag[at] != "h1" and at:
                        at = page.parent[at]
                    while at and at not in heads:
                        heads.add(at)
                        at = page.parent[at]
                rows = [(t, n, weight[t], t in heads, page.parent[t], page.kind[t], page.depth[t], page.free[t]) for t, n in page.times.items()]
                rows += [(t, n, size, False, up, TEXT, 0, True) for t, (n, size, up) in texts.items()]
                rows.append((0, 1, weight[0], bool(heads), 0, ELEMENT, 0, True))
                for token, n, size, headed, up, kind, depth, free in rows:
                    h = xxhash.xxh3_64_intdigest(f"{name} {n}")
                    sums = found.setdefault((host, token), [0, 0, 0, 0, 0, 0, content, content, up, kind, depth, int(free)])
                    for k, x in enumerate((h & 0xFFFFFFFF, h >> 32, 1, n, size, headed)):
                        sums[k] += x
                    sums[6:8] = min(sums[6], content), max(sums[7], content)
            keys = list(found)
            columns = list(zip(*found.values(), strict=True)) if found else [[]] * 12
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], names=["host", "token", *SUMS, "low", "high", "parent", "kind", "depth", "free"])

    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    columns = ["host string", *[f"{c} long" for c in ("token", *SUMS, "low", "high", "parent", "kind", "depth", "free")]]
    return rows.mapInArrow(lambda batches: common.trimmed(run(batches)), ", ".join(columns))


def deduced(tokens: list[dict]) -> tuple[list[int], list[int]]:
    """(main elements, best first; tokens of text) of a host's template, from
    the tokens that enough of its pages hold."""
    whole = next((t for t in tokens if t["token"] == 0), None)
    vector = lambda t: (t["h1"], t["h2"], t["pages"], t["times"])
    size = Counter(vector(t) for t in tokens if t["token"])
    template = {t["token"]: t for t in tokens if t["token"] and size[vector(t)] >= TOKENS}
    repeated = [t for t in template.values() if t["kind"] == TEXT and t["low"] < t["high"]]
    slots = {t["token"]: t["weight"] for t in tokens}  # text that is no template
    parents = {t["token"]: t["parent"] for t in tokens}
    for t in repeated:
        at = t["parent"]
        while at:
            slots[at] = slots.get(at, 0) - t["weight"]
            at = parents.get(at, 0)
        slots[0] = slots.get(0, 0) - t["weight"]

    def once(t: dict) -> bool:
        """Whether it and all around it occur once a page."""
        while t is not None and t["pages"] == t["times"]:
            if not t["parent"]:
                return True
            t = template.get(t["parent"])
        return False

    single = [t for t in template.values() if t["kind"] in (HOLDER, MAIN_ELEMENT) and t["free"] and once(t)]
    text, heads = max(1, slots.get(0, 0)), whole["heads"] if whole else 0
    named_main = [t for t in single if t["kind"] == MAIN_ELEMENT and slots[t["token"]] >= NAMED * text]
    heavy = [t for t in single if slots[t["token"]] >= WEIGHT * text]
    heavy = [t for t in heavy if t["heads"] >= HEADINGS * heads] or heavy
    mains = sorted(named_main, key=lambda t: (t["depth"], t["token"]))[:1] or sorted(heavy, key=lambda t: (-t["depth"], -slots[t["token"]], t["token"]))[:1]
    return [t["token"] for t in mains], sorted(t["token"] for t in repeated)


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, mains, repeated): main elements and tokens of text of the template
    of each host with enough pages."""
    fixed = ("parent", "kind", "depth", "free")
    tokens = evidence(pages, url, html).groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in SUMS], F.min("low").alias("low"), F.max("high").alias("high"), *[F.min(c).alias(c) for c in fixed])
    # Read twice, though pages are parsed once for it; tokens on too few pages for any host are no template.
    tokens = common.cut(tokens.where((F.col("token") == 0) | (F.col("pages") >= SHARE * PAGES)), "tokens")
    sizes = tokens.where("token = 0").select("host", F.col("pages").alias("all")).where(F.col("all") >= PAGES)
    held = common.cut(tokens.join(common.by_key(sizes), "host").where(F.col("pages") >= SHARE * F.col("all")), "held")
    common.dropped(tokens)
    one = F.struct("token", *SUMS, "low", "high", *fixed)
    hosts = held.groupBy("host").agg(F.collect_list(one).alias("tokens"))  # at most 1 / SHARE pages' tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [deduced(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1)]], names=["host", "mains", "repeated"])

    out = hosts.mapInArrow(run, "host string, mains array<long>, repeated array<long>")
    out.reads = held
    return out


def extracted(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``pages`` (all, if not given) with ``text`` and ``n_chars``."""
    made = ["text", "n_chars"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in made]
    common.arrow_batches(pages.sparkSession)
    # Small, so that pages meet it in a broadcast where its size allows; else in
    # a sort-merge join, whose hot hosts adaptive execution splits.
    deduced_ones = templates(pages, url, html)
    found = common.cut(deduced_ones, "templates")
    common.dropped(deduced_ones.reads)
    rows = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{html}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"))
    rows = rows.join(found, "host", "left").select(*[f"k{i}" for i in range(len(keep))], "html", "mains", "repeated")
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "html", 8 << 20):
            texts = [extract(source, mains or (), frozenset(repeated or ())) for source, mains, repeated in zip(*[batch.column(k + i).to_pylist() for i in range(3)], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, *made])

    schema = pages.select(*[F.col(f"`{c}`") for c in keep]).schema.add("text", "string", True).add("n_chars", "long", True)
    return rows.mapInArrow(lambda batches: common.trimmed(run(batches)), schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"), keep=["page_id", "url"])
