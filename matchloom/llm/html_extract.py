"""HTML extraction: the main text of pages, by markup where it says what is what and by a host's suffix array where it doesn't.

A page is cut into text inside <article> or <main> (main text), text of menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments (dropped), and other text. Where a page has main text, that is its text: a passage of an article
that another page has too is still that article's, so nothing is dropped from it. A page without such markup is judged by its host:
the suffixes of its pages' token streams are put in order by a 64-bit hash of host and first `min_tokens` tokens, and a run of equal
prefixes from two pages or more that differ is boilerplate; tokens it covers go, and the unique runs stay. A longer repeated substring is covered by
its windows, so the order need not go deeper.

Parsing is one pass without a shuffle. Only pages without main text have suffixes; these are dealt by hash and counted before the shuffle,
so no host and no passage is one task, and a passage shows however many pages a host has and wherever the two that share it lie.
Defined results: a null html is empty and gives an empty text; a page without a host forms a group with others like it; repeated rows of
a page id count as one page, and so do pages with equal tokens, so they don't make each other boilerplate; null ids and urls stay null; a long page
is parsed whole; an empty table gives no rows; columns besides page_id, url and html don't matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import SPACED, WordHasher, mix, ngram_hashes, small_batches, stage, tidy

MIN_TOKENS = 8
#: Elements whose text isn't main text; those that hold no markup are passed over up to their end tag.
DROPPED = frozenset("nav footer aside form head menu dialog svg math select button noscript template object canvas audio video map fieldset datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Elements that don't end a word.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Words that mark an element as no main text: as a class, or as a class with other such words and words of LAYOUT ("sidebar-left"). Roles that do.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices sidebar menu navbar nav navigation breadcrumb breadcrumbs footer comment comments commentlist respond disqus reply replies share sharing social related recommended newsletter subscribe signup login popup modal pagination pager toolbar".split()
)
#: Of these, the words that mark an <article> as what a reader wrote below the main one.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
LAYOUT = frozenset("area articles bar block body box buttons column container content form group header icons inner item items left links list main meta outer overlay page panel posts right section site slot text thread top bottom unit widget widgets wrap wrapper".split())
#: Ids that do, outside main text. Elsewhere, and on headings and links, an id is a name of what it holds.
IDS = frozenset("ad ads banner breadcrumb breadcrumbs comments cookie-banner disqus_thread footer menu nav navbar navigation sidebar site-footer site-nav".split())
SLUGGED = frozenset("a h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<!?(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def hinted(name: str, attributes: str, in_main: bool = False) -> bool:
    """Whether attributes say that an element is no main text."""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role":
            if value in ROLES:
                return True
        elif key == "hidden":
            return True
        elif key == "aria-hidden":
            if value == "true":
                return True
        elif key == "style":
            if re.search(r"display\s*:\s*none", value):
                return True
        elif key == "id":
            if not in_main and name not in SLUGGED and value in IDS:
                return True
        elif key == "class":
            for word in value.split():
                parts = set(re.split(r"[-_]+", word))
                if parts & HINTS and parts <= HINTS | LAYOUT | {""}:
                    return True
    return False


def commentary(attributes: str) -> bool:
    """Whether an <article> is a reader's comment: by a class of such words, or by its type."""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "itemtype" and re.search(r"schema\.org/comment$", value):
            return True
        if key == "class":
            for word in value.split():
                parts = set(re.split(r"[-_]+", word))
                if parts & COMMENTS and parts <= COMMENTS | LAYOUT | {""}:
                    return True
    return False


def parse(page: str) -> tuple[str, list[str]]:
    """The main text, and the blocks of other text that isn't dropped."""
    main: list[str] = []
    other: list[str] = []
    stack: list[str] = []
    dropped = in_main = 0  # depth of the stack, plus one, where that began
    at, end = 0, len(page)

    def pop_to(depth: int) -> None:
        nonlocal dropped, in_main
        del stack[depth:]
        if dropped > depth:
            dropped = 0
        if in_main > depth:
            in_main = 0

    def put(text: str) -> None:
        if not dropped and text:
            (main if in_main else other).append(html.unescape(text))

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>"))
            continue
        if not m[0].endswith(">"):
            break  # a tag that the page's end cuts off
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name not in INLINE and not dropped:
            (main if in_main else other).append("\0")
        if closing:
            if name in stack:
                pop_to(len(stack) - 1 - stack[::-1].index(name))
            if name not in INLINE and not dropped:
                (main if in_main else other).append("\0")
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if name in BLOCKS and stack and stack[-1] == "p":
            pop_to(len(stack) - 1)
        if name in VOID or attributes.endswith("/") and name not in MAIN and name not in BLOCKS:
            continue
        stack.append(name)
        if not dropped and name == "article" and attributes and commentary(attributes):
            dropped = len(stack)
        elif not in_main and not dropped and name in MAIN:
            in_main = len(stack)
        elif not dropped and (name in DROPPED or name == "header" and not in_main or name not in ("html", "body", "article", "main") and attributes and hinted(name, attributes, bool(in_main))):
            dropped = len(stack)
    blocks = (" ".join(x.split()) for x in "".join(other).split("\0"))
    return " ".join("".join(main).replace("\0", " ").split()), [x for x in blocks if x]


def suffixes(hasher: WordHasher, blocks: list[str], host: int, min_tokens: int) -> tuple[list[str], np.ndarray]:
    """The tokens of a page, and the hash of host and first min_tokens tokens of each suffix that has so many."""
    words = [w for block in blocks for w in block.split()]
    hashes = ngram_hashes(hasher.of([" ".join(words).encode()])[0], min_tokens)
    return words, mix(hashes ^ mix(np.array([host], dtype=np.int64).view(np.uint64)))


def unique_runs(words: list[str], hashes: np.ndarray, shared: np.ndarray, min_tokens: int) -> str:
    """The words that no shared run of min_tokens covers; hashes are those of the runs that begin at each word."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    hit = np.flatnonzero(np.isin(hashes, shared))
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + min_tokens, -1)
    return " ".join(w for w, n in zip(words, np.cumsum(edges)[:-1].tolist(), strict=True) if not n)


def extract(pages: DataFrame, min_tokens: int = MIN_TOKENS, trust_markup: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html).

    trust_markup: whether text inside <article> or <main> is main text whatever the host's other pages have; otherwise it is judged as other text is.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, others = [], []
            for page in batch.column("html").to_pylist():
                text, blocks = parse(page or "")
                if not trust_markup:
                    text, blocks = "", [*([text] if text else []), *blocks]
                texts.append(text)
                others.append(None if text or not blocks else blocks)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(others, pa.list_(pa.string()))], names=["page_id", "url", "text", "blocks"])

    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string"
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    parsed = stage(rows.mapInArrow(tidy(run), f"{kinds}, text string, blocks array<string>"))
    # Pages that the markup doesn't settle.
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    open_pages = parsed.where("blocks IS NOT NULL")
    who = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("#"), F.col("uid").cast("string"))))
    open_pages = stage(open_pages.withColumn("uid", F.monotonically_increasing_id()).withColumn("host", F.xxhash64(host)).withColumn("who", who).withColumn("content", F.xxhash64(F.array_join("blocks", " "))))

    def list_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACED)
        for batch in batches:
            for uid, own, content, host, blocks in zip(*(batch.column(c).to_pylist() for c in ("uid", "who", "content", "host", "blocks")), strict=True):
                keys = np.unique(suffixes(hasher, blocks, host, min_tokens)[1]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.full(len(keys), x, dtype=np.int64)) for x in (own, content, uid))], names=["run", "who", "content", "uid"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACED)
        for batch in batches:
            texts = []
            for host, blocks, shared in zip(*(batch.column(c).to_pylist() for c in ("host", "blocks", "shared")), strict=True):
                words, hashes = suffixes(hasher, blocks, host, min_tokens)
                texts.append(unique_runs(words, hashes, np.array(shared or [], dtype=np.int64).view(np.uint64), min_tokens))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    runs = open_pages.select("uid", "who", "content", "host", "blocks").mapInArrow(tidy(list_suffixes), "run long, who long, content long, uid long")
    # Where neither all ids nor all contents are equal, two pages differ in both.
    ends = [f(c).alias(f"{c}_{n}") for c in ("who", "content") for f, n in ((F.min, "least"), (F.max, "most"))]
    boilerplate = runs.groupBy(F.col("run").alias("of")).agg(*ends).where("who_least < who_most AND content_least < content_most").select("of")
    covered = runs.join(boilerplate, F.col("run") == F.col("of")).groupBy(F.col("uid").alias("page")).agg(F.collect_list("run").alias("shared"))  # a page's own runs
    judged = open_pages.join(covered, F.col("uid") == F.col("page"), "left").select("page_id", "url", "host", "blocks", "shared").mapInArrow(tidy(drop), f"{kinds}, text string")
    found = parsed.where("blocks IS NULL").select("page_id", "url", "text").unionByName(judged)
    return found.withColumn("n_chars", F.length("text").cast("long"))
