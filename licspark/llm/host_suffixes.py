"""Main text of web pages: host suffix arrays find repeated runs, markup settles the rest.

Pages are cut into blocks of text. The token streams of a host's pages, on end, have a
suffix array; two neighbours in it that share their first MIN_RUN tokens are a long
substring repeated in the host. Only that prefix of each suffix matters, so suffixes are
dealt to tasks by (host, first MIN_RUN tokens) and no host is ever gathered: a host may
own any share of the pages. A run that stands on two distinct pages (different html) is
covered; blocks covered by half or more are boilerplate, unique runs stay.

Repeats alone give wrong results at both ends: an article that is copied, or quotes a
widely used passage, repeats too, and an advert may be shown once. So markup speaks
first: blocks in menus, forms, adverts and so on are never main text, and where a page
marks its article, unless that is a mere teaser beside a far longer open text, only
blocks in it can be. Inside a marked article the run that counts is a whole block, and
it needs more proof: it is covered where it stands on SITE_SHARE of the distinct pages
of the host, SITE_PAGES at least, and holds less than half of the article's tokens. So
a site's own "subscribe to our letter" goes, and copied articles and shared passages stay.
"""

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from licspark.llm import textops
from licspark.session import durable

#: Tokens of a long substring.
MIN_RUN = 6
#: Distinct pages of a host, and their share, on which a block of a marked article must stand to be the site's own.
SITE_PAGES, SITE_SHARE = 4, 0.6
#: An article this many times shorter than the page's open text, and shorter than TEASER characters, is a teaser.
TEASER_RATIO, TEASER = 4, 400
#: Characters from which the text of a form, where a page has no longer one, is the page's text.
FORM_TEXT = 400

_TAG = re.compile(
    r"<!--.*?(?:--\s*>|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|canvas|video|audio|select|textarea|xmp)(?:/>|(?=\s)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=[\s\"']/)>|\b[^>]*>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Class words that tell the state of a page or wrapper, not what it holds.
_STATE = re.compile(r"(?:has|no|with|without)[-_].*|.*[-_](?:open|opened|closed|collapsed|expanded|active|enabled|disabled|visible)")
_PIECES = re.compile(r"[a-z0-9]+")
_WHITE = re.compile(r"\s+")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text.
CHROME = frozenset("aside button dialog footer form head legend menu nav search title".split())
#: Names in class, id and role that mark menus, notices, adverts, comments and the like.
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_COMMENT_NAMES = frozenset("comment comments replies reply respond disqus".split())
#: Parts of names that say nothing about what an element holds.
PLAIN_NAMES = frozenset(
    "area bar block bottom box button buttons container content inner item items left link links list main outer page panel post posts right row section site slot stories story top unit wrap wrapper".split()
)
ARTICLE, CHROME_ZONE, OPEN, WRAPPED, FORM = 0, 1, 2, 3, 4


def _names(attributes: str, inside: bool) -> tuple[set[str], bool]:
    """Parts of the names in class, id and role; whether the element is hidden.

    Inside an article a name with a part of any other meaning tells nothing: a search box
    goes, a search term and a market share stay.
    """
    names, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
        elif name in ("class", "id", "role"):
            for word in value.split():
                if not _STATE.fullmatch(word):
                    pieces = _PIECES.findall(word)
                    if not inside or all(p in CHROME_NAMES or p in PLAIN_NAMES for p in pieces):
                        names.update(pieces)
    return names, hidden


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order; character references decoded, white space single.

    A form, or a name on a wrapper, is weaker than an article or main element in it: where
    the page has no other marked text, these are its article if they are longer than its
    open text. A form around the whole text of a page without an article is no form either. A
    teaser beside a far longer open text is open text.
    """
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # name, chrome (1: a wrapper by its name or a form, 2: else), article
    parts: list[str] = []
    zone = OPEN

    def flush():
        if parts:
            text = _WHITE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                blocks.append((zone, text))

    def current() -> int:
        if any(chrome for _, chrome, _ in stack):
            wrappers = next((k for k, (_, _, article) in enumerate(stack) if article), 0)
            outside = all(chrome == 0 or (chrome == 1 and k < wrappers) for k, (_, chrome, _) in enumerate(stack))
            if not outside and all(chrome == 0 or name == "form" and chrome == 1 for name, chrome, _ in stack):
                return FORM
            return WRAPPED if outside else CHROME_ZONE
        return ARTICLE if any(article for _, _, article in stack) else OPEN

    at = 0
    for match in _TAG.finditer(page):
        if match.start() > at:
            parts.append(page[at : match.start()])
        at = match.end()
        raw, close, name, attributes, close2, name2, attributes2 = match.groups()
        name = name or name2
        if name is None:
            if raw:
                parts.append(" ")
            continue
        name, close, attributes = name.lower(), close or close2, attributes or attributes2 or ""
        if name not in BLOCKS:
            if name == "br":
                parts.append(" ")
            elif not close and name not in VOID and attributes and not attributes.endswith("/"):
                names, hidden = _names(attributes, any(article for _, _, article in stack))
                if hidden or names & CHROME_NAMES:
                    flush()
                    stack.append((name, 2, False))
                    zone = current()
            elif close and any(open_name == name for open_name, *_ in stack):
                flush()
                while stack.pop()[0] != name:
                    pass
                zone = current()
            continue
        flush()
        if close:
            if any(open_name == name for open_name, *_ in stack):
                while stack.pop()[0] != name:
                    pass
                zone = current()
        elif name not in VOID:
            # a paragraph or list item ends where the next block starts
            if stack and stack[-1][0] == "p" or (stack and name == stack[-1][0] and name in ("li", "td", "th", "tr", "dt", "dd", "option")):
                stack.pop()
            inside = any(article for _, _, article in stack)
            names, hidden = _names(attributes, inside) if attributes else (set(), False)
            if name in ("html", "body", "main"):
                chrome = 0
            elif name == "article":
                chrome = 2 * bool(names & _COMMENT_NAMES)
            elif name == "form" and not inside and not names & _COMMENT_NAMES:
                chrome = 1
            elif name in CHROME or (name == "header" and not inside) or names & _COMMENT_NAMES:
                chrome = 2
            else:
                chrome = int(bool(names & CHROME_NAMES))
            stack.append((name, 2 if hidden else chrome, name in ("article", "main")))
            zone = current()
    if at < len(page):
        parts.append(page[at:])
    flush()
    size = {kind: sum(len(text) for found, text in blocks if found == kind) for kind in (ARTICLE, OPEN, WRAPPED, FORM)}
    settled = {WRAPPED: CHROME_ZONE, FORM: CHROME_ZONE}
    if not size[ARTICLE]:
        if size[WRAPPED] > size[OPEN]:
            settled[WRAPPED] = ARTICLE
        elif size[FORM] > size[OPEN] and size[FORM] >= FORM_TEXT:
            settled[FORM] = OPEN
    elif size[ARTICLE] < TEASER and size[OPEN] > TEASER_RATIO * size[ARTICLE]:
        settled[ARTICLE] = OPEN
    return [(settled.get(kind, kind), text) for kind, text in blocks]


def _host(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return found[1].rpartition("@")[2].partition(":")[0].lower() if found else ""


def _stream(blocks: list[tuple[int, str]], host: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the suffixes that are MIN_RUN tokens long or longer, and the block of each token; article blocks are left out."""
    texts = [text.encode() for zone, text in blocks if zone != ARTICLE]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends, _ = textops.words(data, np.array([0, len(data)]))
    tokens = textops.span_hashes(data, starts, ends)
    cuts = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(cuts, starts, "right")
    if len(tokens) < MIN_RUN:
        return np.zeros(0, np.int64), owner
    keys, _ = textops.run_hashes(tokens, np.array([0, len(tokens)]), MIN_RUN)
    salt = np.frombuffer(hashlib.blake2b(host.encode(), digest_size=8).digest(), "<u8")
    return textops.mixed(keys ^ salt).view(np.int64), owner


def _block_keys(texts: list[str], host: str) -> list[int | None]:
    """Key of each block of a marked article, by its words; null for blocks that are short or hold half of the article."""
    words = [" ".join(text.split()).encode() for text in texts]
    sizes = [w.count(b" ") + 1 for w in words]
    keys = []
    for w, n in zip(words, sizes):
        digest = hashlib.blake2b(host.encode() + b"\n" + w, digest_size=8, person=b"block").digest()
        keys.append(int.from_bytes(digest, "little", signed=True) if MIN_RUN <= n and 2 * n < sum(sizes) else None)
    return keys


def _page_key(host: str, page: str) -> bytes:
    return hashlib.blake2b(f"{host}\n{page}".encode(), digest_size=16).digest()


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def read_pages(pages: DataFrame) -> DataFrame:
    """Parsed pages, one row per row of `pages`: the text where an article is marked, else the blocks to choose from.

    Also the page's key (equal for equal html on one host) and that of its host, the keys
    of its suffixes in page order, the block of each token of the stream, and for a marked
    article the keys of its blocks.
    """

    def settle(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("page_id", "url", "text", "page", "host", "blocks", "owners", "keys", "marks")}
            for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                host, blocks = _host(url), page_blocks(page or "")
                marked = [text for zone, text in blocks if zone == ARTICLE]
                choose = not marked and any(zone == OPEN for zone, _ in blocks)
                keys, owner = _stream(blocks, host)
                values = (
                    page_id,
                    url,
                    None if choose else "\n\n".join(marked),
                    _page_key(host, page or ""),
                    hashlib.blake2b(host.encode(), digest_size=16).digest(),
                    [None if zone == CHROME_ZONE else text for zone, text in blocks] if choose else None,
                    owner.tolist() if choose else None,
                    keys.tolist(),
                    _block_keys(marked, host) if marked else None,
                )
                for name, value in zip(out, values):
                    out[name].append(value)
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()), longs, longs, longs)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    schema = "page_id long, url string, text string, page binary, host binary, blocks array<string>, owners array<long>, keys array<long>, marks array<long>"
    return _pages(pages).mapInArrow(settle, schema)


def repeated_runs(parsed: DataFrame) -> DataFrame:
    """Keys of the MIN_RUN-token runs that stand on two or more distinct pages of one host.

    Suffixes with one key are combined in each task first, so a run that stands on most
    pages of a hot host costs a row per task.
    """
    suffixes = parsed.select("page", F.explode("keys").alias("key"))
    return suffixes.groupBy("key").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low <> high").select("key")


def site_blocks(parsed: DataFrame) -> DataFrame:
    """Keys of the blocks of marked articles that stand on most distinct pages of their host, copies of a page not counted.

    Blocks are counted once per page, pages once per host, both combined in each task; what is left are the few
    blocks that a site repeats, at most 1 / SITE_SHARE of its blocks per page.
    """
    distinct = parsed.select("host", "page", "marks").dropDuplicates(["host", "page"])
    pages = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    found = distinct.select("host", F.explode(F.array_distinct("marks")).alias("key")).where("key is not null")
    often = found.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= SITE_PAGES)
    return often.join(pages, "host").where(F.col("n") >= SITE_SHARE * F.col("pages")).select("key")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) per row of `pages` (page_id, url, html; others are ignored).

    Blocks are joined by two line ends in page order. A null or empty html, or a page
    without main text, gives an empty text; a null url is a host of its own. Equal pages
    are one page to the search for repeats, so copies of a page keep its text. Broken
    markup ends open elements with the page. Pages are parsed once, into a stored table.
    """
    parsed = durable(read_pages(pages))
    open_pages = parsed.where("text is null")
    suffixes = open_pages.dropDuplicates(["page"]).select("page", F.posexplode("keys").alias("place", "key"))
    covered = suffixes.join(repeated_runs(parsed), "key").groupBy("page").agg(F.array_sort(F.collect_list("place")).alias("places"))

    def unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, owners, places in zip(*(batch.column(c).to_pylist() for c in ("blocks", "owners", "places"))):
                owner = np.array(owners, np.int64)
                hit = np.zeros(len(owner) + MIN_RUN, bool)
                for k in range(MIN_RUN):
                    hit[np.array(places or [], np.int64) + k] = True
                total, inside = np.bincount(owner, minlength=len(blocks)), np.bincount(owner[hit[: len(owner)]], minlength=len(blocks))
                texts.append("\n\n".join(b for b, n, c in zip(blocks, total, inside) if b is not None and 2 * c < max(n, 1)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rest = open_pages.join(covered, "page", "left").select("page_id", "url", "blocks", "owners", "places").mapInArrow(unique_runs, "page_id long, url string, text string")
    settled = parsed.where("text is not null")
    own = durable(site_blocks(settled))
    whole = settled.select("page_id", "url", "text")
    if not own.isEmpty():
        hits = settled.select("page", F.explode("marks").alias("key")).join(own, "key").groupBy("page").agg(F.collect_set("key").alias("own"))
        # blocks hold no line ends, so the text gives them back
        left = F.filter(F.split("text", "\n\n"), lambda b, k: ~F.coalesce(F.array_contains("own", F.get("marks", k)), F.lit(False)))
        text = F.when(F.col("own").isNull(), F.col("text")).otherwise(F.array_join(left, "\n\n")).alias("text")
        whole = settled.select("page_id", "url", "text", "page", "marks").join(hits, "page", "left").select("page_id", "url", text)
    done = whole.unionByName(rest)
    return done.withColumn("n_chars", F.length("text").cast("long"))
