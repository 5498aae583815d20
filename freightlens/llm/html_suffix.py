"""Main text of HTML pages, with a suffix array over each host's token streams.

A page is cut into blocks of text. Elements that say what they are (nav,
footer, forms, scripts, or a class, id or role to that effect) are left out.
Paragraphs, headings, lists, tables, quotes and preformatted text of an
``article`` or ``main`` element are prose by structure: they are the text, as
often as they may stand elsewhere. All other blocks, outside articles or in
unlabelled containers inside, go through the host: their tokens are concatenated
page by page, a suffix array over dense token numbers (by prefix doubling)
brings equal suffixes together, and the runs of at least ``RUN`` tokens that
``MIN_PAGES`` different pages of the host share are removed as boilerplate. What
is unique stays. Runs that cover more than half of a page's article are taken
as a copy of the article and stay. Then the article is the text, unless more
text stands outside: then both are.

A suffix array sorted to a depth of ``RUN`` tokens tells which places lie in a
shared run of any greater length: they are those covered by shared runs of
``RUN``. A host may hold a third of all pages, so its pages are dealt over
shards of bounded size; each builds its own suffix array. A host of one shard
reports its shared runs only, of several shards all runs with their numbers of
pages, and the sums decide. Pages with equal text fall into one shard and count
once: copies of a page are not boilerplate.

Defined results: null or empty html gives an empty text; a null url belongs to
the empty host; repeated rows get equal texts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.url_filter import host_of
from freightlens.plans.session import materialise

RUN = 8  # tokens
MIN_PAGES = 3
SHARD_TOKENS = 1 << 20

RAW = "script|style|noscript|template|textarea|iframe|svg|canvas|object|select|title|math"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    rf"|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"([a-z_:-][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
LEFT_OUT = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "label", "input", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em",
    "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
PARTS = re.compile(
    r"(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar\w*|widget\w*|menu\w*|nav|navbar|"
    r"navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|share|sharing|social|related|recommend\w*|comments?|commentlist|"
    r"disqus|respond|replies|reply|login|signup|search\w*|toolbar|pagination|pager|copyright|disclaimer|"
    r"skip|hidden)$",
    re.I,
)
PLACES = {"site", "page", "main", "global"}  # may precede the leading name
BY_NAME, OUT = 1, 2
OUTSIDE, INSIDE, ENCLOSED = 0, 1, 2  # ENCLOSED: an article in an element that is out by name
PROSE = 4  # added to INSIDE and ENCLOSED: prose by structure
PROSE_TAGS = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "blockquote", "pre", "figcaption",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}


def _left_out(tag: str, attributes: str, inside_text: bool) -> int:
    """Whether an element is no part of the text by what it says of itself:
    ``BY_NAME`` if only a class, id or role says so, else ``OUT`` or 0. Of a
    class or id the whole or its leading name counts."""
    if tag in LEFT_OUT or (tag == "header" and not inside_text):
        return OUT
    if not attributes.strip() or tag in ("html", "body"):
        return 0
    found = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for token in value.split():
                named = [p for p in re.split(r"[-_]+", token) if p]
                if len(named) > 1 and named[0].lower() in PLACES:
                    named = named[1:]
                if named and PARTS.match(named[0]) and not (inside_text and named[0].lower() == "header"):
                    found = BY_NAME
        elif name == "role" and value.lower() in ROLES:
            found = BY_NAME
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return OUT
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return OUT
    # An article named so (a comment, a card) is out for good, main is not.
    return OUT if found and tag == "article" else found


def page_blocks(page: str) -> tuple[list[str], list[str]]:
    """``(text, others)``: the blocks inside article or main elements and the
    blocks outside, both without elements that are left out."""
    blocks, kinds = ordered_blocks(page)
    of = lambda kind: [b for b, k in zip(blocks, kinds) if k & ~PROSE == kind]
    inside = of(INSIDE) or of(ENCLOSED)
    return inside, [b for b, k in zip(blocks, kinds) if k == OUTSIDE]


def ordered_blocks(page: str) -> tuple[list[str], list[int]]:
    """The blocks in their order and the kind of each."""
    found: tuple[list[str], list[int]] = ([], [])
    open_tags: list[tuple[str, int, int]] = []  # name, left out, kind
    piece: list[str] = []
    left_out, inside = 0, OUTSIDE

    def close_block() -> None:
        if piece:
            block = " ".join(entities.unescape("".join(piece)).split())
            if block:
                holder = next((t[0] for t in reversed(open_tags) if t[0] not in INLINE), "")
                found[0].append(block)
                found[1].append(inside | PROSE if inside and holder in PROSE_TAGS else inside)
            piece.clear()

    at = 0
    for m in TAG.finditer(page):
        if not left_out and m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            if not left_out:
                piece.append(" ")
            continue
        if tag not in INLINE:
            close_block()
        if m[2]:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    del open_tags[k:]
                    break
                if tag in INLINE and open_tags[k][0] not in INLINE:
                    break
            left_out, inside = (open_tags[-1][1], open_tags[-1][2]) if open_tags else (0, OUTSIDE)
            continue
        if tag in VOID or m[4].rstrip().endswith("/"):
            continue
        out = max(left_out, _left_out(tag, m[4], inside != OUTSIDE) if left_out < OUT else 0)
        if tag in INLINE:
            if out:
                open_tags.append((tag, out, inside))
                left_out = out
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th"):  # closed by the next of their kind
            if open_tags and open_tags[-1][0] == tag:
                open_tags.pop()
                out_above = open_tags[-1][1] if open_tags else 0
                out = max(out_above, _left_out(tag, m[4], inside != OUTSIDE))
        kind = inside
        if tag in ("article", "main") and out < OUT:
            kind, out = (ENCLOSED if out or inside == ENCLOSED else INSIDE), 0
        open_tags.append((tag, out, kind))
        left_out, inside = out, kind
    if not left_out and at < len(page):
        piece.append(page[at:])
    close_block()
    return found


def _token_hashes(blocks: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for b in blocks for w in b.split(" ")], np.uint64)


def _run_keys(tokens: np.ndarray) -> np.ndarray:
    """A hash of the run of ``RUN`` tokens at each place where one fits."""
    n = len(tokens) - RUN + 1
    if n < 1:
        return np.empty(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(RUN):
        key = (key ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _shared_blocks(blocks: list[str], kinds: list[int]) -> list[str]:
    """The blocks that the host decides on."""
    return [b for b, k in zip(blocks, kinds) if not k & PROSE]


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``(id, url, host, blocks, kinds, stream, n_tokens)``; ``stream`` tells
    pages of different text, ``n_tokens`` is of the blocks the host decides on."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[], [], [], []]
                for page in part.column(3):
                    blocks, kinds = ordered_blocks(page.as_py() or "")
                    tokens = _token_hashes(_shared_blocks(blocks, kinds))
                    stream = xxhash.xxh3_64_intdigest("\n".join(blocks).encode()) - (1 << 63)
                    for column, value in zip(columns, (blocks, kinds, stream, len(tokens))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *[pa.array(c, k) for c, k in zip(columns, types)]],
                    ["id", "url", "host", "blocks", "kinds", "stream", "n_tokens"],
                )

    url = F.col(f"`{url_col}`")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        url.alias("url"),
        host_of(url).alias("host"),
        F.col(f"`{html_col}`").alias("html"),
    )
    return rows.mapInArrow(
        parse,
        "id long, url string, host string, blocks array<string>, kinds array<int>, stream long, n_tokens long",
    )


def _streams(parsed: DataFrame) -> DataFrame:
    """``(host, stream, n_tokens, tokens)`` of the different pages of hosts with
    ``MIN_PAGES`` of them; others share no run."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = zip(part.column(3).to_pylist(), part.column(4).to_pylist())
                own = [_token_hashes(_shared_blocks(*page)).view(np.int64).tolist() for page in pages]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(own, pa.list_(pa.int64()))], ["host", "stream", "n_tokens", "tokens"]
                )

    spark = parsed.sparkSession
    rows = parsed.where(F.col("n_tokens") >= RUN)
    several = rows.groupBy("host").agg(F.count_distinct("stream").alias("n")).where(F.col("n") >= MIN_PAGES)
    several = materialise(spark, several.select("host"), "hosts")
    rows = rows.select("host", "stream", "n_tokens", "blocks", "kinds").join(several, "host", "left_semi")
    rows = rows.mapInArrow(tokens, "host string, stream long, n_tokens long, tokens array<long>")
    return rows.dropDuplicates(["host", "stream"])


def _suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each place's suffix among all, by its first ``depth`` (a
    power of two) tokens: ranks of half the length, two by two, are ranked
    again until the length is reached."""
    rank, n = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    while n < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-n] = rank[n:]
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1] + 1
        n *= 2
    return rank


def _shard_runs(frame: pd.DataFrame) -> pd.DataFrame:
    """The runs of a shard with the number of pages that hold each, from the
    suffix array of its pages' streams; of a host's only shard the shared ones."""
    streams = [np.asarray(t, np.int64) for t in frame["tokens"]]
    sizes = np.array([len(t) for t in streams])
    tokens, page = np.concatenate(streams), np.repeat(np.arange(len(streams)), sizes)
    rank = _suffix_ranks(tokens, RUN)
    # Places whose run ends on their page, in the order of the suffix array.
    place = np.flatnonzero(np.arange(len(tokens)) + RUN <= np.cumsum(sizes)[page])
    place = place[np.lexsort((page[place], rank[place]))]
    if not len(place):
        return pd.DataFrame({"host": [], "key": [], "pages": []}).astype({"host": str, "key": "int64", "pages": "int64"})
    rank, page = rank[place], page[place]
    new_run = np.r_[True, rank[1:] != rank[:-1]]
    new_page = new_run | np.r_[True, page[1:] != page[:-1]]
    pages = np.bincount(np.cumsum(new_run) - 1, weights=new_page).astype(np.int64)
    keys = _run_keys(tokens.view(np.uint64))[place[new_run]]
    told = pages >= (MIN_PAGES if frame["shards"].iloc[0] == 1 else 1)
    return pd.DataFrame({"host": frame["host"].iloc[0], "key": keys[told], "pages": pages[told]})


def _boilerplate(candidates: DataFrame) -> DataFrame:
    """``(host, key)``: the runs that enough pages of a host share."""
    spark = candidates.sparkSession
    sizes = candidates.groupBy("host").agg(F.ceil(F.sum("n_tokens") / SHARD_TOKENS).cast("long").alias("shards"))
    sizes = materialise(spark, sizes, "host-shards")
    dealt = candidates.join(sizes, "host").select(
        "host", F.pmod(F.xxhash64("stream"), F.col("shards")).alias("shard"), "shards", "tokens"
    )
    runs = dealt.groupBy("host", "shard").applyInPandas(
        lambda frame: _shard_runs(frame), "host string, key long, pages long"
    )
    runs = runs.groupBy("host", "key").agg(F.sum("pages").alias("pages"))
    return runs.where(F.col("pages") >= MIN_PAGES).select("host", "key")


def _places(candidates: DataFrame, shared: DataFrame) -> DataFrame:
    """``(host, stream, starts)``: where the shared runs begin on each page."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_run_keys(np.array(t, np.int64).view(np.uint64)).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(own, pa.list_(pa.int64()))], ["host", "stream", "keys"]
            )

    rows = candidates.select("host", "stream", "tokens")
    rows = rows.mapInArrow(keys, "host string, stream long, keys array<long>")
    rows = rows.select("host", "stream", F.posexplode("keys").alias("at", "key"))
    return rows.join(shared, ["host", "key"]).groupBy("host", "stream").agg(F.collect_set("at").alias("starts"))


def _unique_blocks(blocks: list[str], starts: set[int]) -> list[str]:
    """``blocks`` without the tokens covered by the runs at ``starts``. Blocks
    covered in full become empty; in others only stretches of ``RUN`` tokens or more, so
    a run that ends some words into a block takes nothing from it."""
    kept, at, covered = [], 0, 0  # covered: up to this token
    for block in blocks:
        words, stretch, gone = [], [], 0
        for word in block.split(" "):
            if at in starts:
                covered = at + RUN
            if at < covered:
                stretch.append(word)
            else:
                if len(stretch) < RUN:
                    words += stretch
                else:
                    gone += len(stretch)
                stretch = []
                words.append(word)
            at += 1
        if (words or gone) and len(stretch) < RUN:
            words += stretch
        kept.append(" ".join(words))
    return kept


def _main_text(blocks: list[str], kinds: list[int], starts: set[int]) -> str:
    """What the runs leave, decided by structure. Runs that cover most of an
    article are a copy of it, not boilerplate. The article is the text unless
    more text stands outside."""
    unique = list(blocks)
    if starts:
        left = iter(_unique_blocks(_shared_blocks(blocks, kinds), starts))
        unique = [b if k & PROSE else next(left) for b, k in zip(blocks, kinds)]
    kinds = [k & ~PROSE for k in kinds]
    text = INSIDE if INSIDE in kinds else ENCLOSED
    length = lambda of, kind: sum(len(b) for b, k in zip(of, kinds) if k == kind)
    if 2 * length(unique, text) < length(blocks, text):
        unique = [b if k == text else u for b, u, k in zip(blocks, unique, kinds)]
    if length(unique, text) >= length(unique, OUTSIDE):
        taken = {text}
    else:
        taken = {OUTSIDE, INSIDE}
    return "\n".join(u for u, k in zip(unique, kinds) if u and k in taken)


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Every row of ``pages`` as ``(id, url, text, by_host)``; ``by_host`` tells
    whether the host's runs took part."""
    spark = pages.sparkSession
    parsed = materialise(spark, _parsed(pages, id_col, url_col, html_col), "page-blocks")
    candidates = materialise(spark, _streams(parsed), "page-streams")
    shared = materialise(spark, _boilerplate(candidates), "host-boilerplate")
    places = materialise(spark, _places(candidates, shared), "boilerplate-places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (2, 3, 4)]
            texts = [_main_text(blocks, kinds, set(starts or ())) for blocks, kinds, starts in zip(*columns)]
            by_host = pa.array([bool(s) for s in columns[2]], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), by_host],
                ["id", "url", "text", "by_host"],
            )

    decided = parsed.join(places, ["host", "stream"], "left").select("id", "url", "blocks", "kinds", "starts")
    return decided.mapInArrow(cut, "id long, url string, text string, by_host boolean")
