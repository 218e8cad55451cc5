"""HTML extraction with a suffix array for each host.

A page becomes blocks of text. Mark-up says of some what they are: ``IN`` an article,
``AWAY`` from it (menus, headers, footers, sidebars, notices, adverts, forms, comments), or nothing (``OPEN``).
The words of a host's open blocks are concatenated page by page and their suffixes
sorted to a depth of ``RUN`` words by prefix doubling. A run of so many words that stands
on two distinct pages, and on one in ``SHARE`` of the pages, is a repeat; the words that
repeats cover go and the unique runs of a block stay. On a page without an article
all text is found so. Inside an article, repeats alone can't give right results: articles that are
copied between pages, or quote one passage, repeat as menus do. So there a block goes only
where all of it, of ``IN_WORDS`` words at most, is found on half of the host's pages and on
``IN_PAGES`` of them, as a line is that asks to sign up.

Pages count by content: pages of equal text that is not AWAY are one page, so a copied
page is not its own boilerplate, and pages without such text are none.

A host of more than ``GROUP`` pages, or ``GROUP_BYTES`` bytes, is dealt into groups. What repeats
there is counted before, over the whole host: suffixes of equal first RUN words meet in one
shuffle by their hash, once for each content, and each group gets its host's repeats: at
most 20 times as many as a page has words on average. So a result does not depend on the groups, and a
host with a third of all pages is many tasks.

Equal runs, blocks and contents are told by 64-bit hashes.

Defined results: a null or empty html gives an empty text; a page with no readable
host is of the empty host; rows that tie on or repeat a page_id, and null ones, are each
extracted; an unclosed comment or script ends the page; where a tag with an unclosed quote
runs to the end, tags end at the next ``>`` from there on. A very long page is
parsed in one pass, in time proportional to its length, and its text is never cut; an empty table gives an
empty one; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, text_chunks, words

RUN = 8
GROUP = 64
GROUP_BYTES = 32 << 20
#: Of how many pages of a host boilerplate is on one at least.
SHARE = 20
#: Pages that a block inside articles is on, at least, and its words, at least and at most, if it is boilerplate.
IN_PAGES = 10
IN_WORDS = (4, 40)
#: Rows of hosts with more pages than a group up to which they are broadcast.
BROADCAST_HOSTS = 100_000

# Elements of which the content is no text of the page, with what ends it.
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+(?:>|$)", re.I) for x in ("script", "style", "noscript", "textarea", "title", "iframe", "xmp")}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: From a tag's name to its end. A quote counts after an equals sign only; nothing is tried twice.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+>""")
_ATTRIBUTE = re.compile(r"""([^\s/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|\S++))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# HTML elements that break text into blocks.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
# HTML elements without an end.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article's text.
_OUT = frozenset("nav aside footer form button dialog menu search label fieldset select datalist template svg math object canvas audio video".split())
#: Words of a class, id or role that name what surrounds an article; an article inside is one all the same.
_HINTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer contentinfo complementary banner masthead topbar toolbar ad ads advert advertisement adverts advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget widgets pagination pager copyright disclaimer skip".split()
)
#: Words that name readers' comments, which may be articles of their own.
_COMMENTS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
#: First words of a name that says what a part has or lacks, not what it is.
_ASIDE = frozenset("has with without no is hide show".split())
#: Words beside those, which say where or what kind of box; any other word makes a name one of content.
_FRAME = frozenset(
    "site page main body top bottom left right center middle inner outer global local primary secondary first last sticky fixed mobile desktop section block box bar panel area region zone slot "
    "column columns col row rows grid container wrapper wrap holder group list items item link links button buttons btn icon icons image img title heading headline label text content "
    "header form js module component unit element post posts entry entries articles stories up in".split()
)


@lru_cache(1 << 16)
def _name_says(name: str) -> int:
    """What a class, id or role says: 0 nothing, 1 a part around the article, 2 comments."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    if not parts or parts[0] in _ASIDE:
        return 0
    told = [x for x in parts if x not in _FRAME]
    if not told or any(x not in _HINTS and x not in _COMMENTS for x in told):
        return 0
    return 2 if any(x in _COMMENTS for x in told) else 1


def _named(tag: str, attributes: str) -> int:
    """What a start tag's attributes say: 0 nothing, 1 a part around the article, 2 comments or hidden."""
    found = 0
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden":
            return 2
        if not value or key not in ("class", "id", "role", "aria-hidden", "style"):
            continue
        value = value.strip("\"'")
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        if key in ("class", "id", "role") and tag not in ("html", "body"):
            found = max([found, *map(_name_says, value.split())])
            if found == 2:
                return 2
    return found


def tokens(page: str):
    """Yield ("", text), (tag, attributes) and ("/" + tag, "") in order, in one pass over the page."""
    at, n, strict = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield "", page[at : lt if lt >= 0 else n]
            if lt < 0:
                return
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", lt)
            mark = "-->" if comment else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = page.find(mark, lt + 2)
            if end < 0:
                return
            at = end + len(mark)
            continue
        closing = after == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if closing:  # no end tag: like a comment
                at = page.find(">", lt) + 1 or n
            else:
                yield "", "<"
                at = lt + 1
            continue
        rest = _REST.match(page, name.end()) if strict else None
        if rest:
            end = rest.end()
        else:
            strict = False
            end = page.find(">", name.end()) + 1
            if not end:
                return
        tag = name.group().lower()
        at = end
        yield ("/" + tag, "") if closing else (tag, page[name.end() : end - 1])
        if not closing and tag in _RAW:
            close = _RAW[tag].search(page, end)
            if not close:
                return
            at = close.end()


OPEN, IN, AWAY, AROUND = 0, 1, 2, 3
_ITEM = frozenset("p li dt dd tr td th option".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(state, text) of each block of a page, in order: IN an article, AWAY from it by mark-up, or OPEN.

    A block outside an article that is mostly links is AWAY too, unless it is a paragraph.
    """
    out: list[tuple[int, str]] = []
    # Open elements with their states; of each name, and of those that break text, where they are among them.
    tags: list[str] = []
    states: list[int] = []
    places: dict[str, list[int]] = {}
    breaks: list[int] = []
    state, text, linked, links = OPEN, [], False, 0

    def flush() -> None:
        nonlocal links
        if text:
            line = " ".join("".join(text).split())
            if line:
                list_like = state == OPEN and 2 * links > len(line) and not (breaks and tags[breaks[-1]] in _PROSE)
                out.append((AWAY if state == AROUND or list_like else state, line))
            text.clear()
            links = 0

    def pop() -> None:
        tag = tags.pop()
        states.pop()
        places[tag].pop()
        if tag in _BLOCK:
            breaks.pop()

    for tag, said in tokens(page or ""):
        if not tag:
            text.append(entities.unescape(said) if "&" in said else said)
            if linked:
                links += len(text[-1])
            continue
        closing = tag[0] == "/"
        if closing:
            tag = tag[1:]
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            linked = not closing
            continue
        if tag in _RAW:
            continue
        if tag in _BLOCK or tag in _OUT:
            flush()
        if closing:
            mine = places.get(tag)
            # A stray end tag does not close what lies around an article's or page's part.
            if mine and (tag in _BLOCK or not breaks or breaks[-1] <= mine[-1]):
                at = mine[-1]
                outer = states[at - 1] if at else OPEN
                if outer != state:
                    flush()
                while len(tags) > at:
                    pop()
                state = outer
            continue
        if tag in _VOID or said.endswith("/"):
            continue
        if tag in _ITEM:  # an open one of these ends here
            while tags and (tags[-1] == tag or tags[-1] not in _BLOCK and tags[-1] not in _OUT):
                pop()
            state = states[-1] if states else OPEN
        now, named = state, _named(tag, said) if said and not said.isspace() else 0
        if state == AWAY or tag in _OUT or tag == "header" and state != IN or named == 2:
            now = AWAY
        elif tag in ("article", "main"):
            now = IN
        elif named:
            now = AROUND
        if now != state:
            flush()
        places.setdefault(tag, []).append(len(tags))
        if tag in _BLOCK:
            breaks.append(len(tags))
        tags.append(tag)
        states.append(now)
        state = now
    flush()
    return out


def stream(texts: list[str], page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, words after it on its page) of each word of texts, of which ``page`` numbers the pages."""
    column = pa.array(texts, pa.large_string())
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, _, data, starts in text_chunks(column):
        _, _, h, first = words(data, starts)
        hashes.append(h)
        owner.append(lo + np.repeat(np.arange(len(first) - 1), np.diff(first)))
    h, owner = np.concatenate(hashes), np.concatenate(owner)
    n = len(h)
    if not n:
        return h, owner, owner
    of = page[owner]
    last = np.r_[np.flatnonzero(of[1:] != of[:-1]), n - 1]
    return h, owner, last[np.searchsorted(last, np.arange(n))] - np.arange(n)


def run_keys(h: np.ndarray, run: int = RUN) -> np.ndarray:
    """64-bit hash of the run of words that starts at each word; past the end words count as none."""
    out = np.zeros(len(h), np.uint64)
    for k in range(run):
        out = mix(out + np.r_[h[k:], np.zeros(min(k, len(h)), np.uint64)])
    return out


def cover(again: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which words lie in a run that starts where ``again`` says."""
    edge = np.zeros(len(again) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_words(texts: list[str], page: np.ndarray, alike: np.ndarray | None = None, least: int = 2, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(covered, text) of each word: whether runs found on ``least`` pages or more cover it.

    ``page`` numbers the page of each text; texts of a page are in its order and follow one another.
    ``alike`` gives pages that are one the same number.
    """
    h, owner, left = stream(texts, page)
    n = len(h)
    if not n:
        return np.zeros(0, bool), owner
    of = page[owner] if alike is None else alike[page[owner]]
    # Sort suffixes by their first 1, 2, 4, ... words; past a page's end stands a rank of its own.
    rank = np.unique(h, return_inverse=True)[1].astype(np.int64) + 1
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.where(left >= step, rank[np.minimum(np.arange(n) + step, n - 1)], 0)
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    array = np.lexsort((of, rank))
    sorted_rank, pages = rank[array], of[array]
    starts = np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]
    first = np.flatnonzero(starts)
    spans = np.add.reduceat(starts | np.r_[True, pages[1:] != pages[:-1]], first, dtype=np.int64) >= least
    again = np.zeros(n, bool)
    again[array] = np.repeat(spans, np.diff(np.r_[first, n]))
    return cover(again & (left >= run - 1), run), owner


def repeats(texts: list[str], page: np.ndarray, run: int = RUN, least: int = 2) -> np.ndarray:
    """Of each text, the share of its words that runs found on ``least`` pages or more cover."""
    covered, owner = repeated_words(texts, page, None, least, run)
    return np.bincount(owner, covered, len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1)


def known_words(texts: list[str], page: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(covered, text) of each word: whether runs of which the hash is in ``known`` (sorted) cover it."""
    h, owner, left = stream(texts, page)
    if not len(h) or not len(known):
        return np.zeros(len(h), bool), owner
    keys = run_keys(h)
    found = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
    return cover(found & (left >= RUN - 1)), owner


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def content(parts: list[tuple[int, str]]) -> int | None:
    """What makes pages one: the text that mark-up does not put away."""
    kept = [t for s, t in parts if s != AWAY]
    return _key("\n".join(kept)) if kept else None


def short(state: int, text: str) -> bool:
    return state == IN and IN_WORDS[0] <= text.count(" ") + 1 <= IN_WORDS[1]


def main_text(parts: list[tuple[int, str]], hits: list[np.ndarray | None], common: set[int]) -> tuple[str, int, int]:
    """(text, blocks kept, blocks that repeats touch) of a page; hits: of each open block, which words go."""
    article = any(s == IN for s, _ in parts)
    keep, many = [], 0
    for (s, t), hit in zip(parts, hits, strict=True):
        if s == IN:
            if short(s, t) and _key(t) in common:
                many += 1
                continue
        elif s == OPEN and not article:
            if hit is not None and hit.any():  # the runs that are the page's own stay
                many += 1
                t = " ".join(w for w, x in zip(t.split(" "), hit, strict=True) if not x)
        else:
            continue
        if t:
            keep.append(t)
    return "\n\n".join(keep), len(keep), many


def extract_group(pages: pd.DataFrame, known: np.ndarray | None = None) -> pd.DataFrame:
    """Main texts of pages (page_id, url, html) of one host: of all its pages, or of some with the hashes of its repeats."""
    parts = [blocks(h) for h in pages["html"]]
    starts = np.cumsum([0, *map(len, parts)])
    opened = [k for p, lo in zip(parts, starts, strict=False) for k, (s, _) in enumerate(p, int(lo)) if s == OPEN]
    flat = [t for p in parts for _, t in p]
    page = np.repeat(np.arange(len(parts)), np.diff(starts))
    if known is None:
        # Pages of one content are one page: its open blocks follow one another for each of them.
        first: dict[int, int] = {}
        alike = np.array([i if c is None else first.setdefault(c, i) for i, c in enumerate(map(content, parts))], np.int64)
        opened.sort(key=lambda k: (alike[page[k]], k))
        n = len(first)
        covered, owner = repeated_words([flat[k] for k in opened], page[opened] if opened else page[:0], alike, max(2, -(-n // SHARE)))
        found: dict[int, set[int]] = {}
        for i, p in enumerate(parts):
            for s, t in p:
                if short(s, t):
                    found.setdefault(_key(t), set()).add(int(alike[i]))
        common = {k for k, on in found.items() if len(on) >= IN_PAGES and 2 * len(on) >= n}
    else:
        covered, owner = known_words([flat[k] for k in opened], page[opened] if opened else page[:0], known)
        common = set(known.view(np.int64).tolist())
    hits: list[np.ndarray | None] = [None] * len(flat)
    cut = np.searchsorted(owner, np.arange(len(opened) + 1))
    for j, k in enumerate(opened):
        hits[k] = covered[cut[j] : cut[j + 1]]
    done = [main_text(p, hits[lo : lo + len(p)], common) for p, lo in zip(parts, starts, strict=False)]
    texts = pd.Series([d[0] for d in done], dtype=object)
    return pd.DataFrame({"page_id": pages["page_id"], "url": pages["url"].astype(object), "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [d[1] for d in done], "n_repeated": [d[2] for d in done]})


def host_repeats(rows: DataFrame) -> DataFrame:
    """(host, key): hashes of the runs, and of the blocks in articles, on enough pages of a host, over all of rows (host, html)."""

    def runs(batches):
        for batch in batches:
            hosts, marks, kinds, keys = [], [], [], []
            for host, html in zip(*(batch.column(k).to_pylist() for k in ("host", "html")), strict=True):
                parts = blocks(html)
                mark = content(parts)
                if mark is None:
                    continue
                texts = [t for s, t in parts if s == OPEN]
                h, _, left = stream(texts, np.zeros(len(texts), np.int64))
                found = np.unique(run_keys(h)[left >= RUN - 1]).view(np.int64)
                inside = np.array(sorted({_key(t) for s, t in parts if short(s, t)}), np.int64)
                keys += [np.zeros(1, np.int64), found, inside]
                kinds += [np.repeat(np.arange(3, dtype=np.int32), (1, len(found), len(inside)))]
                hosts += [host] * len(kinds[-1])
                marks += [np.full(len(kinds[-1]), mark, np.int64)]
            if hosts:
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(np.concatenate(x)) for x in (marks, kinds, keys))], ["host", "content", "kind", "key"])

    found = rows.mapInArrow(runs, "host string, content long, kind int, key long").distinct()
    # Kind 0 counts the contents of a host. A run that all pages have is counted in parts before they meet.
    counts = found.groupBy("host", "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = Scratch(rows.sparkSession, "runs").put(counts.where((F.col("kind") == 0) | (F.col("n") >= 2)), "counts")
    many = F.when(F.col("kind") == 1, SHARE * F.col("n") >= F.col("all")).otherwise((F.col("n") >= IN_PAGES) & (2 * F.col("n") >= F.col("all")))
    return counts.where("kind > 0").join(counts.where("kind = 0").select("host", F.col("n").alias("all")), "host").where(many).select("host", "key")


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", group: int = GROUP) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_blocks (kept), n_repeated (blocks that repeats took from)."""
    rows = pages.select(F.col(page_id).cast("long").cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(url).alias("host"))
    size = F.greatest(F.count(F.lit(1)) / group, F.sum(F.octet_length(F.coalesce("html", F.lit("")))) / GROUP_BYTES)
    large = rows.groupBy("host").agg(F.ceil(size).cast("int").alias("groups")).where(F.col("groups") > 1)
    n = large.count()
    large = F.broadcast(large) if n <= BROADCAST_HOSTS else large
    # A large host's rows are dealt by their numbers, so that equal rows part too; the group does not change a result.
    shard = F.when(F.col("groups").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("groups")).cast("int"))
    dealt = rows.join(large, "host", "left").select("host", shard.alias("shard"), "page_id", "url", "html", F.col("groups").isNotNull().alias("many"))
    # pandas would take a column of longs and nulls for doubles, so ids are text on the way.
    schema = "page_id string, url string, text string, n_chars long, n_blocks int, n_repeated int"
    out = lambda df: df.withColumn("page_id", F.col("page_id").cast("long"))
    whole = dealt.where(~F.col("many")).groupBy("host").applyInPandas(lambda pdf: extract_group(pdf), schema)
    if not n:
        return out(whole)
    common = host_repeats(rows.select("host", "html").join(large, "host", "left_semi"))
    common = common.join(large, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("shard"), "key")

    def grouped(pages: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        return extract_group(pages, np.sort(keys["key"].to_numpy(np.int64).view(np.uint64)))

    parts = dealt.where("many").groupBy("host", "shard").cogroup(common.groupBy("host", "shard")).applyInPandas(grouped, schema)
    return out(whole.unionByName(parts))
