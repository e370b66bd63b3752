"""Main text of web pages: block structure, and page differencing against the page with the nearest URL on the same host."""

import hashlib
import html as references
import re
from bisect import bisect_left
from itertools import accumulate
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import batch_of, fields_of, parts_in_order

OPENING = re.compile(r"<(?:(!--)|(/?)(?=[a-zA-Z])|[!?])")
NAME_END = re.compile(r"[\s/>]")
REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>")
DELIMITER = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")

# Fixed values of the markup language: elements whose content is no markup, that have no content, that stand in a line of
# text, and that end an open one of their own kind.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# Elements, roles and words of a class or id that mark what is not the article.
NOISE_TAGS = frozenset("head nav footer aside form button select menu dialog template svg math object canvas audio video map datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo search complementary dialog alert alertdialog menu menubar toolbar form".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu submenu sidebar footer masthead breadcrumb breadcrumbs pagination pager toolbar ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal "
    "overlay share sharing social related recommended recommendation recommendations widget widgets login search disclaimer copyright skip tracking".split()
)
READER_WORDS = frozenset("comment comments disqus discussion reply replies respond".split())
# In one class name with these, a word of noise only tells of the layout around it.
LAYOUT_WORDS = frozenset("with has no without layout main article entry post body".split())
KEPT_TAGS = frozenset("html body main article".split())


def attributes(text):
    return {k.lower(): references.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(text)}


def is_noise(tag, text, in_article):
    """0: no noise; 1: noise by a class or id word, which an article inside overrules; 2: noise with all it holds."""
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return 2
    if not text or text.isspace():
        return 0
    attr = attributes(text)
    role = attr.get("role", "").lower()
    if role in NOISE_ROLES and tag not in KEPT_TAGS or "hidden" in attr or attr.get("aria-hidden", "").lower() == "true":
        return 2
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attr.get("style", ""), re.I):
        return 2
    names = [{w.lower() for w in NAME.findall(name)} for name in f"{attr.get('class', '')} {attr.get('id', '')}".split()]
    words = set().union(*(n for n in names if not n & LAYOUT_WORDS))
    if words & READER_WORDS and tag not in ("html", "body", "main"):
        return 2
    if tag in KEPT_TAGS:
        return 0
    return 1 if words & NOISE_WORDS or "header" in words and not in_article else 0


class Tags:
    """The tags of a page in order, in time linear in the page whatever its markup: what is no whole tag is text.

    A tag ends at the first > outside quotes.  Once one has none, a table from the end of the page backward tells of every quote
    and > whether a tag that is open there ends at all, so that no other search runs to the end of the page in vain.
    """

    def __init__(self, page):
        self.page, self.last = page, page.rfind(">")
        self.name_end, self.table = -1, None

    def ends(self, at):
        """Whether a tag whose name ended at ``at`` ends."""
        if self.table is None:
            places, closed = [], []
            ahead, quoted = False, {'"': False, "'": False}
            for m in reversed([*DELIMITER.finditer(self.page)]):
                # quoted[q]: whether a tag ends in which the quote q is open here, that is, what follows the next q
                if m[0] == ">":
                    ahead = True
                else:
                    ahead, quoted[m[0]] = quoted[m[0]], ahead
                places.append(m.start())
                closed.append(ahead)
            self.table = places[::-1], closed[::-1]
        places, closed = self.table
        k = bisect_left(places, at)
        return k < len(places) and closed[k]

    def next(self, at):
        """(start, end, kind, name, attributes) of the next tag: kind is "!--", "/" or "" for a tag, None for a declaration."""
        page = self.page
        while True:
            m = OPENING.search(page, at)
            if m and m.start() > self.last and not m[1]:
                # only a comment may still begin where no > is left
                at = page.find("<!--", at)
                m = OPENING.match(page, at) if at >= 0 else None
            if not m:
                return None
            if m[1]:
                close = page.find("-->", m.end())
                return m.start(), len(page) if close < 0 else close + 3, "!--", "", ""
            if m[2] is None:
                return m.start(), page.index(">", m.end()) + 1, None, "", ""
            if self.name_end < m.end():
                found = NAME_END.search(page, m.end())
                self.name_end = found.start() if found else len(page)
            name_end = self.name_end
            rest = REST.match(page, name_end) if self.table is None or self.ends(name_end) else None
            if rest:
                return m.start(), rest.end(), m[2], page[m.end():name_end].lower(), page[name_end:rest.end() - 1]
            self.ends(name_end)
            at = m.start() + 1


def blocks(page):
    """(text, in article) of every text block of a page, in order, without what the markup itself marks as no article.

    Character references are decoded, white space is one blank, empty blocks are left out.
    """
    out, line = [], []
    stack = []  # (tag, noise, in article, place of the nearest block element at or below)
    open_tags = {}
    noise, inside = 0, False
    at, last = 0, None
    tags = Tags(page)

    def end_block():
        text = " ".join(references.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append((text, last))

    def close_from(k):
        for entry in stack[k:]:
            open_tags[entry[0]] -= 1
        del stack[k:]

    while True:
        found = tags.next(at)
        text = page[at:found[0] if found else len(page)]
        if text and not noise:
            if last is not inside:
                end_block()
                last = inside
            line.append(text)
        if not found:
            break
        _, at, kind, tag, rest = found
        if not tag:
            continue
        if tag not in INLINE:
            end_block()
        if kind:
            if open_tags.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close_from(k)
        elif tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            end = page.find(">", close.start()) if close else -1
            at = len(page) if end < 0 else end + 1
            continue
        elif tag not in VOID:
            ended = SELF_ENDING.get(tag, ())
            k = stack[-1][3] if stack else -1
            if k >= 0 and (stack[k][0] in ended or stack[k][0] == "p" and tag in ENDS_P):
                close_from(k)
            above, held, base = stack[-1][1:] if stack else (0, False, -1)
            mark = is_noise(tag, rest, held)
            article = held or tag in ("article", "main") and above < 2 and not mark
            if article and not held and above == 1:
                above = 0
            stack.append((tag, max(above, mark), article, base if tag in INLINE else len(stack)))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        noise, inside = (stack[-1][1], stack[-1][2]) if stack else (0, False)
    end_block()
    return out


def line_key(text):
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def bits_at(places, size):
    out = bytearray(size // 8 + 1)
    for j in places:
        out[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(out, "little")


def subsequence_rows(a, b):
    """After each line of ``a``: a number whose bit j is clear where the longest common subsequence with ``b[:j + 1]`` is longer
    than with ``b[:j]``.  All lines of ``b`` are one addition."""
    where = {}
    for j, v in enumerate(b):
        where.setdefault(v, []).append(j)
    kept = {v: bits_at(places, len(b)) for v, places in where.items() if len(places) > 64}
    full = row = (1 << len(b)) - 1
    for v in a:
        if v in where:
            hit = row & (kept.get(v) or bits_at(where[v], len(b)))
            row = (row + hit | row - hit) & full
        yield row


def common_places(a, b, cells=1 << 28):
    """Places in ``a`` of one longest common subsequence; tables beyond ``cells`` bits are cut in two (Hirschberg's way)."""
    if not a or not b:
        return []
    if len(a) * len(b) > cells and len(a) > 1:
        def lengths(x, y):
            for row in subsequence_rows(x, y):
                pass
            return [0, *accumulate(c == "0" for c in reversed(f"{row:0{len(y)}b}"))]

        half = len(a) // 2
        before, after = lengths(a[:half], b), lengths(a[:half - 1:-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[j])
        return common_places(a[:half], b[:cut], cells) + [half + i for i in common_places(a[half:], b[cut:], cells)]
    rows = [(1 << len(b)) - 1, *subsequence_rows(a, b)]
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
            if rows[i] >> j - 1 & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def common_lines(a, b):
    """Places in ``a`` of one longest common subsequence of the two line lists: equal ends first, then 64 lines a step."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead:len(a) - tail], b[lead:len(b) - tail]
    both = set(x) & set(y)
    at = [lead + i for i, v in enumerate(x) if v in both]
    middle = common_places([a[i] for i in at], [v for v in y if v in both])
    return [*range(lead), *[at[i] for i in middle], *range(len(a) - tail, len(a))]


def template_edges(a, b):
    """Places in ``a`` of the lines that open or close both lists; none where most of ``a`` is in ``b``: then the two are
    versions of one text, and what they share is that text."""
    if 2 * len(common_lines(a, b)) > len(a):
        return []
    n, lead, tail = min(len(a), len(b)), 0, 0
    while lead < n and a[lead] == b[lead]:
        lead += 1
    while tail < n - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return [*range(lead), *range(len(a) - tail, len(a))]


def address(url):
    """(host, path with query) of an address; an address that cannot be read has no host."""
    try:
        parts = urlsplit(url or "")
        return parts.hostname or "", parts.path.rstrip("/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return "", ""


def line_lists(pages):
    """(key, host, path, lines, own, article): hashes of a page's blocks and of those that may be its text, for pairing; equal rows once."""
    fields = {"host": "string", "path": "string", "lines": "longs", "own": "longs", "article": "boolean"}
    schema = T.StructType([T.StructField("key", T.LongType())] + fields_of(fields))

    def run(batches):
        for batch in batches:
            out = {k: [] for k in fields}
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = blocks(page or "")
                host, path = address(url)
                lines = [line_key(t) for t, _ in found]
                own = [n for n, (_, x) in zip(lines, found) if x]
                for k, v in (("host", host), ("path", path), ("lines", lines), ("own", own or lines), ("article", bool(own))):
                    out[k].append(v)
            made = batch_of(out, fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], ["key", *fields])

    return pages.select("key", "url", "html").mapInArrow(run, schema).dropDuplicates(["key"])


def shared_lines(lists):
    """(key, drop): the numbers of a page's blocks that it shares, in order, with the page of the nearest URL on its host.

    The pages stand in the order of host and path, cut into ordered parts; the nearest page is the neighbour with the longer
    common path, the one before in case of a tie.  A page with the very same text is a copy and tells nothing of what is
    template, so runs of copies are passed over, to the next page that differs.  Four pages of each part (one row per part)
    bridge the cuts.  Inside an article element only the lines that open or close both articles go, and the numbers are those
    of the article's blocks.  Only pages with something to drop are returned.
    """
    order = ["host", "path", "key"]
    parts = parts_in_order(lists, [F.col(c) for c in order])
    whole = F.struct("host", "path", "lines", "own")

    def other(page, step):
        """The nearest page before (after) that has not the text of this one: the one beyond the run of copies."""
        row = Window.partitionBy("__part").orderBy(*(order if step > 0 else [F.col(c).desc() for c in order]))
        beside = F.lag(page).over(row)
        return F.last(F.when(beside["own"] != F.col("own"), beside), ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))

    near = parts.withColumn("prev", other(whole, 1)).withColumn("next", other(whole, -1))
    place = F.struct(*order)
    ends = near.groupBy("__part").agg(
        F.min_by(whole, place).alias("head"), F.min_by("next", place).alias("after_head"),
        F.max_by(whole, place).alias("tail"), F.max_by("prev", place).alias("before_tail"),
    )
    ends = stored(ends, "ends")

    def beyond(edge, far, beyond_far, chain):
        """The same over the parts: the far edge of the part beside, else what differs from it there; a part of copies alone is passed over."""
        found = F.when(F.lag(far).over(chain)["own"] != F.col(edge)["own"], F.lag(far).over(chain)).otherwise(F.lag(beyond_far).over(chain))
        return F.last(found, ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, 0))

    ends = ends.select(
        "__part", beyond("head", "tail", "before_tail", Window.orderBy("__part")).alias("before"), beyond("tail", "head", "after_head", Window.orderBy(F.desc("__part"))).alias("after"),
    )
    near = near.filter("host <> ''").join(F.broadcast(ends), "__part")
    near = near.select("key", "host", "path", "lines", "own", "article", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))
    fields = {"drop": "longs"}
    schema = T.StructType([T.StructField("key", T.LongType())] + fields_of(fields))

    def alike(path, other):
        n = 0
        for x, y in zip(path, other):
            if x != y:
                break
            n += 1
        return n

    def run(batches):
        for batch in batches:
            keys, drops = [], []
            for r in batch.to_pylist():
                sides = [s for s in (r["prev"], r["next"]) if s and s["host"] == r["host"]]
                if sides:
                    partner = max(sides, key=lambda s: alike(r["path"], s["path"]))
                    drop = template_edges(r["own"], partner["own"]) if r["article"] else common_lines(r["lines"], partner["lines"])
                    if drop:
                        keys.append(r["key"])
                        drops.append(drop)
            yield batch_of({"key": keys, "drop": drops}, {"key": "long", **fields})

    return near.mapInArrow(run, schema)


def extract(pages, page_id="page_id", url="url", html="html"):
    """The main text of every page: page_id, url, text, n_chars.

    Where the markup names an article (or main) element, its blocks are the text, without those that open or close it and the
    nearest page's too: equal lines further inside are text that two articles share.  Elsewhere the blocks outside navigation,
    forms, adverts and the like are, without those shared with the page of the nearest URL on the same host.  Copies of a page
    do not count as its nearest; a page with copies only keeps its lines.

    A null html has an empty text; a page with a null or unreadable address has no partner; repeated rows get equal texts; an
    empty table gives no rows.  Only these columns are returned.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("key", F.xxhash64(F.col("page_id").cast("string"), "url", "html"))
    drops = stored(shared_lines(line_lists(rows)), "shared")
    joined = rows.join(drops, "key", "left").select("page_id", "url", "html", "drop")

    def run(batches):
        for batch in batches:
            texts = []
            for page, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = blocks(page or "")
                own = [t for t, x in found if x] or [t for t, _ in found]
                gone = set(drop or ())
                texts.append(" ".join(t for k, t in enumerate(own) if k not in gone))
            made = batch_of({"text": texts, "n_chars": [len(t) for t in texts]}, {"text": "string", "n_chars": "long"})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made.columns], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([joined.schema["page_id"], joined.schema["url"]] + fields_of({"text": "string", "n_chars": "long"}))
    return joined.mapInArrow(run, schema)
