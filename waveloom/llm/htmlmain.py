"""Main text of web pages by equivalence-class template deduction.

Pages of a host are sequences of tokens: tags under the path of tags that they stand in, and strings
between tags. Tokens with the same occurrence vector (how often on which pages of the host) form a class.
A class is valid if its tokens stand in one order on its pages and its occurrences do not cross those of
the class around it; valid classes nest into the host's template. What stands between template tokens is
a slot. The main text is the slots of the innermost template element, of those that stand once on a page, that holds two
thirds of what fills slots outside links and nine in ten of the headings that change from page to page. From it the text
widens to the elements around it, but not the body, as long as every block that this adds is mostly slots outside links
and other matter: leads and ends of articles are, menus are not. An article around it counts
whole. Template strings in it are dropped, unless they are the larger
part of its text: then they are what the page is about. Otherwise element names and words of class names do not choose
it: in it they tell what is something else (menu, form, script, comments, ...), and they decide alone only on pages
without such an element, as those of hosts with few pages. Pages with the same tokens count as one page: copies of an
article under several addresses are no template. Ids, and numbers in class names, are no part of a path.

Pages are read twice. The first reading writes a narrow table of token hashes, from which classes are judged. Occurrence
vectors are never built as rows: a token's vector is the sum of hashes of (page, count), summed map-side per (host,
token), so a host with a third of all pages is a few rows per task. Templates are broadcast if they are small
by their measured size; beyond it they are joined by host, where the engine splits hot hosts.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveloom.llm.common import discard, materialize, spread, worker

# Fixed values of HTML: elements by their role.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold no main text.
OTHER = frozenset("head nav footer aside form script style noscript template iframe svg math button select textarea input object canvas menu dialog audio video datalist label option title xmp".split())
#: Elements that a start tag of the same kind ends.
ENDS_OWN = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"body", "html", "head", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "legend", "summary"}
#: Words of class, id and role that name something other than the article.
OTHER_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice alert disclaimer warning newsletter subscribe subscription signup signin login register menu menubar nav navbar navigation navlist breadcrumb breadcrumbs crumbs pagination pager sidebar side aside rail widget widgets related recommended recommendations more-stories trending popular footer foot colophon copyright legal masthead topbar toolbar header site-header page-header comment comments commentlist reply replies respond disqus discussion responses share sharing social follow buttons tags taglist search searchbox skip skiplink complementary contentinfo".split()
)
ARTICLE_WORDS = frozenset("article articlebody article-body story storybody story-body post postbody post-body post-content entry entry-content main maincontent main-content content-main bodytext".split())
#: Parts of compounds that tell of the page's state or layout: what such a compound names is not what it holds.
STATE_WORDS = frozenset("with has no without open closed enabled disabled layout".split())
SIDE_WORDS = frozenset("sidebar side aside rail".split())
CONTENT_WORDS = frozenset("content main article".split())
WRAP_WORDS = frozenset("wrap wrapper container outer inner".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion responses".split())
TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<bogus>[!?][^>]*>?)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)|(?P<junk>/[^a-zA-Z>][^>]*>?|/>))", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: A flag of the page's own elements.
WHOLE_PAGE = 8
SPACE, NUMBER = re.compile(r"\s+"), re.compile(r"\d+")


class Node:
    """An open element: name, path hash, whether it holds article or other matter (and the token that began the
    latter), which elements in it end that: 0 none, 1 main, 2 main and article; and whether it is in a link or heading."""

    __slots__ = ("name", "path", "other", "article", "ends", "mark", "flags")

    def __init__(self, name, path, other, article, ends=2, mark=-1, flags=0):
        self.name, self.path, self.other, self.article, self.ends, self.mark, self.flags = name, path, other, article, ends, mark, flags


def _named(words: list[str]) -> tuple[bool, bool, int]:
    """(other, article, ends) by words of class, id and role; a compound counts by its parts, unless they tell of
    a layout. A comment list is ended by no element in it, a compound with a side only by main and article."""
    parts, ends = set(), 2
    for w in words:
        split = set(re.split(r"[-_]+", w)) - {"header" if w != "header" else ""}
        found = (split | {w}) & OTHER_WORDS
        compound = w not in OTHER_WORDS
        if compound and (split & STATE_WORDS or found <= SIDE_WORDS and split & CONTENT_WORDS and split & WRAP_WORDS):
            continue
        if found:
            parts |= found
            ends = min(ends, 0 if found & COMMENT_WORDS else 2 if compound and found <= SIDE_WORDS else 1)
    return bool(parts), bool(set(words) & ARTICLE_WORDS), ends


def tokens(page: str):
    """Tokens of a page in order: (kind, token hash, block number, text, in an article, in other matter, the token
    that began that, flags). kind: 0 tag start, 1 tag end, 2 string; flags: 1 in a link, 2 in a heading, 8 of the page's own elements. Block numbers
    grow at every block's start and end."""
    stack = [Node("", 0, False, False)]
    block, at, size, out = 0, 0, len(page), []

    def string(raw: str):
        text = html.unescape(raw)
        if text:
            top = stack[-1]
            plain = SPACE.sub(" ", text).strip()
            out.append((2, hashed(top.path, plain) if plain else 0, block, text, top.article, top.other, top.mark, top.flags))

    def end(n: int):
        nonlocal block
        while len(stack) > n:
            node = stack.pop()
            block += node.name in BLOCKS
            out.append((1, hashed(node.path, "/"), block, "", stack[-1].article, stack[-1].other, stack[-1].mark, 0))

    while at < size:
        m = TAG.search(page, at)
        if not m:
            string(page[at:])
            break
        if m.start() > at:
            string(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    end(i)
                    break
                if stack[i].name in ("table", "article", "body", "main") and name not in BLOCKS:
                    break
            else:
                block += name in BLOCKS
            continue
        closes = ENDS_OWN.get(name, frozenset()) | ({"p"} if name in ENDS_P else set())
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closes:
                    end(i)
                    break
                if stack[i].name in BLOCKS:
                    break
        words, shape, hidden = [], [], False
        if m["attrs"]:
            for a in ATTRIBUTE.finditer(m["attrs"]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "hidden":
                    hidden = True
                elif key == "style":
                    hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
                else:
                    found = html.unescape(value).lower().split()
                    words += found
                    if key != "id":
                        shape += [NUMBER.sub("#", w) for w in found]
        top = stack[-1]
        other, article, ends = _named(words)
        article = article or name in ("article", "main")
        # a header inside an article holds its title; page headers stand outside
        whole = name in ("html", "body", "main", "article")
        other = hidden or name in OTHER or (other and not whole) or (name == "header" and not top.article)
        if hidden or name in OTHER or name == "header":
            ends = 0
        # an article among comments is a comment; one in a wrapper that names a side is not of that side
        above = top.other and not (name in ("main", "article") and top.ends >= (1 if name == "main" else 2))
        ends = min(ends if other else 2, top.ends if above else 2)
        flags = top.flags | (name == "a") | 2 * (name in HEADINGS)
        node = Node(name, hashed(top.path, name + " " + " ".join(shape)), above or other, top.article or (article and not (above or other)), ends, len(out) if other else top.mark if above else -1, flags)
        block += name in BLOCKS
        out.append((0, node.path, block, " " if name == "br" else "", node.article, node.other, node.mark, flags | WHOLE_PAGE * (name in ("html", "body"))))
        if name in VOID or m["attrs"].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:  # its content is not markup
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else size
            out.append((1, hashed(node.path, "/"), block, "", top.article, top.other, top.mark, 0))
            continue
        stack.append(node)
    end(1)
    return out


def hashed(path: int, what: str) -> int:
    return xxhash.xxh64_intdigest(what, path & 0xFFFFFFFFFFFFFFFF)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def widened(parsed, first: int, strings) -> int:
    """The start of the outermost element that the text of the element begun at token ``first`` widens to."""
    around: list[int] = []
    for i, t in enumerate(parsed[:first]):
        if t[0] == 0:
            around.append(i)
        elif t[0] == 1:
            at = next((k for k in range(len(around) - 1, -1, -1) if hashed(parsed[around[k]][1], "/") == t[1]), None)
            if at is not None:
                del around[at:]
    # void elements before the first have no end: what ends after it is around it
    around = [i for i in around if end_of(parsed, i) > end_of(parsed, first)]
    own = next((i for i in around if parsed[i][4] and not parsed[i][5]), None)
    if own is not None:
        return own
    a, b = first, end_of(parsed, first)
    for i in reversed(around):
        end = end_of(parsed, i)
        blocks: dict[int, int] = {}
        for t in parsed[i:a] + parsed[b:end]:
            if t[0] == 2 and (n := len(t[3].strip())):
                blocks[t[2]] = blocks.get(t[2], 0) + (-n if t[5] or t[7] & 1 or signed(t[1]) in strings else n)
        if parsed[i][7] & WHOLE_PAGE or any(n <= 0 for n in blocks.values()):
            break
        a, b = i, end
    return a


def end_of(parsed, first: int) -> int:
    """The token that ends the element begun at ``first``. In an element none has its path, so the first such end is its own."""
    stop = hashed(parsed[first][1], "/")
    return next((i for i in range(first + 1, len(parsed)) if parsed[i][1] == stop and parsed[i][0] == 1), first)


def blocks_text(parsed, containers=frozenset(), strings=frozenset()) -> str:
    """Main text of parsed tokens: that of the innermost of the template's ``containers`` that stands once on
    the page, widened to what belongs to it; else that of articles if they hold any; else all but other matter. Template
    ``strings`` are dropped."""
    plain = lambda t: not (t[0] == 2 and signed(t[1]) in strings)
    found = Counter(t[1] for t in parsed if t[0] == 0 and signed(t[1]) in containers)
    first = max((i for i, t in enumerate(parsed) if t[0] == 0 and found.get(t[1]) == 1), default=None)
    if first is not None:
        first = widened(parsed, first, strings)
        chosen = [t for t in parsed[first : end_of(parsed, first)] if t[3] and t[6] <= first]
        left = [t for t in chosen if plain(t)]
        size = lambda tokens: sum(len(t[3].strip()) for t in tokens if t[0] == 2)
        chosen = left if 2 * size(left) >= size(chosen) else chosen
    elif any(kind == 2 and article and not other and text.strip() for kind, _, _, text, article, other, _, _ in parsed):
        chosen = [t for t in parsed if t[3] and t[4] and not t[5]]
    else:
        chosen = [t for t in parsed if t[3] and not t[5] and plain(t)]
    held: dict[int, list[str]] = {}
    for t in chosen:
        held.setdefault(t[2], []).append(t[3])
    blocks = (SPACE.sub(" ", "".join(x)).strip() for x in held.values())
    return "\n\n".join(b for b in blocks if b)


#: Pages of a host that must hold a class's tokens, and their share of the host's pages.
LEAST_PAGES, LEAST_SHARE = 4, 0.1
#: Pages of a class that may break its order or nesting, in hundredths.
UNSTEADY = 5
#: Templates of all hosts that are broadcast, in bytes.
MOST_BROADCAST = 32 << 20


def _token_sums(sums: dict, host, name: int, counts: Counter, weight: int = 1) -> None:
    """Add a page's tokens: per (host, token, kind) pages, the sum of hashes of (page, count), and occurrences."""
    for (token, kind), n in counts.items():
        h = xxhash.xxh64_intdigest(f"{name}:{n}") >> 24
        seen = sums.setdefault((host, token, kind), [0, 0, 0])
        seen[0] += weight
        seen[1] += weight * h
        seen[2] += weight * n


_SUM_NAMES = ["host", "token", "kind", "pages", "vector", "occurrences"]
_SUM_TYPES = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 3]
_SUM_FIELDS = "host string, token long, kind int, pages long, vector long, occurrences long"


def _sum_columns(sums: dict) -> list[list]:
    keys, values = list(sums), list(sums.values())
    return [*([k[i] for k in keys] for i in range(3)), *([v[i] for v in values] for i in range(3))]


def scan_pages(rows: DataFrame) -> DataFrame:
    """Rows of two kinds from one reading of ``rows`` (host, html): a page's tokens (host, name, hashes, kinds, chars:
    packed arrays) and, per task, sums of tokens. A page's name is a hash of all its tokens: copies have one name."""
    names = ["name", "hashes", "kinds", "chars", *_SUM_NAMES]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), *_SUM_TYPES]

    def out(columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    @worker
    def scan(batches):
        sums: dict = {}
        for batch in batches:
            packed: dict = {c: [] for c in ("host", "name", "hashes", "kinds", "chars")}
            for host, text in zip(*(batch.column(c).to_pylist() for c in ("host", "html")), strict=True):
                held = [(signed(t[1]), t[0], t[7] | 4 * t[5], len(t[3]) if t[0] == 2 else 0) for t in tokens(text or "") if t[1]]
                columns = list(zip(*held, strict=True)) or [()] * 4
                hashes = np.array(columns[0], np.int64).tobytes()
                name = signed(xxhash.xxh64_intdigest(hashes))
                packed["host"].append(host)
                packed["name"].append(name)
                packed["hashes"].append(hashes)
                packed["kinds"].append((np.array(columns[1], np.uint8) | np.array(columns[2], np.uint8) << 2).tobytes())
                packed["chars"].append(np.array(columns[3], np.uint32).tobytes())
                _token_sums(sums, host, name, Counter(t[:2] for t in held))
            yield out(packed)
            if len(sums) > 200_000:
                yield out(dict(zip(_SUM_NAMES, _sum_columns(sums), strict=True)))
                sums = {}
        if sums:
            yield out(dict(zip(_SUM_NAMES, _sum_columns(sums), strict=True)))

    return rows.mapInArrow(scan, "name long, hashes binary, kinds binary, chars binary, " + _SUM_FIELDS)


def copies_of(pages: DataFrame) -> DataFrame:
    """(host, name, n) of pages (host, name) that stand several times, counted map-side."""
    return pages.groupBy("host", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def surplus(pages: DataFrame, copies: DataFrame) -> DataFrame:
    """Sums of tokens, negative, of all copies of pages but one each: of a page's rows any will do, as their tokens are
    equal, so each task takes its first."""

    @worker
    def scan(batches):
        sums: dict = {}
        for batch in batches:
            for host, name, hashes, kinds, n in zip(*(batch.column(c).to_pylist() for c in ("host", "name", "hashes", "kinds", "n")), strict=True):
                counts = Counter(zip(np.frombuffer(hashes, np.int64).tolist(), (np.frombuffer(kinds, np.uint8) & 3).tolist(), strict=True))
                _token_sums(sums, host, name, counts, 1 - n)
            if len(sums) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_sum_columns(sums), _SUM_TYPES, strict=True)], _SUM_NAMES)
                sums = {}
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_sum_columns(sums), _SUM_TYPES, strict=True)], _SUM_NAMES)

    repeated = pages.join(copies, ["host", "name"]).groupBy("host", "name").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.first("kinds").alias("kinds"))
    return repeated.select("host", "name", "hashes", "kinds", "n").mapInArrow(scan, _SUM_FIELDS)


def equivalence_classes(sums: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, template) of hosts with enough pages: tokens that enough of them share, each with its class and kind,
    packed. A class has a start tag at least, so strings alone are none. A host's row is as long as its template."""
    vectors = sums.groupBy("host", "token", "kind").agg(F.sum("pages").alias("pages"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.sum("occurrences").alias("occurrences"))
    shared = vectors.join(hosts, "host").where(f"pages >= {LEAST_PAGES} and pages >= {LEAST_SHARE} * host_pages")
    numbered = shared.withColumn("class", F.xxhash64("pages", "vector", "occurrences"))
    long = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    packed = F.concat(long(F.col("token")), long(F.col("class")), long(F.col("kind")))
    # a class with strings only is left out by its least kind
    classes = numbered.groupBy("host", "class").agg(F.min("kind").alias("least"), F.sort_array(F.collect_list(packed)).alias("held")).where("least = 0")
    return classes.groupBy("host").agg(F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("held"))), lambda x: F.hex(x)), "").alias("template")).select("host", F.unhex("template").alias("template"))


def judge(events: list[tuple[int, int]], sizes: dict[int, int]) -> tuple[set, dict]:
    """On one page, for (class, token) in order: classes that cross another, and per (class, token) its place among
    its class's tokens, around and around; -1 if that changes."""
    places: dict[int, list[int]] = {}
    turns: dict[tuple[int, int], int] = {}
    for at, (kind, token) in enumerate(events):
        held = places.setdefault(kind, [])
        turn = len(held) % sizes[kind]
        held.append(at)
        if turns.setdefault((kind, token), turn) != turn:
            turns[kind, token] = -1

    def nests(inner: int, outer: int) -> bool:
        a, b, n = places[inner], places[outer], sizes[inner]
        return all(bisect_left(b, a[i]) == bisect_left(b, a[min(i + n, len(a)) - 1]) for i in range(0, len(a), n))

    kinds = sorted(places, key=lambda k: (-sizes[k], k))
    crossing = {d for i, d in enumerate(kinds) for c in kinds[:i] if not nests(d, c) and not nests(c, d)}
    return crossing, turns


class Template:
    """A host's candidate tokens, unpacked: class of (token, kind), size of each class, start of each end tag."""

    def __init__(self, packed: bytes):
        table = np.frombuffer(packed, ">i8").reshape(-1, 3).tolist()
        self.of = {(token, kind): name for token, name, kind in table}
        self.sizes = Counter(self.of.values())
        self.starts = {signed(hashed(token, "/")): token for token, _, kind in table if kind == 0}


def slots(page: list[tuple[int, int, int]], template: Template) -> tuple[dict, tuple[int, int]]:
    """Of one page's (token, kind and flags, characters): per start tag of the template that stands on it once, the
    characters and headings in it that are no template strings, not in links nor in other matter; and the same of
    the whole page."""
    total = heads = 0
    began, out, twice = {}, {}, set()
    for token, k, n in page:
        kind, flags = k & 3, k >> 2
        if kind == 2:
            if not flags & 5 and (token, 2) not in template.of:
                total += n
                heads += flags >> 1 & 1
        elif kind == 0:
            if (token, 0) in template.of:
                if token in began:
                    twice.add(token)
                began[token] = total, heads
        elif (start := template.starts.get(token)) in began:
            out[start] = total - began[start][0], heads - began[start][1]
    return {t: v for t, v in out.items() if t not in twice}, (total, heads)


def judged_tokens(rows: DataFrame) -> DataFrame:
    """Per task and (host, class, token, kind, turn): pages, pages on which the class crosses another, and of start
    tags what fills slots in them and on their pages. rows: (host, hashes, kinds, chars, template)."""
    sums = ["pages", "crossing", "chars", "heads", "all_chars", "all_heads"]

    @worker
    def scan(batches):
        known: dict = {}
        held: dict = {}
        for batch in batches:
            for host, hashes, kinds, chars, packed in zip(*(batch.column(c).to_pylist() for c in ("host", "hashes", "kinds", "chars", "template")), strict=True):
                template = known.get(host)
                if template is None:
                    if len(known) > 1000:
                        known = {}
                    template = known[host] = Template(packed)
                page = list(zip(np.frombuffer(hashes, np.int64).tolist(), np.frombuffer(kinds, np.uint8).tolist(), np.frombuffer(chars, np.uint32).tolist(), strict=True))
                events = [(name, (token, k & 3)) for token, k, _ in page if (name := template.of.get((token, k & 3))) is not None]
                crossing, turns = judge(events, template.sizes)
                inside, whole = slots(page, template)
                for (name, (token, kind)), turn in turns.items():
                    seen = held.setdefault((host, name, token, kind, turn), [0] * len(sums))
                    seen[0] += 1
                    seen[1] += name in crossing
                    if kind == 0 and token in inside:
                        for i, n in enumerate((*inside[token], *whole)):
                            seen[2 + i] += n
            if len(held) > 100_000:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held):
        keys, values = list(held), list(held.values())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(1, 5)), *(pa.array([v[i] for v in values], pa.int64()) for i in range(len(sums)))], ["host", "class", "token", "kind", "turn", *sums])

    partial = rows.mapInArrow(scan, "host string, class long, token long, kind long, turn long, " + ", ".join(f"{c} long" for c in sums))
    return partial.groupBy("host", "class", "token", "kind", "turn").agg(*[F.sum(c).alias(c) for c in sums])


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, containers, strings): of each host's template the elements that may hold the main text and the strings,
    packed, of pages (host, html)."""
    scanned = materialize(scan_pages(pages), "page-tokens")
    narrow = scanned.where("hashes is not null").select("host", "name", "hashes", "kinds", "chars")
    copies = materialize(copies_of(narrow), "page-copies")
    own = narrow.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).unionByName(copies.groupBy("host").agg((F.count(F.lit(1)) - F.sum("n")).alias("host_pages")))
    hosts = own.groupBy("host").agg(F.sum("host_pages").alias("host_pages")).where(f"host_pages >= {LEAST_PAGES}")
    sums = scanned.where("token is not null").select(_SUM_NAMES).unionByName(surplus(narrow, copies))
    found = materialize(equivalence_classes(sums, hosts), "page-classes")
    judged = materialize(judged_tokens(beside(narrow.drop("name"), found, "template")), "page-judged")
    discard(scanned)
    names = ("pages", "crossing", "chars", "heads", "all_chars", "all_heads")
    steady = judged.groupBy("host", "class", "token", "kind").agg(F.max(F.when(F.col("turn") >= 0, F.col("pages")).otherwise(0)).alias("most"), *[F.sum(c).alias(c) for c in names])
    odd = steady.where(f"most * 100 < pages * {100 - UNSTEADY} or crossing * 100 > pages * {UNSTEADY}").select("host", "class").distinct()
    valid = steady.join(odd, ["host", "class"], "left_anti")
    holds = (F.col("kind") == 0) & (F.col("all_chars") > 0) & (F.col("chars") * 3 >= F.col("all_chars") * 2) & (F.col("heads") * 10 >= F.col("all_heads") * 9)
    long = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    packed = lambda rows: F.unhex(F.array_join(F.transform(F.sort_array(F.collect_set(F.when(rows, long(F.col("token"))))), lambda x: F.hex(x)), ""))
    return materialize(valid.groupBy("host").agg(packed(holds).alias("containers"), packed(F.col("kind") == 2).alias("strings")), "page-templates")


def beside(rows: DataFrame, found: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """``rows`` with a host's columns of ``found``: broadcast only if these are small in bytes, as measured."""
    held = found.agg(F.sum(sum((F.octet_length(c) for c in columns), F.octet_length("host")) + 40)).first()[0] or 0
    return rows.join(F.broadcast(found) if held <= MOST_BROADCAST else found, "host", how)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every row: the main text, blocks in page order joined by an empty line.

    A null page has an empty text; a page whose url has no host belongs to the host ''. Pages of hosts with
    fewer than 4 pages are read by their own containers alone. Rows that repeat an id are pages of their
    own. An empty table gives an empty result; other columns are ignored. Broken markup is read as browsers
    do where it matters here: unclosed elements end with what encloses them.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html")))
    templates = deduce_templates(rows.select("host", "html"))
    id_field, url_field = df.schema[id_col], df.schema[url_col]

    @worker
    def extract(batches):
        known: dict = {}
        for batch in batches:
            texts = []
            for host, text, *packed in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "containers", "strings")), strict=True):
                template = known.get(host)
                if template is None:
                    if len(known) > 1000:
                        known = {}
                    template = known[host] = [frozenset(np.frombuffer(x or b"", ">i8").tolist()) for x in packed]
                texts.append(blocks_text(tokens(text or ""), *template))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    schema = T.StructType([T.StructField(id_col, id_field.dataType), T.StructField(url_col, url_field.dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return beside(rows, templates, "containers", "strings", how="left").select("id", "url", "host", "html", "containers", "strings").mapInArrow(extract, schema)
