"""Main text of web pages by template deduction over pages of one host.

A page becomes a sequence of tokens: tags, told apart by the containers they stand in, and stretches
of text. Over a group's differing pages, less those without tokens, each token has an occurrence
vector. Tokens that occur equally often on most pages are told apart by their number on the page;
those that then stand in one order on more than half of the pages (two at least) are the outer
class. Other tokens with one and the same vector are a class if they follow one another in a fixed
turn and each turn lies inside one gap of the outer class; such classes nest in the template. An odd page
(null, cut off, an error) costs no other page its template.

What stands between template tokens are the slots. Over all pages of the group a slot has so much
text, in links or not; a region (a container that the template opens) has what its slots have. The
main region is the innermost one with REGION_SHARE of all; its slots less the ones that are mostly
links (and, where the region is the whole page or a table, the ones that are nothing beside the
largest) are the main text, and text that is itself template falls away. Names of
elements, roles and classes weigh a slot (main or apart), and what they set apart inside the main
region goes; but names never empty a page: if they set all of the main region apart, what it holds is taken, and
only what they set apart inside it goes. Shared text inside the region is main text where main text stands before
and after it on the page and it is no link; at the region's ends it is template, in a marked article only if
all pages with that article share it and it is no sentence. The number of pages makes no difference. Where nothing can be compared (one page, or a page that lacks the region)
names alone decide, class names last.

A group is at most about GROUP pages of a host, dealt by a hash: a host with a third of all pages
becomes many groups, each with a template of its own, and no task holds more than a group at once.
Null html is an empty page with no text; a null or odd url makes a host of its own kind; cut-off
markup counts to the end; repeated rows come out each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import small

GROUP = 64
#: Times a token may stand on each page to be told apart by its number there; more frequent ones may only form nested classes.
NUMBERED = 64
#: Containers, from the innermost, that tell tokens of one name apart.
PATH = 6
#: The share of the group's text that the main region holds; of a slot's text in links that makes it a menu; of the largest slot's text that a slot needs in a region that is a whole page or table.
REGION_SHARE, LINK_SHARE, LEAST_SHARE = 0.6, 0.6, 0.05
#: How names weigh a slot's text.
WEIGH_MAIN, WEIGH_APART = 4.0, 0.125

# Element names of the HTML standard, by what they mean for extraction.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "xmp", "noembed", "noframes")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINER = {"html", "head", "body", "nav", "header", "footer", "aside", "article", "main", "section", "div", "form", "figure", "ul", "ol", "dl", "table", "blockquote", "dialog", "menu", "details", "button", "fieldset"}
BLOCK = CONTAINER | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "tr", "td", "th", "caption", "figcaption", "address", "hr", "summary", "legend", "thead", "tbody", "tfoot", "center", "option", "search", "hgroup"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
APART = {"head", "nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|newsletter|subscribe|popup|modal|nav\w*|menu|breadcrumbs?|sidebar|side-bar|widget|"
    r"header|masthead|footer|foot|comments?|commentlist|replies|reply|disqus|respond|related|share|social|skip-link|pagination|toolbar)(?:$|[\s_-])",
    re.I,
)

#: Classes of a layout that only say what it has beside it.
MODIFIER = re.compile(r"(?:^|(?<=\s))(?:(?:with|has|no|is|show|hide)[-_]\S*|\S*[-_](?:enabled|disabled|on|off))(?=\s|$)", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<(?P<cut>/?[a-zA-Z][^>]*)\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
#: How a sentence ends.
SENTENCE = re.compile(r"[.!?\u2026\u3002][\"'\u2019\u201d\u00bb)]*\s*\Z")


class Page:
    """Tokens of one page: (kind, key, text, box, link, heading); kind t is text, b a block border, o a tag inside a block.

    A box is a container: apart and main tell by names whether its text is set apart or main, opens is its opening token.
    """

    def __init__(self, source: str | None):
        self.tokens: list[tuple[str, str, str, int, bool, bool]] = []
        self.parent, self.nature, self.named, self.inner, self.opens = [-1], [False], [False], [False], [-1]
        stack: list[tuple[str, int]] = []
        open_names, within = Counter(), [False]
        path, box, at, link, heading = "", 0, 0, 0, False
        source = source or ""
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()], path, box, link > 0, heading)
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if name not in CONTAINER:
                if name == "a":
                    link = 0 if m["end"] else 1
                elif name in HEADINGS:
                    heading = not m["end"]
                self.tokens.append(("b" if name in BLOCK else "o", f"{path}<{m['end']}{name}", "", box, False, False))
                if name == "br":
                    self.tokens.append(("t", "", " ", box, False, False))
                continue
            link, heading = 0, False
            if m["end"]:
                if open_names[name]:
                    while stack[-1][0] != name:
                        open_names[stack.pop()[0]] -= 1
                        within.pop()
                    self.tokens.append(("b", f"{path}</{name}", "", box, False, False))
                    open_names[stack.pop()[0]] -= 1
                    within.pop()
            elif self._open(name, m["rest"], path, box, within[-1]):
                stack.append((name, len(self.parent) - 1))
                open_names[name] += 1
                within.append(within[-1] or self.inner[-1])
            path = "/".join(s[0] for s in stack[-PATH:]) + "/"
            box = stack[-1][1] if stack else 0
        if at < len(source):
            self._text(source[at:], path, box, link > 0, heading)
        self._judge()

    def _open(self, name: str, rest: str, path: str, box: int, within: bool) -> bool:
        """Takes an opening tag; tells whether it opens a box."""
        told = {a.lower(): q or s or u for a, q, s, u in ATTRIBUTE.findall(rest)} if rest else {}
        label = f"{told.get('class', '')} {told.get('id', '')}".strip()
        role = told.get("role", "").lower()
        nature = name in APART and not (name == "header" and within) or role in ROLES
        nature = nature or bool(rest) and (re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", rest) is not None or HIDDEN.search(told.get("style", "")) is not None)
        named = bool(label) and name not in ("html", "body", "article", "main") and NAMED.search(MODIFIER.sub("", label)) is not None
        self.tokens.append(("b", f"{path}<{name} {label}", "", box, False, False))
        if rest.endswith("/") and name in VOID:
            return False
        self.parent.append(box)
        self.nature.append(nature)
        self.named.append(named)
        self.inner.append(name in ("article", "main") or role in ("main", "article"))
        self.opens.append(len(self.tokens) - 1)
        return True

    def _text(self, raw: str, path: str, box: int, link: bool, heading: bool) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.tokens.append(("t", f"{path}#{SPACE.sub(' ', text).strip()}", text, box, link, heading))

    def _judge(self) -> None:
        """A box named like something apart is none if it holds all articles of the page: the name is its layout's."""
        n = len(self.parent)
        held = list(map(int, self.inner))  # articles in each box
        for b in range(n - 1, 0, -1):
            if self.parent[b] > 0:
                held[self.parent[b]] += held[b]
        articles = sum(self.inner)
        self.apart, self.main, self.own = [False] * n, [False] * n, [False] * n
        for b in range(1, n):
            up = self.parent[b]
            self.own[b] = self.nature[b] or self.named[b] and not (articles and held[b] == articles)
            self.apart[b] = self.apart[up] or self.own[b]
            self.main[b] = self.main[up] or self.inner[b]

    def apart_below(self, above: list[bool], names: bool) -> list[bool]:
        """For each box whether something sets it apart that is not itself above (in that list); names tells whether classes count."""
        own = self.own if names else self.nature
        out = [False] * len(self.parent)
        for b in range(1, len(out)):
            out[b] = not above[b] and (out[self.parent[b]] or own[b])
        return out


def _in_order(ranks: list[int]) -> set[int]:
    """The places of a longest rising run of ranks."""
    ends: list[int] = []
    last: list[int] = []
    before = []
    for i, rank in enumerate(ranks):
        k = bisect_left(ends, rank)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [rank], [i]
    found, i = set(), last[-1] if last else -1
    while i >= 0:
        found.add(i)
        i = before[i]
    return found


class Template:
    """What a group's pages share: outer tokens by (key, number on the page), and nested classes of tokens that repeat."""

    def __init__(self) -> None:
        self.often: dict[str, int] = {}
        self.outer: dict[tuple[str, int], int] = {}
        self.nested: dict[str, int] = {}
        self.region = -1
        self.marked = False
        self.names = True
        self.slots: set[tuple[int, str]] = set()
        self.support: Counter = Counter()

    def places(self, page: Page) -> list[int]:
        """For each token of the page its number among the outer ones, or -1."""
        many, met, out = Counter(t[1] for t in page.tokens), Counter(), []
        for t in page.tokens:
            key = t[1]
            if key and self.often.get(key) == many[key]:
                out.append(self.outer.get((key, met[key]), -1))
                met[key] += 1
            else:
                out.append(-1)
        return out


def _differing(pages: list[Page]) -> list[Page]:
    distinct: dict[tuple, Page] = {}
    for page in pages:
        if page.tokens:
            distinct.setdefault(tuple(t[1] for t in page.tokens if t[0] == "t"), page)
    return list(distinct.values())


def _outer(found: Template, pages: list[Page], many: list[Counter], need: int) -> None:
    """The tokens that stand equally often and in one order on most pages."""
    vectors: dict[str, Counter] = defaultdict(Counter)
    for own in many:
        for key, n in own.items():
            vectors[key][n] += 1
    for key, counts in vectors.items():
        n, pages_with = counts.most_common(1)[0]
        if key and n <= NUMBERED and pages_with >= need:
            found.often[key] = n
    seen = []
    for page, own in zip(pages, many):
        met, order = Counter(), []
        for t in page.tokens:
            key = t[1]
            if key and found.often.get(key) == own[key]:
                order.append((key, met[key]))
                met[key] += 1
        seen.append(order)
    by_size = sorted(seen, key=len, reverse=True)
    after: dict = dict(zip([None, *by_size[0]], [*by_size[0], None]))
    for own in by_size[1:]:  # a token that the fullest page lacks comes after the one that it follows elsewhere
        for before, key in zip([None, *own], own):
            if key not in after:
                after[before], after[key] = key, after[before]
    order, key = [], after[None]
    while key is not None:
        order.append(key)
        key = after[key]
    rank = {k: i for i, k in enumerate(order)}
    steady = Counter(own[i] for own in seen for i in _in_order([rank[k] for k in own]))
    found.outer = {k: rank[k] for k, n in steady.items() if n >= need}
    found.support = Counter({rank[k]: n for k, n in steady.items()})
    found.often = {k: n for k, n in found.often.items() if any((k, i) in found.outer for i in range(n))}


def _nested(found: Template, pages: list[Page], many: list[Counter], marks: list[list[int]], need: int) -> None:
    """Classes of tags with one vector whose turns each lie in one gap of the outer class."""
    vectors: dict[str, list[int]] = {}
    for k, (page, own) in enumerate(zip(pages, many)):
        for key in {t[1] for t in page.tokens if t[0] != "t"}:
            if key not in found.often:
                vectors.setdefault(key, [0] * len(pages))[k] = own[key]
    classes: dict[tuple, list[str]] = defaultdict(list)
    for key, vector in vectors.items():
        if sum(v > 0 for v in vector) >= need:
            classes[tuple(vector)].append(key)
    gaps = []
    for own in marks:
        gap, out = -1, []
        for m in own:
            gap = m if m >= 0 else gap
            out.append(gap)
        gaps.append(out)
    for keys in classes.values():
        members, turn = set(keys), None
        for page, gap in zip(pages, gaps):
            at = [i for i, t in enumerate(page.tokens) if t[1] in members]
            names = [page.tokens[i][1] for i in at]
            turn = turn or names[: len(keys)] or None
            if turn and (names != turn * (len(at) // len(keys)) or any(gap[at[i]] != gap[at[i + len(keys) - 1]] for i in range(0, len(at), len(keys)))):
                break
        else:
            found.nested |= {k: len(keys) for k in keys}


def template(pages: list[Page]) -> Template | None:
    """What the pages that differ share, its main region and main slots; None where there is nothing to compare."""
    distinct = _differing(pages)
    if len(distinct) < 2:
        return None
    found, need = Template(), max(2, len(distinct) // 2 + 1)
    many = [Counter(t[1] for t in p.tokens) for p in distinct]
    _outer(found, distinct, many, need)
    if len(found.outer) < 2:
        return None
    marks = [found.places(p) for p in distinct]
    _nested(found, distinct, many, marks, need)
    _choose(found, distinct, marks)
    return found if found.region >= 0 else None


def _slots(found: Template, page: Page, marks: list[int]) -> Iterator[tuple[int, tuple[int, str], int]]:
    """(token, slot, innermost region or -1) of the page's texts, template or not."""
    region = [-1] * len(page.parent)
    for b in range(1, len(region)):
        own = marks[page.opens[b]]
        region[b] = own if own >= 0 else region[page.parent[b]]
    last, turn = -1, ""
    for i, (kind, key, _, box, _, _) in enumerate(page.tokens):
        if marks[i] >= 0:
            last, turn = marks[i], ""
            if kind != "t":
                continue
        elif key in found.nested:
            turn = key
        if kind == "t":
            yield i, (last, turn), region[box]


def _inside(found: Template, page: Page, marks: list[int]) -> list[bool]:
    """For each box whether it is the main region's or in it."""
    inside = [False] * len(page.parent)
    for b in range(1, len(inside)):
        inside[b] = marks[page.opens[b]] == found.region or inside[page.parent[b]]
    return inside


def _choose(found: Template, pages: list[Page], marks: list[list[int]]) -> None:
    """Sets the main region and slots by what they hold over all pages."""
    held: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0, 0.0])  # text, in links, headings, main, apart
    up: dict[int, int] = {}
    in_main: Counter = Counter()
    for page, own in zip(pages, marks):
        region = [-1] * len(page.parent)
        for b in range(1, len(region)):
            over, mark = region[page.parent[b]], own[page.opens[b]]
            region[b] = mark if mark >= 0 else over
            if mark >= 0 and over < mark:  # what opens earlier has the smaller number, so the regions are a tree
                up.setdefault(mark, over)
            if mark >= 0:
                in_main[mark] += 1 if page.main[b] else -1
        for i, slot, inner in _slots(found, page, own):
            _, _, text, box, link, heading = page.tokens[i]
            n = len(text.strip())
            if n and own[i] < 0 and inner >= 0:
                h = held[slot, inner]
                for k, is_so in enumerate((True, link, heading, page.main[box], page.apart[box])):
                    h[k] += n * is_so
    score = {}
    for key, (text, links, _, main, apart) in held.items():
        weight = WEIGH_APART if 2 * apart > text else WEIGH_MAIN if 2 * main > text else 1.0
        score[key] = max(0.0, text - 2 * links if weight == 1.0 else text) * weight
    if not any(score.values()):  # nothing but links: they are what the pages hold
        score = {key: h[0] * WEIGH_APART for key, h in held.items()}
    whole, sums, marked, depth = sum(score.values()), Counter(), Counter(), {}
    if not whole:
        return
    for (slot, inner), s in score.items():
        sums[inner] += s
        marked[inner] += s * (2 * held[slot, inner][3] > held[slot, inner][0])
    for region in sorted({*up, *sums}):
        depth[region] = depth.get(up.get(region, -1), 0) + 1
    for region in sorted(depth, reverse=True):
        over = up.get(region, -1)
        if over >= 0:
            sums[over] += sums[region]
            marked[over] += marked[region]
    fit = [r for r in depth if sums[r] >= REGION_SHARE * whole]
    if not fit:
        return
    found.region = max(fit, key=lambda r: (depth[r], sums[r]))
    while in_main[found.region] > 0 and in_main[up.get(found.region, -1)] > 0:
        found.region = up[found.region]  # a marked article is taken whole
    found.marked = 2 * marked[found.region] > sums[found.region]
    within = {found.region}
    for region in sorted(depth):
        if up.get(region, -1) in within:
            within.add(region)
    inside = {k: h for k, h in held.items() if k[1] in within}
    opened = next(key for (key, _), r in found.outer.items() if r == found.region)
    flat = opened.rpartition("<")[2].split(" ")[0] in ("html", "body", "table")
    most = max((h[0] for k, h in inside.items() if score[k] > 0), default=0) if flat else 0
    found.names = any(2 * apart <= text for text, *_, apart in inside.values())
    alone = len({slot for slot, _ in inside}) == 1
    for (slot, _), (text, links, headings, main, apart) in inside.items():
        if found.names and 2 * apart > text:
            continue
        if found.marked or main or alone or links <= LINK_SHARE * text and (text >= LEAST_SHARE * most or 2 * headings > text):
            found.slots.add(slot)


def _blocks(tokens: list, wanted: set[int]) -> str:
    out: list[str] = []
    block: list[str] = []
    for i, t in enumerate(tokens):
        if t[0] == "b":
            out.append("".join(block))
            block = []
        elif i in wanted:
            block.append(t[2])
    out.append("".join(block))
    return "\n\n".join(b for b in (SPACE.sub(" ", b).strip() for b in out) if b)


def by_names(page: Page) -> str:
    """The text of the marked article, or else all that no name sets apart; if class names leave nothing, what elements leave."""
    nothing = [False] * len(page.parent)
    for apart in (page.apart, page.apart_below(nothing, False)):
        texts = [i for i, t in enumerate(page.tokens) if t[0] == "t" and not apart[t[3]]]
        if any(page.main[page.tokens[i][3]] and page.tokens[i][2].strip() for i in texts):
            texts = [i for i in texts if page.main[page.tokens[i][3]]]
        found = _blocks(page.tokens, set(texts))
        if found:
            return found
    return ""


def main_text(page: Page, found: Template | None) -> str:
    """The text of the page's main slots, by blocks."""
    if found is None:
        return by_names(page)
    marks = found.places(page)
    inside = _inside(found, page, marks)
    above = [False] * len(inside)
    if not found.names:  # the region is set apart as a whole: what is around it and its own name don't count
        above = [not i or not inside[page.parent[b]] for b, i in enumerate(inside)]
    apart = page.apart if found.names else page.apart_below(above, True)
    wanted, shared, present = [], [], False
    for i, slot, _ in _slots(found, page, marks):
        _, _, text, box, link, _ = page.tokens[i]
        if not inside[box] or apart[box]:
            continue
        if not text.strip():
            shared.append(i)
        elif marks[i] >= 0:
            present = True
            if page.main[box] and not link and (found.support[marks[i]] < found.support[found.region] or SENTENCE.search(text)):
                wanted.append(i)
            elif not link:
                shared.append(i)
        else:
            present = True
            if slot in found.slots:
                wanted.append(i)
    if wanted:
        wanted += [i for i in shared if wanted[0] < i < wanted[-1] or not page.tokens[i][2].strip()]
    return _blocks(page.tokens, set(wanted)) if present else by_names(page)


def extract_group(sources: list[str | None]) -> list[str]:
    pages = [Page(s) for s in sources]
    found = template(pages)
    return [main_text(p, found) for p in pages]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, ids, urls, sources = None, [], [], []

    def done() -> pa.RecordBatch:
        texts = extract_group(sources)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            for group, page_id, url, source in zip(*(c.to_pylist() for c in batch.slice(low, 64).columns)):
                if group != key and ids:
                    yield done()
                    ids, urls, sources = [], [], []
                key = group
                ids.append(page_id)
                urls.append(url)
                sources.append(source)
    yield done()


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("_host", host_of(F.col("url")))
    hosts = rows.groupBy("_host").agg(F.ceil(F.count(F.lit(1)) / group).alias("_parts"))
    dealt = rows.join(small(hosts), "_host").withColumn("_part", F.pmod(F.xxhash64("page_id", "url"), F.col("_parts")))
    keyed = dealt.select(F.xxhash64("_host", "_part").alias("_group"), "page_id", "url", "html").repartition("_group").sortWithinPartitions("_group", "page_id")
    texts = keyed.mapInArrow(_extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
