"""Main text of web pages by wrapper induction.

Pages of a host that have the same kinds of containers share a template. A bounded sample of them is parsed into trees, and
every two neighbours of the sample are aligned by simple tree matching. Aligned nodes of the same text are the template's;
those whose texts differ are slots. The wrapper is the deepest element that holds nearly all slot text, menus and the like
aside, and the template's nodes in it, as far as nearly all pages have them, which are counted over all pages. The main
text is the wrapper's element without those nodes. Pages without a wrapper, or where it doesn't fit, fall back on their
article or main element, or else the body.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_lists

#: Pages of a template that are aligned; wrappers that are sent to every task, beyond which they are joined by a shuffle.
SAMPLED, SENT = 12, 50_000
#: Share of the slot text that a region holds, and of a template's pages that have a node of it; pages that tell.
NEARLY, TELLING = 0.9, 4
#: Nodes of a page's tree that are aligned, so that a pair of pages takes bounded time; extraction itself has no such bound.
ALIGNED = 3000
#: Containers whose presence tells templates of a host apart.
CONTAINERS = r"<(nav|header|main|article|section|aside|footer|form|table)\b"
#: Comments, declarations, tags, texts. A quoted value follows an equals sign and may hold any sign; nothing is read twice.
LEXED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|[^<]++|<", re.S)
LABEL = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements without content, with content that is no text, those that begin a block, and those never in a main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("nav footer aside form script style noscript template head button menu dialog iframe svg select textarea".split())
CHROME_LABEL = re.compile(
    r"(?:^|[\s_-])(?:promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|footer|masthead|"
    r"cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|pagination|search|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Whole names that mark adverts and readers' comments. Within a wrapper, no other labels count.
INNER_LABEL = re.compile(
    r"(?:(?:post|page|article|reader|user|blog)[_-])?(?:ads?|advert\w*|adsense|sponsor(?:s|ed)?|comments?|disqus|replies)(?:[_-](?:\d+|area|banner|block|body|box|container|content|form|item|label|list|section|slot|thread|unit|wrap|wrapper))*",
    re.I,
)
#: Elements that are no chrome, however they are labelled.
WHOLE = frozenset("html body main article".split())
#: An end tag that closes elements which need none of their own, and what a start tag closes.
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What any other block closes.
PARAGRAPH = frozenset({"p"})


#: Characters of a path, beyond which elements are neither aligned nor named by it.
LONGEST = 1000


class Node:
    """An element: what it is called in paths, whether it is chrome, by any label or surely, its children in order (nodes and strings).

    key is a hash of its path; the path itself is kept for as long as it may name a region.
    """

    __slots__ = ("tag", "name", "chrome", "sure", "children", "path", "key", "story")

    def __init__(self, tag: str, name: str, chrome: bool, sure: bool, up: Node | None):
        self.tag, self.name, self.chrome, self.sure, self.children = tag, name, chrome, sure, []
        self.path = "" if up is None else f"{up.path}/{name}" if up.path is not None and len(up.path) + len(name) < LONGEST else None
        self.key = 0 if up is None else xxhash.xxh64_intdigest(f"{up.key}/{name}".encode("utf-8", "replace"))
        self.story = up is not None and (up.story or "article" in name or "main" in name)

    def text(self) -> str:
        """The text right inside this element, inline elements included, however deep they are."""
        parts, todo = [], [iter(self.children)]
        while todo:
            for c in todo[-1]:
                if isinstance(c, str):
                    parts.append(c)
                elif c.tag == "br" or c.tag not in INLINE:
                    parts.append(" ")
                else:
                    todo.append(iter(c.children))
                    break
            else:
                todo.pop()
        return " ".join("".join(parts).split())

    def mark(self) -> int:
        """A hash of its path and its text."""
        return xxhash.xxh64_intdigest(f"{self.key}\n{self.text()}".encode("utf-8", "replace")) - (1 << 63)


def parse(page: str | None) -> Node:
    """The tree of a page, in time linear in its length. Unclosed elements end with their parent; a paragraph ends where a block begins; nothing is an error."""
    root = Node("#", "#", False, False, None)
    stack, raw = [root], None
    # where blocks are in the stack, and how many elements of each tag are open
    blocks, opened = [0], Counter()

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]
        while blocks[-1] >= k:
            blocks.pop()

    for m in LEXED.finditer(page or ""):
        got = m[0]
        if got[0] != "<" or got == "<":
            if raw is None:
                stack[-1].children.append(entities.unescape(got) if "&" in got else got)
            continue
        if m[2] is None:
            continue
        end, tag, rest = m[1], m[2].lower(), m[3]
        if raw is not None:
            if end and tag == raw:
                raw = None
            continue
        if end:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in RAW:
            raw = None if rest.endswith("/") else tag
            continue
        inline = tag in INLINE or tag == "button"
        if not inline and blocks[-1] and stack[blocks[-1]].tag in CLOSED_BY.get(tag, PARAGRAPH):
            close(blocks[-1])
        labels = " ".join(x[1] or x[2] or x[3] for x in LABEL.findall(rest)) if "=" in rest else ""
        name = tag + ("." + re.sub(r"\d+", "#", labels.split()[0]) if labels.split() else "")
        up = stack[-1]
        by_tag = tag in CHROME or (tag == "header" and not up.story)
        told = bool(labels) and not inline and tag not in WHOLE
        sure = up.sure or by_tag or (told and any(map(INNER_LABEL.fullmatch, labels.split())))
        node = Node(tag, name, up.chrome or sure or (told and bool(CHROME_LABEL.search(labels))), sure, up)
        up.children.append(node)
        if tag not in VOID and not rest.endswith("/"):
            opened[tag] += 1
            if not inline:
                blocks.append(len(stack))
            stack.append(node)
    return root


def nodes(root: Node, most: int = ALIGNED) -> list[Node]:
    """Block elements in page order, chrome aside, at most `most`."""
    found, todo = [], [root]
    while todo and len(found) < most:
        node = todo.pop()
        found.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in INLINE and not c.sure]
    return found


def align(a: Node, b: Node, allowed: set[int]) -> list[tuple[Node, Node]]:
    """Simple tree matching: the most pairs of nodes of one name, parents and order of siblings kept."""
    blocks = lambda x: [c for c in x.children if isinstance(c, Node) and c.tag not in INLINE and id(c) in allowed]
    # pairs that may meet, level by level; then the best pairing of their children, from the lowest level up
    levels, seen = [[(a, b)] if a.name == b.name else []], set()
    while levels[-1]:
        below = []
        for x, y in levels[-1]:
            left, right = blocks(x), blocks(y)
            if not _plain_list(left, right):
                below += [(p, q) for p in left for q in right if p.name == q.name and (id(p), id(q)) not in seen]
        seen.update((id(p), id(q)) for p, q in below)
        levels.append(below)
    kept: dict[tuple[int, int], tuple[int, list]] = {}
    for x, y in (pair for level in reversed(levels) for pair in level):
        left, right = blocks(x), blocks(y)
        if _plain_list(left, right):
            pairs = list(zip(left, right, strict=False))[::-1]  # one list of elements without blocks of their own: any order-keeping pairs are as many
            kept[id(x), id(y)] = (len(pairs) + 1, pairs)
            continue
        table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + kept.get((id(p), id(q)), (0,))[0])
        i, j, pairs = len(left), len(right), []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((left[i], right[j]))
        kept[id(x), id(y)] = (table[-1][-1] + 1, pairs)

    found, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.name == y.name:
            found.append((x, y))
            todo += kept.get((id(x), id(y)), (1, []))[1]
    return found


def _plain_list(left: list[Node], right: list[Node]) -> bool:
    """Whether these are elements of one name without blocks of their own."""
    every = left + right
    return {c.name for c in every} == {left[0].name if left else ""} and not any(isinstance(d, Node) and d.tag not in INLINE for c in every for d in c.children)


def induce(pages: list[str]) -> tuple[str, list[int]]:
    """The path of the region that varies between the pages, empty if they don't tell; and the marks of the template's nodes, those that aligned with an equal one."""
    trees = [parse(p) for p in pages]
    slots: Counter = Counter()
    same: set[int] = set()
    for a, b in zip(trees, trees[1:], strict=False):
        allowed = {id(n) for t in (a, b) for n in nodes(t) if n.path is not None}
        for x, y in align(a, b, allowed):
            s, t = x.text(), y.text()
            if s != t and not x.chrome:
                slots[x.path] += len(s) + len(t)
            elif s and s == t and x.key == y.key:
                same.add(x.mark())
    total = sum(slots.values())
    if not total:
        return "", []
    held: Counter = Counter()
    for path, n in slots.items():
        steps = path.split("/")[1:]
        for k in range(1, len(steps)):
            held["/" + "/".join(steps[:k])] += n
    fit = [p for p, n in held.items() if n >= NEARLY * total]
    return (widened(max(fit, key=lambda p: (p.count("/"), p)), slots) if fit else ""), sorted(same)


def widened(region: str, slots: Counter) -> str:
    """region, or what is around it: the whole article that it lies in, or else the least element that has the varying headings too, unless that is the body."""
    steps = region.split("/")
    for k, step in enumerate(steps):
        if step.split(".")[0] == "article":
            return "/".join(steps[: k + 1])
    for path in sorted(slots):
        if path.rpartition("/")[2].split(".")[0] in ("h1", "h2"):
            shared = 0
            for a, b in zip(steps, path.split("/"), strict=False):
                if a != b:
                    break
                shared += 1
            if shared > 3:  # an empty step, html, body
                steps = steps[:shared]
    return "/".join(steps)


def find(root: Node, region: str | None) -> tuple[list[Node], bool]:
    """The elements that hold a page's main text: those of the region's path, else its article or main elements, else the page; and whether it is the region."""
    for fits in (lambda n: region and n.path == region, lambda n: n.tag == "article" and not n.chrome, lambda n: n.tag == "main" and not n.chrome):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if fits(node):
                # what is inside of it comes with it
                found.append(node)
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.sure]
        if found:
            return found, found[0].path == region
    return [root], False


def main_text(page: str | None, region: str | None = None, template: list[int] | None = None) -> str:
    """Blocks of the main text, white space within as single spaces, joined by two line feeds; empty if there is none.

    template: marks of nodes whose own text is left out of the region, unless that is most of what is there: pages that
    are copies of each other agree in their contents.
    """
    tops, fits = find(parse(page), region)
    whole = blocks_of(tops, fits, frozenset())
    if not fits or not template:
        return "\n\n".join(whole)
    part = blocks_of(tops, fits, frozenset(template))
    return "\n\n".join(part if 2 * sum(map(len, part)) >= sum(map(len, whole)) else whole)


def blocks_of(tops: list[Node], fits: bool, template: frozenset[int]) -> list[str]:
    """The blocks of these elements. Within a region, labels count for adverts and comments only."""
    blocks: list[list[str]] = [[]]
    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                blocks[-1].append(x)
            elif x is None:
                blocks.append([])
            elif x.tag == "br":
                blocks[-1].append(" ")
            elif not (x.sure if fits else x.chrome):
                below = list(reversed(x.children))
                if x.tag not in INLINE:
                    if template and x.mark() in template:
                        below = [c for c in below if isinstance(c, Node) and c.tag not in INLINE]
                    blocks.append([])
                    below = [None, *below]
                todo += below
    joined = [" ".join("".join(b).split()) for b in blocks]
    return [b for b in joined if b]


def host(url: str) -> Column:
    """The host of an address; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def kind(html: str) -> Column:
    """A page's template within its host: a hash of the kinds of containers that it has."""
    return F.xxhash64(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(html), F.lit(""))), F.lit(CONTAINERS), F.lit(1)))))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, kind, region, template) for each template; pages of no host count as one host. Pages of the same html count once."""
    rows = pages.select(host(url).alias("host"), kind(html).alias("kind"), F.xxhash64(F.col(html)).alias("h"), F.col(html).alias("page")).where("page is not null")
    chosen = cut(rows.groupBy("host", "kind", F.pmod("h", F.lit(SAMPLED)).alias("slot")).agg(F.min("h").alias("h")).select("host", "kind", "h"))
    told = chosen.join(chosen.groupBy("host", "kind").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["host", "kind"])
    told = cut(told)
    sample = rows.join(F.broadcast(told) if told.count() <= SENT else told, ["host", "kind", "h"], "left_semi").dropDuplicates(["host", "kind", "h"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        region, same = induce(list(group["page"]))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "kind": [group["kind"].iloc[0]], "region": [region], "same": [same]})

    found = cut(sample.groupBy("host", "kind").applyInPandas(run, "host string, kind long, region string, same array<long>").where("region <> ''"))
    # how many pages of the template have each node that aligned: those that nearly all have are the template's
    asked = found.where(F.size("same") > 0).select("host", "kind", "same")
    send = F.broadcast if asked.count() <= SENT else (lambda df: df)
    marked = rows.join(send(asked), ["host", "kind"]).select("host", "kind", "h", "page", "same")

    def held(hosts, kinds, hashes, texts, sames):
        wanted = [set(s) for s in sames]
        return hosts, kinds, hashes, [sorted({m for n in nodes(parse(t), 1 << 62) if (m := n.mark()) in w}) for t, w in zip(texts, wanted, strict=True)]

    marks = map_lists(marked, held, "host string, kind long, h long, marks array<long>").dropDuplicates(["host", "kind", "h"])
    marks = cut(marks)
    of = marks.groupBy("host", "kind").agg(F.count("*").alias("pages"))
    counts = marks.select("host", "kind", F.explode("marks").alias("mark")).groupBy("host", "kind", "mark").agg(F.count("*").alias("n"))
    usual = counts.join(of, ["host", "kind"]).where((F.col("pages") >= TELLING) & (F.col("n") >= NEARLY * F.col("pages")))
    template = usual.groupBy("host", "kind").agg(F.collect_list("mark").alias("template"))
    return found.drop("same").join(template, ["host", "kind"], "left")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) for each page, in any order. A null or empty page has an empty text; null urls and keys stay null.

    Repeated rows give repeated results; other columns are ignored; an empty table gives an empty one. Whole pages are
    parsed, whatever their length. A page that breaks off keeps what its article held so far.
    """
    known = cut(wrappers(pages, url, html))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("page"), host(url).alias("host"), kind(html).alias("kind"))
    send = F.broadcast if known.count() <= SENT else (lambda df: df)
    rows = rows.join(send(known), ["host", "kind"], "left").select("key", "url", "page", "region", "template")

    def run(keys, urls, texts, regions, templates):
        return keys, urls, [main_text(p, r, t) for p, r, t in zip(texts, regions, templates, strict=True)]

    made = map_lists(rows, run, f"key {pages.schema[key].dataType.simpleString()}, url string, text string")
    return made.select(F.col("key").alias(key), F.col("url").alias(url), "text")
