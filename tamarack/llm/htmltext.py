"""Main text of web pages by composite text density.

For each node of the DOM: characters per tag, adjusted for links; each node then sums its children's densities. The
subtree with the largest sum holds the article. It is raised to the article or main around it; on a page that has none
there, the whole body is taken but for link lists around the subtree: mostly link text, and less dense than anything on
the subtree's path up to the body.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the first kind ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of the given kinds, up to the given containers.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tr td th", "table")}
P = frozenset(("p",))
#: Elements that the end tag of an inline element inside them doesn't close.
KEEPERS = frozenset("table article main body".split())
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
#: Elements, roles and words in class or id that mark what isn't the article.
BOILER_TAGS = frozenset("nav footer aside form button select option input dialog menu svg canvas object embed audio video map head datalist fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget comment comments commentlist disqus respond reply replies discussion share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar skip".split()
)
#: Words that say nothing of a node beside those: "comment-list" is named for comments alone, "no-comments" isn't.
NEUTRAL_WORDS = frozenset("area bar block body bottom box button buttons by col column container form global group holder icons inner item items left link links list outer page post posts right row section site slot stories top unit wrap wrapper".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[a-z]+")
#: Tags where one's quotes don't close: each ends at its first ">".
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>", re.S)
OPENING = re.compile(r"<[a-zA-Z]")
UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")


class Node:
    __slots__ = ("tag", "parent", "boiler", "named", "chars", "link_chars", "tags", "link_tags", "density", "total", "children")

    def __init__(self, tag: str, parent: int, boiler: bool):
        self.tag, self.parent, self.boiler, self.named = tag, parent, boiler, 0
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.children: list[int] = []


def _is_boiler(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in BOILER_TAGS or (tag == "header" and not inside_article):
        return True
    if not attrs or not attrs.strip() or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value in BOILER_ROLES:
            return True
    return False


def _named(tag: str, attrs: str) -> int:
    """2 for a class or id that names boilerplate alone, 1 for one of whose names one does, else 0: "share-price" names none."""
    if not attrs or not attrs.strip() or tag in ("html", "body", "article", "main", "header"):
        return 0
    found = 0
    for name, value in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id") and not BOILER_WORDS.isdisjoint(words := WORD.findall(value.lower())):
            whole = [all(w in BOILER_WORDS or w in NEUTRAL_WORDS for w in x) and not BOILER_WORDS.isdisjoint(x) for x in map(WORD.findall, value.lower().split())]
            found = max(found, 2 if all(w in BOILER_WORDS or w in NEUTRAL_WORDS for w in words) else int(any(whole)))
    return found


def _settle_names(nodes: list[Node], runs: list[tuple[int, str]]) -> None:
    """Make boilerplate of what class or id name so, but for names on what wraps the article.

    These are nodes with most of the page's text outside links (for a name of boilerplate alone: nearly all of it), and,
    while no article or main stands outside such nodes, the likeliest one that holds main or a single article (for a name
    of boilerplate alone: an article with most of the text; lists of comments and teasers have an article each). Names
    inside them are settled in the same way.
    """
    if not any(n.named and not n.boiler for n in nodes):
        return
    text, holds, articles = ([0] * len(nodes) for _ in range(3))
    linked = [False] * len(nodes)
    for k, n in enumerate(nodes):
        linked[k] = n.tag == "a" or (k > 0 and linked[n.parent])
    for k, run in runs:
        if not nodes[k].boiler and not linked[k]:
            text[k] += len("".join(run.split()))
    inner: list[list[int]] = [[] for _ in nodes]  # the outermost named nodes below each
    for k in range(len(nodes) - 1, 0, -1):
        n = nodes[k]
        if n.boiler:
            continue
        if n.tag in ("article", "main") and text[k]:
            holds[k], articles[k] = max(holds[k], 2 if n.tag == "main" else 1), 1
        text[n.parent] += text[k]
        holds[n.parent] = max(holds[n.parent], holds[k])
        articles[n.parent] += articles[k]
        inner[n.parent] += [k] if n.named else inner[k]
    waits: list[int] = []

    def wraps(k: int) -> bool:
        return holds[k] == 2 or (articles[k] == 1 and (nodes[k].named == 1 or 2 * text[k] > text[0]))

    def look(named: list[int]) -> None:
        todo = list(named)
        while todo:
            k = todo.pop()
            if (20 * text[k] > 19 * text[0]) if nodes[k].named == 2 else (2 * text[k] > text[0]):
                nodes[k].named = 0
                todo += inner[k]
            else:
                waits.append(k)

    look(inner[0])
    while any(map(wraps, waits)):
        free = [k == 0 or not n.named for k, n in enumerate(nodes)]
        for k in range(1, len(nodes)):
            free[k] = free[k] and free[nodes[k].parent]
        if any(n.tag in ("article", "main") and text[k] and free[k] and not n.boiler for k, n in enumerate(nodes)):
            break
        k = max(filter(wraps, waits), key=lambda k: (-nodes[k].named, holds[k], text[k], -k))
        nodes[k].named = 0
        waits.remove(k)
        look(inner[k])
    for k, n in enumerate(nodes[1:], 1):
        n.boiler = n.boiler or n.named > 0 or nodes[n.parent].boiler


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order (a parent before its children, the root first) and (node, text) runs.

    Tags may be unclosed or cut off; what can't be a tag is text.
    """
    nodes, runs = [Node("#root", -1, False)], []
    stack = [0]
    at, end = 0, len(page)
    opened: Counter[str] = Counter()  # open elements of each tag
    endless: set[str] = set()  # raw tags with no end tag ahead
    tokens = TOKEN

    def close(d: int) -> None:
        for k in stack[d:]:
            opened[nodes[k].tag] -= 1
        del stack[d:]

    def last_open(tags: frozenset, bounds) -> int:
        """Where the innermost open element of these tags is, or 0 if there is none before one in ``bounds``."""
        if any(opened[t] for t in tags):
            for d in range(len(stack) - 1, 0, -1):
                if (t := nodes[stack[d]].tag) in tags:
                    return d
                if bounds(t):
                    break
        return 0

    while at < end:
        m = tokens.search(page, at)
        stop = m.start() if m else end
        if stop > at and tokens is TOKEN and OPENING.search(page, at, stop):  # a tag that doesn't end: from here on quotes don't count
            tokens = LOOSE
            continue
        if stop > at:
            text = page[at:stop]
            if not m and (cut := UNFINISHED.search(text)):
                text = text[: cut.start()]
            if text and not text.isspace():
                runs.append((stack[-1], entities.unescape(text) if "&" in text else text))
            elif text:
                runs.append((stack[-1], " "))
        if not m:
            break
        at = m.end()
        tag = m[1]
        if tag:
            tag = tag.lower()
            attrs = m[2]
            if tag in RAW:
                found = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if found:
                    at = found.end()
                elif tag != "title":
                    at = end
                else:
                    endless.add(tag)
                continue
            if tag in ("html", "body") and opened[tag]:
                continue
            if tag in ENDS_P:
                if d := last_open(P, lambda t: t not in INLINE):
                    close(d)
            elif tag in SIBLINGS:
                ends, holds = SIBLINGS[tag]
                while d := last_open(ends, lambda t: t in holds):  # noqa: B023  called at once
                    close(d)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
            if tag == "body":  # the head is over, closed or not
                while len(stack) > 1 and nodes[stack[-1]].tag == "head":
                    close(len(stack) - 1)
            up = stack[-1]
            if tag == "br":
                runs.append((up, " "))
            boiler = nodes[up].boiler or _is_boiler(tag, attrs, opened["article"] + opened["main"] > 0)
            nodes.append(Node(tag, up, boiler))
            k = len(nodes) - 1
            nodes[k].named = 0 if boiler else _named(tag, attrs)
            nodes[up].children.append(k)
            if tag not in VOID and not attrs.endswith("/"):
                stack.append(k)
                opened[tag] += 1
        elif m[3]:
            tag = m[3].lower()
            if opened[tag] and (d := last_open(frozenset((tag,)), lambda t: t in KEEPERS and tag in INLINE)):  # noqa: B023  called at once
                close(d)
    _settle_names(nodes, runs)
    return nodes, runs


def _measure(nodes: list[Node], runs: list[tuple[int, str]]) -> int:
    """Densities and their sums, bottom up; the body's index."""
    for k, text in runs:
        if not nodes[k].boiler:
            nodes[k].chars += len("".join(text.split()))
    for k in range(len(nodes) - 1, 0, -1):
        n = nodes[k]
        if n.boiler:
            continue
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        up = nodes[n.parent]
        up.chars += n.chars
        up.link_chars += n.link_chars
        up.tags += n.tags + 1
        up.link_tags += n.link_tags
    body = next((k for k, n in enumerate(nodes) if n.tag == "body"), 0)
    b = nodes[body]
    ratio = b.link_chars / max(1, b.chars)
    for n in nodes:
        if n.boiler or not n.chars:
            continue
        plain = max(1, n.chars - n.link_chars)
        per_tag = n.chars / max(1, n.tags)
        base = math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
        n.density = per_tag * math.log(max(1.0, n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)) + 1e-9, base) if base > 1 else per_tag * math.log(max(1.0, n.chars * max(1, n.tags)) + 1e-9)
    for n in nodes:
        if not n.boiler and n.tag not in INLINE:
            n.total = sum(nodes[c].density for c in n.children if not nodes[c].boiler and nodes[c].tag not in INLINE)
    return body


def _article(nodes: list[Node], body: int) -> tuple[int, set[int]]:
    """The article's node, and the nodes under it that are left out with all they hold.

    The node whose children's densities sum to most is raised to the article or main around it, or else to the whole
    page. Of what then stands around it only link lists are left out: nodes under the threshold with mostly link text,
    without the parts of them that are neither.
    """
    best = body
    for k, n in enumerate(nodes):
        if k >= body and not n.boiler and n.total > nodes[best].total:
            best = k
    path = [best]
    while nodes[path[-1]].parent >= 0:
        path.append(nodes[path[-1]].parent)
    for k in path:
        if nodes[k].tag in ("article", "main"):
            return k, set()
    threshold = min(nodes[k].density for k in (path[: path.index(body) + 1] if body in path else path))
    out: set[int] = set()
    for k, below in zip(path[1:], path, strict=False):
        n = nodes[k]
        sides = [c for c in n.children if c != below and not nodes[c].boiler]
        blocks, inline = ([c for c in sides if (nodes[c].tag in INLINE) == x] for x in (False, True))
        own = n.chars - sum(nodes[c].chars for c in [*blocks, below] if not nodes[c].boiler)
        if 2 * sum(nodes[c].link_chars for c in inline) > own:  # else they are links within sentences
            blocks += inline
        todo = [(c, False) for c in blocks]
        while todo:
            c, linked = todo.pop()
            n = nodes[c]
            if linked or (n.density < threshold and 2 * n.link_chars > n.chars):
                out.add(c)
                todo += [(x, linked or n.link_chars == n.chars) for x in n.children]
    return path[-1], out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by blank lines; empty if there is none."""
    if not page:
        return ""
    nodes, runs = parse(page)
    body = _measure(nodes, runs)
    top, left_out = _article(nodes, body)
    inside = [False] * len(nodes)
    block = [0] * len(nodes)
    inside[top] = not nodes[top].boiler
    block[top] = top
    for k in range(top + 1, len(nodes)):
        n = nodes[k]
        inside[k] = (inside[n.parent] or n.parent in left_out) and not n.boiler and k not in left_out
        block[k] = block[n.parent] if n.tag in INLINE else k
    blocks: list[list[str]] = []
    last = None
    for k, text in runs:
        if inside[k]:
            if block[k] != last:
                blocks.append([])
                last = block[k]
            blocks[-1].append(text)
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null or empty html gives empty text, and repeated rows are extracted alike.

    An empty table gives an empty result.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for whole in batches:
            for b in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                text = [main_text(h.as_py()) for h in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
