"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import ready

MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?)?)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
DROPPED = {
    "script", "style", "noscript", "template", "iframe", "object", "embed", "applet", "canvas", "svg", "math", "audio", "video", "textarea", "select",
    "button", "input", "nav", "menu", "footer", "aside", "dialog", "head", "title", "datalist", "noembed", "noframes", "map",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status"}
NEGATIVE = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|sidebar\w*|side|rail|widget\w*|cookies?|consent|gdpr|notices?|alert"
    r"|popup|modal|overlay|subscri\w+|newsletter|signup|login|comments?|discussions?|disqus|respond|replies|reply|share\w*|sharing|social|related|recommend\w*|pagination|pager|toolbar|skip|search"
)
POSITIVE = re.compile(r"article\w*|content|main|body|entry|post|story|text|prose")
TITLES = {"header", "masthead"}
MODIFIERS = {"has", "have", "with", "without", "no", "not", "show", "is", "can", "your", "my", "our", "the"}
WORDS = re.compile(r"[^\W_]+")
MINE, DOUBTFUL, ALIEN = 0, 1, 2
CLOSES_P = BLOCK - {"br"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"table", "ul", "ol", "dl", "div", "section", "article", "body", "td", "th"}
SPACE = re.compile(r"\s+")
DEPTH = 200


def label_of(names: str) -> tuple[bool, int]:
    """(whether a class or id says main text, and how surely one says something else).

    A name such as ``sidebar`` or ``post-comments`` is alien; one with a modifier (``has-sidebar``,
    ``share-your-story``), or beside another that says main text, is doubtful.
    """
    good, bad = False, MINE
    for name in names.split():
        words = WORDS.findall(name)
        says = any(POSITIVE.fullmatch(w) for w in words)
        wrong = [w for w in words if NEGATIVE.fullmatch(w) and not (says and w in TITLES)]
        if wrong:
            bad = max(bad, DOUBTFUL if MODIFIERS & set(words) else ALIEN)
        elif says:
            good = True
    return good, min(bad, DOUBTFUL) if good else bad


class Node:
    """An element: its parts in order (text or elements), and what scoring gathers in it."""

    __slots__ = ("core", "dropped", "link", "name", "parent", "parts", "points", "score", "size", "suspect", "weight")

    def __init__(self, name: str, attrs: str, parent: Node | None, hiding: bool = True):
        self.name, self.parent, self.parts = name, parent, []
        self.clear()
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attrs)} if attrs else {}
        good, bad = label_of(f"{found.get('class', '')} {found.get('id', '')}") if "class" in found or "id" in found else (False, MINE)
        top = name in ("article", "main") or found.get("role") in ("main", "article")
        self.suspect = MINE if name in ("body", "html") else ALIEN if name == "form" or found.get("role") == "form" else min(bad, DOUBTFUL) if top and name == "main" else bad
        self.weight = -25.0 if self.suspect else 25.0 if top else 10.0 if good else 0.0
        self.core = self.suspect < ALIEN and (top or good or name == "h1")
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) is not None
        alien = hidden or name == "noscript" or found.get("role") in ROLES
        self.dropped = name in DROPPED and name != "noscript" or hiding and alien or name == "header" and not inside(parent, "article", "main")

    def clear(self) -> None:
        self.score, self.size, self.link, self.points = 0.0, 0, 0, 0.0


def inside(node: Node | None, *names: str) -> bool:
    while node is not None:
        if node.name in names:
            return True
        node = node.parent
    return False


def parse(page: str, hiding: bool = True) -> Node:
    """The tree of a page, however its tags are nested; elements below a depth of 200 hang on that depth.

    With ``hiding`` False what is hidden, for pages without scripts or of a role beside the text is read too.
    """
    root = Node("html", "", None)
    here, depth, at = root, 0, 0
    low = None
    while at < len(page):
        start = page.find("<", at)
        m = MARKUP.match(page, start) if start >= 0 else None
        if start < 0 or m is None:
            end = len(page) if start < 0 else start + 1
            here.parts.append(page[at:end])
            at = end
            continue
        if start > at:
            here.parts.append(page[at:start])
        at = m.end()
        if m["cdata"] is not None:
            here.parts.append(m["cdata"])
        elif m["close"]:
            name = m["close"].lower()
            node, up = here, 0
            while node is not None and node.name != name:
                if node.name in ("table", "article", "body") and name in ("p", "b", "i", "a", "span", "em", "strong", "li"):
                    node = None
                    break
                node, up = node.parent, up + 1
            if node is not None and node.parent is not None:
                here, depth = node.parent, depth - up - 1
        elif m["open"]:
            name = m["open"].lower()
            ends = ENDS.get(name, ())
            node, up = here, 0
            while node.parent is not None and node.name not in SCOPES | {"p"} and node.name not in ends:
                node, up = node.parent, up + 1
            if node.parent is not None and (node.name in ends or node.name == "p" and name in CLOSES_P):
                here, depth = node.parent, depth - up - 1
            if name in ("html", "body"):
                child = Node(name, m["attrs"], here, hiding)
                here.weight += child.weight
                continue
            node = Node(name, m["attrs"], here, hiding)
            here.parts.append(node)
            if name in RAW and (hiding or name != "noscript"):
                low = page.lower() if low is None else low
                end = low.find(f"</{name}", at)
                at = len(page) if end < 0 else end
                close = page.find(">", at)
                at = len(page) if close < 0 else close + 1
            elif name not in VOID and depth < DEPTH and not m["attrs"].endswith("/"):
                here, depth = node, depth + 1
    return root


def blocks(node: Node) -> list[str]:
    """Text of the blocks below ``node`` in page order, without dropped elements."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", html.unescape("".join(now))).strip()
        if text:
            out.append(text)
        now.clear()

    def walk(n: Node) -> None:
        for part in n.parts:
            if isinstance(part, str):
                now.append(part)
            elif part.dropped:
                if part.name in BLOCK:
                    end()
            else:
                edge = part.name in BLOCK
                if edge:
                    end()
                walk(part)
                if edge:
                    end()

    walk(node)
    end()
    return out


def measure(node: Node, in_link: bool = False) -> None:
    """Set size, link (characters in all and in links) and points (of all paragraphs inside), and give each paragraph's points to its ancestors.

    A run of text straight in an element counts as a paragraph: one point, one for each
    comma, one for each hundred characters up to three; the parent gets them whole, the
    grandparent half, the next a third and so on. Short lines, as of a list or a poem, count as
    one paragraph together, as the element that first holds 25 characters of them.
    """
    own = 0
    commas = 0
    for part in node.parts:
        if isinstance(part, str):
            own += len(SPACE.sub(" ", part).strip())
            commas += part.count(",")
        elif not part.dropped:
            measure(part, in_link or part.name == "a")
            node.size += part.size
            node.link += part.link
            node.points += part.points
            if part.name not in BLOCK:
                own += part.size
    if own:
        text = sum(len(SPACE.sub(" ", p).strip()) for p in node.parts if isinstance(p, str))
        node.size += text
        node.link += text if in_link or node.name == "a" else 0
    if own >= 25 and (node.name in BLOCK or node.parent is None):
        points = (1 + commas + min(own // 100, 3)) * (1 - min(1.0, node.link / max(1, node.size)))
    elif node.size >= 25 and not node.points and not own and node.name in BLOCK:
        points = (1 + min(node.size // 100, 3)) * (1 - min(1.0, node.link / node.size))
    else:
        return
    node.points += points
    up, share = node.parent or node, 1
    while up is not None and share <= 5:
        up.score += points / share
        up, share = up.parent, share + 1


def prune(root: Node) -> bool:
    """Drop what labels and scores together say is no main text; whether anything was.

    An element that holds half of all points, and either nearly all of them and of the text or an
    element that says main text, is a wrapper whatever its label, and stays. Otherwise forms and alien
    elements go, doubtful ones only if their text is short or mostly links.
    """
    todo, gone = [root], False
    core: dict[int, bool] = {}

    def says_main(n: Node) -> bool:
        if id(n) not in core:
            core[id(n)] = n.core or any(says_main(p) for p in n.parts if not isinstance(p, str) and not p.dropped and p.suspect < ALIEN)
        return core[id(n)]

    while todo:
        n = todo.pop()
        if n.suspect and not n.dropped:
            outside, text = (root.size - root.link) - (n.size - n.link), n.size - n.link
            wrapper = root.points > 0 and n.points >= root.points / 2 and (root.points - n.points < 2 and outside < text / 2 or says_main(n))
            if wrapper:
                n.weight = 10.0 if says_main(n) else 0.0
            elif n.suspect == ALIEN or n.size < 200 or n.link > n.size / 3:
                n.dropped = gone = True
        if not n.dropped:
            todo += [p for p in n.parts if not isinstance(p, str)]
    return gone


def forget(root: Node) -> None:
    """Back to the state before scoring."""
    todo = [root]
    while todo:
        n = todo.pop()
        n.clear()
        todo += [p for p in n.parts if not isinstance(p, str)]


def main_text(page: str | None) -> str:
    """Blocks of the best container and of the siblings that score with it, one to a line.

    A page that is empty without what is hidden at first (by style, role or for want of
    scripts) is read with it.
    """
    if not page:
        return ""
    return best_blocks(parse(page)) or best_blocks(parse(page, hiding=False))


def best_blocks(root: Node) -> str:
    measure(root)
    if prune(root):
        forget(root)
        measure(root)
    best, top = root, -1.0
    todo = [root]
    while todo:
        n = todo.pop()
        if n.dropped:
            continue
        todo += [p for p in reversed(n.parts) if not isinstance(p, str)]
        if n.name in BLOCK and n.name not in ("p", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6"):
            score = (n.score + n.weight * (n.size > 0)) * (1 - n.link / max(1, n.size))
            if score > top:
                best, top = n, score
    parent = best.parent
    if parent is None or best.name in ("article", "main") and sum(not isinstance(p, str) and p.name == best.name for p in parent.parts) == 1:
        return "\n".join(blocks(best))
    out: list[str] = []
    for part in parent.parts:
        if isinstance(part, str) or part.dropped:
            continue
        density = part.link / max(1, part.size)
        like = part is best or (part.score + part.weight) * (1 - density) >= max(10.0, 0.2 * top) or part.name == "p" and part.size > 80 and density < 0.25
        if like:
            out += blocks(part)
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars``: the article of each page, whole.

    Menus, headers, footers, sidebars, adverts, scripts and styles that say so by element or
    role go before scoring. Forms and what a class or id calls a sidebar, notice, advert or
    comments score lower, and go unless they hold the page's main text themselves. Null, empty and article-less pages give
    an empty text; broken and cut markup is read as far as it goes. Rows stand alone, so
    nothing is shuffled. Columns named ``text`` or ``n_chars`` are replaced, others kept.
    """
    ready(pages.sparkSession)
    if html_col != "text":
        pages = pages.drop("text")
    pages = pages.drop("n_chars")
    keep = [f for f in pages.schema.fields if f.name != "text"]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(*[f"`{f.name}`" for f in keep], F.col(html_col).alias("__html")).mapInArrow(run, schema)
