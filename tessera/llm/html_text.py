"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each under the path of tags from the root to it. Text length,
words, punctuation and link text are aggregated by path; a path's ratio is its text for each block,
with bonuses for punctuation and malus for links. Ratios are smoothed along the page, so that a
short paragraph among long ones gains from them; the smoothed ratio, the path's own, and a prior
for the meaning of the tags in the path are fused into one value, and the paths above a threshold
found from the page's own values are the content. What remains is decoded, its white space
collapsed, and joined in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import quoted, table

#: Elements without an end (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that never hold main text.
DROPPED = frozenset("script style title head nav header footer aside form button select option textarea input noscript template iframe svg math object canvas menu dialog label fieldset datalist xmp noembed noframes audio video map".split())
#: Elements that stand inside a line of text; any other begins a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the key ends an open element of the values, not looking past the third's.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold the article by their meaning.
MEANT = frozenset(("article", "main"))
#: Words in class, id or role that mark what is not the article; the latter ones only without a word of the article's.
BOILER = re.compile(
    r"(?:^|[-_\s])(?:ads?|ad(?:box|slot|unit|space|wrap\w*|container)|advert\w*|adsense|banners?|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notices?|alerts?|dialog|popups?|modal|overlay|newsletter\w*|subscri\w*|signup|login|shar(?:e|ing)\w*|social\w*|breadcrumbs?|crumbs?|nav\w*|menu\w*|topbar|toolbar|sidebar\w*|aside|related\w*|recommend\w*|footer\w*|foot|pagination|pager|comment\w*|respond|disqus|discussion|replies|reply|copyright|disclaimer|search\w*|skip|contentinfo|complementary)(?:$|[-_\s])",
    re.IGNORECASE,
)
DOUBTFUL = re.compile(r"(?:^|[-_\s])(?:header|masthead|side|widgets?|legal|hidden|tags|taglist|form)(?:$|[-_\s])", re.IGNORECASE)
CONTENT = re.compile(r"(?:^|[-_\s])(?:article|articlebody|content|entry|main|maincontent|post|story|text|body)(?:$|[-_\s])", re.IGNORECASE)
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?¡¿…、。]")
#: Blocks on either side that smooth a value, and their weights.
SMOOTHING = np.array([0.25, 0.5, 1.0, 0.5, 0.25])
#: Share of the page's weighted mean that a path must reach, and what its meaning adds to its own share: outside, by the share of text that is meant; or as a link list.
THRESHOLD, INSIDE, OUTSIDE, LINKED = 0.15, 0.05, -2.0, -3.0
#: Share of link text beyond which a path counts as outside.
MOST_LINKS = 0.6


@dataclass
class Element:
    """An open element: its tag, the number of its path, and whether it or one above is never main text, or is meant to be."""

    tag: str
    path: int
    dropped: bool
    meant: bool


@dataclass
class Block:
    """A text block, as pieces that are still to be decoded."""

    path: int
    meant: bool
    heading: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        """Decoded, white space collapsed."""
        return SPACE.sub(" ", "".join(self.pieces)).strip()


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag, the first of a name."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def refused(tag: str, given: dict[str, str]) -> bool:
    """Whether an element's attributes say that it is not the article."""
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
        return True
    named = " ".join(given.get(k, "") for k in ("class", "id", "role"))
    if not named.strip() or tag in MEANT or tag in ("body", "html"):
        return False
    return bool(BOILER.search(named)) or bool(DOUBTFUL.search(named)) and not CONTENT.search(named)


def blocks_of(source: str) -> list[Block]:
    """The text blocks of a page that are not inside an element that never holds main text, in page order."""
    stack = [Element("", 0, False, False)]
    numbers: dict[tuple[int, str], int] = {}
    out: list[Block] = []
    current: Block | None = None
    opened: Counter[str] = Counter()
    at, links = 0, 0

    def add(text: str) -> None:
        nonlocal current
        top = stack[-1]
        if not text or top.dropped:
            return
        if current is None:
            if not text.strip():
                return
            holder = next(e for e in reversed(stack) if e.tag not in INLINE)
            current = Block(holder.path, holder.meant, any(e.tag in HEADINGS for e in stack[-4:]))
            out.append(current)
        current.pieces.append(html.unescape(text))
        if links:
            current.linked += len(text)

    def close(depth: int) -> None:
        nonlocal current, links
        for e in stack[depth:]:
            opened[e.tag] -= 1
            links -= e.tag == "a"
            if e.tag not in INLINE:
                current = None
        del stack[depth:]

    length = len(source)
    while at < length:
        found = TOKEN.search(source, at)
        if not found:
            add(source[at:])
            break
        add(source[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if found[1] or found[4]:
            if tag == "br":
                current = None
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if opened[tag] else 0
            if depth:
                if tag in INLINE and any(e.tag not in INLINE for e in stack[depth:]):
                    # a block stands in it: only the inline element itself ends
                    opened[tag] -= 1
                    links -= tag == "a"
                    del stack[depth]
                else:
                    close(depth)
            elif tag == "p":
                current = None
            continue
        given = attributes(found[3] or found[6] or "")
        if tag in ENDS_P and opened["p"]:
            depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p")
            if not any(e.tag in ("table", "td", "th", "button", "object") for e in stack[depth:]):
                close(depth)
        if tag in CLOSES:
            ended, limit = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in limit:
                    break
                if stack[i].tag in ended and not any(e.tag in limit for e in stack[i + 1 :]) and (i == 1 or stack[i - 1].tag not in ended):
                    close(i)
                    break
        if tag not in INLINE:
            current = None
        if tag in VOID:
            continue
        top = stack[-1]
        named = given.get("class", "").split()
        element = Element(tag, top.path if tag in INLINE else numbers.setdefault((top.path, " ".join([tag, *named[:1]])), len(numbers) + 1), top.dropped or tag in DROPPED and not (tag == "header" and top.meant) or refused(tag, given), top.meant or tag in MEANT or given.get("role") == "main")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, at) if tag != "plaintext" else None
            stop = end.start() if end else length
            stack.append(element)
            add(source[at:stop])
            stack.pop()
            after = source.find(">", stop)
            at = length if end is None or after < 0 else after + 1
            continue
        if not found[0].endswith("/>") or tag not in ("svg", "math", "path"):
            stack.append(element)
            opened[tag] += 1
            links += tag == "a"
    return out


def content_blocks(blocks: list[Block]) -> list[str]:
    """Texts of the blocks whose paths are content."""
    texts = [b.text() for b in blocks]
    kept = [i for i, t in enumerate(texts) if t]
    if not kept:
        return []
    paths = list(dict.fromkeys(blocks[i].path for i in kept))
    number = {p: k for k, p in enumerate(paths)}
    of = np.array([number[blocks[i].path] for i in kept])
    chars = np.array([len(texts[i]) for i in kept], float)
    marks = np.array([len(PUNCTUATION.findall(texts[i])) for i in kept], float)
    linked = np.array([min(blocks[i].linked, len(texts[i])) for i in kept], float)
    total, points, links, blocks_in = (np.bincount(of, w) for w in (chars, marks, linked, np.ones(len(kept))))
    plain = total - links
    ratio = plain / blocks_in * (1 + np.minimum(1, 20 * points / np.maximum(total, 1))) * (1 - links / total) ** 2
    along = ratio[of]
    smoothed = np.convolve(np.pad(along, 2, mode="edge"), SMOOTHING / SMOOTHING.sum(), "valid")
    mean = np.bincount(of, smoothed) / blocks_in
    heading = np.array([any(blocks[i].heading for i, k in zip(kept, of) if k == p) for p in range(len(paths))])
    fused = np.sqrt(np.maximum(ratio, 0) * mean) * np.where(heading, 2.0, 1.0)
    value = fused / max(float(np.average(fused, weights=np.maximum(plain, 1))), 1e-9)
    # a bonus for what the page itself marks as its article, a malus for the rest if that holds much of the text; link lists go wherever they are
    meant = np.array([any(blocks[i].meant for i, k in zip(kept, of) if k == p) for p in range(len(paths))])
    share = plain[meant].sum() / max(plain.sum(), 1)
    # headings are short by nature: their length does not tell against them where the article is
    prior = np.where(meant, np.where(heading, THRESHOLD, INSIDE), OUTSIDE * share) + np.where(links <= MOST_LINKS * total, 0.0, LINKED)
    return [texts[i] for i, p in zip(kept, of) if value[p] + prior[p] >= THRESHOLD]


def main_text(source: str | None) -> str:
    """The main text of a page, its blocks joined by a space; empty if there is none."""
    return " ".join(content_blocks(blocks_of(source or "")))


def extract_text(df: DataFrame, column: str = "html") -> DataFrame:
    """``df`` with text and n_chars (code points of it); input columns of these names are replaced.

    Null and empty pages, and pages without main text, have the empty text. Repeated rows are rows like
    others; an empty table stays empty; all other columns are kept. A page is taken whole, however long.
    """

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x.as_py()) for x in batch], pa.string())

    return df.withColumn("text", extracted(quoted(column))).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
