"""Main text of web pages by two-pass block rules.

The page is cut into blocks.  What the markup names as menu, footer, advert and so on,
and lists of links, are out; but a name or a form around the main element or most of the
page's text says nothing about it, so it does not count.  The first pass weighs the others by the share of stop
words, length and link density; an article or main element counts as one more feature.
Blocks that this does not decide stay open; the second pass gives them the label of
the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from markbook.llm.common import text_or_empty

# Comments, declarations, tags (an unclosed one runs to the end), text.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z) | <(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)"""
    r"""| <(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z) | [^<]+ | <""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# HTML's elements by their role.
RAW = frozenset("script style noscript template svg math iframe object title textarea select head".split())
# Of those, the ones whose start tag alone counts for nothing if they are never closed.
CLOSED = frozenset("noscript template svg math object select iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp
    small span strike strong sub sup time tt u var wbr""".split()
)
BOILERPLATE = frozenset("nav footer aside form menu button dialog header fieldset option".split())
MAIN = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p blockquote pre".split())
# Words in class and id attributes that name what is not the article.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|cookies?\w*|consent|disqus"
    r"|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|outbrain|overlay"
    r"|pagination|popup|promo\w*|recommended|related|replies|share|sharing|sidebar|signup|social|sponsor\w*"
    r"|subscribe|taboola|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_HEADER_NAMES = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies)(?:$|[\s_-])", re.I)
# Names that tell how an element looks or what is beside it, not what it is.
_STATE_NAMES = re.compile(
    r"^(?:has|with|without|no|is|hide|show|js)[_-]|[_-](?:enabled|disabled|open|opened|closed|active|visible|hidden|left|right)$", re.I
)
# Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """a about an and are as at be but by for from has have he her his i in is it not of on or she that the their they
    this to was we were which will with you
    aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist
    mit nach nicht noch nur oder sich sie sind so und von war wie wird zu zum zur
    al como con de del el en es esta este ha la las lo los más no o para pero por que se sin son su sus un una y
    au aux avec ce cette dans des du elle est et il ils je la le les mais ne nous on ou par pas plus pour qui sa ses
    son sont sur un une vous""".split()
)

SHORT = 70  # characters below which a block without context is not decided
LONG = 200
LINKS = 0.5  # share of characters in links from which a block is a list of links
SOME_LINKS = 0.25  # share from which links speak against a block
STOPS_LOW, STOPS_HIGH = 0.15, 0.25
MOST = 0.5  # share of the page's text from which a name or form around it does not count
NAMED, COMMENTS, HIDDEN = 1, 2, 3  # what attributes tell
IN_MAIN, OUTSIDE = 2, -2  # what the place counts on a page that names its article
_WORD = re.compile(r"[\W\d_]+")


@dataclass
class Block:
    text: str
    tag: str
    links: int  # characters in links
    hint: int  # the nearest element around it that is named as boilerplate, or -1
    main: bool  # inside an article or main element
    hinted: bool = False  # whether such a name counts
    label: str = ""


@dataclass
class _Hint:
    """An element that the markup names as boilerplate."""

    around: int  # the next one around it, or -1
    weighed: bool  # whether it is a name or a form, which the text inside can overrule
    size: int = 0  # characters inside, without links
    holds_main: bool = False


@dataclass
class _Open:
    tag: str
    hint: int
    main: bool


_NOTHING = _Open("", -1, False)


@dataclass
class _Reader:
    """Cuts a page into blocks."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    counts: Counter[str] = field(default_factory=Counter)  # open elements by tag
    hints: list[_Hint] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    in_link: int = 0
    block_tag: str = ""
    breaks: int = 0

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            links = len(" ".join(html.unescape("".join(self.linked)).split()))
            top = self.stack[-1] if self.stack else _NOTHING
            self.blocks.append(Block(text, self.block_tag, links, top.hint, top.main))
            if top.hint >= 0:
                self.hints[top.hint].size += max(0, len(text) - links)
        self.parts, self.linked, self.breaks = [], [], 0

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.counts[tag] -= 1
        return tag

    def weigh_hints(self) -> None:
        """Tell each block whether a name around it counts.  Elements come after those around them."""
        total = sum(max(0, len(b.text) - b.links) for b in self.blocks)
        for hint in reversed(self.hints):
            if hint.around >= 0:
                self.hints[hint.around].size += hint.size
                self.hints[hint.around].holds_main |= hint.holds_main
        counts = []
        for hint in self.hints:
            overruled = hint.weighed and (hint.holds_main or hint.size >= max(LONG, MOST * total))
            counts.append(not overruled or (hint.around >= 0 and counts[hint.around]))
        for b in self.blocks:
            b.hinted = b.hint >= 0 and counts[b.hint]

    def text(self, data: str) -> None:
        if self.breaks > 1 and not data.isspace():
            self.flush()
        if not data.isspace():
            self.breaks = 0
        self.parts.append(data)
        if self.in_link:
            self.linked.append(data)

    def open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.breaks += 1
                self.parts.append(" ")
            elif tag == "a":
                self.in_link = 1
            if tag in VOID or not (attributes and _named(attributes, True)):
                return
        else:
            self.flush()
            self.in_link = 0
            if tag in VOID:
                return
            if self.stack and self.stack[-1].tag == "p":
                self.pop()
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.stack and self.stack[-1].tag == tag:
                self.pop()
            self.block_tag = tag
        top = self.stack[-1] if self.stack else _NOTHING
        main = top.main or tag in MAIN
        # An article's own header holds its title; its footer and the rest do not belong to it.
        own = tag in BOILERPLATE and not (tag == "header" and top.main)
        told = _named(attributes, main) if attributes and tag not in ("body", "html") else 0
        if tag in MAIN and told != HIDDEN:
            told = 0
        if tag in INLINE:
            self.flush()
        hint = top.hint
        if own or told:
            hint = len(self.hints)
            self.hints.append(_Hint(top.hint, told in (0, NAMED) and (not own or tag == "form")))
        if tag == "main" and hint >= 0:
            self.hints[hint].holds_main = True
        self.stack.append(_Open(tag, hint, main))
        self.counts[tag] += 1

    def close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        known = self.counts[tag] > 0
        if tag in INLINE and not (known and self.stack[-1].tag == tag):
            return
        self.flush()
        self.in_link = 0
        if known:
            while self.pop() != tag:
                pass
        self.block_tag = self.stack[-1].tag if self.stack else ""


def _named(attributes: str, in_main: bool) -> int:
    """Whether attributes name something that is not the article: ``NAMED``, ``COMMENTS``, ``HIDDEN`` or 0."""
    told = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for word in value.split():
                if _STATE_NAMES.search(word):
                    continue
                if _COMMENT_NAMES.search(word):
                    told = max(told, COMMENTS)
                elif _NAMES.search(word) or (not in_main and _HEADER_NAMES.search(word)):
                    told = max(told, NAMED)
        if name == "role" and value in BOILERPLATE_ROLES:
            told = max(told, NAMED if value == "form" else HIDDEN)
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            told = HIDDEN
        if name == "style" and "display:none" in value.replace(" ", ""):
            told = HIDDEN
    return told


def read_blocks(page: str) -> list[Block]:
    reader = _Reader()
    at, end = 0, len(page)
    unclosed: set[str] = set()  # elements that nothing closes from here on
    while at < end:
        found = _TOKEN.match(page, at)
        at = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if tag is None:
            data = found[0]
            if not data.startswith("<!") and not data.startswith("<?"):
                reader.text(data)
            continue
        tag = tag.lower()
        if closing:
            reader.close(tag)
        elif tag in RAW and not attributes.endswith("/"):
            if tag in unclosed:
                continue
            over = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if over is None and tag in CLOSED:
                unclosed.add(tag)
                continue
            if tag == "head":  # its end may be implied
                body = re.compile(r"<body\b", re.I).search(page, at)
                if over is None or (body and body.start() < over.start()):
                    at = body.start() if body else at
                    continue
            at = over.end() if over else end
        else:
            reader.open(tag, attributes)
    reader.flush()
    reader.weigh_hints()
    return reader.blocks


def _evidence(block: Block, has_main: bool) -> int:
    """What speaks for a block: stop words, length, few links, and its place if the page names its article."""
    size = len(block.text)
    score = 0
    if size >= SHORT:
        words = [w for w in _WORD.split(block.text.lower()) if w]
        share = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        score += 2 if share >= STOPS_HIGH else 1 if share >= STOPS_LOW else -1
    score += size >= LONG
    score -= block.links > SOME_LINKS * size
    return score + (IN_MAIN if block.main else OUTSIDE if has_main else 0)


def _first_pass(block: Block, has_main: bool) -> str:
    """``good``, ``bad``, ``near`` (nearly good) or ``short`` (open)."""
    if block.hinted or block.links > LINKS * len(block.text):
        return "bad"
    score = _evidence(block, has_main)
    return "good" if score >= 3 else "near" if score >= 1 else "short" if score == 0 else "bad"


def classify(blocks: list[Block]) -> None:
    """Label each block ``good`` or ``bad``."""
    has_main = any(b.main and not b.hinted for b in blocks)
    for b in blocks:
        b.label = _first_pass(b, has_main)
    decided = [b.label if b.label in ("good", "bad") else "" for b in blocks]
    if "good" not in decided and "near" in (b.label for b in blocks):
        # Nothing is long enough to be sure: what is nearly good has to do.
        decided = ["good" if b.label == "near" else d for b, d in zip(blocks, decided, strict=True)]
    # What the markup names (an advert, say) tells nothing about the text around it.
    told = ["" if b.hinted else d for b, d in zip(blocks, decided, strict=True)]
    before = _nearest(told)
    after = _nearest(told[::-1])[::-1]
    last = len(blocks)
    for i, b in enumerate(blocks):
        if decided[i]:
            b.label = decided[i]
            continue
        (left, left_at), (right, right_at) = before[i], after[i]
        gap_left, gap_right = i - left_at, last - 1 - right_at - i
        if b.label == "near" and b.main:
            b.label = "good"
        elif left == right:
            b.label = left or "good"  # a page of short blocks only
        elif b.label == "near" or (b.tag in HEADINGS and right == "good"):
            b.label = "good"
        elif left and right and gap_left != gap_right:
            b.label = left if gap_left < gap_right else right
        elif left and right:  # as near to either: a paragraph belongs to the text
            b.label = "good" if b.tag in PARAGRAPHS else "bad"
        else:
            b.label = left or right


def _nearest(labels: list[str]) -> list[tuple[str, int]]:
    """For each place the last decided label up to it, and where it is."""
    out, label, at = [], "", -1
    for i, x in enumerate(labels):
        if x:
            label, at = x, i
        out.append((label, at))
    return out


def main_text(page: str | None) -> str:
    """The good blocks in page order, one per line."""
    blocks = read_blocks(page) if page else []
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    The whole page is read.  Null and empty pages, and pages without a good block,
    give an empty text.  Character references are decoded, white space in a block
    becomes one space; one line break is white space, two in a row end a block.
    Broken markup never fails: an unclosed tag or comment runs to the end.  Rows are
    independent of each other; repeated rows give repeated results; extra columns
    are ignored; nothing is shuffled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("page")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    body = pages.select("page_id", "url", text_or_empty("html").alias("page"))
    return body.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
