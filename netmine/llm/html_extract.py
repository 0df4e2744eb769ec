"""Main text of web pages by line-block distribution.

Markup is stripped into blocks (lines); text of scripts, styles, menus, headers,
footers, sidebars, forms and dialogs goes with the markup.  Every block has a
weight, its characters outside links, and weights are summed over sliding windows
of WINDOW lines.  Where the sum surges to SURGE and more a stretch of main text
begins, where it dives under DIVE it ends, and the blocks between are kept.

Markup only changes weights.  A block in a marked article (article, main) weighs
SURGE more, so short ones stay; on a page whose article has SURGE characters and
more, other blocks have no weight, else an eighth.  Class names, ids and roles of
notices, adverts, comments and the like take the weight from their element; an id
counts if it has no further word of its own (`related`, `related-posts`, but not
`related-work`), and headings have none that count.  Where that leaves a page without
a marked article, marks don't count for a wrapper, an element whose own text, without
that of marked elements inside, is over half of the page's; so a form around the whole
page is one, by its text outside links.  An article inside an aside element counts if
nothing else has a weight.  Those of the body never count.

Character references are decoded, white space within a block becomes one
space, blocks are trimmed, empty ones dropped, the others joined by two \\n in the
order of the page.  Defined cases: null html is empty; a page without text gives
the empty string and 0 characters; a page without any surge keeps all blocks that
have a weight; an element left open ends with the element around it, an unclosed
script, style, title, comment or tag at the end of the page; repeated rows are
judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 60
DIVE = 12
#: What a block outside of the marked article weighs is divided by so much.
OUTSIDE = 8

# Elements of HTML by their role.
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset head select datalist svg object canvas video audio".split())
MAIN = frozenset(["article", "main"])
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms msub msup mtext nobr q rp rt ruby s samp "
    "small span strike strong sub sup svg time tt u var wbr".split()
)
#: Elements whose end tag may be left out before another of the same name.
IMPLIED = frozenset("p li dt dd option optgroup tr td th thead tbody tfoot".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?<!\bwith[_-])(?<!\bhas[_-])(?<!\bno[_-])(?<!\bwithout[_-])(?:ads?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|sidebar\w*|side-?bar|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|"
    r"comments?|comment-?list|replies|disqus|respond|related|recommend\w*|share|sharing|social|menu|nav|navbar|navigation|breadcrumbs?|pagination|"
    r"footer|masthead|popup|modal|overlay|widget|toolbar|skip-?link)(?=$|[\s_-])",
    re.I,
)
#: Words that may stand beside a hint in an id.
BESIDE = frozenset(
    "posts post articles article links link content contents stories items item list box block section widget container wrapper wrap area bar bars button buttons icons icon inner outer main left right top bottom "
    "header title banner form message messages text thread panel pane region module group slot unit zone view page site primary secondary".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements that are aside by name but may hold the whole page.
MAY_WRAP = frozenset(["form", "fieldset"])
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
#: One attribute after another, so that no word within a value counts; a quote cut off goes to the end.
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*)))?""")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")


class Around(NamedTuple):
    """What stands around a block: outside and inside of the outermost article, elements that are always aside, and numbers of other marked ones."""

    in_main: bool = False
    aside_out: bool = False
    aside_in: bool = False
    hints_out: tuple[int, ...] = ()
    hints_in: tuple[int, ...] = ()
    links: int = 0

    def within(self, e: "Element") -> "Around":
        main = self.in_main or e.name in MAIN
        hint = () if e.hint is None else (e.hint,)
        if self.in_main:
            return Around(True, self.aside_out, self.aside_in or e.aside, self.hints_out, self.hints_in + hint, self.links + (e.name == "a"))
        if main:  # the article itself: its own marks count as inside
            return Around(True, self.aside_out, e.aside, self.hints_out, hint, self.links)
        return Around(False, self.aside_out or e.aside, False, self.hints_out + hint, (), self.links + (e.name == "a"))


class Element(NamedTuple):
    name: str
    aside: bool = False
    hint: int | None = None


class Block(NamedTuple):
    text: str
    #: Characters outside links.
    plain: int
    around: Around


def _hinting_id(value: str) -> bool:
    """Whether an id is a hint and has no word beside it that is none; numbers count for nothing."""
    if not HINT.search(value):
        return False
    words = [w for w in re.split(r"[\s_-]+", value.lower()) if w and not w.isdigit()]
    return all(w in BESIDE or HINT.search(w) for w in words)


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is aside whatever it holds, or hidden, and whether its name or its attributes hint at that."""
    if name in ASIDE and name not in MAY_WRAP:
        return True, False
    named = name in MAY_WRAP
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False, named
    hint = named
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, False
        if key == "class" and HINT.search(value) or key == "id" and name not in HEADINGS and _hinting_id(value) or key == "role" and value.lower() in ROLES:
            hint = name not in ("html", "body")
    return False, hint


def _end_of(page: str, name: str, at: int) -> int:
    m = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
    return len(page) if m is None else m.end()


def _tokens(page: str):
    """("text", string), ("open", name, attributes) and ("close", name) in the order of the page."""
    at, n, quotes = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield ("text", page[at:])
            return
        if lt > at:
            yield ("text", page[at:lt])
        ahead = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif ahead in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif not (ahead.isalpha() or ahead == "/"):
            yield ("text", "<")
            at = lt + 1
        else:
            m = TAG.match(page, lt) if quotes else None
            if m is None:
                end = page.find(">", lt)
                if end < 0:
                    return  # a tag cut off at the end
                quotes = False  # an unbalanced quote: from here on tags end at the first >
                inner = page[lt + 1 : end].strip()
                closing, inner = inner.startswith("/"), inner.lstrip("/")
                name = (inner.split(None, 1) or [""])[0].lower().rstrip("/")
                attributes, at = inner[len(name) :], end + 1
            else:
                closing, name, attributes, at = bool(m[1]), m[2].lower(), m[3], m.end()
            if closing:
                yield ("close", name)
            elif name in RAW:
                yield ("break", name)
                at = _end_of(page, name, at)
            elif name in VOID or attributes.endswith("/"):
                yield ("void", name)
            else:
                yield ("open", name, attributes)


def blocks(page: str) -> list[Block]:
    """The blocks of a page with what stands around them."""
    out: list[Block] = []
    stack: list[tuple[Element, Around]] = []
    names: Counter[str] = Counter()
    parts: list[str] = []
    linked = hinted = 0  # characters inside links in this block; hinted elements so far

    def around() -> Around:
        return stack[-1][1] if stack else Around()

    def close():
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, max(0, len(text) - linked), around()))
        linked = 0

    def cut(at: int):
        for e, _ in stack[at:]:
            names[e.name] -= 1
        del stack[at:]

    for token in _tokens(page):
        kind, name = token[0], token[1]
        if kind == "text":
            parts.append(name)
            if around().links:
                linked += len(" ".join(name.split()))
        elif kind == "void":
            if name == "br":
                parts.append("\n")
            elif name not in INLINE:
                close()
        elif kind == "break":
            close()
        elif kind == "open":
            aside, hint = _marks(name, token[2])
            if name not in INLINE or aside or hint:
                close()
            if name not in INLINE:
                # an element whose end may be left out ends where the next of its kind begins, a paragraph at any block
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0].name not in INLINE), None)
                if at is not None and (stack[at][0].name == "p" or stack[at][0].name == name and name in IMPLIED):
                    cut(at)
            hinted += hint
            e = Element(name, aside, hinted if hint else None)
            stack.append((e, around().within(e)))
            names[name] += 1
        else:
            inline = name in INLINE
            if not names[name]:
                if not inline:
                    close()
                continue
            at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0].name == name)
            over = stack[at + 1 :]
            if inline and any(e.name not in INLINE for e, _ in over):  # crossed with a block: only this element ends
                cut(at)
                for e, _ in over:
                    stack.append((e, around().within(e)))
                    names[e.name] += 1
                continue
            if not inline or any(e.aside or e.hint is not None for e, _ in stack[at:]):
                close()
            cut(at)
    close()
    return out


def weights_of(found: list[Block]) -> np.ndarray:
    """The weight of every block, -1 where it is stripped with the markup."""
    length = np.fromiter((len(b.text) for b in found), np.int64, len(found))
    structural = np.array([b.around.aside_out or b.around.aside_in for b in found], bool)
    plain = np.fromiter((b.plain for b in found), np.int64, len(found))
    in_main = np.array([b.around.in_main for b in found], bool)

    def off(wrappers):
        inner = np.array([b.around.aside_in or any(h not in wrappers for h in b.around.hints_in) for b in found], bool)
        return inner, np.array([b.around.aside_out or any(h not in wrappers for h in b.around.hints_out) for b in found], bool)

    strict = off_in, off_out = off(())
    main = in_main & ~off_in & ~off_out
    if not main.any():
        own: Counter[int] = Counter()
        for b, n, aside in zip(found, plain.tolist(), structural.tolist()):
            hints = b.around.hints_out + b.around.hints_in
            if hints and not aside:
                own[hints[-1]] += n
        whole = int(plain[~structural].sum())
        off_in, off_out = off({h for h, n in own.items() if 2 * n > whole})
        main = in_main & ~off_in & ~off_out
        if not main.any() and not plain[~off_in & ~off_out].any():
            main = in_main & ~off_in
    if main.any():  # a wrapper is one for its article only
        beside = np.zeros_like(plain) if length[main].sum() >= SURGE else plain // OUTSIDE
        return np.where(main, length + SURGE, np.where(strict[0] | strict[1], -1, beside))
    return np.where(off_in | off_out, -1, plain)


def kept(weights: np.ndarray) -> np.ndarray:
    """Blocks with a weight between the surge and dive points of the window sums."""
    n = len(weights)
    total = np.append(0, np.cumsum(weights))
    at = np.arange(n)
    sums = total[np.minimum(at + WINDOW, n)] - total[at]
    out, inside = np.zeros(n, dtype=bool), False
    for i in range(n):
        if not inside and weights[i] and sums[i] >= SURGE:
            inside = True
        elif inside and sums[i] < DIVE and weights[i] < DIVE:
            inside = False
        out[i] = inside and weights[i] > 0
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    weights = weights_of(found)
    found = [b for b, w in zip(found, weights.tolist()) if w >= 0]
    weights = weights[weights >= 0]
    flags = kept(weights)
    if not flags.any():
        flags = weights > 0
    return "\n\n".join(b.text for b, k in zip(found, flags) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema
                )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
