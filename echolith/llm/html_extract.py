"""HTML extraction by the maximum-scoring subsequence.

A page is read once into a sequence of words and tags. Every score is a
log-odds learned from labelled pages (LABELLED by hand, and labelled_pages(),
which are built by rule from usual names of elements): tags score negative,
words by the evidence of the elements that they lie in, positive in text and
negative in menus, adverts, comments and the like, less in links. A linear scan
finds the contiguous region with the greatest sum; it is widened to the element
that encloses it (the article, where there is one), and the blocks inside it
whose evidence is not negative are the text. The weights are fitted once, on
the driver, and go along with the function.

Defined results: null and empty html give an empty text; a page without words
too; of regions of equal sums the earliest is taken; unclosed and crossed tags
are read as browsers do for paragraphs and lists; an empty table gives no row;
repeated rows get equal results; a very long page is one row, read in time
linear in its length and the depth of its widest element; columns named text
or n_chars are replaced, others pass through.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Kinds of elements of the HTML standard.
RAW = "script style noscript template textarea title iframe svg math select option object canvas video audio"
SPECIAL = "nav header footer aside form menu dialog button label fieldset figure head main article search"
VOID = "area base br col embed hr img input link meta source track wbr"
BLOCKS = (
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
)
RAW, SPECIAL, VOID, BLOCKS = (frozenset(x.split()) for x in (RAW, SPECIAL, VOID, BLOCKS))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

#: Elements that no name of their own makes noise, and words before a name that make it a trait of the element.
OWN = frozenset({"html", "body", "main", "article"})
TRAIT = frozenset("has have with without no not non is".split())
OTHER_TAG = -0.3
#: Scores of a word or a tag lie between these.
LEAST, MOST = -1.0, 2.0
#: An opening tag that ends an open element, if no other block is open in between.
ENDS = {"p": ("p", BLOCKS - {"br", "body", "html"}), "li": ("li", {"li"}), "td": ("td", {"td", "th", "tr"}), "th": ("th", {"td", "th", "tr"}), "tr": ("tr", {"tr"}), "dd": ("dd", {"dd", "dt"}), "dt": ("dt", {"dd", "dt"})}
ENDED = {name: [tag for tag, names in ENDS.values() if name in names] for name in BLOCKS}


def features(name: str, attributes: str, in_article: bool) -> tuple[str, ...]:
    """What is learned of an element: its kind, whether it is hidden, and of a block the last word of each of its names (class, id, role) and the words before it."""
    out = [name + ("*" if in_article else "")] if name in SPECIAL else []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" and name not in ("html", "body") or key == "style" and HIDDEN.search(value) and name not in ("html", "body"):
            out.append("hidden")
        elif key in ("class", "id", "role") and name in BLOCKS and name not in OWN:
            for one in value.lower().split():
                words = [x for x in re.split(r"[^a-z]+", one) if x]
                if words and not TRAIT & set(words[:-1]):
                    out += ["of:" + x for x in words[:-1]] + ["is:" + words[-1]]
    return tuple(dict.fromkeys(out))


class Page:
    """The blocks of a page: words and tags in order, with the element each lies in."""

    def __init__(self, html: str):
        self.names, self.parents, self.own, self.linked = ["#"], [-1], [()], [False]
        self.tokens: list[tuple[str, int, int]] = []  # kind, weight count, element
        self.blocks: list[list] = []  # element, first token, pieces with the element of each
        self.inside: list[bool] = []
        stack, at, marked = [0], 0, False
        open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
        block_at = [0]  # places of open blocks
        self.new = True

        def close(to: int) -> None:
            while len(stack) > to:
                gone = self.names[stack.pop()]
                open_at[gone].pop()
                if block_at[-1] == len(stack):
                    block_at.pop()

        def text(piece: str) -> None:
            if not piece.strip():
                if self.blocks and not self.new and piece:
                    self.blocks[-1][2].append((" ", stack[-1]))
                return
            here = stack[-1]
            if self.new:
                self.blocks.append([stack[block_at[-1]], len(self.tokens), []])
                self.new = False
            self.blocks[-1][2].append((piece, here))
            self.tokens.append(("a" if self.linked[here] else "word", len(piece.split()), here))
            self.inside.append(marked)

        for m in TOKEN.finditer(html):
            if m.start() < at:
                continue
            text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                marked = {"<!--content-->": True, "<!--/content-->": False}.get(m[0], marked)
                continue
            name = m[2].lower()
            if name in RAW:
                if not m[1] and not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                continue
            self.tokens.append((("/" if m[1] else "") + name, 1, stack[-1]))
            self.inside.append(marked)
            if name in BLOCKS:
                self.new = True
            if m[1]:
                if open_at.get(name) and (name in BLOCKS or open_at[name][-1] > block_at[-1]):
                    close(open_at[name][-1])
            elif name not in VOID and not m[3].endswith("/"):
                for tag in ENDED.get(name, ()):
                    if open_at.get(tag) and block_at[-1] <= open_at[tag][-1]:
                        close(open_at[tag][-1])
                own = features(name, m[3], bool(open_at.get("article") or open_at.get("main")))
                self.names.append(name)
                self.parents.append(stack[-1])
                self.own.append(own)
                self.linked.append(name == "a" or (self.linked[stack[-1]] and name not in BLOCKS))
                open_at.setdefault(name, []).append(len(stack))
                if name in BLOCKS:
                    block_at.append(len(stack))
                stack.append(len(self.names) - 1)
        text(html[at:])

    def evidence(self, weights: dict[str, float]) -> list[float]:
        """The log-odds of each element that its words are text."""
        out = [weights["base"]]
        for own, parent in zip(self.own[1:], self.parents[1:], strict=True):
            x = min(out[parent], 1.0) + sum(weights.get(f, 0.0) for f in own)
            out.append(x if out[parent] >= 0 else min(x, out[parent]))  # nothing inside a menu is text
        return out

    def path(self, element: int) -> list[int]:
        out = []
        while element >= 0:
            out.append(element)
            element = self.parents[element]
        return out[::-1]


# Pages labelled by hand; the main text lies between the marks.
LABELLED = (
    "<html><head><title>t</title></head><body><nav><ul><li><a href=x>home</a></li><li><a href=x>news</a></li></ul></nav><div class=ad>buy now today</div><article><!--content--><h1>A title of words</h1><p>One two three four five six seven eight.</p><p>Nine ten eleven twelve words here too.</p><!--/content--></article><footer>all rights kept <a href=x>terms</a></footer></body></html>",
    "<body><header><h1>site</h1><a href=x>in</a><a href=x>up</a></header><div id=main><!--content--><h2>Long heading here</h2><p>This part has many plain words and <b>bold</b> ones in it.</p><ul><li>first point of the list</li><li>second point of it</li></ul><!--/content--></div><aside><ul><li><a href=x>more</a></li><li><a href=x>most read</a></li></ul></aside><div class=footer>end</div></body>",
    "<body><div class=menu><a href=x>a</a> <a href=x>b</a> <a href=x>c</a></div><div><!--content--><p>Plain text without an article element around it but long enough.</p><p>It goes on for another paragraph of plain words.</p><!--/content--></div><form><label>mail</label><input><button>send</button></form></body>",
    "<body><div class=cookie-notice>we use cookies <button>ok</button></div><main><!--content--><h1>Head</h1><p>Words and words and words in a row.<br>And a line after a break, longer still.</p><blockquote>said by someone once upon a time</blockquote><!--/content--></main><div class=comments><p>nice one</p><p>first</p></div></body>",
    "<body><table><tr><td><a href=x>one</a></td><td><a href=x>two</a></td></tr></table><article><!--content--><p>A short text of ten plain words in one paragraph only.</p><!--/content--></article><footer><a href=x>a</a> <a href=x>b</a></footer></body>",
)


# Names of elements that hold no text of the article, of those that hold some, and of parts of either.
NOISE = (
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion nav navbar navigation menu sidebar footer header masthead cookie cookies"
    " consent notice notices banner alert comment comments disqus respond replies share sharing social related recommended newsletter subscribe"
    " breadcrumb breadcrumbs popup modal login signup widget toolbar pagination pager legal disclaimer copyright complementary contentinfo search"
).split()
TEXT = "content article post entry story text body page prose section chapter work works method methods theory history study results basis period policy analysis".split()
PART = "list box area wrapper container inner block row col left right top bottom".split()


def labelled_pages() -> list[str]:
    """Pages by rule: each name of NOISE as the whole name, as its last and as its first word, about and inside texts under names of TEXT."""
    rng = random.Random(11)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def links() -> str:
        return "<ul>" + "".join(f"<li><a href=x>{words(1, 4)}</a></li>" for _ in range(rng.randint(2, 6))) + "</ul>"

    def noise(name: str) -> str:
        form = rng.choice([name, f"{rng.choice(TEXT)}-{name}", f"{name}-{rng.choice(PART)}", f"{name}-{rng.choice(PART)}", f"{rng.choice(PART)}-{name}", f"{name}-{rng.choice(['links', 'items', 'more', 'form'])}", f"site_{name}"])
        tag, key = rng.choice(["div", "div", "section", "ul", "p"]), rng.choice(["class", "class", "id", "role"])
        inner = words(3, 30) if tag == "p" else rng.choice([links, lambda: words(3, 30), lambda: f"<p>{words(3, 40)}</p><p>{words(3, 20)}</p>"])()
        return f'<{tag} {key}="{form}">{inner}</{tag}>'

    def named(k: int) -> str:
        a, b = TEXT[k % len(TEXT)], rng.choice(TEXT)
        return rng.choice([a, f"{a}-{b}", f"{a}-{rng.choice(PART)}", f"{rng.choice(PART)}-{a}", f"site_{a}"]) if k % 8 else f"{NOISE[k // 8 % len(NOISE)]}-{TEXT[8 + k // 8 % (len(TEXT) - 8)]}"

    def special(k: int, within: bool) -> str:
        kind = ("nav", "footer", "aside", "form", "menu", "dialog", "hidden", "button", "search", "aside" if within else "header")[k % 10]
        if kind == "hidden":
            return rng.choice([f"<div hidden>{words(4, 30)}</div>", f'<div style="display: none">{words(4, 30)}</div>', f'<p style="visibility:hidden">{words(4, 30)}</p>'])
        inner = f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>" if kind == "form" else rng.choice([links(), f"<p>{words(3, 25)}</p>"])
        return f"<{kind}>{inner}</{kind}>"

    def paragraphs(n: int) -> str:
        some = (lambda: f"<p>{words(15, 60)}</p>", lambda: f"<p>{words(5, 20)} <a href=x>{words(1, 3)}</a> {words(8, 20)}</p>", lambda: f"<h2>{words(2, 6)}</h2><p>{words(10, 40)}</p>",
                lambda: f"<ul><li>{words(4, 12)}</li><li>{words(4, 12)}</li></ul>", lambda: f"<blockquote>{words(8, 25)}</blockquote>", lambda: f"<p><b>{words(2, 5)}</b> {words(10, 30)}<br>{words(5, 20)}</p>",
                lambda: f"<figure><img><figcaption>{words(4, 10)}</figcaption></figure>")
        return "".join(rng.choice(some)() for _ in range(n))

    out, at = [], 0
    for k in range(8 * len(NOISE)):
        near = [special(k + 3 * j, j < 2) if j in (0, 3) else noise(NOISE[(at + j) % len(NOISE)]) for j in range(6)]
        if k % 2:
            near[:2] = near[1::-1]
        at += 5
        start, end = (("<article>", "</article>"), ("<main>", "</main>"), (f'<div class="{named(k + 1)}">', "</div>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"), ("", ""))[k % 6]
        title = f"<header><h1>{words(3, 9)}</h1></header>" if k % 6 in (0, 3) and k % 2 else f"<h1>{words(3, 9)}</h1>"
        inner = f"<!--content-->{title}{paragraphs(2)}<!--/content-->{near[0]}<!--content-->{paragraphs(2)}<section class=\"{named(k)}\">{paragraphs(2)}</section><!--/content-->{near[1]}"
        part = PART[k % len(PART)]
        outer = rng.choice([part, f"page-{part}", f"site-{part}", f"{rng.choice(TEXT)}-{part}", f"{part}-{rng.choice(TEXT)}", f"{rng.choice(PART)}-{part}"])
        whole = f"{near[2]}{near[3]}{start}{inner}{end}{near[4]}{near[5]}"
        out.append("<html><body>" + (f'<div class="{outer}">{whole}</div>' if k % 6 < 5 else whole) + "</body></html>")
    return out


@lru_cache(maxsize=4)
def fit(pages: tuple[str, ...] | None = None) -> dict[str, float]:
    """Log-odds of text against the rest: of blocks in elements of no feature, of each feature by blocks, of words in links, and of tags, which are negative."""
    inside, outside, plain = Counter(), Counter(), Counter()
    tags = {True: Counter(), False: Counter()}
    for html in pages if pages is not None else (*LABELLED, *labelled_pages()):
        page = Page(html)
        for (kind, n, _), inn in zip(page.tokens, page.inside, strict=True):
            tags[inn][kind] += n
        for _, first, pieces in page.blocks:
            found = {f for e in page.path(pieces[0][1]) for f in page.own[e]}
            (inside if page.inside[first] else outside).update([*found, ""])
            plain[page.inside[first]] += not found
    odds = lambda a, b, m, n: math.log((a + 0.5) / (m + 1)) - math.log((b + 0.5) / (n + 1))
    n_in, n_out = inside[""], outside[""]
    weights = {f: odds(inside[f], outside[f], n_in, n_out) for f in {*inside, *outside} - {""}}
    weights["base"] = min(max(odds(plain[True], plain[False], 0, 0), 0.1), 1.0)
    total = {k: c["word"] + c["a"] for k, c in tags.items()}
    weights["in a link"] = min(odds(tags[True]["a"], tags[False]["a"], total[True], total[False]), -0.1)
    for kind in {*tags[True], *tags[False]} - {"word", "a"}:
        weights["<" + kind] = max(min(odds(tags[True][kind], tags[False][kind], total[True], total[False]), -0.1), LEAST)
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range of the greatest sum, the earliest and shortest of equals."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, lo, hi = total, start, k + 1
    return lo, hi


def main_text(html: str | None, weights: dict[str, float] | None = None) -> str:
    if not html:
        return ""
    weights = fit() if weights is None else weights
    page = Page(html)
    evidence = page.evidence(weights)

    def score(kind: str, n: int, element: int) -> float:
        if evidence[element] < 0:  # cut out of the text, whatever its length
            return 0.0
        if kind not in ("word", "a"):
            return weights.get("<" + kind, OTHER_TAG)
        return n * min(max(evidence[element] + (weights["in a link"] if kind == "a" else 0.0), LEAST), MOST)

    lo, hi = best_region([score(*t) for t in page.tokens])
    core = [b for b in page.blocks if lo <= b[1] < hi and evidence[b[0]] >= 0]
    if not core:
        return ""
    common = page.path(core[0][0])
    for element in dict.fromkeys(b[0] for b in core[1:]):
        if common[-1] != element and len(common) > 1:
            other = page.path(element)
            common = [x for x, y in zip(common, other, strict=False) if x == y]
    articles = [e for e in common if page.names[e] in ("article", "main")]
    box = articles[-1] if articles else common[-1]
    while not articles and page.names[box] not in ("div", "section", "td", "body", "html", "#"):
        box = page.parents[box]
    wide = page.names[box] not in ("body", "html", "#")
    within = [False] * len(page.names)
    for e in range(len(within)):
        within[e] = e == box or (e > box and within[page.parents[e]])
    kept = [b for b in page.blocks if evidence[b[0]] >= 0 and (within[b[0]] if wide else lo <= b[1] < hi)]
    texts = (" ".join(unescape("".join(x for x, e in b[2] if evidence[e] >= 0)).split()) for b in kept)
    return "\n".join(t for t in texts if t)


def extract(pages: DataFrame, html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """pages with text and n_chars."""
    weights = fit() if weights is None else weights

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h, weights) if isinstance(h, str) else "")

    return pages.withColumn("__el_t", text(F.col(html_col))).withColumn("text", F.col("__el_t")).withColumn("n_chars", F.length("__el_t").cast("long")).drop("__el_t")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
