"""Main text of web pages: flat blocks classified by a decision tree.

A page is cut into flat text blocks at block-level tags.  A block has a word count and a link density (share of its words in
links); these and both neighbours' are the features of a decision tree, beside three marks of its markup: whether it is a
heading, whether it is a paragraph, and what its container calls itself (page furniture, content, or nothing known).  The
tree is trained on the small labelled table that ``labelled_blocks`` makes of ``training_pages``: most of these pages have
class names that tell nothing, so that counts and densities decide; names decide where counts can't (an advert or a reader's
comment of the length of a paragraph).  The fitted tree is written out as a column expression: classification stays in the JVM.

Scale: one pass without a shuffle, linear in a page's length; a task looks at ``common.BLOCK_BYTES`` of pages (or one page) at
a time; the training table has a few thousand rows whatever the input.

Nulls and odd input: null and empty pages have an empty text; an empty table gives an empty result; further columns don't
matter; very long pages are read whole; repeated rows each get a row.  Unclosed tags end with their container; unclosed
comments and raw text (script, style, textarea, title, iframe) run to the end of the page, other unclosed hidden tags to the
next block; a tag that meets another ``<`` ends there; one that the page's end cuts is text.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_START = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[\"'<>]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
_NAME = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"\s+")

#: Tags whose content is no text of the page.
HIDDEN = frozenset("head noscript template svg annotation annotation-xml object select button canvas audio video datalist".split()) | _RAW_END.keys()
#: Tags that don't end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input meta link "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msup msub msubsup munder mover munderover msqrt mroot mstyle mpadded mfenced mtable mtr mtd".split()
)
CONTAINERS = frozenset("html body div section nav header footer aside form article main ul ol dl table figure details dialog menu blockquote center fieldset td".split())
BOILER_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
#: Words of class names, ids and roles for page furniture, and for content.
BOILER = frozenset(
    "nav navbar navigation menu header masthead footer sidebar side aside ad ads adv advert adverts advertisement banner promo promoted sponsor sponsored "
    "cookie cookies consent gdpr notice alert comment comments commentlist disqus reply replies response responses discussion review reviews kommentar kommentare "
    "commentaire commentaires comentario comentarios share social related recommended breadcrumb breadcrumbs newsletter subscribe "
    "subscription popup modal overlay login signin signup search widget toolbar pagination pager tags legal copyright complementary contentinfo form".split()
)
CONTENT = frozenset("article content main post entry story body text maintext".split())
#: Parts of a class name that say nothing by themselves.
NEUTRAL = frozenset("site page main top bottom left right primary secondary global section container wrapper wrap box block list area bar inner outer item links user reader".split())
_PARTS = re.compile(r"[_-]+")

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "heading", "para", "place")
#: Containers whose content stays furniture, even if it is an article in them.
STICKY = frozenset(
    "nav navbar navigation menu footer sidebar aside comment comments commentlist disqus reply replies response responses discussion review reviews kommentar "
    "kommentare commentaire commentaires comentario comentarios related recommended".split()
)
#: Pages of the labelled table.
TRAINING_PAGES = 240


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") of a page, in order, in linear time."""
    last = {c: page.rfind(c) for c in ('"', "'", "-->", "]]>", ">")}
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        m = _START.match(page, lt)
        if not m:
            follows = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                if page.startswith((">", "->"), lt + 4):
                    at = page.index(">", lt) + 1
                else:
                    at = page.index("-->", lt + 4) + 3 if last["-->"] >= lt + 4 else end
            elif page.startswith("<![CDATA[", lt) and last["]]>"] > lt:
                at = page.index("]]>", lt) + 3
            elif follows in ("!", "?", "/") and last[">"] > lt:
                at = page.index(">", lt) + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        place = m.end()
        while True:
            stop = _STOP.search(page, place)
            if not stop:
                yield "text", page[lt:], ""  # the page ends inside a tag
                return
            place, c = stop.end(), stop[0]
            if c in "<>":
                break
            before = place - 2
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and last[c] >= place:  # only a quote after "=" hides what follows
                place = page.index(c, place) + 1
        stop_at = place - 1
        tag, attributes = m[2].lower(), page[m.end() : stop_at]
        at = place if c == ">" else stop_at
        if m[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, attributes
        if tag in _RAW_END:
            close = _RAW_END[tag].search(page, at)
            at = close.start() if close else end


def _place(tag: str, attributes: str, above: int, closed: bool) -> int:
    """-2 and -1 in page furniture, 1 in content, 0 unknown; what says nothing is as the container above it.

    An article or main part in furniture is content again, but for an article at -2 (comments, menus, sidebars).
    """
    named = [m[1].strip("\"'").lower() for m in _NAME.finditer(attributes)] if attributes else []
    whole = [[p.rstrip("0123456789") for p in _PARTS.split(t) if p] for x in named for t in x.split()]
    # Whole class names only: has-sidebar isn't a sidebar, entry-header is none of both.
    boiler = [t for t in whole if all(p in BOILER or p in NEUTRAL for p in t) and any(p in BOILER for p in t)]
    content = any(all(p in CONTENT or p in NEUTRAL for p in t) and any(p in CONTENT for p in t) for t in whole)
    if tag in ("body", "html"):
        return 0
    if tag == "main" or (tag == "article" and above > -2 and (content or not boiler)):
        return 1
    if tag in BOILER_TAGS or (tag == "header" and above < 1 and not any(p in CONTENT for t in whole for p in t)) or (boiler and not content):
        sticky = closed and (tag in STICKY or any(p in STICKY for t in boiler for p in t))
        return min(above, -2 if sticky else -1)
    return 1 if above >= 0 and content and not boiler else above


def _pairs(parts: list[tuple[str, str, str]]) -> dict[int, int]:
    """Index of the end tag by that of its start tag, for containers and hidden elements that are closed."""
    out: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    depth: Counter = Counter()
    for i, (kind, tag, _) in enumerate(parts):
        if kind == "text" or (tag not in CONTAINERS and tag not in HIDDEN):
            continue
        if kind == "open":
            open_.append((tag, i))
            depth[tag] += 1
        elif depth[tag]:
            while True:
                name, at = open_.pop()
                depth[name] -= 1
                if name == tag:
                    out[at] = i
                    break
    return out


def blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, heading, para, place) of each block, in page order."""
    out: list[tuple[str, int, float, int, int, int]] = []
    stack: list[tuple[str, int]] = []
    depth: Counter = Counter()
    parts: list[str] = []
    linked, in_link, heading, para = 0, False, 0, 0

    def close() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts = []
        if text:
            words = text.count(" ") + 1
            out.append((text, words, min(1.0, linked / words), heading, para, max(-1, stack[-1][1]) if stack else 0))
        linked = 0

    found = list(tokens(page))
    ends = _pairs(found)
    i = -1
    while (i := i + 1) < len(found):
        kind, tag, attributes = found[i]
        if kind == "text":
            parts.append(tag)
            linked += len(tag.split()) if in_link else 0
        elif tag in HIDDEN:
            if tag == "head":
                close()
            if kind == "close" or attributes.endswith("/"):
                continue
            if i in ends:
                i = ends[i]
            else:  # never closed: up to the next block
                while i + 1 < len(found) and (found[i + 1][0] == "text" or found[i + 1][1] in INLINE or found[i + 1][1] in HIDDEN):
                    i += 1
        elif tag == "a":
            in_link = kind == "open"
        elif tag == "br":
            parts.append(" ")
        elif tag not in INLINE:
            close()
            in_link = in_link and tag not in CONTAINERS
            heading = int(kind == "open" and len(tag) == 2 and tag[0] == "h" and tag[1] in "123456")
            para = int(kind == "open" and tag in ("p", "pre", "blockquote", "dd"))
            if tag in CONTAINERS:
                if kind == "open":
                    stack.append((tag, _place(tag, attributes, stack[-1][1] if stack else 0, i in ends)))
                    depth[tag] += 1
                elif depth[tag]:
                    while True:
                        name = stack.pop()[0]
                        depth[name] -= 1
                        if name == tag:
                            break
    close()
    return out


NUMBERS = ("words", "links", "heading", "para", "place")
BLOCKS = f"array<struct<text:string,{','.join(f'{n}:double' for n in NUMBERS)}>>"


def cut(pages: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and __blocks of every page (column html)."""
    kind = pa.list_(pa.struct([("text", pa.string()), *[(n, pa.float64()) for n in NUMBERS]]))
    schema = pages.select(*carry).schema
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), f"__blocks {BLOCKS}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.by_bytes(whole, "__html"):
                found = [[dict(zip(("text", *NUMBERS), b)) for b in blocks(p.as_py() or "")] for p in batch.column("__html")]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(found, kind)], [*carry, "__blocks"])

    return pages.select(*carry, F.col("html").alias("__html")).mapInArrow(run, full)


def _row(b: Column, i: Column, all_: Column) -> Column:
    before, after = F.get(all_, i - 1), F.get(all_, i + 1)
    zero = F.lit(0.0)
    return F.struct(
        b["text"].alias("text"), b["words"].alias("words"), b["links"].alias("links"),
        F.coalesce(before["words"], zero).alias("prev_words"), F.coalesce(before["links"], zero).alias("prev_links"),
        F.coalesce(after["words"], zero).alias("next_words"), F.coalesce(after["links"], zero).alias("next_links"),
        b["heading"].alias("heading"), b["para"].alias("para"), b["place"].alias("place"),
    )


def _with_neighbours(found: DataFrame) -> DataFrame:
    return found.withColumn("__blocks", F.transform("__blocks", lambda b, i: _row(b, i, F.col("__blocks"))))


def training_pages(n: int = TRAINING_PAGES, seed: int = 5, named: float = 0.4) -> list[str]:
    """``n`` drawn pages; blocks of main text begin with "+".  A share of them has telling names, the others have none."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(rng.randint(low, high)))

    def link(low: int, high: int) -> str:
        return f"<a href='/x'>{words(low, high)}</a>"

    def links(item: str, low: int, high: int) -> str:
        return "".join(f"<{item}>{link(1, 4)}</{item}>" for _ in range(rng.randint(low, high)))

    def sentence() -> str:
        low, high = rng.choices(((1, 5), (6, 25), (25, 120)), (0.2, 0.4, 0.4))[0]
        return words(low, high) + (f" {link(1, 3)} {words(2, 6)}" if rng.random() < 0.2 and low > 1 else "")

    def page() -> str:
        telling = rng.random() < named

        def part(tag: str, names: str, body: str) -> str:
            """One container: by its tag, a telling class or (unless ``telling``) a class that says nothing."""
            if not telling:
                return f"<div class='x{rng.randint(1, 999)}'>{body}</div>"
            return f"<{tag}>{body}</{tag}>" if tag and rng.random() < 0.5 else f"<div class='{rng.choice(names.split())}'>{body}</div>"

        def article() -> str:
            out = [f"<h1>+{words(2, 14)}</h1>"] if rng.random() < 0.9 else []
            for _ in range(rng.choice((1, 2, 4, 7, 12))):
                kind = rng.random()
                if kind < 0.66:
                    out.append(f"<p>+{sentence()}</p>")
                elif kind < 0.72:
                    out.append(f"<p>+{words(1, 4)} {link(1, 3)}</p>")
                elif kind < 0.8:
                    out.append(f"<h2>+{words(1, 8)}</h2><p>+{words(8, 60)}</p>")
                elif kind < 0.86:
                    out.append("<ul>" + "".join(f"<li>+{words(2, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
                elif kind < 0.9:
                    out.append(f"<blockquote>+{words(5, 50)}</blockquote>")
                elif kind < 0.95:
                    out.append(part("aside", "related share social", f"<ul>{links('li', 2, 5)}</ul>"))
                else:
                    out.append(f"<p>+{words(1, 6)} {link(1, 4)} {words(4, 20)}</p>")
            return "".join(out)

        top, bottom = [], []
        if rng.random() < 0.5:
            top.append(part("header", "header masthead banner", rng.choice((words(1, 4), link(1, 3), f"{link(1, 3)}<p>{words(3, 8)}</p>" if telling else link(2, 3)))))
        top.append(part("nav", "nav menu navbar", f"<ul>{links('li', 3, 10)}</ul>" if rng.random() < 0.7 else " ".join(link(1, 2) for _ in range(rng.randint(3, 8)))))
        if rng.random() < 0.4:
            top.append(part("", "cookie-notice notice alert", f"{words(4, 25) if telling else words(2, 9)} {link(1, 3)}"))
        if rng.random() < 0.5:
            top.append(part("", "ad advert promo sponsored", words(3, 20) if telling else words(1, 7)))
        if rng.random() < 0.4:
            side = part("aside", "sidebar widget", (f"<p>{words(5, 60)}</p>" if telling else "") + f"<h3>{words(1, 3)}</h3><ul>{links('li', 3, 8)}</ul>")
            (top if rng.random() < 0.4 else bottom).append(side)
        if rng.random() < 0.35:
            if telling:
                bottom.append(part("", "comments reviews discussion", "".join(f"<p>{link(1, 2)} {words(1, 4)}</p><p>{words(3, 90)}</p>" for _ in range(rng.randint(1, 5)))))
            else:
                bottom.append(part("", "", "".join(f"<div>{link(1, 2)} {link(1, 2)}</div>" for _ in range(rng.randint(2, 5)))))
        if rng.random() < 0.3:
            bottom.append(part("form", "newsletter search form", f"{words(1, 12) if telling else words(1, 3)}"))
        bottom.append(part("footer", "footer legal", rng.choice((f"{words(2, 12) if telling else words(1, 4)} {link(1, 3)}", f"{link(1, 3)} {link(1, 3)}", words(3, 16) if telling else link(2, 5)))))
        # On a page with telling names, what has no such name is content more often than not.
        main = article()
        if telling and rng.random() < 0.7:
            main = rng.choice((f"<article>{main}</article>", f"<main>{main}</main>", f"<div class='content'>{main}</div>"))
        else:
            main = f"<div>{main}</div>"
        # Some pages begin or end with their article.
        top, bottom = top if rng.random() < 0.75 else [], bottom if rng.random() < 0.75 else []
        return f"<body class='{rng.choice(('home', 'has-sidebar', 'no-comments'))}'>{''.join(top)}{main}{''.join(bottom)}</body>"

    return [page() for _ in range(n)]


def labelled_blocks(spark: SparkSession, pages: list[str] | None = None) -> DataFrame:
    """The labelled table: features and label (1: main text) of the blocks of ``pages`` (by default the training pages)."""
    rows = []
    for page in training_pages() if pages is None else pages:
        found = blocks(page)
        sides = [(0.0, 0.0), *[(float(b[1]), b[2]) for b in found], (0.0, 0.0)]
        for i, (text, words, links, heading, para, place) in enumerate(found):
            rows.append((float(words), links, *sides[i], *sides[i + 2], float(heading), float(para), float(place), float(text[0] == "+")))
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in (*FEATURES, "label")))


def fit(spark: SparkSession, table: DataFrame | None = None, depth: int = 8):
    """The tree as a function from a block struct to a boolean column."""
    return expression(train(spark, table, depth))


def train(spark: SparkSession, table: DataFrame | None = None, depth: int = 8):
    table = (labelled_blocks(spark) if table is None else table).coalesce(1)
    data = table.select("label", array_to_vector(F.array(*FEATURES)).alias("features"))
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=3, maxBins=128, seed=7).fit(data)


def expression(model):
    def read(node) -> tuple | bool:
        if node.subtreeDepth() == 0:
            return node.prediction() >= 0.5
        split = node.split()
        left, right = read(node.leftChild()), read(node.rightChild())
        return left if left is right and isinstance(left, bool) else (FEATURES[split.featureIndex()], split.threshold(), left, right)

    tree = read(model._java_obj.rootNode())

    def decide(b: Column, node=tree) -> Column:
        if isinstance(node, bool):
            return F.lit(node)
        name, threshold, left, right = node
        return F.when(b[name] <= threshold, decide(b, left)).otherwise(decide(b, right))

    return decide


def extract(pages: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and __text, the main text, of every row of ``pages`` (column html)."""
    decide = fit(pages.sparkSession)
    kept = F.filter("__blocks", lambda b: decide(b))
    found = _with_neighbours(cut(pages, carry))
    return found.select(*carry, F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n").alias("__text"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, ["page_id", "url"]).select(
        "page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars")
    )
