"""Main text of pages by a site style tree."""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtract.llm.storage import stage
from fairtract.llm.urls import url_host

#: Weight of what lies below a node against its own layout, per layout of the node.
DECAY = 0.9
#: Branches of less importance are taken out.
LEAST_IMPORTANCE = 0.3
#: A branch is judged only if this many pages of its site have it.
LEAST_PAGES = 5

# Names of HTML and words that sites use for what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Never shown as text: these alone stay out of the tree.
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video map".split())
MAIN = frozenset("article main".split())
#: Names of what is no article though it differs by page, such as reader comments, adverts, footers and
#: links to other pages: entropy cannot tell these from text, so their names decide.
VARIED_TAGS = frozenset("nav aside footer form button select textarea input option dialog menu".split())
VARIED_ROLES = frozenset("navigation complementary contentinfo search form menu menubar".split())
VARIED = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising breadcrumb breadcrumbs comment comments disqus footer "
    "menu nav navbar navigation pager pagination promo promotion recommended related replies reply respond share sharing "
    "sidebar social sponsor sponsored".split()
)
#: Names of frames and notices. The tree decides about them; the names do only where too few pages of
#: the site have the branch for that.
FRAME_ROLES = frozenset("banner dialog alertdialog alert".split())
FRAME = frozenset(
    "banner consent cookie cookies disclaimer gdpr login masthead modal newsletter notice notices notification "
    "overlay paywall popup signup subscribe subscription toolbar widget".split()
)
#: Start tags that end an open element of the given names; all block elements end a paragraph.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: Numbers in a text up to which other numbers do not make it another text.
FEW_NUMBERS = 3
#: Branches that a worker remembers before it starts anew.
REMEMBERED = 100_000
#: Elements that lie deeper belong to the branch of their ancestor at this depth, so that what is told of a
#: branch is bounded. Their text is read like any other, and names go on counting.
DEEPEST = 64
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")


def number(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


class Branch:
    """A place in a site's merged tree: the names, classes and ids of a path of elements."""

    __slots__ = ("tag", "number", "path", "unseen", "varied", "frame", "main")

    def __init__(self, tag: str, attrs: dict, parent: Branch | None):
        names = attrs.get("class") or ""
        mark = f"{attrs.get('id') or ''}.{' '.join(sorted(names.split()))}"
        self.tag = tag
        if parent and len(parent.path) >= DEEPEST:
            self.number, self.path = parent.number, parent.path
        else:
            self.number = number(f"{parent.number if parent else ''}>{tag}#{mark}")
            self.path = (*parent.path, self.number) if parent else (self.number,)
        self.unseen = bool(parent and parent.unseen) or tag in UNSEEN or "hidden" in attrs
        #: Number of the outermost article around the branch.
        self.main = parent.main if parent else None
        if self.main is None and (tag in MAIN or attrs.get("role") == "main"):
            self.main = self.number
        role = attrs.get("role") or ""
        words = {w.lower() for w in _PART.findall(f"{attrs.get('id') or ''} {names}")}
        named = tag not in ("html", "body", *MAIN)
        self.varied = (
            bool(parent and parent.varied)
            or tag in VARIED_TAGS
            or role in VARIED_ROLES
            or named and not words.isdisjoint(VARIED)
        )
        self.frame = (
            bool(parent and parent.frame)
            or (tag == "header" or "header" in words) and self.main is None
            or role in FRAME_ROLES
            or named and not words.isdisjoint(FRAME)
        )

    def kept(self, dull: frozenset, lively: frozenset) -> bool:
        """Whether text right in the branch is main text, by the dull branches and lively frames of the site."""
        if self.varied:
            return False
        if self.frame and self.number not in lively:
            return False
        # If whole articles are dull, the site has the same article everywhere and the tree cannot tell.
        return self.main in dull or dull.isdisjoint(self.path)


_ROOT = Branch("", {}, None)
_branches: dict[tuple, Branch] = {}


def branch_of(parent: Branch, tag: str, attrs: list) -> Branch:
    key = (parent.number, parent.unseen, parent.varied, parent.frame, parent.main, tag, *attrs)
    known = _branches.get(key)
    if known is None:
        if len(_branches) > REMEMBERED:
            _branches.clear()
        known = _branches[key] = Branch(tag, dict(attrs), parent)
    return known


class Page(HTMLParser):
    """Blocks of text in page order with their branches, and the child sequences of all elements."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[Branch, list[str]]] = [(_ROOT, [])]
        self.open_tags: Counter[str] = Counter()
        self.elements = list(self.open)
        self.blocks: list[tuple[Branch, str]] = []
        self.text: list[str] = []
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                self.blocks.append((self.holder, " ".join(words)))
            self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in INLINE and tag not in VOID:
            return
        self.flush()
        if tag in VOID:
            return
        while len(self.open) > 1 and (last := self.open[-1][0].tag) and (last == "p" or last in ENDS.get(tag, ())):
            self.open.pop()
            self.open_tags[last] -= 1
        parent, children = self.open[-1]
        children.append(tag)
        element = (branch_of(parent, tag, attrs), [])
        self.open.append(element)
        self.open_tags[tag] += 1
        self.elements.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in INLINE:
            return
        self.flush()
        # An end without a start is passed over at once, however many elements are open.
        found = self.open_tags[tag] == 0
        while not found:
            last = self.open.pop()[0].tag
            self.open_tags[last] -= 1
            found = last == tag

    def handle_data(self, data):
        if not self.text:
            self.holder = self.open[-1][0]
        if not self.holder.unseen:
            self.text.append(data)


def _plain(branch: Branch, text: str) -> str:
    """A text with its numbers made equal if it has few, such as a date or a counter. Articles' numbers stay."""
    if branch.main is not None:
        return text
    return _DIGITS.sub("0", text) if len(_DIGITS.findall(text)) <= FEW_NUMBERS else text


def _facts(batches):
    """Rows ``host, branch, kind, item, n, mass, spread`` of a batch, added up: of branches
    their pages (the item is 1 in frames), of their layouts the pages with each, of their texts the uses by page."""
    for batch in batches:
        found: dict[tuple, list] = {}
        paths: dict[int, tuple] = {}

        def add(host, branch, kind, item, n, times, found=found):
            row = found.setdefault((host, branch, kind, item), [0, 0, 0.0])
            row[0] += n
            row[1] += times
            row[2] += times * math.log(times)

        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html or "")
            layouts: dict[int, tuple[Branch, list]] = {}
            for branch, children in page.elements:
                if not branch.unseen:
                    layouts.setdefault(branch.number, (branch, []))[1].append(" ".join(children))
            for branch, children in layouts.values():
                paths[branch.number] = branch.path
                add(host, branch.number, 0, int(branch.frame), 1, 1)
                add(host, branch.number, 1, number("|".join(children)), 1, 1)
            texts = Counter((branch.number, number(_plain(branch, text))) for branch, text in page.blocks)
            for (branch, item), times in texts.items():
                add(host, branch, 2, item, 1, times)
        keys = list(zip(*found)) if found else [[], [], [], []]
        values = list(zip(*found.values())) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[0], pa.string()),
                pa.array(keys[1], pa.int64()),
                pa.array([paths[b] for b in keys[1]], pa.list_(pa.int64())),
                pa.array(keys[2], pa.int32()),
                pa.array(keys[3], pa.int64()),
                pa.array(values[0], pa.int64()),
                pa.array(values[1], pa.int64()),
                pa.array(values[2], pa.float64()),
            ],
            ["host", "branch", "path", "kind", "item", "n", "mass", "spread"],
        )


def style_tree(pages: DataFrame) -> DataFrame:
    """Importance of each branch of each site of ``pages(host, html)``.

    The pages' element trees are merged by site: elements with equal names,
    classes and ids along their whole path are one branch. A branch's layout
    importance is the entropy of the child sequences that it has on its pages;
    its content importance is one less the mean entropy of its texts over the
    pages, so a text on all pages counts nothing and one on a single page
    fully. A branch counts with both: its layouts weigh more the more there
    are, else the contents at and below it count.

    Entropies are sums over texts, so a site of any size is added up in parts;
    no join and no list of a site's texts is needed.

    Returns ``host, branch, path, frame, n_pages, importance``.
    """
    facts = pages.select("host", "html").mapInArrow(
        _facts, "host string, branch long, path array<long>, kind int, item long, n long, mass long, spread double"
    )
    items = facts.groupBy("host", "branch", "kind", "item").agg(
        F.first("path").alias("path"), F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.sum("spread").alias("spread")
    )
    layout, text = F.col("kind") == 1, F.col("kind") == 2
    n = F.sum(F.when(F.col("kind") == 0, F.col("n")))
    branches = items.groupBy("host", "branch").agg(
        F.first("path").alias("path"),
        F.bool_or((F.col("kind") == 0) & (F.col("item") == 1)).alias("frame"),
        n.alias("n_pages"),
        F.count_if(layout).alias("layouts"),
        F.sum(F.when(layout, F.col("n") * F.ln("n"))).alias("layout_spread"),
        F.count_if(text).alias("texts"),
        F.sum(F.when(text, F.ln("mass") - F.col("spread") / F.col("mass"))).alias("text_entropy"),
    )
    log_pages = F.ln("n_pages")
    several = F.col("n_pages") > 1
    own = stage(branches.select(
        "host",
        "branch",
        "path",
        "frame",
        "n_pages",
        "layouts",
        F.when(several, (log_pages - F.col("layout_spread") / F.col("n_pages")) / log_pages).otherwise(1.0).alias("layout"),
        F.when(several, 1 - F.col("text_entropy") / F.col("texts") / log_pages).otherwise(1.0).alias("content"),
        (F.col("n_pages") * F.col("texts")).alias("weight"),
    ), "branches")
    # The pages are read for this table only; branches are few.
    below = (
        own.where("weight > 0")
        .select("host", F.explode("path").alias("branch"), "content", "n_pages")
        .groupBy("host", "branch")
        .agg((F.sum(F.col("content") * F.col("n_pages")) / F.sum("n_pages")).alias("below"))
    )
    share = F.pow(F.lit(DECAY), F.col("layouts"))
    return own.join(below, ["host", "branch"]).select(
        "host", "branch", "path", "frame", "n_pages", ((1 - share) * F.col("layout") + share * F.col("below")).alias("importance")
    )


def judged(tree: DataFrame) -> DataFrame:
    """By host, the dull branches of a style tree, and the branches in frames that are not.

    Both are on ``LEAST_PAGES`` pages or more. A branch is dull if its importance
    and that of every branch below it are under ``LEAST_IMPORTANCE``, so a page of
    much boilerplate around a little text is not dull as a whole.
    """
    itself = F.col("branch") == F.col("at")
    own = lambda c: F.max(F.when(itself, F.col(c)))
    branches = (
        tree.select("*", F.explode("path").alias("at"))
        .groupBy("host", "at")
        .agg(F.max("importance").alias("most"), *(own(c).alias(c) for c in ("frame", "n_pages", "importance")))
        .where(F.col("n_pages") >= LEAST_PAGES)
    )
    dull = F.col("most") < LEAST_IMPORTANCE
    lively = F.col("frame") & (F.col("importance") >= LEAST_IMPORTANCE)
    listed = lambda which: F.array_sort(F.collect_set(F.when(which, F.col("at"))))
    return branches.where(dull | lively).groupBy("host").agg(listed(dull).alias("dull"), listed(lively).alias("lively"))


def main_text(html: str | None, dull: frozenset, lively: frozenset = frozenset()) -> str:
    """Blocks of a page that ``Branch.kept`` takes, joined by one space."""
    return " ".join(text for branch, text in Page(html or "").blocks if branch.kept(dull, lively))


def _extracted(batches):
    for batch in batches:
        sets: dict[tuple, frozenset] = {}
        texts = []
        columns = (batch.column(c).to_pylist() for c in ("dull", "lively"))
        for html, *lists in zip(batch.column("html"), *columns):
            keys = (tuple(x or ()) for x in lists)
            texts.append(main_text(html.as_py(), *(sets.setdefault(key, frozenset(key)) for key in keys)))
        rest = [batch.column(c) for c in ("page_id", "url")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """The main text of each of ``pages(page_id, url, html)``.

    All that is shown is merged into the style tree of the page's site, and its
    dull branches go, in articles as well as around them. Names decide only
    where entropy cannot tell: on branches that too few pages of the site have,
    frames and notices go and other text stays; comments, adverts, footers, forms
    and links to other pages (``VARIED``) go though they differ by page; and an
    article that is the same all over its site stays. The dull branches of a
    site, few whatever its number of pages, are joined to the pages by host;
    Spark broadcasts them only while they are small.

    Returns one row per input row: ``page_id, url, text, n_chars``. Null or
    empty html gives an empty text. Pages without a url form a site of their
    own. Ids may be null or repeated; other columns are not read.
    """
    sited = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    # Written, so that its size is known before the pages are joined to it.
    verdicts = stage(judged(style_tree(sited)), "dull")
    kind = pages.schema["page_id"].dataType.simpleString()
    found = (
        sited.join(verdicts, "host", "left")
        .select("page_id", "url", "html", "dull", "lively")
        .mapInArrow(_extracted, f"page_id {kind}, url string, text string")
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))
