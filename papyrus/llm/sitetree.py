"""Main text of web pages by a site style tree.

The whole DOMs of a host's pages are merged into one tree of style nodes: an element's node is its path of tags with class,
id and role (runs of digits as one), down to ``MAX_DEPTH`` levels; what stands deeper belongs to the node of that level. Over
the host's distinct pages a node has

* a presentation importance: the entropy of the child layouts that it shows, by logarithms to the number m of its pages;
* a content importance, from the novelty of its texts: a text on n of the m pages has 1 - log n / log m (a text on every page
  says nothing, a text of one page everything). Within a main element it is the branch's novel share of its own words,
  elsewhere its novel words a page in proportion to those of the branch beside it that has most;
* a composite of the two, by ``GAMMA``.

Branches of low composite importance go from each page. What tags, roles and class words say is a prior: it decides where a host
has fewer than ``LEAST_PAGES`` distinct pages with a node, and with the counts elsewhere. Tags and roles that are no main text whatever
their importance (navigation, footers, forms, scripts, hidden elements) go, and so do comments and adverts, whose texts are as
new as an article's. Other class words (share, sidebar, cookies, ...; outside main elements also related, social, notice, ...) and
branches beside a main element go unless their importance is above ``DOUBT``. Class words are whole names, or parts of names
whose other parts only say where they stand ("site-footer"; not "footer-note"). Main elements stay, and so do headings, paragraphs, lists and tables that carry no class, id or role, and everything inline.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from papyrus.llm.common import checkpointed, pick

GAMMA, LEAST_IMPORTANCE, DOUBT, LEAST_PAGES, MAX_DEPTH = 0.9, 0.2, 0.4, 8, 64
#: Verdicts on style nodes that are broadcast at most; more are joined by host and salt.
MAX_BROADCAST, SALTS = 20_000, 64

#: A comment, a declaration, or a tag: possessive, so each character is read once. The last group is empty where a quote is never closed.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img math mi mn mo mrow msup msub mfrac".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption hr br".split())
#: An opening tag closes an open one of these, looked for up to the scope.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
GONE_TAGS = frozenset("nav footer aside form head button select dialog menu input label fieldset svg object template canvas".split()) | RAW
GONE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu form".split())
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("main", "article"))
#: What may stand before or behind a class word in a name without changing what it says ("site-footer", "share-buttons"; but not "footer-note").
_BEFORE, _BEHIND = r"(?:(?:site|page|main|top|bottom|left|right|global|post|article|user|reader|blog|wp|js|the)[-_]?)*", r"(?:[-_]?(?:bar|box|list|area|section|container|wrapper|wrap|links?|buttons?|icons?|block|widget|unit|slot|left|right|top|bottom|inner|outer|form|menu|item|items|thread|panel|main|content|header|title|[0-9]+))*"


def _class_words(words: str) -> re.Pattern:
    """A whole name among a class attribute's, made of one of the words and of parts that say nothing."""
    return re.compile(rf"(?:^|\s){_BEFORE}(?:{words}){_BEHIND}(?:$|\s)", re.I)


#: Kinds that are no main text whatever their importance; kinds that importance may overrule; words that count outside main elements only.
FIXED_CLASS = _class_words(r"ads?|advert(?:s|isement|isements|ising)?|sponsor(?:ed|s)?|comments?|commentlist|disqus|replies|respond|skip-?link")
LIKELY_CLASS = _class_words(r"nav(?:bar|igation)?|breadcrumbs?|side-?bar|footer|masthead|cookies?|cookies?-?(?:banner|notice|consent)|consent|gdpr|newsletter|search-?(?:bar|box|form)|share|sharing|pagination|pager")
WEAK_CLASS = _class_words(r"banner|promo(?:tion)?s?|menus?|widgets?|foot|header|notices?|subscribe|signup|login|search|social|related|recommended|popular|popup|modal|overlay|toolbar")

STAYS, WEAK, LIKELY, STRONG = 0, 1, 2, 3


def _key(text: str, seed: int = 0) -> int:
    found = xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)
    return found - (1 << 64) if found >> 63 else found


class Node:
    """An element: ``path`` is its style node's key, ``above`` that of the node it stands in."""

    __slots__ = ("above", "depth", "inside", "main", "named", "path", "prior", "step", "tag")

    def __init__(self, tag: str, step: str, parent: Node | None, named: bool, main: bool, prior: int) -> None:
        self.tag, self.step, self.named, self.main, self.prior = tag, step, named, main, prior
        self.depth, self.inside = (parent.depth + 1, parent.inside or parent.main) if parent else (0, False)
        deep = parent is not None and parent.depth >= MAX_DEPTH
        self.path = parent.path if deep else _key(step, (parent.path if parent else 0) & (1 << 64) - 1)
        self.above = parent.above if deep else (parent.path if parent else 0)


def _prior(tag: str, words: str, role: str, hidden: bool, main: bool, inside: bool) -> int:
    if hidden or tag in GONE_TAGS or role in GONE_ROLES or (tag == "header" and not inside):
        return STRONG
    if main or tag in ("html", "body") or not words.strip():
        return STAYS
    if FIXED_CLASS.search(words):
        return STRONG
    return LIKELY if LIKELY_CLASS.search(words) else WEAK if not inside and WEAK_CLASS.search(words) else STAYS


def events(page: str) -> list[Node | str | None]:
    """The page in order: a node where an element starts, its (decoded) texts, None where an element ends.

    One pass without recursion: how deep elements are nested and how badly they are closed and quoted makes no difference to
    the time. Scripts, styles and markup declarations leave nothing.
    """
    root = Node("", "", None, False, False, STAYS)
    out: list[Node | str | None] = []
    stack, at, n = [root], 0, len(page)
    places: dict[str, list[int]] = defaultdict(list)  # of each open tag, its places in the stack
    blocks: list[int] = []  # places of open elements that are not inline

    def last(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            places[node.tag].pop()
            if node.tag not in INLINE:
                blocks.pop()
            out.append(None)

    def text(end: int) -> None:
        if end > at:
            out.append(htmllib.unescape(page[at:end]) if "&" in page[at:end] else page[at:end])

    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            text(n)
            break
        text(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[4] is None:  # a quote that is never closed: the tag ends where it would without quotes; no later tag has such a quote
            at = page.find(">", at) + 1 or n
        if m[1]:
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag in CLOSES_P and blocks and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in IMPLIED:
            closed, scope = (last(tags) for tags in IMPLIED[tag])
            if closed > scope:
                close(closed)
        names: dict[str, str] = {}
        if "=" in m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                names.setdefault(a[1].lower(), htmllib.unescape(a[2] or a[3] or a[4] or ""))
        look = " ".join(f"{k}={names[k]}" for k in ("class", "id", "role") if names.get(k))
        words, role = f"{names.get('class', '')} {names.get('id', '')}", names.get("role", "").lower()
        hidden = "hidden" in m[3].lower().split() or names.get("aria-hidden", "").lower() == "true"
        main = (tag in MAIN_TAGS or role in MAIN_ROLES) and not FIXED_CLASS.search(words) and not LIKELY_CLASS.search(words)
        top = stack[-1]
        step = f"{tag}[{re.sub('[0-9]+', '#', look)}]" if look else tag
        node = Node(tag, step, top, bool(look), main, _prior(tag, words, role, hidden, main, top.inside or top.main))
        out.append(node)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?![A-Za-z0-9-])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = closing.end() if closing else n
        if tag in VOID or tag in RAW or m[3].endswith("/"):
            out.append(None)
            continue
        places[tag].append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(node)
    close(1)
    return out


def removable(node: Node) -> bool:
    """Whether counts alone may remove the node's branch: neither main elements nor unnamed text elements nor anything inline, in main elements named ones only."""
    if node.main or node.tag in INLINE or node.tag in HEADINGS or node.tag in ("html", "body"):
        return False
    return node.named or not (node.inside or node.tag in PLAIN)


def _around_main(found: list[Node | str | None]) -> set[int] | None:
    """Places of the elements that main elements stand in; None without a main element outside removed branches."""
    around, open_, away = None, [], 0
    for i, x in enumerate(found):
        if isinstance(x, Node):
            open_.append(i)
            if not away and x.prior >= LIKELY:
                away = len(open_)
            elif not away and x.main:
                around = set() if around is None else around
                for k in reversed(open_[:-1]):
                    if k in around:
                        break
                    around.add(k)
        elif x is None:
            open_.pop()
            if away > len(open_):
                away = 0
    return around


def _priors(found: list[Node | str | None]) -> None:
    """Where the page has a main element, what stands beside it gets a weak prior, if it has none."""
    around = _around_main(found)
    open_: list[int] = []
    for i, x in enumerate(found if around is not None else ()):
        if isinstance(x, Node):
            if x.prior == STAYS and not x.main and i not in around and (not open_ or open_[-1] in around):
                x.prior = WEAK
            open_.append(i)
        elif x is None:
            open_.pop()


def main_blocks(page: str, gone: frozenset[int] = frozenset(), kept: frozenset[int] = frozenset(), priors: bool = True) -> list[str]:
    """The page's blocks of text without its low branches: a new block starts and ends with every element that is not inline, white space becomes one space.

    gone: style nodes of low importance. kept: those that stay against a weak prior. Without ``priors`` only gone counts.
    """
    found = events(page)
    around = _around_main(found) if priors else None
    _priors(found)
    parts: list[list[str]] = [[]]
    open_: list[int] = []
    away = 0  # how many elements were open where the removed branch starts, with it
    for i, x in enumerate(found):
        if isinstance(x, Node):
            open_.append(i)
            if not away and ((removable(x) and x.path in gone) or (priors and (x.prior == STRONG or (x.prior != STAYS and x.path not in kept)))):
                away = len(open_)
            if not away and x.tag not in INLINE:
                parts.append([])
        elif x is None:
            tag = found[open_.pop()].tag
            if away > len(open_):
                away = 0
                parts.append([])
            elif not away and tag not in INLINE:
                parts.append([])
        elif not away and (around is None or (open_ and open_[-1] not in around)):
            parts[-1].append(x)
    return [t for t in (" ".join("".join(p).split()) for p in parts) if t]


ROWS = [("host", pa.int64()), ("path", pa.int64()), ("kind", pa.int32()), ("sig", pa.int64()), ("page", pa.int64()), ("words", pa.int64()), ("flags", pa.int32()), ("up", pa.list_(pa.int64()))]
REMOVABLE, INSIDE, WEAKLY = 1, 2, 4


def style_rows(page: str) -> list[tuple]:
    """What a page shows of each of its style nodes: (path, kind, sig, page, words, flags, up).

    kind 0: the set of child layouts of the node's elements, its flags and the nodes it stands in, from the nearest to the root;
    kind 1: a text that stands in it, and how many words it has. One row for each different one.
    """
    found = events(page)
    _priors(found)
    layouts: dict[int, set[int]] = defaultdict(set)
    flags: dict[int, int] = {}
    above: dict[int, int] = {}
    texts: dict[tuple[int, int], int] = {}
    open_: list[tuple[Node, list[str]]] = []
    whole: list[int] = []
    for x in found:
        if isinstance(x, Node):
            if open_:
                open_[-1][1].append(x.step)
            open_.append((x, []))
            above[x.path] = x.above
            flags[x.path] = flags.get(x.path, 0) | REMOVABLE * removable(x) | INSIDE * x.inside | WEAKLY * (x.prior in (WEAK, LIKELY))
        elif x is None:
            node, steps = open_.pop()
            layouts[node.path].add(_key(" ".join(steps)))
        elif open_ and (words := x.split()):
            node, steps = open_[-1]
            steps.append("#")
            sig = _key(" ".join(words))
            texts[node.path, sig] = len(words)
            whole.append(sig)
    page_sig = _key(" ".join(map(str, whole)))
    rows = []
    for path, seen in layouts.items():
        up, at = [], above[path]
        while at in above:
            up.append(at)
            at = above[at]
        rows.append((path, 0, _key(" ".join(map(str, sorted(seen)))), page_sig, 0, flags[path], up))
    return rows + [(path, 1, sig, page_sig, words, 0, []) for (path, sig), words in texts.items()]


def importance(pages: DataFrame, gamma: float = GAMMA, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path, flags, n_pages, presentation, content, importance) of the style nodes on least_pages distinct pages of a host or more.

    pages: host (a hash), html. Pages of a host with the same texts count once. A branch has at most MAX_DEPTH nodes above it, so
    its words are summed up the tree without rounds. Only hashes are shuffled, and counts of them are summed before every
    shuffle, by keys that are single texts, style nodes or their parents: a hot host is spread over all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [(h, *r) for h, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in style_rows(page)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows, strict=True)) or [()] * len(ROWS), ROWS, strict=True)], [n for n, _ in ROWS])

    seen = pages.select("host", "html").mapInArrow(run, "host long, path long, kind int, sig long, page long, words long, flags int, up array<long>").distinct()
    counted = seen.groupBy("host", "path", "kind", "sig").agg(F.count("*").alias("n"), F.max("words").alias("words"), F.bit_or("flags").alias("flags"), F.max("up").alias("up"))
    layout, text = F.col("kind") == 0, F.col("kind") == 1
    node = counted.groupBy("host", "path").agg(
        F.sum(F.when(layout, F.col("n"))).alias("m"), F.sum(F.when(layout, F.col("n") * F.log("n"))).alias("layouts"),
        F.sum(F.when(text, F.col("n") * F.col("words"))).alias("mass"), F.sum(F.when(text, F.col("n") * F.col("words") * F.log("n"))).alias("shared"),
        F.bit_or("flags").alias("flags"), F.max("up").alias("up"),
    )
    base = F.when(F.col("m") > 1, F.log("m")).otherwise(1.0)
    presentation = F.when(F.col("m") > 1, F.greatest((base - F.col("layouts") / F.col("m")) / base, F.lit(0.0))).otherwise(1.0)
    mass = F.coalesce("mass", F.lit(0)).cast("double")
    novel = F.greatest(mass - F.coalesce("shared", F.lit(0.0)) / base, F.lit(0.0))
    node = node.select("host", "path", "m", "flags", presentation.alias("presentation"), mass.alias("mass"), novel.alias("novel"), "up")
    # Each node's own row, and its words once more for every node above it.
    none = F.lit(None)
    own = F.struct(F.col("path").alias("path"), F.get("up", 0).alias("parent"), F.col("m").alias("m"), F.col("flags").alias("flags"), F.col("presentation").alias("presentation"))
    higher = F.transform("up", lambda p: F.struct(p.alias("path"), none.cast("long").alias("parent"), none.cast("long").alias("m"), none.cast("int").alias("flags"), none.cast("double").alias("presentation")))
    spread = node.select("host", "mass", "novel", F.explode(F.concat(F.array(own), higher)).alias("at")).select("host", "at.*", "mass", "novel")
    branch = spread.groupBy("host", "path").agg(*[F.max(c).alias(c) for c in ("parent", "m", "flags", "presentation")], F.sum("mass").alias("mass"), F.sum("novel").alias("novel"))
    branch = branch.where(F.col("m") >= least_pages).withColumn("a_page", F.col("novel") / F.col("m")).withColumn("parent", F.coalesce("parent", F.lit(0)))
    most = branch.groupBy("host", "parent").agg(F.max("a_page").alias("most"))
    share = F.coalesce(F.try_divide(F.col("a_page"), F.col("most")), F.lit(0.0))
    ratio = F.coalesce(F.try_divide(F.col("novel"), F.col("mass")), F.lit(0.0))
    content = F.when(F.col("flags").bitwiseAND(F.lit(INSIDE)) != 0, ratio).otherwise(share)
    out = branch.join(most, ["host", "parent"]).withColumn("content", content)
    return out.select("host", "path", "flags", F.col("m").alias("n_pages"), "presentation", "content", ((1 - gamma) * F.col("presentation") + gamma * F.col("content")).alias("importance"))


def verdicts(pages: DataFrame, least: float = LEAST_IMPORTANCE, doubt: float = DOUBT, least_pages: int = LEAST_PAGES, gamma: float = GAMMA) -> DataFrame:
    """(host, path, gone): gone is true for removable nodes of low importance, false for weakly judged ones that stay."""
    seen, flag = importance(pages, gamma, least_pages), F.col("flags")
    low = (flag.bitwiseAND(F.lit(REMOVABLE)) != 0) & (F.col("importance") < least)
    stays = (flag.bitwiseAND(F.lit(WEAKLY)) != 0) & (F.col("importance") >= doubt)
    return seen.where(low | stays).select("host", "path", low.alias("gone"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES, priors: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of df; null html counts as empty and gives an empty text, a null url has host ''.

    Repeated rows each get a row. On hosts with fewer than ``least_pages`` distinct pages the priors alone decide;
    without ``priors`` the counts alone do.
    """
    own = pick(df, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long")).withColumn("html", F.coalesce("html", F.lit("")))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))
    pages = own.withColumn("host", F.xxhash64(host))
    found = checkpointed(verdicts(pages, least, max(DOUBT, least), least_pages))
    few = found.count() <= MAX_BROADCAST
    keys = ["host"] if few else ["host", "salt"]
    if not few:  # a host's pages are dealt over SALTS tasks, its verdicts copied to each
        pages = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    by_host = found.groupBy(*keys).agg(F.collect_list(F.when(F.col("gone"), F.col("path"))).alias("low"), F.collect_list(F.when(~F.col("gone"), F.col("path"))).alias("kept"))
    joined = pages.join(F.broadcast(by_host) if few else by_host, keys, "left").select("page_id", "url", "html", "low", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(main_blocks(page, frozenset(low or ()), frozenset(kept or ()), priors)) for page, low, kept in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
