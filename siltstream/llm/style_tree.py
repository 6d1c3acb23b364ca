"""Main text of web pages by site style trees (operator 10)."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.llm.shared import saved, sent_if_small

#: Branches below this importance (0 to 1) are noise.
IMPORTANT = 0.4
#: Pages of all hosts that weigh as much as so many pages of the host itself.
PRIOR_PAGES = 50
#: Pages as whose finding the marks of an article weigh: 1 inside, 0 outside of it.
MARK_PAGES = 25
#: Share of a branch's importance that its presentation has; its content has the rest.
PRESENTATION = 0.1
#: Features a task holds before it passes their counts on.
MOST_FEATURES = 100_000

# Element names and words of class, id and role, in natural order.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre"
    " search section select summary table tbody td tfoot th thead tr ul button label".split()
)
NOISE = frozenset("head nav footer aside form menu button select dialog label fieldset search option svg canvas audio video object template".split())
MAIN = frozenset(["article", "main"])
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
LISTS = frozenset("ul ol dl table tbody thead tfoot select article section div body main".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments"
    " complementary contentinfo cookie cookies consent dialog disqus footer gdpr masthead menu modal nav navbar"
    " navigation newsletter notice notices overlay pagination pager popup promo promoted promotion recommended"
    " sidebar sidebars signup skip sponsor sponsored subscribe topbar".split()
)
#: These say noise only if no word of MAIN_WORDS stands beside them.
WEAK_WORDS = frozenset("alert form forms login related search share sharing social tags toolbar widget".split())
MAIN_WORDS = frozenset("article body content entry main post story text".split())
#: A class that begins so tells of something else on the page.
ELSEWHERE = frozenset("has no with without is not".split())

#: Words that, joined to a word of noise in one class, leave it noise inside an article.
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box button buttons card col container content element footer form frame group head"
    " header inline inner item items label left link links list message module outer panel position right row section"
    " slot space text title top unit widget wrap wrapper zone".split()
)
#: Words of lines about the site. Inside an article a line of many pages goes only at the
#: article's edge and with one of these.
NOTICE_WORDS = frozenset(
    "account advertisement advertising all app bookmark click comment comments contact cookie cookies copyright"
    " download facebook follow licence license licensed linkedin login newsletter permission pinterest policy"
    " powered print privacy reddit register reserved rights rss share shares sign site sponsored subscribe"
    " subscription terms tweet twitter website whatsapp".split()
)
HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Characters of a path; what is nested deeper has a path of its own under a hash of this one.
MOST_PATH = 1024

TAG = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass(slots=True)
class Mark:
    """A word that says an element is noise. It counts until the article is found below, and
    beside a word of MAIN_WORDS only if no block is below at all; else the tree decides."""

    beside: bool
    lifted: bool = False


@dataclass(slots=True)
class Article:
    """An article or main part of a page, the marks of noise on it and around it, and
    whether it holds text. Those with the fewest marks are the page's own, others are
    comments or teasers."""

    marks: list[Mark]
    text: bool = False


@dataclass(slots=True)
class Node:
    """An open element: its style path, whether it lies in noise by its kind or in the marked
    article, and the marks on it and above."""

    tag: str
    path: str
    noise: bool
    main: bool
    children: list[str]
    marks: tuple[Mark, ...] = ()
    article: Article | None = None


def marked(tag: str, attributes: str, inside: bool = False) -> tuple[str, bool, bool, Mark | None]:
    """The name of an element in a path, whether it is hidden, whether it is the main part of
    the page, and the mark of a word of noise, if no name beside it is one of the article.
    ``inside`` an article a word of noise in a compound such as notice-period says nothing,
    unless the other words are of layout."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag, False, tag in MAIN, None
    name, noise, main, mark = tag, False, tag in MAIN, None
    said: set[str] = set()
    plain = False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            main |= key == "role" and value in MAIN
            words: set[str] = set()
            for part in value.split():
                found = WORDS.findall(part)
                other = not (NOISE_WORDS | WEAK_WORDS | MAIN_WORDS | LAYOUT_WORDS).issuperset(found)
                if found and found[0] not in ELSEWHERE and not (inside and len(found) > 1 and other):
                    words.update(found)
                    plain |= MAIN_WORDS.issuperset(found)
            if words & NOISE_WORDS or words & WEAK_WORDS and not (main or words & MAIN_WORDS):
                mark = Mark(False)
            said |= words
            if key == "class" and value:
                name = f"{tag}.{'.'.join(sorted(value.split()))}".replace("/", "|")
                if len(name) > 80:
                    name = f"{name[:60]}#{xxhash.xxh64_hexdigest(name.encode('utf-8', 'replace'))}"
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            noise = True
        elif key == "style" and HIDDEN.search(value):
            noise = True
    if mark:
        mark = None if plain else Mark(bool(said & MAIN_WORDS))
    # What a role marks is not merged with bare elements of the same name.
    return name + "[main]" * (main and tag not in MAIN), noise, main, mark


def walk(page: str) -> tuple[list[tuple[str, str, bool, bool]], Counter]:
    """The text blocks of a page in order, as ``(path, text, noise, main)``, and how often
    an element of each path has each sequence of children (its presentation).

    Tags are read as browsers do in the main: elements may lack their end, a paragraph ends
    where a block begins, what script and style hold is not markup, and an unfinished tag or
    comment at the end of a page is dropped.
    """
    stack = [Node("", "", False, False, [])]
    blocks: list[tuple[str, str, Node]] = []
    styles: Counter = Counter()
    text: list[str] = []
    articles: list[Article] = []

    def end_block() -> None:
        if text:
            joined = "".join(text)
            text.clear()
            joined = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if joined:
                top = stack[-1]
                blocks.append((top.path, joined, top))
                if top.article:
                    top.article.text = True

    def pop(count: int) -> None:
        for _ in range(count):
            node = stack.pop()
            if node.children:
                styles[node.path, " ".join(node.children)] += 1

    def depth_of(tags: frozenset, stops: frozenset = frozenset()) -> int:
        """How many elements down to the innermost of ``tags`` are open; 0 for none."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return len(stack) - k
            if stack[k].tag in stops:
                return 0
        return 0

    at, end = 0, len(page)
    while at < end:
        found = TAG.search(page, at)
        if not found:
            text.append(page[at:])
            break
        if found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        if not found[1]:
            continue
        tag, closing = found[1].lower(), page[found.start() + 1] == "/"
        if page[at - 1] != ">":
            break
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        if closing:
            depth = depth_of(frozenset([tag]))
            if depth:
                # An inline element that was set apart for its marks ends its block too.
                end_block()
                pop(depth)
            elif tag == "p":
                end_block()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = close.start() if close else end
            stop = page.find(">", at) if close else -1
            at = stop + 1 if stop >= 0 else end
            continue
        name, noise, is_main, mark = marked(tag, found[2], stack[-1].main)
        if tag not in BLOCKS and not noise and not mark and tag not in NOISE:
            continue  # inline markup
        if tag in EMPTY or found[2].endswith("/") and tag not in BLOCKS:
            if tag in BLOCKS:
                end_block()
            continue
        if tag in BLOCKS:
            end_block()
            if tag in CLOSES:
                pop(depth_of(CLOSES[tag], LISTS if tag != "tr" else LISTS - {"tbody", "thead", "tfoot"}))
            elif depth_of(frozenset("p"), LISTS):
                pop(depth_of(frozenset("p"), LISTS))
        else:
            end_block()
        top = stack[-1]
        top.children.append(name)
        outside = tag == "header" and not top.main
        noise = top.noise or noise and tag != "body" or tag in NOISE or outside
        main = (top.main or is_main) and not noise
        nested = is_main and any(node.tag == "article" for node in stack)
        article = top.article
        for above in top.marks:
            above.lifted |= above.beside and tag in BLOCKS
        # The element that holds the whole page is not noise by a word.
        own = (*top.marks, mark) if mark and tag not in ("html", "body") else top.marks
        if is_main and not nested and not (top.main and mark):
            article = Article(list(own))
            articles.append(article)
        path = top.path
        if len(path) > MOST_PATH:
            path = f"~{xxhash.xxh64_hexdigest(path.encode('utf-8', 'replace'))}"
        stack.append(Node(tag, f"{path}/{name}", noise, main, [], own, article))
    end_block()
    pop(len(stack))
    told = [article.marks for article in articles if article.text]
    for marks in told:
        if len(marks) == min(map(len, told)):
            for mark in marks:
                mark.lifted = True
    out = []
    for path, joined, node in blocks:
        noise = node.noise or not all(mark.lifted for mark in node.marks)
        out.append((path, joined, noise, node.main and not noise))
    return out, styles


def hostname(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """``(host, hash, copies, all_copies)``: how many pages of a host and of all hosts have
    the same payload."""
    rows = pages.select(hostname(F.col("url")).alias("host"), payload_hash().alias("hash"))
    found = saved(rows.groupBy("host", "hash").agg(F.count("*").alias("copies")), "payloads")
    whole = saved(found.groupBy("hash").agg(F.sum("copies").alias("all_copies")), "all_payloads")
    return saved(found.join(whole, "hash").select("host", "hash", "copies", "all_copies"), "copies")


def payload_hash() -> Column:
    return F.xxhash64(F.coalesce("html", F.lit("")))


def features(pages: DataFrame, distinct: DataFrame) -> DataFrame:
    """``(host, path, kind, feature, n, all_n, inside, outside)``: how often an element of the
    path has a content (kind 0: :func:`content_hash`) or a presentation (kind 1: the hash of
    its children), and how many contents are inside and outside of a marked article. Equal pages of a host count once in ``n``, those of all hosts once in
    ``all_n``: each of c copies counts 1 / c. Counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        all_counts: Counter = Counter()
        inside: Counter = Counter()
        outside: Counter = Counter()

        def flush() -> pa.RecordBatch:
            host, path, kind, feature = zip(*counts) if counts else ([], [], [], [])
            out = {"host": pa.array(host, pa.string()), "path": pa.array(path, pa.string())}
            out |= {"kind": pa.array(kind, pa.int32()), "feature": pa.array(feature, pa.int64())}
            out |= {"n": pa.array(counts.values(), pa.float64())}
            out |= {"all_n": pa.array([all_counts[key] for key in counts], pa.float64())}
            out |= {"inside": pa.array([float(inside[key]) for key in counts], pa.float64())}
            out |= {"outside": pa.array([float(outside[key]) for key in counts], pa.float64())}
            for kept in (counts, all_counts, inside, outside):
                kept.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            shares = [(1 / (c or 1), 1 / (a or 1)) for c, a in zip(*(batch.column(k).to_pylist() for k in (2, 3)))]
            for host, page, (share, all_share) in zip(batch.column(0), batch.column(1), shares):
                host, (blocks, styles) = host.as_py(), walk(page.as_py() or "")
                # A content counts once in a page, a presentation for each element.
                marked_article = any(main for _, _, noise, main in blocks if not noise)
                for (path, text), main in {(path, text): main for path, text, _, main in blocks}.items():
                    key = host, path, 0, content_hash(path, text)
                    counts[key] += share
                    all_counts[key] += all_share
                    if marked_article:
                        (inside if main else outside)[key] += share
                for (path, children), n in styles.items():
                    counts[host, path, 1, signed(children)] += n * share
                    all_counts[host, path, 1, signed(children)] += n * all_share
                if len(counts) > MOST_FEATURES:
                    yield flush()
        yield flush()

    rows = pages.select(hostname(F.col("url")).alias("host"), "html", payload_hash().alias("hash"))
    # The pages themselves move only if the copied payloads are too many to be sent.
    several = saved(distinct.where("all_copies > 1"), "several")
    several = sent_if_small(several, F.length("host") + 24)
    rows = rows.join(several, ["host", "hash"], "left").select("host", "html", "copies", "all_copies")
    found = rows.mapInArrow(run, "host string, path string, kind int, feature long, n double, all_n double, inside double, outside double")
    # Shares of copies add up to whole numbers, but for the last digits.
    return found.groupBy("host", "path", "kind", "feature").agg(
        F.round(F.sum("n"), 6).alias("n"), *[F.sum(c).alias(c) for c in ("all_n", "inside", "outside")]
    )


def content_hash(path: str, text: str) -> int:
    """Names a content where it stands."""
    return signed(f"{path}\n{text}")


def signed(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


def noise_branches(pages: DataFrame, important: float = IMPORTANT, prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """``(host, branches)``: the paths of each host's style tree that are of low importance
    with all paths below, and the :func:`content_hash` of single contents that are.

    The importance of a content that d of m pages have at a path falls with its entropy,
    log d over log m, and a path's is the mean over what stands there and below. A
    presentation's is the entropy of the sequences of children, for menus and frames look the
    same everywhere. Copies of a page count once, so that they neither lower the importance
    of their article nor raise m. The tree of all hosts together stands in for hosts of few pages. The
    marks of an article are a prior: they weigh as :data:`MARK_PAGES` pages that find what is
    inside important and what is outside not, so on hosts of many pages the tree decides.
    """
    distinct = distinct_pages(pages)
    found = saved(features(pages, distinct), "features")
    sizes = distinct.groupBy("host").agg(F.count("*").alias("m"))
    marks = [F.sum(c).alias(c) for c in ("inside", "outside")]
    whole = found.groupBy("path", "kind", "feature").agg(F.round(F.sum("all_n"), 6).alias("n"), *marks)

    def sums(rows: DataFrame, *keys: str) -> DataFrame:
        """Total and n log n of a path, contents with those of all paths below."""
        steps = F.when(F.col("kind") == 0, F.sequence(F.lit(2), F.size("parts"))).otherwise(F.array(F.size("parts")))
        part = rows.groupBy(*keys, "path", "kind").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.log("n")).alias("l"), *marks)
        part = part.withColumn("parts", F.split("path", "/")).where(F.size("parts") > 1)
        part = part.withColumn("step", F.explode(steps))
        part = part.withColumn("path", F.array_join(F.slice("parts", F.lit(1), F.col("step")), "/"))
        return part.groupBy(*keys, "path", "kind").agg(F.sum("s").alias("s"), F.sum("l").alias("l"), *marks)

    def importance(rows: DataFrame, m: Column, *keys: str) -> DataFrame:
        """Both kinds side by side; 1 where a single page says nothing."""
        mean = F.when(F.col("s") > 0, F.col("l") / F.col("s")).otherwise(0.0)
        content = 1 - mean / F.log(m)
        style = F.least(F.lit(1.0), (F.log("s") - mean) / F.log(m))
        value = F.when(m <= 1, 1.0).when(F.col("kind") == 0, content).otherwise(style)
        both = rows.withColumn("value", value).groupBy(*keys, "path").agg(
            F.max(F.when(F.col("kind") == 0, F.col("value"))).alias("content"),
            F.max(F.when(F.col("kind") == 1, F.col("value"))).alias("style"),
            *marks,
        )
        mixed = F.coalesce("content", F.lit(1.0)) * (1 - PRESENTATION) + PRESENTATION * F.coalesce("style", "content", F.lit(1.0))
        return both.where("content is not null").select(*keys, "path", mixed.alias("value"), "inside", "outside")

    # Pages that several hosts have are one here.
    pages_of_all = distinct.agg(F.round(F.sum(F.col("copies") / F.col("all_copies"))).alias("all_m"))
    own = sums(found, "host").join(sizes, "host")
    own = importance(own, F.col("m").cast("double"), "host", "m")
    other = sums(whole).crossJoin(F.broadcast(pages_of_all))  # a single number
    other = importance(other, F.col("all_m").cast("double"), "all_m").withColumnRenamed("value", "other")

    def blended(m: Column, all_m: Column) -> Column:
        weight = F.least(F.lit(prior_pages), all_m)
        marks = F.col("inside") + F.col("outside")
        mark = F.when(marks > 0, F.lit(MARK_PAGES)).otherwise(0)
        inside = F.when(marks > 0, F.col("inside") / marks).otherwise(0.0)
        return (m * F.col("value") + weight * F.col("other") + mark * inside) / (m + weight + mark)

    both = own.join(other.drop("inside", "outside"), "path").withColumn("value", blended(F.col("m"), F.col("all_m")))
    # A path with an important one below it is not noise as a whole.
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    best = both.select("host", "value", F.explode(above).alias("branch")).groupBy("host", "branch")
    low = best.agg(F.max("value").alias("value")).where(F.col("value") < important).select("host", "branch")

    # A content that many pages have at a path is a leaf of its own, whatever else is there.
    many = whole.where("kind = 0 and n > 1").select("path", "feature", F.col("n").alias("all_n"))
    leaves = found.where("kind = 0").drop("all_n").join(many, ["path", "feature"]).join(sizes, "host").crossJoin(F.broadcast(pages_of_all))

    def single(n: str, m: str) -> Column:
        return F.when(F.col(m) <= 1, 1.0).otherwise(1 - F.log(n) / F.log(F.col(m).cast("double")))

    leaves = leaves.withColumn("value", single("n", "m")).withColumn("other", single("all_n", "all_m"))
    leaves = leaves.where(blended(F.col("m"), F.col("all_m")) < important)
    low = low.union(leaves.select("host", F.col("feature").cast("string")))
    return saved(low.groupBy("host").agg(F.collect_set("branch").alias("branches")), "branches")


def main_text(page: str, branches: frozenset[str], decided: bool = False) -> str:
    """The text blocks of a page that are in no low branch, no low content and in no marked
    noise, joined by line breaks.

    Inside the marked article a heading stays if text under it does, and of single contents
    of low importance only notices at its edges go: lines that many pages share are part of
    their articles otherwise.

    Without a tree that has ``decided`` on them, blocks outside the marked article of a page
    that has one with text are left out.
    """
    low: dict[str, bool] = {}

    def in_low(path: str) -> bool:
        if path not in low:
            parts = path.split("/")
            low[path] = any("/".join(parts[:k]) in branches for k in range(2, len(parts) + 1))
        return low[path]

    blocks = [(path, text, main) for path, text, noise, main in walk(page)[0] if not noise]
    branch = [bool(branches) and in_low(path) for path, _, _ in blocks]
    single = [bool(branches) and str(content_hash(path, text)) in branches for path, text, _ in blocks]
    article = [k for k, (_, _, main) in enumerate(blocks) if main]
    keep = [not (b or s) for b, s in zip(branch, single)]
    # Inside the article a line that many pages have goes from its edges, if it is a notice.
    for k in article:
        keep[k] = not branch[k]
    for side in (article, article[::-1]):
        for k in side:
            if keep[k] and not (single[k] and not NOTICE_WORDS.isdisjoint(WORDS.findall(blocks[k][1].lower()))):
                break
            keep[k] = False
    # A heading of the article is as important as what it stands over.
    over: list[int] = []
    for k in article:
        level = HEADINGS.get(blocks[k][0].rpartition("/")[2].partition(".")[0])
        if level:
            over = [h for h in over if HEADINGS[blocks[h][0].rpartition("/")[2].partition(".")[0]] < level] + [k]
        elif keep[k]:
            for h in over:
                keep[h] = True
            over = []
    if not decided and any(keep[k] for k in article):
        keep = [kept and main for kept, (_, _, main) in zip(keep, blocks)]
    return "\n".join(text for (_, text, _), kept in zip(blocks, keep) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    The pages of each host are merged in a style tree, whose branches of low importance are
    noise (:func:`noise_branches`), inside a marked article and outside of it; marks such as
    nav, aside, form or class="ad" say so directly. Inside a block, white space becomes one space; blocks are joined by one line
    break; character references are decoded. Nothing else is dropped or cut.

    A null or empty page has an empty text. Pages without a host share the tree of the empty
    host. Repeated rows and copies of a page keep a row each and count once in the tree. Null ids and URLs stay
    null. An empty table gives no rows; other columns are not read.
    """
    branches = F.aggregate("branches", F.lit(0), lambda total, branch: total + F.length(branch))
    noise = sent_if_small(noise_branches(pages), branches).withColumnRenamed("host", "_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts, sets = [], {}
                for page, branches in zip(part.column(2), part.column(3).to_pylist()):
                    key = tuple(branches or ())
                    if key not in sets:
                        sets[key] = frozenset(key)
                    texts.append(main_text(page.as_py() or "", sets[key], decided=True))
                sizes = pa.array([len(text) for text in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), sizes],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select("page_id", "url", "html", hostname(F.col("url")).alias("_host"))
    rows = rows.join(noise, "_host", "left").select("page_id", "url", "html", "branches")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
