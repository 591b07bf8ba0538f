"""Main text of web pages by paths that the pages of a host agree on.

Each page's containers are scored: the share of the page's clean text that they hold
outside links, times the clean share of their own text, with a bonus for names that mark
an article. A container is named by its path of tags and classes from the body down, with
digits in classes generalised, so that pages of one template agree. Scores are averaged by
host and path over the pages that vote for it (each votes for its best few containers), so
that an ancestor does not win by being in every template. Every page is read again with
the first of its host's paths that holds text there: at least one part in ``LEAST`` of what
the page's own best container holds, so a teaser that happens to have the path does not
stand for the article, and a path after the first not if it merely lies around that
container. A page without such a path, or without a host, is read by its own best container.

What is clean: tags for menus, headers, footers, sidebars, forms, scripts and styles, and
hidden elements, are not, but for two that an article may have as its own: its header, if
that holds a heading or a paragraph, and an aside that has a paragraph and no link and
stands between the article's paragraphs. A block whose names (class, id, role) hold a word
for such things, for adverts, notices or reader comments is not clean either, except where
its text says otherwise: an element that holds most of the page's text is not taken out by
a word of its names, and inside an article a word that may as well name a part of the text
(``DOUBTFUL``, or any next to words of other kinds, as in share-prices) takes out a block
only if links are most of it or it has no paragraph. Paragraphs, headings and inline
elements are taken out only by a class that is such a word as a whole. Formulas are text.

White space inside a block becomes one space, blocks are joined by one space in page
order; ``br`` counts as white space and other inline tags as nothing.

Cases: null or empty html gives an empty text. Broken markup (tags that are not closed,
not opened, or cut at the end) is read as far as it goes, in time and memory that grow with
the page, whatever its depth. Rows with equal ids are separate pages; each votes. An empty
table gives an empty result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterlens.llm.shared import Scratch, with_each

VOTES = 4
PATHS = 3
#: A path that fewer pages than one in so many of the host's most common path vote for is left to those pages.
SUPPORT = 20
#: A host's path is used on a page where it holds at least one part in so many of what the page's best container holds.
LEAST = 10
#: Paths of up to so many hosts are broadcast whole (some 100 bytes each).
BROADCAST_ROWS = 100_000
#: Deeper paths are named by their hash.
SPELLED_DEPTH = 40

# Tags of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg annotation annotation-xml".split())
DROP = frozenset("head script style noscript template nav footer header aside form iframe svg annotation annotation-xml button select textarea input object embed applet canvas audio video dialog menu title xmp noembed noframes option datalist fieldset".split())
CONTAINERS = frozenset("body div article section main td center blockquote".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPES = frozenset("table ul ol dl td th body article section main div aside nav footer header form".split())
# Words of class, id and role names that mark what is not main text.
NOISE = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense banner promo promotion promoted sponsor sponsored sponsors sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion "
    "widget widgets toolbar pagination pager skip search contentinfo complementary dialog disclaimer".split()
)
GOOD = frozenset("article content entry main post story text body page".split())
#: Words that may also name a part of an article.
DOUBTFUL = frozenset("discussion related notice notices alert social head header foot footer promo promotion social widget widgets side search disclaimer recommended recommendations respond reply replies".split())
KEEP_TAGS = frozenset("html body main article".split())
#: Elements of running text; only a whole class takes them out.
TEXT_TAGS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody figcaption caption".split())
#: Words that say what kind of block a name's other words make, and of what: next to these a noise word is one.
FRAME = GOOD | frozenset("area author avatar bar block body bottom box button buttons card cell code column container content count embed field fixed form grid group holder icon icons image img info inner inline item items label left link links list load meta more name new number outer panel picks policy popup post posts right row section slot sticky tab tabs tags text thread title toggle top unit user view wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A name with one of these says what a page has or lacks, not what the element is.
NEUTRAL = frozenset("no not non has have with without".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>?|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
#: Attributes that are looked at; others are read past, with their values.
READ = frozenset("class id role hidden aria-hidden style".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower().removeprefix("www.") if found else ""


def _named(above: int, name: str, classes: str) -> int:
    """The key of a path, from that of the path above."""
    return int.from_bytes(blake2b(f"{above}>{name}.{classes}".encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


class Page:
    """Elements of a page, with clean text by element, in one pass over the markup."""

    def __init__(self, source: str):
        # of every element: tag, its classes, parent, depth, key of its path, noise (itself or above), bonus, noise by tag, noise words in its names, whether those are doubtful
        self.tag, self.classes, self.parent, self.depth, self.key = ["#"], [""], [-1], [0], [0]
        self.noisy, self.bonus, self.hard, self.words, self.doubt, self.inside, self.aside = [False], [0], [False], [0], [False], [False], [False]
        self.pieces: list[tuple[int, int, str]] = []  # element, block, text
        self._read(source)
        if any(self.words):
            self._weigh_doubt()
            self._clear_wrappers()

    def _open(self, name: str, raw: str, above: int) -> int:
        words: list[str] = []
        marks: set[str] = set()
        sure: set[str] = set()
        classes, hidden, whole = "", False, name in TEXT_TAGS
        if len(raw) > len(name) + 2:
            for key, value in _ATTR.findall(raw, len(name) + 1):
                key = key.lower()
                if key not in READ:
                    continue
                value = value.strip("\"'").lower()
                if key == "class":
                    classes = ".".join(sorted(_DIGITS.sub("N", value).split()))
                if key in ("class", "id", "role"):
                    for token in value.split():
                        part = [x for x in _SPLIT.split(token) if x]
                        words += part
                        found = NOISE.intersection([token] if whole else part)
                        if found and (key == "class" if whole else NEUTRAL.isdisjoint(part)):
                            marks |= found
                            # next to a word of another kind a noise word may be the subject of a text
                            if all(x in NOISE or x in FRAME or x.isdigit() for x in part):
                                sure |= found
                hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "")
        story = name == "header" and self.inside[above]
        if name == "aside" and self.inside[above] and not marks:
            story, sure = True, {name}  # settled by its place
        count = 0 if name in KEEP_TAGS else len(marks) + story
        self.words.append(count)
        self.doubt.append(count > 0 and sure <= DOUBTFUL and self.inside[above])
        self.aside.append(name == "aside" and story)
        self.hard.append(self.hard[above] or name in DROP and not story or hidden)
        self.noisy.append(self.noisy[above] or self.hard[-1] or count > 0)
        self.tag.append(name)
        self.classes.append(classes)
        self.parent.append(above)
        named = name not in ("html", "#")
        self.depth.append(self.depth[above] + named)
        self.key.append(_named(self.key[above], name, classes) if named else self.key[above])
        self.bonus.append(2 if name in ("article", "main") else 1 if not whole and not GOOD.isdisjoint(words) else 0)
        self.inside.append(self.inside[above] or name in ("article", "main"))
        return len(self.tag) - 1

    def path(self, e: int) -> str:
        """The path of an element, spelled out; of one that is very deep, its key."""
        if self.depth[e] > SPELLED_DEPTH:
            return f"#{self.key[e]}"
        out = []
        while e > 0:
            if self.tag[e] != "html":
                out.append(f">{self.tag[e]}{'.' if self.classes[e] else ''}{self.classes[e]}")
            e = self.parent[e]
        return "".join(reversed(out))

    def _read(self, source: str) -> None:
        open_, at, block = [0], 0, 0
        self._count: dict[str, int] = defaultdict(int)  # open elements by tag
        while True:
            found = _TOKEN.search(source, at)
            end = found.start() if found else len(source)
            if end > at:
                self.pieces.append((open_[-1], block, source[at:end]))
            if not found:
                return
            raw, at = found[0], found.end()
            if raw == "<":
                self.pieces.append((open_[-1], block, "<"))
                continue
            if raw[1] in "!?":
                continue
            name = _NAME.match(raw)[1].lower()
            if raw[1] == "/":
                if name not in INLINE:
                    block += 1
                for k in range(len(open_) - 1, 0, -1) if self._count[name] else ():
                    if self.tag[open_[k]] == name:
                        self._shut(open_, k)
                        break
                    if name in INLINE and self.tag[open_[k]] not in INLINE or name in ("p", "li") and self.tag[open_[k]] in SCOPES:
                        break
                continue
            if name == "br":
                self.pieces.append((open_[-1], block, " "))
                continue
            if name not in INLINE:
                block += 1
            if name in VOID:
                continue
            if name in CLOSES_P:
                self._close(open_, {"p"})
            if name in CLOSED_BY:
                self._close(open_, CLOSED_BY[name])
            element = self._open(name, raw, open_[-1])
            if name in RAW and not raw.endswith("/>"):
                shut = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                at = shut.end() if shut else len(source)
                if name not in INLINE:
                    block += 1
            elif not raw.endswith("/>"):
                open_.append(element)
                self._count[name] += 1

    def _shut(self, open_: list[int], k: int) -> None:
        for e in open_[k:]:
            self._count[self.tag[e]] -= 1
        del open_[k:]

    def _close(self, open_: list[int], names: set[str]) -> None:
        if not any(self._count[n] for n in names):
            return
        for k in range(len(open_) - 1, 0, -1):
            tag = self.tag[open_[k]]
            if tag in names:
                self._shut(open_, k)
                return
            if tag in SCOPES:
                return

    def _sizes(self, left_out: list[bool]) -> list[int]:
        """Characters below each element, without those of elements left out."""
        out = [0] * len(self.tag)
        for e, _, text in self.pieces:
            if not left_out[e]:
                out[e] += len(text) - text.count(" ")
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def _mark(self) -> None:
        for x in range(1, len(self.tag)):
            self.noisy[x] = self.noisy[self.parent[x]] or self.hard[x] or self.words[x] > 0

    def _weigh_doubt(self) -> None:
        """Blocks of an article whose names or tags leave it open are text if they hold prose and links are not most of it.

        Prose is a paragraph, or, of a header, a heading. An aside must have no link at all
        and stand between paragraphs of its article's own.
        """
        if not any(self.doubt) and not any(self.aside):
            return
        n = len(self.tag)
        every, linked, prose, headed = [0] * n, [0] * n, [False] * n, [False] * n
        in_link, aside = [False] * n, [False] * n
        for e in range(1, n):
            up = self.parent[e]
            in_link[e] = in_link[up] or self.tag[e] == "a"
            aside[e] = aside[up] or self.aside[e]
        for e, _, text in self.pieces:
            if not self.hard[e]:
                size = len(text) - text.count(" ")
                every[e] += size
                linked[e] += size * in_link[e]
        ends = list(range(n))  # the last element inside each
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            every[up] += every[e]
            linked[up] += linked[e]
            prose[up] |= prose[e] or self.tag[e] == "p"
            headed[up] |= headed[e] or self.tag[e] in HEADINGS
            ends[up] = max(ends[up], ends[e])
        own = [e for e in range(1, n) if self.tag[e] == "p" and self.inside[e] and not aside[e] and not self.hard[e] and every[e]]
        for e in range(1, n):
            if self.aside[e]:
                between = own and own[0] < e and any(p > ends[e] for p in own)
                if between and prose[e] and not linked[e]:
                    self.words[e] = 0
            elif self.doubt[e] and (prose[e] or self.tag[e] == "header" and headed[e]) and 2 * linked[e] < every[e]:
                self.words[e] = 0
        self._mark()

    def _clear_wrappers(self) -> None:
        """An element that holds most of the page's text is no noise by its names alone.

        It is cleared if a name of it marks an article too, or if next to nothing that is
        clean stands outside it. A page without clean text is read from the elements
        with the fewest noise words; of them, from the one with the most text.
        """
        n = len(self.tag)
        held, clean = self._sizes(self.hard), self._sizes(self.noisy)
        # elements that hold most of the text are a chain from the root down
        chain = [e for e in range(1, n) if 2 * held[e] > held[0]]
        known = set(chain)
        rival = any(self.bonus[y] and clean[y] and y not in known for y in range(1, n))
        cleared = [e for e in chain if self.words[e] and not self.hard[e] and (self.bonus[e] or not rival and 4 * clean[0] < held[e])]
        for e in cleared:
            self.words[e] = 0
        if cleared:
            self._mark()
        if held[0] and not self._sizes(self.noisy)[0]:
            marked = [e for e in range(1, n) if self.words[e] and held[e] and not self.noisy[self.parent[e]]]
            best, below = min(marked, key=lambda e: (self.words[e], -held[e])), [False] * n
            for e in range(best, n):
                below[e] = e == best or below[self.parent[e]]
                if below[e]:
                    self.words[e] = 0
            self._mark()

    def scores(self) -> dict[int, tuple[int, int, int]]:
        """By key of its path: thousandths, clean text outside links, and an element, of containers that hold clean text."""
        n = len(self.tag)
        clean, every, linked = [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for e in range(1, n):
            in_link[e] = in_link[self.parent[e]] or self.tag[e] == "a"
        for e, _, text in self.pieces:
            size = len(text) - text.count(" ")
            every[e] += size
            if not self.noisy[e]:
                clean[e] += size
                linked[e] += size * in_link[e]
        for e in range(n - 1, 0, -1):
            for x in (clean, every, linked):
                x[self.parent[e]] += x[e]
        out: dict[int, tuple[int, int, int]] = {}
        total = clean[0]
        for e in range(1, n):
            if self.tag[e] in CONTAINERS and clean[e] and not self.noisy[e]:
                own = clean[e] - linked[e]
                share, pure = own / total, clean[e] / every[e]
                score = int(1000 * share * pure) + 150 * self.bonus[e] * (share > 0.25)
                before = out.get(self.key[e], (-1, 0, 0))
                # several elements of one path are read together
                out[self.key[e]] = (max(score, before[0]), own + before[1], before[2] or e)
        return out

    def best_first(self, scores: dict[int, tuple[int, int, int]]) -> list[int]:
        """Keys by score; of equals the deeper, then the smaller path."""
        return sorted(scores, key=lambda k: (-scores[k][0], -self.depth[scores[k][2]], k))

    def chosen(self, paths: list[int]) -> int | None:
        """The first of a host's paths that holds enough text here, else the page's own best; None without clean text in a container.

        A later path that only lies around the page's own best container does not replace it.
        """
        scores = self.scores()
        if not scores:
            return None
        own = self.best_first(scores)[0]
        around, e = set(), self.parent[scores[own][2]]
        while e >= 0:
            around.add(self.key[e])
            e = self.parent[e]
        for i, p in enumerate(paths):
            if p in scores and scores[p][1] and LEAST * scores[p][1] >= scores[own][1] and (i == 0 or p not in around):
                return p
        return own

    def text(self, key: int | None = None) -> str:
        """Clean text of the elements whose path has this key; of all, if None."""
        inside = [key is None]
        for e in range(1, len(self.tag)):
            inside.append(inside[self.parent[e]] or self.key[e] == key)
        out, last = [], None
        for e, block, piece in self.pieces:
            if inside[e] and not self.noisy[e]:
                if block != last:
                    out.append(" ")
                    last = block
                out.append(piece)
        joined = "".join(out)
        return " ".join((html_lib.unescape(joined) if "&" in joined else joined).split())


def read(source: str, paths: list[int] | None = None) -> str:
    """Main text of one page, with the paths of its host if they are known."""
    page = Page(source)
    return page.text(page.chosen(paths or []))


def _vote():
    schema = pa.schema([("host", pa.string()), ("key", pa.int64()), ("path", pa.string()), ("depth", pa.int32()), ("score", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, int], list] = {}
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html")):
                host = host_of(url)
                if host and source.is_valid:
                    page = Page(source.as_py())
                    scores = page.scores()
                    for key in page.best_first(scores)[:VOTES]:
                        score, _, e = scores[key]
                        held = votes.setdefault((host, key), [page.path(e), page.depth[e], 0, 0])
                        held[2] += score
                        held[3] += 1
            rows = [(h, k, *v) for (h, k), v in votes.items()]
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return run


def _extract():
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read(source.as_py() or "", keys) for source, keys in zip(batch.column("html"), batch.column("keys").to_pylist())]
            yield pa.record_batch([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return run


def consensus(pages: DataFrame) -> DataFrame:
    """(host, paths, keys, pages): each host's best paths, by the votes of all its pages, and about how many pages it has."""
    votes = pages.select("url", "html").mapInArrow(_vote(), "host string, key long, path string, depth int, score long, n long")
    votes = votes.groupBy("host", "key").agg(F.min("path").alias("path"), F.min("depth").alias("depth"), (F.sum("score") / F.sum("n")).alias("score"), F.sum("n").alias("n"))
    votes = votes.withColumn("most", F.max("n").over(Window.partitionBy("host"))).where(f"{SUPPORT} * n >= most")
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), F.desc("depth"), "path"))
    top = votes.withColumn("rank", rank).where(F.col("rank") <= PATHS)
    by = top.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "key"))).alias("p"), F.max("most").alias("pages"))
    return by.select("host", F.transform("p", lambda x: x.path).alias("paths"), F.transform("p", lambda x: x.key).alias("keys"), "pages")


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select("page_id", "url", "html")
    paths = scratch.table(consensus(pages), "paths").select("host", "keys", "pages")
    hosts, total = paths.agg(F.count("*"), F.sum("pages")).first()
    host = F.regexp_replace(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), r"^www\.", "")
    keyed = pages.withColumn("host", host)
    joined = keyed.join(F.broadcast(paths), "host", "left") if hosts <= BROADCAST_ROWS else with_each(keyed, paths, ["host"], "pages", total)
    return joined.select("page_id", "url", "html", "keys").mapInArrow(_extract(), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "pages"))
