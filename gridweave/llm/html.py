"""Main text of web pages by templates deduced from the pages of each host.

A page is a sequence of tokens: starts and ends of its block elements, each
told apart by the path of elements around it, and the texts between them.
Tokens of one host that occur equally often on every page share an occurrence
vector and form an equivalence class. A vector is never built: its pages and
counts are hashed and the hashes xored, so a task adds up its pages before
anything is shuffled, and equal sums of 128 bits are equal vectors.

A class is valid if its tokens come in one order on every page that has them.
Valid classes lie in one another by their elements' paths and make up the
host's template. What is between two of its tokens is a slot. The slots of the
element with the article are kept: of what stands in them, the texts that
belong to a class of the template, as on every page, are not part of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridweave.llm.shared import only, parts, release, saved, trim

#: A token is in the template if so large a share of the host's pages has it; a text needs so many pages besides.
LEAST_SHARE, LEAST_TEXT_PAGES = 0.5, 6
#: An element is narrowed down to a part of it that has this share of its text; a part in which links have this share is a menu.
NARROW, LINKED = 0.6, 0.7
#: Template tokens of all hosts up to which they are sent to every task (8 bytes each); beyond, pages are shuffled to them.
SENT_TOKENS, SALTS = 1 << 22, 32

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: Elements without an end, those whose content is no markup, and those that stand inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Of those, the ones that end no block.
SKIPPED = frozenset("script style iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: What a start ends before it, up to the elements that hold such parts.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that are no part of an article, and words of class, id and role that say so, first or last.
OUTSIDE = frozenset("head nav footer aside form script style noscript template iframe button select textarea dialog menu svg object canvas".split())
OUTSIDE_WORDS = frozenset(
    """ad ads adsense advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo
    cookie cookies copyright dialog discussion disqus disclaimer footer gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices
    pager pagination popup promo promos promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor
    sponsored subscribe subscription toolbar topbar widget widgets""".split()
)
NEGATING = frozenset("no not with without has".split())
#: Kinds of elements: any, one outside, one with the article, one of a line or a list, a first heading, a page header.
ANY, OUT, ARTICLE, LEAF, HEADING, HEADER = range(6)
LEAVES = frozenset("p h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption tr table tbody thead hr address".split())
#: Kinds of tokens.
START, END, TEXT = range(3)


def _hash(*what) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, what)).encode("utf-8", "replace")) - (1 << 63)


def _element(tag: str, attributes: str) -> tuple[str, int]:
    """The name of an element in paths, and its kind. Digits of ids and long numbers in classes, which number pages, don't count."""
    kind = OUT if tag in OUTSIDE else ARTICLE if tag in ("article", "main") else HEADER if tag == "header" else HEADING if tag == "h1" else LEAF if tag in LEAVES else ANY
    if not attributes.strip("/ \t\r\n"):
        return tag, kind
    name = tag
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), unescape(next((v for v in values if v), ""))
        if key in ("class", "id", "role", "itemprop"):
            plain = " ".join(sorted(re.sub(r"[0-9]+" if key == "id" else r"[0-9]{3,}", "", value).split()))
            name += f"|{key}={plain}"
            if key == "itemprop":
                kind = ARTICLE if "articleBody" in value and kind != OUT else kind
            elif key == "role" and value == "main":
                kind = ARTICLE
            elif tag not in ("html", "body"):
                for one in value.split():
                    words = [w.lower() for w in _WORD.findall(one)]
                    if words and not NEGATING.intersection(words):
                        if words[0] in OUTSIDE_WORDS or words[-1] in OUTSIDE_WORDS:
                            kind = OUT
                        elif "header" in (words[0], words[-1]) and kind == ANY:
                            kind = HEADER
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            kind = OUT
    return name, kind


class Page:
    """Tokens of a page: role and kind of each, and the texts in blocks that may be of the article.

    seen: for each role how often, where first, path and parent of its
    element, the element's kind, characters in it and those of links.
    """

    def __init__(self, html: str):
        self.roles, self.kinds, self.texts, self.seen = [], bytearray(), [], {}
        #: tag, path, kind, outside, role, whether in an article and in a header, characters, those of links.
        self._stack: list[list] = []
        self._open: Counter = Counter()
        self._block: list[str] = []
        self._linked = self._links = 0
        self._named: dict = {}
        self._start("#page", "")
        at = 0
        while (m := _TAG.search(html, at)) is not None:
            if m.start() > at:
                self._write(html[at : m.start()])
            at = m.end()
            if m[0].startswith("<![CDATA["):
                self._write(m[0][9:].removesuffix("]]>"), plain=True)
            elif m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                else:
                    if tag not in SKIPPED:
                        self._start(tag, m[3])
                    if tag in RAW and not m[3].endswith("/"):
                        stop = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
                        if tag not in SKIPPED:
                            self._write(html[at : stop.start() if stop else len(html)])
                        at = stop.start() if stop else len(html)
        self._write(html[at:])
        self._flush()
        while self._stack:
            self._pop()

    def _write(self, text: str, plain: bool = False) -> None:
        if self._stack and self._stack[-1][3]:
            return
        text = text if plain or "&" not in text else unescape(text)
        self._block.append(text)
        if self._linked:
            self._links += len(text.strip())

    def _see(self, role: int, kind: int, path: int, parent: int, element: int) -> list:
        self.roles.append(role)
        self.kinds.append(kind)
        found = self.seen.get(role)
        if found is None:
            found = self.seen[role] = [0, len(self.roles), path, parent, element, kind, 0, 0]
        found[0] += 1
        return found

    def _flush(self) -> None:
        """Ends a block."""
        text = " ".join("".join(self._block).split())
        links, self._links = min(self._links, len(text)), 0
        self._block.clear()
        if text:
            path, element = (self._stack[-1][1], self._stack[-1][2]) if self._stack else (0, ANY)
            found = self._see(_hash(path, text), TEXT, path, path, element)
            self.texts.append(text)
            for total, at in ((found, 6), *(((self._stack[-1], 7),) if self._stack else ())):
                total[at] += len(text)
                total[at + 1] += links

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "wbr":
            self._block.append(" " if tag == "br" else "")
        elif tag == "a":
            self._linked = 1
        elif tag in INLINE or (tag in VOID and tag != "hr"):
            return
        else:
            self._flush()
            self._linked = 0
            self._implied(tag)
            if tag == "hr":
                return
            top = self._stack[-1] if self._stack else None
            parent, outside, article, header = (top[1], top[3], top[5], top[6]) if top else (0, False, False, False)
            key = (parent, tag, attributes)
            if key not in self._named:
                name, kind = _element(tag, attributes)
                path = _hash(parent, name)
                self._named[key] = (path, kind, _hash(path, "start"))
            path, kind, role = self._named[key]
            # Of an article's own header the headings belong to it; of a page's header nothing does.
            outside = outside or kind == OUT or (kind == HEADER and not article) or (header and re.fullmatch("h[1-6]|header|hgroup|div", tag) is None)
            self._see(role, START, path, parent, OUT if outside else kind)
            self._stack.append([tag, path, kind, outside, role, article or kind == ARTICLE, header or kind == HEADER, 0, 0])
            self._open[tag] += 1

    def _implied(self, tag: str) -> None:
        if any(x[0] == "p" for x in self._stack[-1:]):
            self._pop()
        if tag in ENDS:
            ended, holders = ENDS[tag]
            for k in () if not any(self._open[x] for x in ended) else range(len(self._stack) - 1, -1, -1):
                if self._stack[k][0] in holders:
                    break
                if self._stack[k][0] in ended:
                    while len(self._stack) > k:
                        self._pop()
                    break

    def _pop(self) -> None:
        tag, path, kind, outside, role, _, _, chars, links = self._stack.pop()
        self._open[tag] -= 1
        parent = self._stack[-1][1] if self._stack else 0
        for total, at in ((self.seen[role], 6), *(((self._stack[-1], 7),) if self._stack else ())):
            total[at] += chars
            total[at + 1] += links
        self._see(_hash(path, "end"), END, path, parent, OUT if outside else kind)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._linked = 0
        elif tag not in INLINE and tag not in VOID and (self._open[tag] or tag == "p"):
            self._flush()
            self._linked = 0
            if self._open[tag]:
                while self._stack[-1][0] != tag:
                    self._pop()
                self._pop()


def article_slots(seen: Iterable[tuple]) -> tuple[set[int], set[int]]:
    """The roles of tags after which a slot of the article begins, and the paths that it has.

    seen: role, n, path, parent, element, token, chars, links of a template's tags.
    """
    starts = {x[2]: x for x in seen if x[5] == START and x[4] != OUT}
    below: dict[int, list] = {}
    for x in starts.values():
        below.setdefault(x[3], []).append(x)
    size = lambda x: (x[6], -x[2])
    inside = [x for x in starts.values() if x[4] == ARTICLE and x[6]]
    roots = [x for x in starts.values() if x[3] not in starts]
    if not roots:
        return set(), set()
    top = max(inside or roots, key=size)
    while True:
        parts_ = below.get(top[2], [])
        held_ = [x for x in parts_ if x[4] in (ANY, ARTICLE) and x[6] >= NARROW * top[6]]
        if not held_ or not top[6] or any(x[4] == HEADING for x in parts_):
            break
        # An article is narrowed to an article in it; anything else to its largest part.
        if top[4] == ARTICLE and not any(x[4] == ARTICLE for x in held_):
            break
        top = max((x for x in held_ if x[4] == ARTICLE), key=size, default=max(held_, key=size))
    paths, ahead = set(), [top]
    while ahead:
        x = ahead.pop()
        # Only what is no line of text by itself can be a menu: a paragraph may well be one link.
        menu = x is not top and x[6] and x[7] >= LINKED * x[6] and x[6] < 0.3 * top[6] and (x[4] == ANY or x[1] > 1 and x[4] == LEAF)
        if not menu:
            paths.add(x[2])
            ahead += below.get(x[2], [])
    return {x[0] for x in seen if (x[5] == START and x[2] in paths) or (x[5] == END and x[3] in paths)}, paths


_SEEN = "role long, n int, at int, path long, parent long, element int, token int, chars long, links long"
_PAGE = f"row long, page_id long, url string, host string, roles binary, kinds binary, texts array<string>, own binary, seen array<struct<{_SEEN.replace(' ', ':').replace(',:', ',')}>>"


def tokenized(pages: DataFrame) -> DataFrame:
    """Pages as tokens; own: which texts are kept by a template of this page alone."""
    struct = pa.struct([(n, {"long": pa.int64(), "int": pa.int32()}[t]) for n, t in (x.split() for x in _SEEN.split(", "))])
    names = [x.name for x in struct]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in parts(batches, "html", 1 << 21, 256):
            roles, kinds, texts, own, seen = [], [], [], [], []
            for html in b.column("html").to_pylist():
                page = Page(html or "")
                all_seen = [(role, *x) for role, x in page.seen.items()]
                main, _ = article_slots([(r, n, path, parent, element, token, chars, links) for r, n, _, path, parent, element, token, chars, links in all_seen])
                roles.append(np.array(page.roles, "<i8").tobytes())
                kinds.append(bytes(page.kinds))
                texts.append(page.texts)
                own.append(bytes(_kept(page.roles, page.kinds, main, None, frozenset())))
                seen.append([dict(zip(names, x, strict=True)) for x in all_seen])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in ("row", "page_id", "url", "host")), pa.array(roles, pa.binary()), pa.array(kinds, pa.binary()), pa.array(texts, pa.list_(pa.string())), pa.array(own, pa.binary()), pa.array(seen, pa.list_(struct))],
                ["row", "page_id", "url", "host", "roles", "kinds", "texts", "own", "seen"],
            )
        trim()

    return pages.mapInArrow(run, _PAGE)


def _kept(roles, kinds, slots, tags, constant) -> Iterator[bool]:
    """Of each text whether it stands in a slot of the article and isn't constant; tags: those of the template, None for all."""
    now = False
    for role, kind in zip(roles, kinds, strict=True):
        if kind == TEXT:
            yield now and role not in constant
        elif tags is None or role in tags:
            now = role in slots


def classes(found: DataFrame) -> DataFrame:
    """The frequent tokens of each host with their equivalence class: host, pages, role, n, path, ..., f1, f2 (the vector)."""
    seen = found.select("row", "host", F.explode("seen").alias("s")).select("row", "host", "s.*")
    plain = [F.any_value(c).alias(c) for c in ("path", "parent", "element", "token")]
    vector = [F.bit_xor(F.xxhash64("row", "n")).alias("f1"), F.bit_xor(F.xxhash64("n", F.lit("vector"), "row")).alias("f2")]
    roles = seen.groupBy("host", "role").agg(F.count("*").alias("pages"), F.sum("n").alias("n"), *plain, F.sum("chars").alias("chars"), F.sum("links").alias("links"), *vector)
    frequent = (F.col("token") != TEXT) | (F.col("pages") >= LEAST_TEXT_PAGES)
    all_pages = found.groupBy("host").agg(F.count("*").alias("all_pages"))
    return roles.where(frequent).join(all_pages, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all_pages"))


def _deduced(t: pa.Table) -> pa.Table:
    """A host's tokens in classes of two or more, numbered: the vectors that share all hash bits."""
    rows = t.to_pylist()
    number: dict[tuple, int] = {}
    for x in rows:
        x["class"] = number.setdefault((x["f1"], x["f2"], x["pages"], x["n"]), len(number))
    size = np.bincount([x["class"] for x in rows], minlength=len(number))
    kept = [x for x in rows if size[x["class"]] > 1]
    out = {"host": [rows[0]["host"]], "n_tokens": [len(kept)]}
    return pa.Table.from_pydict(out | {c: [[x[c] for x in kept]] for c in _TOKEN}, pa.schema([("host", pa.string()), ("n_tokens", pa.int64()), *((c, pa.list_(pa.int64())) for c in _TOKEN)]))


_TOKEN = ("role", "class", "n", "path", "parent", "element", "token", "chars", "links")


def _beside(rows: DataFrame, templates: DataFrame, sent_tokens: int) -> DataFrame:
    """rows with their host's template: it is sent to all tasks while all templates are small, else pages of a host are dealt to many tasks."""
    if (templates.agg(F.sum("n_tokens")).first()[0] or 0) <= sent_tokens:
        return rows.join(F.broadcast(templates), "host", "left")
    salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("roles"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def orders(found: DataFrame, templates: DataFrame, sent_tokens: int = SENT_TOKENS) -> DataFrame:
    """host, class of the classes whose tokens don't come in one order on every page: they are not valid."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: dict[tuple, int] = {}
        bad: set[tuple] = set()
        classes_of: dict[str, dict] = {}
        for b in batches:
            for k in range(b.num_rows):
                host = b.column("host")[k].as_py()
                if host not in classes_of:
                    if len(classes_of) > 64:
                        classes_of.clear()
                    role, cls = (b.column(c)[k].as_py() or () for c in ("role", "class"))
                    sizes: dict[int, int] = {}
                    for c in cls:
                        sizes[c] = sizes.get(c, 0) + 1
                    classes_of[host] = dict(zip(role, cls, strict=True)), sizes
                of, sizes = classes_of[host]
                runs: dict[int, list] = {}
                for r in np.frombuffer(b.column("roles")[k].as_buffer(), "<i8").tolist():
                    if r in of:
                        runs.setdefault(of[r], []).append(r)
                for c, own in runs.items():
                    first = own[: sizes[c]]
                    mark = _hash(*first)
                    if own != first * (len(own) // len(first)) or order.setdefault((host, c), mark) != mark:
                        bad.add((host, c))
        keys = list(order)
        yield pa.RecordBatch.from_pydict(
            {"host": [h for h, _ in keys], "class": [c for _, c in keys], "mark": [order[x] for x in keys], "ok": [x not in bad for x in keys]},
            pa.schema([("host", pa.string()), ("class", pa.int64()), ("mark", pa.int64()), ("ok", pa.bool_())]),
        )

    rows = _beside(found.select("host", "roles"), templates.select("host", "n_tokens", "role", "class"), sent_tokens)
    marks = rows.mapInArrow(run, "host string, class long, mark long, ok boolean").groupBy("host", "class")
    return marks.agg((F.bool_and("ok") & (F.min("mark") == F.max("mark"))).alias("valid")).where("not valid").select("host", "class")


def _templates(t: pa.Table) -> pa.Table:
    """tags, slots, constant of a host: its template's tags, those after which a slot of the article begins, and texts that all pages have there."""
    row = {n: t.column(n)[0].as_py() for n in t.column_names}
    bad = set(row["bad"] or ())
    seen = [x for x in zip(*(row[c] for c in _TOKEN), strict=True) if x[1] not in bad]
    tags = [(role, n, path, parent, element, token, chars, links) for role, _, n, path, parent, element, token, chars, links in seen if token != TEXT]
    slots, paths = article_slots(tags)
    holders = {x[1] for x in seen if x[6] == START and x[0] in slots}
    constant = [x for x in seen if x[6] == TEXT and x[3] in paths and x[1] in holders]
    within = max((x[7] for x in seen if x[6] == START and x[3] in paths), default=0)
    # Where most of the article is the same on all pages these are copies, not a template.
    if 2 * sum(x[7] for x in constant) > within:
        constant = []
    found = {"host": [row["host"]], "n_tokens": [len(tags)], "tags": [[x[0] for x in tags]], "slots": [sorted(slots)], "constant": [[x[0] for x in constant]]}
    return pa.Table.from_pydict(found, pa.schema([("host", pa.string()), ("n_tokens", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("tags", "slots", "constant"))]))


def templates(found: DataFrame, sent_tokens: int = SENT_TOKENS) -> DataFrame:
    """host, n_tokens, tags, slots, constant: the template of each host of tokenized pages."""
    lists = ", ".join(f"`{c}` array<long>" for c in _TOKEN)
    deduced = saved(classes(found).groupBy("host").applyInArrow(_deduced, f"host string, n_tokens long, {lists}"), "classes")
    bad = orders(found, deduced, sent_tokens).groupBy("host").agg(F.collect_set("class").alias("bad"))
    whole = deduced.join(bad, "host", "left")
    return saved(whole.groupBy("host").applyInArrow(_templates, "host string, n_tokens long, tags array<long>, slots array<long>, constant array<long>"), "templates")


def extracted(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sent_tokens: int = SENT_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each row, its blocks in page order with a line end between.

    Character references are decoded, white space in a block (a line break
    too) is one blank. Null and empty html have an empty text. Rows without a
    host, null urls too, share one template. A host with a single page, and a
    page that has no slot of its host's article, go by the template of that
    page alone. Repeated rows and repeated ids come back as often as they
    come; a very long page is one row's work. An empty table gives no rows.
    """
    pages = only(df, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))
    host = F.regexp_extract(F.lower(F.col("url")), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\\]*)", 1)
    found = saved(tokenized(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.coalesce(host, F.lit("")).alias("host"), "html")), "pages")
    known = templates(found, sent_tokens)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_: dict[str, tuple] = {}
        for b in batches:
            out = []
            hosts, texts = b.column("host").to_pylist(), b.column("texts").to_pylist()
            for k, (host, blocks) in enumerate(zip(hosts, texts, strict=True)):
                if host not in held_:
                    if len(held_) > 64:
                        held_.clear()
                    held_[host] = tuple(frozenset(b.column(c)[k].as_py() or ()) for c in ("slots", "tags", "constant"))
                slots, tags, constant = held_[host]
                roles = np.frombuffer(b.column("roles")[k].as_buffer(), "<i8").tolist()
                if slots.isdisjoint(roles):
                    kept = map(bool, b.column("own")[k].as_py())
                else:
                    kept = _kept(roles, b.column("kinds")[k].as_py(), slots, tags, constant)
                out.append("\n".join(x for x, yes in zip(blocks, kept, strict=True) if yes))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = _beside(found.select("page_id", "url", "host", "roles", "kinds", "texts", "own"), known, sent_tokens)
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
