"""Main text of web pages by equivalence classes of template tokens.

A token is an opening tag together with the tags above it. Over all pages of a host each
token has an occurrence vector: how often it occurs in every page. Tokens with equal vectors
form a class. It is valid as a whole: if it occurs in most pages of the host, has more than
one token, has them in one order in all pages, and nests: all its tokens lie in one slot of
the classes of more pages. Tokens that occur exactly once in every page that has the class
are the frame of the template, repeated ones (items of a list, paragraphs) nest in the frame
token above them. The slots between are where pages differ. The article slot is the smallest
frame token around all slots with varying text; an ``article`` or ``main`` in the frame that
holds most of it bounds it. An element inside it whose whole text is the same in all pages
that have it is template text, whatever the number of pages, if these differ otherwise; below
an ``article`` nothing is.

Statistics are aggregates that combine on the map side, vectors and orders as checksums.
Class names tell tokens apart only if most pages of a host have them, and tokens too rare for
a valid class go before a host's tokens are gathered, so what is gathered is bounded by the
tokens of a page, however many pages a host has. A page that is the only one of its host, or without the host's article slot, is read by its own marks: its ``article`` or
``main`` element, else the body. Elements that never hold main text (menus, headers, footers,
sidebars, forms, scripts, styles, adverts, notices, comments, by tag, role, class or id) are
left out of any slot.

Cases: a null or empty html gives an empty text, and so does one without text in its slot.
A null url counts as a host of its own. Repeated rows are pages like others. Unclosed and
crossing tags are read as browsers do, as far as blocks go. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import map_batches, write_table
from kerbside.sizing import BROADCAST_LIMIT_BYTES

#: Pages a host needs for statistics, the share of them in which a valid class occurs, and its size.
LEAST_PAGES, VALID_PERCENT, LEAST_TOKENS = 2, 60, 2

#: Elements that can be a slot.
CONTAINERS = frozenset("body article main section div table td".split())

#: An ``article`` or ``main`` mark with this share of the host's varying text is its article slot.
SLOT_PERCENT = 70

#: Depth to which tokens are told apart: that of the trees browsers build.
DEPTH = 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements whose content is no markup.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp")

#: Elements that begin and end a block of text.
BLOCKS = frozenset((
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul").split())

#: Elements that never hold main text.
OUTSIDE = frozenset("nav header footer aside form menu dialog button select head search".split())

#: Names of such elements in role, class or id, as whole words.
OUTSIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-\w+|cookies?|consent|disclaimer|footer|header|masthead|menu|"
    r"modal|nav\w*|newsletter|notice|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|social|sponsor\w*|"
    r"subscribe|toolbar|widget|complementary|contentinfo|search)(?:$|[\s_-])", re.IGNORECASE)

#: What an opening tag closes if it is open right inside the same parent.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = frozenset((
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul").split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE)
#: One attribute after the other; a quote means something right after the sign only.
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMED = frozenset(("class", "id", "role", "hidden", "aria-hidden"))

#: Classes and roles of an ``article`` element that is a reader's comment.
_READERS = frozenset("comment comments reply replies".split())

#: An open element: its path, name, whether it is outside of main text, and the element around it.
Open = tuple[str, str, bool, "Open | None"]


def _attributes(rest: str) -> dict[str, str]:
    """The attributes that matter; of one given twice the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        name = m[1].lower()
        if name in _NAMED and name not in found:
            found[name] = next((g for g in m.groups()[1:] if g is not None), "")
    return found


def _outside(name: str, attributes: dict[str, str]) -> bool:
    if name in OUTSIDE or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        words = f"{attributes.get('class', '')} {attributes.get('role', '')}".lower().split()
        return not _READERS.isdisjoint(words)
    return any(OUTSIDE_NAMES.search(attributes[a]) for a in ("class", "id", "role") if attributes.get(a))


def _label(name: str, attributes: dict[str, str]) -> str:
    classes = attributes.get("class", "").split()
    return name + ("." + classes[0] if classes else "")


def page_labels(page: str | None) -> set[str]:
    """The labels with a class of a page's elements."""
    found = set()
    for m in _TOKEN.finditer(page or ""):
        if m["name"] and not m["end"] and "class" in m["rest"].lower():
            label = _label(m["name"].lower(), _attributes(m["rest"]))
            if "." in label:
                found.add(label)
    return found


def events(page: str, labels: frozenset[str] | None = None) -> Iterator[tuple[str, Open | str]]:
    """``("open", element)`` and ``("close", element)`` around elements, ``("text", text)`` between.

    Classes are part of a path if their label is in ``labels``, all of them without. What an
    element lies in hangs on it, so that a page of any depth takes room by its elements alone.
    """
    stack: list[Open] = []
    unclosed: dict[str, int] = {}
    at = 0

    def close(k: int) -> Iterator[tuple[str, Open]]:
        while len(stack) > k:
            yield "close", stack[-1]
            unclosed[stack.pop()[1]] -= 1

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at:m.start()]
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if unclosed.get(name):
                yield from close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == name))
            continue
        if name in _ENDS or name in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                inner = stack[k][1]
                if inner in _ENDS.get(name, ()) or inner == "p" and name in _CLOSES_P:
                    yield from close(k)
                    break
                if inner in BLOCKS and inner != "p":
                    break
        attributes = _attributes(m["rest"])
        label = _label(name, attributes)
        if labels is not None and label not in labels:
            label = name
        parent = stack[-1] if stack else None
        above = parent[0] if parent else ""
        path = f"{above}>{label}" if len(stack) < DEPTH else above
        element = (path, name, _outside(name, attributes) or parent is not None and parent[2], parent)
        stack.append(element)
        unclosed[name] = unclosed.get(name, 0) + 1
        yield "open", element
        if name in VOID or m["rest"].endswith("/") and name not in BLOCKS:
            yield from close(len(stack) - 1)
    if at < len(page):
        yield "text", page[at:]
    yield from close(0)


def _slot(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _plain(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def page_tokens(page: str | None, labels: frozenset[str] | None = None) -> dict[str, tuple[int, int, int]]:
    """Per token (path) in the order of their first occurrence: occurrences, characters of all
    text in it and a checksum of that text. Elements that are outside of main text are not
    entered."""
    found: dict[str, list] = {}
    lines: dict[str, tuple[str, ...]] = {"": ()}
    inner: Open | None = None
    for kind, value in events(page or "", labels):
        if kind == "text":
            if inner and not inner[2] and (words := value.split()):
                piece = " ".join(words)
                for path in lines[inner[0]]:
                    entry = found[path]
                    entry[1] += len(piece)
                    entry[2].update(piece + "\n")
            continue
        inner = value if kind == "open" else value[3]
        if kind == "open" and not value[2]:
            path = value[0]
            if path not in lines:
                lines[path] = (*lines[value[3][0] if value[3] else ""], path)
            found.setdefault(path, [0, 0, xxhash.xxh3_64()])[0] += 1
    return {p: (n, chars, text.intdigest() - (1 << 63)) for p, (n, chars, text) in found.items()}


def _placed(pages: DataFrame, columns: str) -> DataFrame:
    """``columns`` of the pages and their host."""
    names = [c.split()[0] for c in columns.split(", ")]

    def address(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts = [_slot(host_of(u)) for u in batch.column("url").to_pylist()]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(hosts, pa.int64())], [*names, "host"])

    return map_batches(pages.select(names), address, f"{columns}, host bigint")


def _with_host(pages: DataFrame, hosts: DataFrame, size: int, how: str = "inner") -> DataFrame:
    return pages.join(F.broadcast(hosts) if size <= BROADCAST_LIMIT_BYTES else hosts, "host", how)


def _rows(rows: list[tuple], names: str, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names.split())


def host_labels(placed: DataFrame) -> DataFrame:
    """``host, total, labels`` of the hosts with enough pages: their number, and the labels with
    a class that most of them have. Classes of single pages or sections tell no tokens apart."""
    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            rows.append((host, ""))
            rows += [(host, label) for label in page_labels(page)]
        return _rows(rows, "host label", (pa.int64(), pa.string()))

    counts = map_batches(placed, emit, "host bigint, label string").groupBy("host", "label").agg(F.count("*").alias("pages"))
    counts = placed.sparkSession.read.parquet(write_table(
        counts.filter((F.col("pages") * 100 >= VALID_PERCENT * LEAST_PAGES) | (F.col("label") == "")), "page-labels"))
    totals = counts.filter((F.col("label") == "") & (F.col("pages") >= LEAST_PAGES)).select("host", F.col("pages").alias("total"))
    kept = _with_host(counts.filter("label != ''"), totals, totals.count() * 32).filter(
        F.col("pages") * 100 >= VALID_PERCENT * F.col("total"))
    kept = kept.groupBy("host").agg(F.collect_list("label").alias("labels"))
    return totals.join(kept, "host", "left").select(
        "host", "total", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def templates(pages: DataFrame) -> DataFrame:
    """``host, labels, slots``: per host the labels that tell its tokens apart, the checksum of
    its article slot, then those of the slots inside it that hold template text."""
    spark = pages.sparkSession
    placed = _placed(pages, "html string, url string").drop("url")
    hosts = spark.read.parquet(write_table(host_labels(placed), "page-hosts"))
    size = hosts.agg(F.sum(F.size("labels") * 32 + 64)).first()[0] or 0

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for host, number, page, labels in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html", "labels")), strict=True):
            found = page_tokens(page, frozenset(labels))
            whole = _slot(str(found))
            rows.append((host, number, "", 1, 0, 0, whole))
            rows += [(host, number, p, *entry, whole) for p, entry in found.items()]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return _rows(rows, "host page path n chars text whole", kinds)

    numbered = _with_host(placed, hosts, size).withColumn("page", F.monotonically_increasing_id())
    tokens = map_batches(
        numbered, emit, "host bigint, page bigint, path string, n int, chars bigint, text bigint, whole bigint",
    ).groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.max("n").alias("most"), F.sum("chars").alias("chars"),
        ((F.min("text") == F.max("text")) & (F.min("whole") != F.max("whole"))).alias("constant"))
    tokens = _with_host(tokens, hosts.select("host", "total"), size).filter(F.col("pages") * 100 >= VALID_PERCENT * F.col("total"))
    tokens = tokens.groupBy("host").agg(F.collect_list(F.struct(
        "path", "pages", "vector", "most", "chars", "constant")).alias("members"))
    tokens = spark.read.parquet(write_table(tokens.join(hosts.select("host", "labels"), "host"), "page-classes"))
    size = tokens.agg(F.sum(F.expr(
        "64 + size(labels) * 32 + aggregate(members, 0L, (n, m) -> n + length(m.path) + 64)"))).first()[0] or 0

    def orders(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for host, page, labels, members in zip(
                *(batch.column(c).to_pylist() for c in ("host", "html", "labels", "members")), strict=True):
            vectors = {m["path"]: m["vector"] for m in members if m["path"] and m["most"] == 1}
            rows += [(host, v, order) for v, order in class_orders(page, frozenset(labels), vectors).items()]
        return _rows(rows, "host vector seen", (pa.int64(), pa.int64(), pa.int64()))

    several = tokens.withColumn("members", F.transform("members", lambda m: F.struct(m["path"], m["vector"], m["most"])))
    mixed = map_batches(_with_host(placed, several, size), orders, "host bigint, vector bigint, seen bigint") \
        .groupBy("host", "vector").agg((F.min("seen") != F.max("seen")).alias("mixed")).filter("mixed") \
        .groupBy("host").agg(F.collect_list("vector").alias("mixed"))

    def choose(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for host, labels, members, wrong in zip(
                *(batch.column(c).to_pylist() for c in ("host", "labels", "members", "mixed")), strict=True):
            if found := article_slot(template_members(members, set(wrong or ()))):
                rows.append((host, labels, [_slot(p) for p in found]))
        return _rows(rows, "host labels slots", (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())))

    return map_batches(tokens.join(mixed, "host", "left"), choose, "host bigint, labels array<string>, slots array<bigint>")


def class_orders(page: str | None, labels: frozenset[str] | None, vectors: dict[str, int]) -> dict[int, int]:
    """Per class a checksum of the order in which the page has its tokens."""
    order: dict[int, list[str]] = {}
    for kind, value in events(page or "", labels):
        if kind == "open" and not value[2] and (vector := vectors.get(value[0])) is not None:
            order.setdefault(vector, []).append(value[0])
    return {v: _slot("\n".join(paths)) for v, paths in order.items()}


def _above(path: str) -> list[str]:
    """The paths of the elements around an element, outermost first."""
    parts = path.split(">")
    return [">".join(parts[:k]) for k in range(2, len(parts))]


def template_members(members: list[dict], mixed: set[int]) -> list[dict]:
    """The page itself and the tokens of the host's template: of the classes that have at least
    ``LEAST_TOKENS`` tokens, always in one order (``mixed`` lists the others), and that nest,
    all tokens in the same slot of the classes of more pages. Classes of repeated tokens nest
    by the frame token above each."""
    classes: dict[int, list[dict]] = {}
    for m in members:
        if m["path"]:
            classes.setdefault(m["vector"], []).append(m)
    template: dict[str, dict] = {}
    for vector, tokens in sorted(classes.items(), key=lambda c: (-c[1][0]["pages"], c[1][0]["most"], -len(c[1]), c[0])):
        if tokens[0]["most"] == 1:
            slots = {next((p for p in reversed(_above(m["path"])) if p in template), "") for m in tokens}
            if len(tokens) < LEAST_TOKENS or vector in mixed or len(slots) > 1:
                continue
        template |= {m["path"]: m for m in tokens}
    return [m for m in members if not m["path"] or m["path"] in template]


def article_slot(members: list[dict]) -> list[str]:
    """The article slot of a template and the template slots inside it; none if the host has too
    few pages. ``members`` has ``path, pages, most, chars, constant`` per token, of all text in
    it; the empty path stands for the page itself.

    The slot is the smallest frame token that covers all varying text of the template (none if
    no token does), or an ``article`` or ``main`` mark that holds most of it; it never lies
    below such a mark.
    """
    total = next((m["pages"] for m in members if not m["path"]), 0)
    if total < LEAST_PAGES:
        return []
    valid = {m["path"]: m for m in members if m["path"] and 100 * m["pages"] >= VALID_PERCENT * total}

    def name(path: str) -> str:
        return path.rsplit(">", 1)[-1].split(".")[0]

    fixed = {p for p, m in valid.items() if m["constant"] and m["chars"] and name(p) in CONTAINERS}
    varying = {p: m["chars"] for p, m in valid.items()}
    for p in fixed:
        if not fixed.intersection(_above(p)):
            for q in (*_above(p), p):
                if q in varying:
                    varying[q] -= valid[p]["chars"]
    frame = [p for p, m in valid.items() if m["most"] == 1 and varying[p] > 0 and name(p) in CONTAINERS | {"html"}]
    if not frame:
        return []
    everything = max(varying[p] for p in frame)
    marks = [p for k in ("article", "main") for p in sorted(frame, key=lambda p: (p.count(">"), p))
             if name(p) == k and 100 * varying[p] >= SLOT_PERCENT * everything]
    if not marks and sum(n for p, n in varying.items() if not valid.keys() & set(_above(p))) > everything:
        return []
    slot = marks[0] if marks else max((p for p in frame if varying[p] == everything), key=lambda p: (p.count(">"), p))
    if "article" in map(name, (*_above(slot), slot)):
        return [slot]
    return [slot] + sorted(p for p in fixed if p.startswith(slot + ">") and "article" not in map(name, _above(p)))


def main_text(page: str | None, slots: list[int] | None, labels: frozenset[str] | None = None) -> str:
    """Blocks of the article slot (or, without one, of the page's own marks), one per line."""
    parsed = list(events(page or "", labels))
    paths = {v[0] for k, v in parsed if k == "open"}
    names = {v[1] for k, v in parsed if k == "open" and not v[2]}
    known = {p: _slot(p) for p in paths} if slots else {}
    fixed: set[int] = set()
    if slots and slots[0] in known.values():
        article, fixed = slots[0], set(slots[1:])

        def enters(element: Open) -> bool:
            return known[element[0]] == article
    else:
        mark = next((n for n in ("article", "main", "body", "html") if n in names), None)

        def enters(element: Open) -> bool:
            return element[1] == mark

        if mark is None:
            return _join_blocks(parsed, True, lambda element, around: True)

    def within(element: Open, around: bool | None) -> bool | None:
        """Whether an element is taken, by what holds for the one around; None below template text."""
        if around is None or known.get(element[0]) in fixed:
            return None
        return around or enters(element)

    return _join_blocks(parsed, False, within)


def _join_blocks(parsed: list, outer: bool, within: Callable[[Open, bool | None], bool | None]) -> str:
    """The text of elements that are taken and not outside of main text, a line per block.
    ``outer`` is what holds above all elements."""
    blocks, pieces = [], []
    states: list[bool | None] = [outer]
    taken = outer
    for kind, value in parsed:
        if kind == "text":
            if taken:
                pieces.append(value)
            continue
        if kind == "open":
            states.append(within(value, states[-1]))
            inside = bool(states[-1]) and not value[2]
        else:
            states.pop()
            inside = bool(states[-1]) and not (value[3] and value[3][2])
        if value[1] in BLOCKS or inside != taken:
            if text := _plain(pieces):
                blocks.append(text)
            pieces = []
        taken = inside
    if text := _plain(pieces):
        blocks.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    found = spark.read.parquet(write_table(templates(source), "page-templates"))
    size = found.agg(F.sum(F.size("slots") * 8 + F.size("labels") * 32 + 64)).first()[0] or 0
    joined = _with_host(_placed(source, "page_id bigint, url string, html string"), found, size, "left")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, s, None if k is None else frozenset(k)) for h, s, k in zip(
            *(batch.column(c).to_pylist() for c in ("html", "slots", "labels")), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(joined, read, "page_id bigint, url string, text string, n_chars bigint")
