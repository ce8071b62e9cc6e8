"""Main text of web pages by wrappers: union-free regular expressions over the token streams of a host's pages."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.plans.session import stage_table
from starloom.plans.sizing import lookup_join

MERGED_STREAMS = 500
_LONGEST_GROUP = 8
_LONGEST_PATH = 400
# A text that two distinct pages and half of those with its slot share is template, outside article and main elements.
TEMPLATE_PAGES = 2
_NAMED = 2

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[-_]+")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt",
           "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
# A start tag closes the open elements of the second set, up to an element of the third.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_NEVER = {"nav", "aside", "form", "footer", "noscript", "template", "button", "select", "svg", "math", "object", "canvas", "audio", "video", "dialog", "menu", "head", "fieldset"}
_NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_NEVER_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promos", "promotion", "banner", "sidebar", "menu", "nav", "navbar",
                "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
                "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "respond", "replies", "disqus", "widget", "pagination",
                "pager", "copyright", "disclaimer", "teaser"}
_OUTSIDE_WORDS = {"header", "head", "top", "bottom", "side"}
_MAIN_WORDS = {"article", "post", "entry", "story", "content", "main"}
_KNOWN_WORDS = _NEVER_WORDS | _OUTSIDE_WORDS | _MAIN_WORDS
# Compound names that tell of a state or a layout ("no-sidebar", "has-banner"), and nouns for a part that is named by the word before ("comment-list").
_STATES = {"no", "not", "non", "has", "have", "with", "without", "is", "hide", "hides", "hidden", "show", "shows", "js", "supports", "enable", "enabled", "disable", "disabled"}
_PART_NOUNS = {"area", "bar", "block", "box", "container", "inner", "item", "items", "link", "links", "list", "outer", "section", "slot", "unit", "wrap", "wrapper"}


def _known_word(token: str) -> str:
    """The known word that a class or id is or, as a compound, ends in; empty for others and for states."""
    parts = [x for part in _PARTS.split(token) if not part[:1].isdigit() and (x := part.rstrip("0123456789"))]
    if not parts or len(parts) > 1 and parts[0] in _STATES:
        return ""
    while len(parts) > 1 and parts[-1] in _PART_NOUNS:
        parts.pop()
    return parts[-1] if parts[-1] in _KNOWN_WORDS else ""


def _role(name: str, attributes: str, level: int) -> tuple[bool, int, str]:
    """Whether an element is never main text, how surely it holds the article (3 to 0), and its label."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    words = {w for k in ("class", "id") for token in found.get(k, "").split() if (w := _known_word(token))}
    role = found.get("role", "")
    page = name in ("html", "body")
    main = 3 if name == "article" or role == "article" else 2 if name == "main" or role == "main" else 1 if words & _MAIN_WORDS and not page else 0
    outside = name == "header" or bool(words & _OUTSIDE_WORDS and not words & _MAIN_WORDS)
    never = name in _NEVER or role in _NEVER_ROLES or (not page and not main and bool(words & _NEVER_WORDS)) or (outside and not level and not page)
    return never, max(level, main), ".".join([name, *sorted(words)])


def text_blocks(html: str | None) -> list[tuple[str, str]]:
    """(slot, text) of every block of a page, in order.

    A slot is the path of the open elements with a mark: ``-`` for parts that are never main text,
    else the certainty 0 to 3 of the container. White space is one blank, references are decoded.
    Start tags that imply the end of others are obeyed, stray end tags are not.
    """
    html = html or ""
    out, text, stack, at = [], [], [("", "", False, 0)], 0

    def flush() -> None:
        joined = " ".join("".join(text).split())
        if joined:
            out.append((f"{stack[-1][1]}|{'-' if stack[-1][2] else stack[-1][3]}", joined))
        text.clear()

    def close(names: set[str], until: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(entities.unescape(html[at:]))
            break
        if m.start() > at:
            text.append(entities.unescape(html[at:m.start()]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        end, attributes = bool(m[1] or m[4]), (m[3] or m[6] or "")
        if name == "br" or name == "hr":
            text.append(" ")
            if name == "hr":
                flush()
        elif end:
            if name not in _INLINE and name not in _VOID:
                flush()
                if any(s[0] == name for s in stack):
                    close({name}, set())
        elif name in _RAW:
            last = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = last.end() if last else size
        elif name in _VOID or name in _INLINE:
            continue
        else:
            flush()
            if any(s[0] == "p" for s in stack):
                close({"p"}, {"article", "body", "div", "section", "td", "li"})
            if name in _CLOSES:
                close(*_CLOSES[name])
            never, level, label = _role(name, attributes, stack[-1][3])
            path = stack[-1][1]
            path = path if path.endswith("/" + label) else f"{path}/{label}"
            if len(path) > _LONGEST_PATH:
                path = f"/~{xxhash.xxh3_64_hexdigest(path)}/{label}"
            if not attributes.endswith("/") or name not in ("svg", "math"):
                stack.append((name, path, stack[-1][2] or never, level))
    flush()
    return out


def fold(slots: list[str]) -> tuple[list[tuple[tuple[str, ...], bool]], list[tuple[int, int]]]:
    """A token stream with immediate repeats made groups, and each token's group and place there."""
    items, places, at, n = [], [], 0, len(slots)
    while at < n:
        best, times = 1, 1
        for width in range(1, _LONGEST_GROUP + 1):
            if at + 2 * width > n or slots[at + width] != slots[at] or slots[at:at + width] != slots[at + width:at + 2 * width]:
                continue
            count = 2
            while slots[at + count * width:at + (count + 1) * width] == slots[at:at + width]:
                count += 1
            if count * width > best * times:
                best, times = width, count
        group = tuple(slots[at:at + best])
        places += [(len(items), k) for _ in range(times) for k in range(best)]
        items.append((group, times > 1))
        at += best * times
    return items, places


def _write_items(items: list[tuple[tuple[str, ...], bool, bool]]) -> str:
    return "\n".join(f"{'*' if rep and opt else '+' if rep else '?' if opt else '1'}" + "\t".join(group) for group, rep, opt in items)


def _read_items(text: str) -> list[tuple[tuple[str, ...], bool, bool]]:
    return [(tuple(line[1:].split("\t")), line[0] in "*+", line[0] in "*?") for line in text.split("\n")] if text else []


def generalise(wrapper: list[tuple[tuple[str, ...], bool, bool]], other: list[tuple[tuple[str, ...], bool, bool]]) -> list[tuple[tuple[str, ...], bool, bool]]:
    """The least union-free expression found that accepts what both accept.

    Groups that match keep their place. A mismatch beside an equal group is a further repeat of that
    group; any other mismatch makes what stands on one side only optional. There are no alternatives.
    """
    out = []

    def put(item: tuple[tuple[str, ...], bool, bool]) -> None:
        if out and out[-1][0] == item[0]:
            out[-1] = (item[0], True, out[-1][2] and item[2])
        else:
            out.append(item)

    match = SequenceMatcher(None, [x[0] for x in wrapper], [x[0] for x in other], autojunk=False)
    for kind, a, b, c, d in match.get_opcodes():
        if kind == "equal":
            for x, y in zip(wrapper[a:b], other[c:d]):
                put((x[0], x[1] or y[1], x[2] or y[2]))
        else:
            for x in [*wrapper[a:b], *other[c:d]]:
                put((x[0], x[1], True))
    return out


def infer(streams: list[str]) -> str:
    """The wrapper of several folded streams or wrappers, aligned one after another."""
    wrapper = None
    for stream in streams:
        items = _read_items(stream)
        wrapper = items if wrapper is None else generalise(wrapper, items)
    return _write_items(wrapper or [])


def aligned(stream: str, wrapper: str) -> list[int]:
    """For each slot of a page's stream its place among the slots of the wrapper, -1 where it has none."""
    items, groups = _read_items(stream), [x[0] for x in _read_items(wrapper)]
    first = [0]
    for group in groups:
        first.append(first[-1] + len(group))
    at = [-1] * len(items)
    for a, b, size in SequenceMatcher(None, [x[0] for x in items], groups, autojunk=False).get_matching_blocks():
        at[a:a + size] = range(b, b + size)
    return [first[k] + n if k >= 0 else -1 for (group, *_), k in zip(items, at) for n in range(len(group))]


def main_blocks(levels: list[int], template: list[bool]) -> list[bool]:
    """Which blocks of a page are main text, by their certainty (-1 for never) and whether they are the host's template.

    A page that names its article or main element is read there, whole. Elsewhere what varies over
    the host's pages is main text, in the surest container that has any, and so is everything that stands
    between two varying blocks of it: only shared texts before the first and after the last of
    them go. A page without varying text keeps its surest container.
    """
    top = max(levels, default=-1)
    if top >= _NAMED:
        return [v >= _NAMED for v in levels]
    varying = [k for k, (v, t) in enumerate(zip(levels, template)) if v >= 0 and not t]
    if not varying:
        return [v == top >= 0 for v in levels]
    top = max(levels[k] for k in varying)
    inside = [k for k in varying if levels[k] == top]
    return [v == top and inside[0] <= k <= inside[-1] for k, v in enumerate(levels)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's blocks, its folded stream, each block's slot in that stream, and a hash of all that may be main text."""
    for batch in batches:
        streams, slots, blocks, seen = [], [], [], []
        for page in batch.column("html").to_pylist():
            found = text_blocks(page)
            items, places = fold([s for s, _ in found])
            first = [0]
            for group, _ in items:
                first.append(first[-1] + len(group))
            streams.append(_write_items([(g, r, False) for g, r in items]))
            slots.append([first[item] + k for item, k in places])
            blocks.append([t for _, t in found])
            seen.append(xxhash.xxh3_64_intdigest("\n".join(t for s, t in found if s[-1] != "-")) - (1 << 63))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(streams, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(blocks, pa.list_(pa.string())), pa.array(seen, pa.int64())],
                                         names=["page_id", "url", "host", "stream", "slots", "blocks", "seen"])


def _infer_group(group: pd.DataFrame) -> pd.DataFrame:
    order = group.sort_values(["pages", "stream"], ascending=[False, True])
    return pd.DataFrame({"host": [order["host"].iloc[0]], "stream": [infer(list(order["stream"]))], "pages": [int(order["pages"].sum())]})


def _align_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place in the host's wrapper and the certainty (-1 for never) of each slot of a stream."""
    for batch in batches:
        streams = batch.column("stream").to_pylist()
        places = [aligned(s, w) for s, w in zip(streams, batch.column("wrapper").to_pylist())]
        levels = [[-1 if slot[-1] == "-" else int(slot[-1]) for group, *_ in _read_items(s) for slot in group] for s in streams]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host_id", "stream_id", "pages")), pa.array(places, pa.list_(pa.int32())), pa.array(levels, pa.list_(pa.int32()))],
                                         names=["host_id", "stream_id", "pages", "places", "levels"])


def _sightings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a page that may be main text, once for each aligned slot."""
    for batch in batches:
        out = []
        for host, seen, slots, texts, places, levels in zip(*(batch.column(c).to_pylist() for c in ("host_id", "seen", "slots", "texts", "places", "levels"))):
            out += {(host, places[s], t, seen) for s, t in zip(slots, texts) if 0 <= levels[s] < _NAMED and places[s] >= 0}
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["host_id", "place", "text", "seen"])


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for blocks, texts, slots, places, levels, template in zip(*(batch.column(c).to_pylist() for c in ("blocks", "texts", "slots", "places", "levels", "template"))):
            known = {(x["place"], x["text"]) for x in template or ()}
            main = main_blocks([levels[s] for s in slots], [(places[s], t) in known for s, t in zip(slots, texts)])
            out.append(" ".join(b for b, m in zip(blocks, main) if m))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def infer_wrappers(streams: DataFrame, merged_streams: int = MERGED_STREAMS) -> DataFrame:
    """(host, wrapper) from the distinct streams (host, stream, pages) of all pages.

    A host's streams are aligned in parts of about ``merged_streams``; the parts' wrappers are
    streams again and are aligned in the next round, until each host has one. No task holds more
    than a part, whatever the size of a host.
    """
    while True:
        parts = streams.groupBy("host").agg(F.ceil(F.count("*") / merged_streams).cast("int").alias("parts"))
        most = parts.agg(F.max("parts")).first()[0] or 1
        dealt = lookup_join(streams, parts, ["host"]).withColumn("part", F.pmod(F.xxhash64("stream"), F.col("parts")))
        streams = stage_table(dealt.groupBy("host", "part").applyInPandas(_infer_group, "host string, stream string, pages long"), "wrappers")
        if most == 1:
            return streams.select("host", F.col("stream").alias("wrapper"))


def template_texts(parsed: DataFrame, streams: DataFrame) -> DataFrame:
    """(host_id, template): the texts, each with its place in the wrapper, that a host's pages share.

    Pages are counted once for each distinct content. A host's texts are at most twice as many as an
    average page has, since each is in half of the pages of its slot.
    """
    slots = streams.select("host_id", "pages", F.explode(F.arrays_zip("places", "levels")).alias("x")).where("x.places >= 0 and x.levels >= 0")
    slots = slots.groupBy("host_id", F.col("x.places").alias("place")).agg(F.sum("pages").alias("slot_pages"), F.max("x.levels").alias("level")).where(F.col("level") < _NAMED)
    seen = lookup_join(parsed.select("stream_id", "seen", "slots", "texts"), streams.drop("pages"), ["stream_id"])
    shared = seen.mapInArrow(_sightings, "host_id long, place int, text long, seen long").groupBy("host_id", "place", "text").agg(F.count_distinct("seen").alias("n")).where(F.col("n") >= TEMPLATE_PAGES)
    constant = lookup_join(shared, slots, ["host_id", "place"]).where(2 * F.col("n") >= F.col("slot_pages"))
    return constant.groupBy("host_id").agg(F.collect_list(F.struct("place", "text")).alias("template"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Every page becomes a stream of text slots; immediate repeats are folded. The distinct streams of a host
    are aligned into one wrapper with optional and repeated groups. A text that the host's pages
    repeat at the same slot of it is template, what varies is main text with all that stands between; article and
    main elements are read whole, and other containers' names decide between varying slots. Menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles and comments are never main text.

    A null html is empty and gives an empty text; a null url has no host and shares the wrapper of
    the empty one; repeated rows are extracted each; unclosed elements, cut pages and very long pages
    are read to their end; an empty table gives an empty result. Other columns are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][^:/?#]*://([^/?#]*)", 1)))
    parsed = stage_table(rows.mapInArrow(_parse, "page_id long, url string, host string, stream string, slots array<int>, blocks array<string>, seen long"), "page-streams")
    parsed = parsed.withColumns({"stream_id": F.xxhash64("host", "stream"), "texts": F.transform("blocks", lambda block: F.xxhash64(block))})
    pages = parsed.groupBy("stream_id").agg(F.count_distinct("seen").alias("pages"))
    streams = stage_table(lookup_join(parsed.select("host", "stream", "stream_id").distinct(), pages, ["stream_id"]), "streams")
    placed = lookup_join(streams.withColumn("host_id", F.xxhash64("host")), infer_wrappers(streams.select("host", "stream", "pages")), ["host"])
    placed = stage_table(placed.mapInArrow(_align_streams, "host_id long, stream_id long, pages long, places array<int>, levels array<int>"), "aligned-streams")
    marked = lookup_join(placed, template_texts(parsed, placed), ["host_id"], "left")
    read = lookup_join(parsed.select("page_id", "url", "slots", "blocks", "texts", "stream_id"), marked.select("stream_id", "places", "levels", "template"), ["stream_id"])
    return read.mapInArrow(_read_pages, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
