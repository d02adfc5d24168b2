"""HTML extraction by union-free regular expressions inferred from pages of one host.

A page becomes a stream of block tags and text slots; adjacent equal runs collapse into a repeated group. The
distinct streams of a host are aligned: what only one side has becomes an optional group, text against text a slot.
Pages are matched against the wrapper of their host, which says in which of its slots each text stands. A slot whose
text hardly varies over the host's pages, and a text that stands in the same slot on most of them, is part of the
template; of the other slots those are content whose text is mostly outside links and that no element or class name
of a menu, notice, advert, form or comment surrounds. Where a page has content inside article or main, that alone is kept.

Pages count as different by the slot with most text on their host (inside articles, if there are), so that copies of an
article are no template; a template needs three.
Headings inside an article are never template texts, so that section titles that an author repeats are kept.

Streams are merged in a tree: no task aligns more than about `fan_in` wrappers, whatever the number of a host's pages.
Where the wrappers together are small (their size is checked) they are broadcast, else joined by host.

Null html gives an empty text; a null url counts as a host of its own. A page that its wrapper does not match is
judged slot by slot, by the elements around it and by its links. Repeated rows each have a row. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, materialise, release, small_batches

RAW = "script|style|noscript|template|textarea|iframe|svg|canvas|select|title"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msubsup msup mtext nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
OUTSIDE = frozenset("nav footer aside form button dialog menu head input figure-ad".split())
#: Words of class names, ids and roles that tell what is not the article's; on a block of text only as a whole name.
BESIDE = frozenset("ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer footers masthead menu menus modal modals nav navbar navigation newsletter newsletters pager pagination popup popups promo promos promotion promotions sidebar sidebars sponsor sponsored toolbar widget widgets".split())
#: Words that tell so as a whole name, or before a word of PARTS.
UNSURE = frozenset("alert alerts header headers hidden login notice notices recommended related replies reply respond responses share sharing signup skip social subscribe tags toc".split())
PARTS = frozenset("area articles bar block box button buttons container content form icons items links list media news posts section stories widget wrapper".split())
TEXTUAL = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def parse(html: str) -> tuple[list[str], list[tuple[str, str, int]]]:
    """The stream of block tags and '#', and for each '#' its (path of open blocks, text, characters inside links)."""
    stream: list[str] = []
    slots: list[tuple[str, str, int]] = []
    stack: list[str] = []
    text: list[str] = []
    links = linked = 0

    def flush():
        nonlocal linked
        if text:
            if block := " ".join(entities.unescape("".join(text)).split()):
                stream.append("#")
                slots.append(("/".join(stack), block, linked))
            text.clear()
        linked = 0

    def close(k: int):
        while len(stack) > k:
            stream.append("/" + stack.pop())

    def last(names, stop=()) -> int:
        for k in range(len(stack) - 1, -1, -1):
            name = stack[k].partition(".")[0]
            if name in names:
                return k
            if name in stop:
                break
        return -1

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                links = 0 if m[2] else 1
            continue
        flush()
        if m[2]:
            k = last((name,))
            if k >= 0:
                close(k)
            continue
        if name in CLOSES_P and (k := last(("p",), ("td", "th", "li", "div", "article", "section", "body"))) >= 0:
            close(k)
        if name in CLOSES and (k := last(CLOSES[name], ("ul", "ol", "dl", "table", "select"))) >= 0:
            close(k)
        marks = ""
        if m[4].strip(" /"):
            got = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(m[4])}
            marks = " ".join(got.get(x, "") for x in ("class", "id", "role"))
            if "hidden" in got or got.get("aria-hidden") == "true":
                marks += " hidden"
            marks = " ".join(re.sub(r"\d+|/", "", marks).split())
        label = f"{name}.{marks}" if marks else name
        if name in VOID:
            stream.append(label)
        else:
            stack.append(label)
            stream.append(label)
    if at < len(html):
        text.append(html[at:])
    flush()
    close(0)
    return stream, slots


# A wrapper is a list of nodes: a token, ["?", nodes] for an optional group or ["+", nodes] for a repeated one.


def collapse(nodes: list, longest: int = 24) -> list:
    """Adjacent equal runs become one repeated group; runs start at an opening tag and are balanced."""
    out: list = []
    for node in nodes:
        out.append(node)
        if isinstance(node, str) and not node.startswith("/"):
            continue
        for n in range(1, min(longest, len(out)) + 1):
            run = out[-n:]
            if not (isinstance(run[0], list) or run[0][0] not in "/#") or not _balanced(run):
                continue
            before = out[-n - 1] if len(out) > n else None
            if isinstance(before, list) and before[0] == "+" and before[1] == run:
                del out[-n:]
                break
            if len(out) >= 2 * n and out[-2 * n : -n] == run:
                out[-2 * n :] = [run[0] if n == 1 and isinstance(run[0], list) and run[0][0] == "+" else ["+", run]]
                break
    return out


def _balanced(run: list) -> bool:
    depth = 0
    for x in run:
        if isinstance(x, str) and x != "#":
            depth += -1 if x[0] == "/" else x.partition(".")[0] not in VOID
            if depth < 0:
                return False
    return depth == 0


def units(nodes: list, found: list | None = None) -> list:
    """The bodies of all repeated groups."""
    found = [] if found is None else found
    for x in nodes:
        if isinstance(x, list):
            units(x[1], found)
            if x[0] == "+" and x[1] not in found:
                found.append(x[1])
    return found


def lift(nodes: list, bodies: list) -> list:
    """Single occurrences of what repeats elsewhere become repeated groups too."""
    for body in bodies:
        out, i, n = [], 0, len(body)
        while i < len(nodes):
            if nodes[i : i + n] == body:
                if not (out and out[-1] == ["+", body]):
                    out.append(["+", body])
                i += n
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return [[x[0], lift(x[1], [b for b in bodies if b != x[1]])] if isinstance(x, list) else x for x in nodes]


def align(a: list, b: list) -> list:
    """A union-free expression for both: unmatched runs of either side become optional groups."""
    bodies = units(a)
    units(b, bodies)
    a, b = lift(a, bodies), lift(b, bodies)
    bare = lambda x: json.dumps(x[1] if isinstance(x, list) and x[0] == "?" and len(x[1]) == 1 else x)
    ka, kb = [bare(x) for x in a], [bare(x) for x in b]
    out: list = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [x if isinstance(x, list) and x[0] == "?" else y for x, y in zip(a[i:j], b[k:m], strict=True)]
            continue
        for side in (a[i:j], b[k:m]):
            run: list = []
            for x in [*side, None]:
                if x is None or isinstance(x, list) and x[0] == "?":
                    if run:
                        out.append(["?", run])
                    run = []
                    if x is not None:
                        out.append(x)
                else:
                    run.append(x)
    return out


def match(nodes: list, stream: list[str], i: int = 0) -> int:
    """Where a greedy match of nodes from i ends, -1 if there is none."""
    for x in nodes:
        if isinstance(x, str):
            if i >= len(stream) or stream[i] != x:
                return -1
            i += 1
        elif x[0] == "?":
            i = j if (j := match(x[1], stream, i)) >= 0 else i
        else:
            j = match(x[1], stream, i)
            if j < 0:
                return -1
            while j > i:
                i, j = j, match(x[1], stream, j)
    return i


def numbered(nodes: list, count: list[int] | None = None) -> list:
    """The wrapper with its slots as numbers, in order."""
    count = [0] if count is None else count
    out: list = []
    for x in nodes:
        if x == "#":
            out.append(count[0])
            count[0] += 1
        else:
            out.append([x[0], numbered(x[1], count)] if isinstance(x, list) else x)
    return out


def trace(nodes: list, stream: list[str], got: list[int], i: int = 0) -> int:
    """As match, for a numbered wrapper; got takes the number of the slot of each text."""
    for x in nodes:
        if isinstance(x, list):
            n = len(got)
            j = trace(x[1], stream, got, i)
            if j < 0:
                del got[n:]
                if x[0] == "+":
                    return -1
                continue
            while x[0] == "+" and j > i:
                i, n = j, len(got)
                j = trace(x[1], stream, got, i)
            if j < 0:
                del got[n:]
            else:
                i = j
            continue
        if i >= len(stream) or stream[i] != ("#" if isinstance(x, int) else x):
            return -1
        if isinstance(x, int):
            got.append(x)
        i += 1
    return i


def places(wrapper: list | None, stream: list[str]) -> list[int] | None:
    """The slot of each text of the page; None if the (numbered) wrapper does not match."""
    got: list[int] = []
    return got if wrapper is not None and trace(wrapper, stream, got) == len(stream) else None


@lru_cache(100_000)
def beside(label: str) -> bool:
    """Of an element's name, classes, id and role: it is none of the article's."""
    name, _, marks = label.partition(".")
    if name in OUTSIDE:
        return True
    if name in ("body", "html", "article", "main"):
        return False
    for mark in marks.lower().split():
        words = re.split("[-_]+", mark)
        if mark in BESIDE or mark in UNSURE:
            return True
        if name not in TEXTUAL and (not BESIDE.isdisjoint(words) or any(a in UNSURE and b in PARTS for a, b in zip(words, words[1:], strict=False))):
            return True
    return False


def outside(path: str) -> bool:
    """Inside an element that is never the article's."""
    within = False
    for label in path.split("/"):
        name = label.partition(".")[0]
        within = within or name in ("article", "main")
        if name == "header" and not within or beside(label):
            return True
    return False


def in_article(path: str) -> bool:
    return any(x.partition(".")[0] in ("article", "main") for x in path.split("/"))


def is_heading(path: str) -> bool:
    return path.rpartition("/")[2].partition(".")[0] in HEADINGS


def fixed(pages: int, kinds: int) -> bool:
    return pages >= 3 and kinds <= max(1, 0.2 * pages)


def slot_verdicts(stats: list[dict]) -> dict[int, bool]:
    """Slots of a wrapper that are content. stats: slot, path, pages, kinds (distinct texts of it), chars, linked."""
    keep = lambda s: not outside(s["path"]) and not fixed(s["pages"], s["kinds"]) and (in_article(s["path"]) or 2 * s["linked"] <= s["chars"])
    return {s["slot"]: keep(s) for s in stats}


def paths_of(stream: list[str]) -> list[str]:
    """The open blocks around each text."""
    stack: list[str] = []
    out = []
    for x in stream:
        if x == "#":
            out.append("/".join(stack))
        elif x[0] == "/":
            stack.pop()
        elif x.partition(".")[0] not in VOID:
            stack.append(x)
    return out


def main_text(stream: list[str], texts: list[str], linked: list[int], wrapper: list | None, content: dict[int, bool], template: frozenset) -> tuple[str, bool]:
    """The article and whether the (numbered) wrapper matched. template: (slot, hash of the text) of fixed texts."""
    paths, slots = paths_of(stream), places(wrapper, stream)
    if slots is None:
        found = [(p, t) for p, t, n in zip(paths, texts, linked, strict=True) if not outside(p) and (in_article(p) or 2 * n <= len(t))]
    else:
        found = [(p, t) for s, p, t in zip(slots, paths, texts, strict=True) if content.get(s, False) and (s, hash_text(t)) not in template]
    article = any(in_article(p) for p, _ in found)
    return "\n".join(t for p, t in found if in_article(p) or not article), slots is not None


def _fold(shapes: list[str]) -> str:
    wrapper: list | None = None
    for s in sorted(shapes, key=lambda s: (-len(s), s)):
        nodes = json.loads(s)
        wrapper = nodes if wrapper is None else collapse(align(wrapper, nodes))
    return json.dumps(wrapper or [])


def _folded(key, frame):
    import pandas as pd

    return pd.DataFrame({"host": [key[0]], "at": [int(key[1])], "shape": [_fold(list(frame["shape"]))]})


def host_wrappers(shapes: DataFrame, fan_in: int) -> DataFrame:
    """host, wrapper: the distinct shapes of each host, merged level by level."""
    dealt = shapes.distinct().withColumn("at", F.pmod(F.xxhash64("shape"), F.lit(2**30)))
    most = dealt.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    width = 1
    while width * fan_in < most:
        width *= fan_in
    while True:
        dealt = dealt.withColumn("at", F.pmod("at", F.lit(width))).groupBy("host", "at").applyInPandas(_folded, "host string, at long, shape string")
        if width == 1:
            return dealt.select("host", F.col("shape").alias("wrapper"))
        width //= fan_in


def extract_pages(pages: DataFrame, broadcast_bytes: int = 8_000_000, fan_in: int = 16) -> DataFrame:
    """page_id, url, text, n_chars and whether the host's wrapper matched, for every row of pages."""
    spark = pages.sparkSession
    small_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))

    def parsed(it):
        for batch in batches(it, 500):
            cols: list[list] = [[] for _ in SEEN]
            for page in batch.column("html").to_pylist():
                stream, found = parse(page)
                row = json.dumps(collapse(stream)), "\n".join(stream), [hash_text(t) for _, t, _ in found], [len(t) for _, t, _ in found], [n for _, _, n in found]
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("host"), *(pa.array(c, t) for c, t in zip(cols, SEEN.values(), strict=True))], ["host", *SEEN])

    # of the texts only hashes and lengths are written; the last step parses the pages again
    seen = materialise(rows.select("html", "host").mapInArrow(parsed, "host string, shape string, stream string, texts array<long>, chars array<int>, linked array<int>"), "html-parsed")
    wrappers = materialise(host_wrappers(seen.select("host", "shape"), fan_in), "html-wrappers")
    release(spark)  # shuffle files of what is written go before more are made, here and below

    def with_model(pages: DataFrame, model: DataFrame, size: str) -> DataFrame:
        total = model.agg(F.sum(F.expr(size))).first()[0] or 0
        return pages.join(F.broadcast(model) if total <= broadcast_bytes else model, "host", "left")

    def loaded(known: dict, *key):
        if key not in known:
            if len(known) > 2000:
                known.clear()
            w, s, t = (*key, None, None)[:3]
            known[key] = (numbered(json.loads(w)) if w else None, {int(k): v for k, v in json.loads(s).items()} if s else {}, frozenset(map(tuple, json.loads(t))) if t else frozenset())
        return known[key]

    def slots(it):
        known: dict = {}
        told: set = set()  # a slot's path is told once a task

        def first(*key):
            if len(told) > 200_000:
                told.clear()
            return None if key in told else told.add(key) or key[2]

        for batch in batches(it, 500):
            out = []
            for h, w, stream, texts, chars, linked in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "stream", "texts", "chars", "linked")), strict=True):
                stream = stream.split("\n") if stream else []
                at = places(loaded(known, w)[0], stream)
                if not at:
                    continue
                rows = list(zip(at, texts, chars, linked, strict=True))
                page = hash_text(repr(sorted(rows)))
                out += [(h, page, *r, first(h, r[0], p)) for r, p in zip(rows, paths_of(stream), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS.values(), strict=True)], list(KINDS))

    found = with_model(seen.drop("shape"), wrappers, "length(wrapper) + length(host)").mapInArrow(slots, "host string, page long, slot int, text long, chars int, linked int, path string")
    sums = [F.max("chars").alias("chars"), F.max("linked").alias("linked"), F.min("path").alias("path")]
    slots_seen = once = materialise(found.groupBy("host", "slot", "page", "text").agg(*sums), "html-slots")
    del found
    release(spark)
    where = materialise(once.groupBy("host", "slot").agg(F.min("path").alias("path")), "html-paths")
    inside = where.where(F.col("path").rlike("(^|/)(article|main)([./]|$)")).select("host", "slot", F.lit(True).alias("inside"))
    kind = F.bit_xor("text").alias("kind")
    # the slot with most text over its different contents, inside articles if there are, is the body; pages of equal bodies count as one
    bodies = materialise(once.groupBy("host", "slot", "page").agg(kind, F.sum("chars").alias("chars")), "html-bodies")
    release(spark)
    volume = bodies.groupBy("host", "slot", "kind").agg(F.max("chars").alias("chars")).groupBy("host", "slot").agg(F.sum("chars").alias("chars"))
    volume = volume.join(inside, ["host", "slot"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    body = volume.groupBy("host").agg(F.max_by("slot", F.struct("inside", "chars", -F.col("slot"))).alias("slot"))
    same = bodies.join(F.broadcast(body) if body.count() <= 100_000 else body, ["host", "slot"]).select("host", "page", F.col("kind").alias("body"))
    once = once.join(same, ["host", "page"], "left").withColumn("page", F.coalesce("body", "page")).groupBy("host", "slot", "page", "text").agg(*sums)
    both = [F.sum("chars").alias("chars"), F.sum("linked").alias("linked")]
    kinds = once.groupBy("host", "slot", "page").agg(kind, *both).groupBy("host", "slot", "kind").agg(F.count(F.lit(1)).alias("n"), *both)
    stats = kinds.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("kinds"), *both).join(where, ["host", "slot"])
    stats = materialise(stats.select("host", "slot", "path", "pages", "kinds", "chars", "linked"), "html-stats")
    release(spark)
    often = once.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").join(stats.select("host", "slot", "pages", F.col("path").alias("where")), ["host", "slot"]).where("n >= 0.8 * pages")

    def judged(key, frame):
        import pandas as pd

        slots = slot_verdicts(frame[frame["text"].isna()].to_dict("records"))
        texts = frame[frame["text"].notna()]
        template = sorted((int(s), int(t)) for s, t, p in zip(texts["slot"], texts["text"], texts["path"], strict=True) if not (in_article(p) and is_heading(p)))
        return pd.DataFrame({"host": [key[0]], "content": [json.dumps({str(k): bool(v) for k, v in sorted(slots.items())})], "template": [json.dumps(template)]})

    none = F.lit(None).cast("string")
    told = stats.withColumn("text", none).unionByName(often.select("host", "slot", F.col("where").alias("path"), *(F.lit(0).cast("long").alias(c) for c in ("pages", "kinds", "chars", "linked")), F.col("text").cast("string").alias("text")))
    chosen = told.groupBy("host").applyInPandas(judged, "host string, content string, template string")
    model = materialise(wrappers.join(chosen, "host", "left"), "html-model")
    for done in (seen, wrappers, slots_seen, where, bodies, stats):
        discard(done)
    release(spark)
    joined = with_model(rows, model, "length(wrapper) + length(host) + coalesce(length(content) + length(template), 0)")

    def texts(it):
        known: dict = {}
        for batch in batches(it, 500):
            out, ok = [], []
            for w, s, t, page in zip(*(batch.column(c).to_pylist() for c in ("wrapper", "content", "template", "html")), strict=True):
                stream, found = parse(page)
                text, matched = main_text(stream, [x for _, x, _ in found], [n for _, _, n in found], *loaded(known, w, s, t))
                out.append(text)
                ok.append(matched)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(ok, pa.bool_())], ["page_id", "url", "text", "n_chars", "matched"])

    return joined.mapInArrow(texts, "page_id long, url string, text string, n_chars long, matched boolean")


SEEN = {"shape": pa.string(), "stream": pa.string(), "texts": pa.list_(pa.int64()), "chars": pa.list_(pa.int32()), "linked": pa.list_(pa.int32())}
KINDS = {"host": pa.string(), "page": pa.int64(), "slot": pa.int32(), "text": pa.int64(), "chars": pa.int32(), "linked": pa.int32(), "path": pa.string()}


def hash_text(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s) - 2**63
