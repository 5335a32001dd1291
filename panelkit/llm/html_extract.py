"""Main text of web pages by union-free wrapper inference.

Each page becomes a stream of tags and text slots; streams of one host are
aligned one after the other, mismatches become optional or repeated groups, and
the result is the host's wrapper, a regular expression without unions.  Each
page is matched against it, which gives every text of the page its slot.  The
article is what stands inside the container (an element chosen by name and class).
On pages without one, slots whose text is the same all over the host are template,
unless they stand beside text that varies, as headings of an article do.

Pages are first reduced to their structure with repeats folded, and equal
structures of a host are counted together, so inference sees every page but its
work follows the number of different structures."""

from __future__ import annotations

import html
import re
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_texts, materialise, on_workers, texts

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("nav header footer aside form button menu dialog".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that mark what is no article text.
BOILER_WORDS = frozenset("""ad ads adv advert advertisement advertising banner sponsor sponsored promo menu nav navbar navigation
    breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus reply replies cookie cookies consent notice notices
    popup modal newsletter subscribe share sharing social related recommended widget toolbar pagination pager login signup
    complementary contentinfo""".split())
#: Those that a heading of the article may have.
HEADING = frozenset("header masthead".split())
#: Other parts that a name made of such words may have.
AFFIXES = frozenset("site global list links posts buttons box slot unit form".split())
#: One of the words as any part of a name: no such element is chosen as the container.
BOILER = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(sorted(BOILER_WORDS))})(?:$|[\s_-])")
#: Words in class, id or role that mark the article where no element does.
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text)(?:$|[\s_-])")
#: Different pages that hold a slot at least, and the share of the host's, for its constant text to be template.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.1
#: Steps of matching a page by trying; beyond them sets of states find the same match.
TRIED_STEPS = 200_000
#: Widths of repeated segments that are all tried; wider ones where symbols recur at that distance.
NARROW = 24
#: Partial wrappers that one task merges at a time.
FAN_IN = 256
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
                   # a quote that never ends: the tag ends at the next bracket
                   r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Characters that names and marks keep.
PLAIN = re.compile(r"[^a-z0-9_\s-]")


# ---- pages as streams ---------------------------------------------------

def stream(page: str) -> list[tuple[str, str, str]]:
    """Tokens (kind, name, value) of a page: ``open`` and ``close`` with the
    element and its class, id and role words, ``text`` with the raw text.
    Comments, declarations and the content of scripts, styles and the like are
    left out; a tag that is never closed ends with the page."""
    out, at = [], 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            out.append(("text", "", page[at: m.start() if m else len(page)]))
            if m is None:
                break
        at = m.end()
        slash, name, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if not name:
            continue
        name = PLAIN.sub("_", name.lower())
        if slash:
            out.append(("close", name, ""))
            continue
        marks = ""
        if attributes:
            marks = {(a[2] or a[3] or a[4] or "").lower() for a in ATTRIBUTE.finditer(attributes)}
            marks = " ".join(PLAIN.sub("_", " ".join(sorted(marks))).split())
        if name in RAW:  # up to its end tag; without one, to the end
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        out.append(("open", name, marks))
        if name in VOID or attributes.rstrip().endswith("/"):
            out.append(("close", name, ""))
    return out


def symbols(tokens: list[tuple[str, str, str]], held: list[list[str]] | None = None) -> list[str]:
    """The structure: tags with their marks, and ``#`` for a text slot.
    Inline elements are part of the text. ``held`` gets the texts of each slot."""
    out: list[str] = []
    for kind, name, value in tokens:
        if kind == "close" and name in VOID:
            continue
        if kind == "text" or name in INLINE:
            if (kind != "text" or value.strip()) and (not out or out[-1] != "#"):
                out.append("#")
                if held is not None:
                    held.append([])
            if held is not None and kind == "text" and value.strip():
                held[-1].append(value)
        else:
            out.append(f"<{name}{'.' + value.replace(' ', '.') if value else ''}>" if kind == "open" else f"</{name}>")
    return out


# ---- wrappers -----------------------------------------------------------
# A wrapper is a list of items: a symbol, "(a b)+" for a repeated group, and
# either in "( )?" if it is optional. Groups nest; their text is their identity.

def _unit(item: str) -> list[str]:
    """The items inside a repeated group."""
    out, depth = [], 0
    for word in item[1:-2].split(" "):
        if depth:
            out[-1] += " " + word
        else:
            out.append(word)
        depth += word.count("(") - word.count(")")
    return out


def _absorb(items: list[str], unit: list[str]) -> list[str]:
    """Write each stretch of ``unit`` and its repeated group as that group."""
    repeated, width = f"({' '.join(unit)})+", len(unit)
    out, i = [], 0
    while i < len(items):
        if items[i] == repeated or items[i: i + width] == unit:
            i += 1 if items[i] == repeated else width
            if not out or out[-1] != repeated:
                out.append(repeated)
        else:
            out.append(items[i])
            i += 1
    return out


def _widths(items: list[str]) -> list[int]:
    """Widths that a repeated segment may have: all narrow ones, and distances
    at which a symbol recurs (its next three places)."""
    far: set[int] = set()
    if len(items) > 2 * NARROW:
        places: dict[str, list[int]] = {}
        for i, x in enumerate(items):
            mine = places.setdefault(x, [])
            far.update(i - k for k in mine[-3:])
            mine.append(i)
    return [*range(1, NARROW + 1), *sorted(w for w in far if w > NARROW)]


def fold(items: list[str]) -> list[str]:
    """Write runs of equal neighbouring segments as repeated groups."""
    widths, k = _widths(items), 0
    while k < len(widths) and widths[k] <= len(items) // 2:
        width, run = widths[k], 0
        k += 1
        for i, (x, y) in enumerate(zip(items, items[width:])):
            run = run + 1 if x == y else 0
            if run == width:  # two equal segments end here
                items = _absorb(items, items[i + 1: i + 1 + width])
                widths, k = _widths(items), 0  # groups may have made new neighbours
                break
    return items


def _bare(item: str) -> str:
    return item[1:-2] if item.endswith(")?") else item


def align(a: list[str], b: list[str]) -> list[str]:
    """A wrapper for whatever either of two wrappers describes: what they share
    stays, a segment that repeats in one is a repeated group in both, and what
    only one has becomes optional."""
    if a == b:
        return a
    groups = {x for item in (*a, *b) if (x := _bare(item)).endswith(")+")}
    for unit in sorted(map(_unit, groups), key=lambda u: (len(" ".join(u)), u)):
        a, b = _absorb(a, unit), _absorb(b, unit)
    out: list[str] = []
    bare = [list(map(_bare, x)) for x in (a, b)]
    for op, i, j, k, m in SequenceMatcher(None, *bare, autojunk=False).get_opcodes():
        if op == "equal":
            out += [x if x == y else f"({_bare(x)})?" for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [f"({_bare(x)})?" for x in (*a[i:j], *b[k:m])]
    return fold(out)


@lru_cache(4096)
def program(wrapper: str) -> tuple[tuple, ...]:
    """A wrapper as steps of a matcher: (symbol, its slot or -1), or (None,
    where to go on, where else)."""
    steps: list[tuple] = []
    slots = 0

    def emit(item: str) -> None:
        nonlocal slots
        here = len(steps)
        if item.endswith(")?"):
            steps.append(())
            emit(_bare(item))
            steps[here] = (None, here + 1, len(steps))
        elif item.endswith(")+"):
            for x in _unit(item):
                emit(x)
            steps.append((None, here, len(steps) + 1))
        else:
            steps.append((item, slots if item == "#" else -1))
            slots += item == "#"

    for item in wrapper.split("\n") if wrapper else []:
        emit(item)
    return tuple(steps)


def match(wrapper: str, found: list[str]) -> list[int] | None:
    """The slot of the wrapper that each ``#`` of a structure falls in; None if
    the wrapper does not describe it. Optional and repeated groups are entered
    if they can be; no step is tried twice at one place."""
    steps, seen, trail = program(wrapper), set(), []
    todo = [(0, 0, 0)]
    while todo:
        step, at, size = todo.pop()
        del trail[size:]
        while (step, at) not in seen:
            seen.add((step, at))
            if len(seen) > TRIED_STEPS:
                return match_by_sets(steps, found)
            if step == len(steps):
                if at == len(found):
                    return trail
                break
            symbol, first, *other = steps[step]
            if symbol is None:
                todo.append((other[0], at, len(trail)))
                step = first
            elif at < len(found) and found[at] == symbol:
                if first >= 0:
                    trail.append(first)
                step, at = step + 1, at + 1
            else:
                break
    return None


@lru_cache(4)
def next_readers(steps: tuple[tuple, ...]) -> list[int]:
    """For each step, as bits, the steps that may read the next symbol from there
    (bit ``len(steps)``: the end). Loops make it a fixed point, which takes a
    round for each depth of groups or so."""
    m = len(steps)
    reach = [0] * m + [1 << m]
    changed = True
    while changed:
        changed = False
        for k in range(m - 1, -1, -1):
            symbol, first, *other = steps[k]
            bits = reach[first] | reach[other[0]] if symbol is None else 1 << k
            if bits != reach[k]:
                reach[k], changed = bits, True
    return reach


def match_by_sets(steps: tuple[tuple, ...], found: list[str]) -> list[int] | None:
    """The match that ``match`` finds, for long pages: from the end, the set of
    steps that may read each symbol and still lead to the end, as bits of an
    integer; then forward the first such step. Sets are stored at every square
    root of the length, and those between computed again."""
    n, m = len(found), len(steps)
    reach = next_readers(steps)
    readers: dict[str, list[int]] = {}
    for k, (symbol, *_) in enumerate(steps):
        if symbol is not None:
            readers.setdefault(symbol, []).append(k)

    def back(at: int, after: int) -> int:
        out = 0
        for k in readers.get(found[at], ()):
            if reach[k + 1] & after:
                out |= 1 << k
        return out

    def choice(step: int, may: int) -> int | None:
        """The first step in order of preference that is among ``may``."""
        todo, seen = [step], set()
        while todo:
            here = todo.pop()
            if here in seen or not reach[here] & may:
                continue
            if here == m or steps[here][0] is not None:
                return here
            seen.add(here)
            todo += [steps[here][2], steps[here][1]]
        return None

    stride = int(n**0.5) + 1
    stored, alive = {n: 1 << m}, 1 << m
    for at in range(n - 1, -1, -1):
        alive = back(at, alive)
        if at % stride == 0:
            stored[at] = alive
    trail, step = [], 0
    for start in range(0, n + 1, stride):
        stop = min(start + stride, n)
        block = [stored[stop]]
        for at in range(stop - 1, start, -1):
            block.append(back(at, block[-1]))
        if stop > start:
            block.append(stored[start])
        for at in range(start, stop):
            read = choice(step, block[stop - at])
            if read is None:
                return None
            if steps[read][1] >= 0:
                trail.append(steps[read][1])
            step = read + 1
    return trail if reach[step] >> m & 1 else None


def once(wrapper: str) -> list[str]:
    """The structure with each repeated group written once."""
    def flat(item: str) -> list[str]:
        return [y for x in _unit(item) for y in flat(x)] if item.endswith(")+") else [item]

    return [y for item in (wrapper.split("\n") if wrapper else []) for y in flat(item)]


def placed_slots(wrapper: str, found: list[str]) -> list[str]:
    """The slot of each ``#``: that of the wrapper and the tag before it, since
    a slot may follow several optional tags."""
    before = [found[i - 1] if i else "" for i, x in enumerate(found) if x == "#"]
    return [f"{slot} {tag}" for slot, tag in zip(match(wrapper, found) or [], before)]


def held_texts(tokens: list[tuple[str, str, str]]) -> tuple[str, list[int]]:
    """The folded structure of a page, and of each of its slots a hash of the
    texts there. A page that its own structure cannot be matched to has none."""
    held: list[list[str]] = []
    found = symbols(tokens, held)
    wrapper = "\n".join(fold(found))
    texts_of: dict[int, list[str]] = {}
    for slot, words in zip(match(wrapper, found) or [], held):
        texts_of.setdefault(slot, []).append(" ".join("".join(words).split()))
    return wrapper, [xxhash.xxh3_64_intdigest("\0".join(texts_of[k])) - (1 << 63) for k in sorted(texts_of)]


def containers(wrapper: list[str]) -> str:
    """The element that holds the article on the pages of this wrapper: the
    first of article or main, else one whose class, id or role says so, else
    ``body``."""
    tags = re.findall(r"<([a-z][^>]*)>", " ".join(wrapper))
    for tag in tags:
        name, _, marks = tag.partition(".")
        if name in MAIN:
            return name
        if re.search(r"(?:^|\.)main(?:$|\.)", marks):
            return tag
    for tag in tags:
        name, _, marks = tag.partition(".")
        if name in ("div", "section", "td") and CONTENT.search(marks.replace(".", " ")) and not BOILER.search(marks.replace(".", " ")):
            return tag
    return "body"


# ---- reading ------------------------------------------------------------

@lru_cache(4096)
def is_boiler(marks: str, heading: bool = False) -> bool:
    """Whether one of the marks is such a word as a whole, or a compound of
    nothing but such words and affixes: "related-posts", not "with-sidebar".
    ``heading``: header words do not count."""
    words = BOILER_WORDS - HEADING if heading else BOILER_WORDS
    for mark in marks.split():
        parts = [x for x in re.split(r"[_-]+", mark) if x]
        if any(x in words for x in parts) and all(x in words or x in AFFIXES for x in parts):
            return True
    return False


def page_container(wrapper: list[str], structure: list[str]) -> str:
    """The container of the host's wrapper, or where the page does not have it,
    that of its own structure."""
    chosen = containers(wrapper)
    tags = re.findall(r"<([a-z][^>]*)>", " ".join(structure))
    return chosen if any(chosen in (t, t.partition(".")[0]) for t in tags) else containers(structure)


def beside_varying(tokens: list[tuple[str, str, str]], constant: list[bool]) -> list[bool]:
    """``constant`` without the slots that are part of the article: those whose
    block has a block of varying text beside it, in one parent (not the body)."""
    parents: list[int] = []
    stack: list[tuple[str, int]] = []
    slot, in_text = -1, False
    for number, (kind, name, value) in enumerate(tokens):
        if kind == "close" and name in VOID:
            continue
        if kind == "text" or name in INLINE:
            if not in_text and (kind != "text" or value.strip()):
                slot, in_text = slot + 1, True
                over = stack[-2] if len(stack) > 1 else ("body", -1)
                parents.append(-1 if over[0] in ("body", "html") else over[1])
            continue
        in_text = False
        if kind == "open":
            if name not in VOID:
                stack.append((name, number))
        elif any(name == x for x, _ in stack):
            while stack.pop()[0] != name:
                pass
    varying = {p for p, same in zip(parents, constant) if not same} - {-1}
    return [same and p not in varying for p, same in zip(parents, constant)]


def main_text(page: str, container: str, template: list[int] | None) -> str:
    """The article of a page: all that its container holds; where that is the
    body, without the slots of its structure that are template (with them where
    nothing else is there)."""
    tokens = stream(page)
    if template and container == "body":
        found = symbols(tokens)
        slots, constant = match("\n".join(fold(found)), found) or [], set(template)
        text = article(tokens, container, beside_varying(tokens, [k in constant for k in slots]))
        if text:
            return text
    return article(tokens, container)


def article(tokens: list[tuple[str, str, str]], container: str, template: list[bool] | None = None) -> str:
    """Blocks of text inside the container, joined by a blank. Without the
    container on the page, all text but boilerplate. ``template`` tells which
    text slots of the page are left out."""
    tags = [f"{n}.{v.replace(' ', '.')}" if v else n for k, n, v in tokens if k == "open"]
    whole = not any(t == container or t.partition(".")[0] == container for t in tags)
    blocks: list[str] = []
    beside: list[str] = []  # of containers in skipped elements: the article if there is no other
    current: list[str] = []
    read = False
    stack: list[tuple[str, bool, bool, bool]] = []  # (element, skipped, inside the container, which is in a skipped element)

    def flush(to: list[str]) -> None:
        words = html.unescape("".join(current)).split()
        if words:
            to.append(" ".join(words))
        current.clear()

    slot, in_text = -1, False  # as symbols() counts them
    for kind, name, value in tokens:
        skipped, inside, aside = stack[-1][1:] if stack else (False, whole, False)
        if kind == "text" or name in INLINE and not (kind == "close" and name in VOID):
            if not in_text and (kind != "text" or value.strip()):
                slot, in_text = slot + 1, True
        elif not (kind == "close" and name in VOID):
            in_text = False
        if kind == "text":
            if inside and not skipped and not (template and in_text and template[slot]):
                current.append(value)
            continue
        if name not in INLINE:
            flush(beside if aside else blocks)
        if kind == "open":
            tag = f"{name}.{value.replace(' ', '.')}" if value else name
            if not inside and container in (tag, name):  # what it stands in does not matter inside
                inside, aside, skipped = True, skipped, False
                read = read or not aside
            within = inside and not whole
            boiler = bool(value and is_boiler(value, within and container != "body")) or name in SKIP and not (name == "header" and within)
            boiler = boiler and tag != container and name not in (container, "html", "body")
            stack.append((name, skipped or boiler or name == "head", inside, aside))
        else:
            # close the nearest such element and what is open in it; a stray end tag does nothing
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in INLINE:
                        stack.pop(k)
                    else:
                        del stack[k:]
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
    flush(beside if stack and stack[-1][3] else blocks)
    return " ".join(blocks if read or whole else beside)


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer_wrappers(structures: DataFrame) -> DataFrame:
    """Rows (host, wrapper) from rows (host, wrapper, n): wrappers are merged
    in rounds, at most ``FAN_IN`` or so in a task, until each host has one."""
    schema = "host string, wrapper string, n long"
    on_workers(structures.sparkSession)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "wrapper"], ascending=[False, True])
        wrapper = None
        for w in group["wrapper"]:
            items = w.split("\n") if w else []
            wrapper = items if wrapper is None else align(wrapper, items)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": ["\n".join(wrapper)], "n": [int(group["n"].sum())]})

    while True:
        sizes = structures.groupBy("host").agg(F.count("*").alias("parts"))
        most = sizes.agg(F.max("parts")).first()[0] or 0
        if most <= 1:
            return structures.select("host", "wrapper")
        dealt = structures.join(sizes, "host").withColumn(
            "salt", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("parts") / FAN_IN).cast("long")))
        structures = materialise(dealt.drop("parts").groupBy("host", "salt").applyInPandas(
            lambda g: merge(g[["host", "wrapper", "n"]]), schema))


def structure_key() -> F.Column:
    return F.xxhash64("host", "wrapper")


def read_by(structures: DataFrame, wrappers: DataFrame, made: DataFrame) -> DataFrame:
    """Rows (key, container, template): of each structure of a host, the element
    that holds the article and its slots that are template, from ``made``, rows
    (host, wrapper, held) of the different pages.

    A slot of the host's wrapper, after the same tag, is template if all pages that hold it have one
    text there, and these are ``TEMPLATE_PAGES`` and ``TEMPLATE_SHARE`` of the
    host's different pages at least; a host without a slot that varies has
    none."""

    def matched():
        def work(batch):
            whole = batch.column(batch.schema.get_field_index("whole")).to_pylist()
            own = texts(batch)
            slots = [placed_slots(w, once(s)) for s, w in zip(own, whole)]
            return None, [slots, [page_container(w.split("\n"), s.split("\n")) for s, w in zip(own, whole)]]

        return work

    both = (structures.select("host", F.col("wrapper").alias("text"), structure_key().alias("key"))
            .join(wrappers.select("host", F.col("wrapper").alias("whole")), "host"))
    placed = materialise(map_texts(both, "slots array<string>, container string", matched, keep=("host", "key")))
    own = placed.select("host", "key", F.posexplode("slots").alias("place", "slot"))
    # what each slot of a structure holds, then what each slot of the host's wrapper does
    held = (made.select(structure_key().alias("key"), F.posexplode("held").alias("place", "value"))
            .groupBy("key", "place").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("pages")))
    slots = materialise(own.join(held, ["key", "place"]).groupBy("host", "slot").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pages").alias("pages")))
    hosts = made.groupBy("host").agg(F.count("*").alias("all")).join(slots.where("low < high").select("host").distinct(), "host", "left_semi")
    constant = (slots.where(f"low = high AND pages >= {TEMPLATE_PAGES}").join(hosts, "host")
                .where(f"pages >= {TEMPLATE_SHARE} * all").select("host", "slot"))
    template = own.join(constant, ["host", "slot"], "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("template"))
    return placed.select("key", "container").join(template, "key", "left")


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the id, the url, ``text`` (the article's blocks in page
    order, joined by a blank; empty if there is none) and ``n_chars`` (its code
    points).

    Null html is empty and gives an empty text; a null url or one without a
    host shares one wrapper with its like; null ids and repeated rows pass as
    they are; an empty table gives an empty result; other columns are ignored.
    Character references are decoded. On pages without an element that holds the
    article, text that stands in the same slot on all pages of a host, away from
    text that varies, is its template; nothing else of the article is dropped."""
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), host_of(F.col(f"`{url_col}`")).alias("host"),
                     F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("text"))

    def structure():
        def work(batch):
            wrapper, values = zip(*(held_texts(stream(t)) for t in texts(batch)))
            return None, [list(wrapper), list(values)]

        return work

    # pages with equal texts in all slots are one
    made = materialise(map_texts(base.select("host", "text"), "wrapper string, held array<bigint>", structure, keep=("host",))
                       .groupBy("host", "wrapper", "held").agg(F.count("*").alias("n")))
    structures = materialise(made.groupBy("host", "wrapper").agg(F.sum("n").alias("n")))
    chosen = read_by(structures, infer_wrappers(structures), made)

    def keyed():
        def work(batch):
            return None, [["\n".join(fold(symbols(stream(t)))) for t in texts(batch)]]

        return work

    def read():
        def work(batch):
            container, template = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("container", "template"))
            return None, [[main_text(t, c or "body", k) for t, c, k in zip(texts(batch), container, template)]]

        return work

    pages = (map_texts(base, "wrapper string", keyed, keep=("id", "url", "host", "text"))
             .withColumn("key", structure_key()).join(chosen, "key", "left").select("id", "url", "container", "template", "text"))
    out = map_texts(pages, "found string", read, keep=("id", "url"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("found").alias("text"),
                      F.length("found").cast("long").alias("n_chars"))
