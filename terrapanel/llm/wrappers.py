"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of structural tags and text slots.  Runs of equal neighbours are
folded into repeated groups, innermost first; two streams of a host are aligned,
and where they differ the differing parts become optional groups (or, where one
side repeats what the other has once, the repeated group).  Text always becomes a
slot.  What is left after all pages of a host is its wrapper.

Inference is a fold that can be split anywhere: every task folds the pages it
reads into one wrapper per host, those are folded in slices per host, and the
slices into one.  Beside the structure, a wrapper knows which texts stand in the same
slot on all pages of its host: those are the template's, the other slots are data.
Its slots are then told apart by the elements that hold them; of the content slots a
page fills, those of its article are its text, and where no element names an
article, all that is not template.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import OrderedDict
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import send_if_small, whole_groups
from terrapanel.llm.urlrules import split_url
from terrapanel.session import cut_lineage

# Kinds of elements and names that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title svg iframe select"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()) | frozenset(
    # Formulae inside a line of text.
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle semantics annotation".split()
)
CHROME_TAGS = frozenset(f"nav footer aside button dialog menu head {RAW}".split())
# Elements that are chrome unless they are around the page: they hold its article, or most of its text.
AROUND = frozenset("form header".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies "
    "consent notice notices alert popup modal overlay comment comments reply replies respond discussion footer masthead share sharing social newsletter subscribe "
    "subscription related recommended search login signup toolbar pagination pager widget widgets skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies".split())
ADVERT_WORDS = frozenset("ad advert advertisement sponsored".split())
# Words beside which a name tells of the layout or of what is not there: no-sidebar, ad-free, overflow-hidden, search-results.
LAYOUT_WORDS = frozenset("no not non without with has have free open opened closed enabled disabled overflow layout result results supported".split())
# Words that may stand beside those in a name inside an article: related-posts, share-buttons; not related-work, comment-count.
FILLER_WORDS = frozenset("area bar block body box button buttons container content inline item items left link links list main post posts right section slot text title top unit wrapper".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_LEX = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?<=/)>|<(" + "|".join(RAW.split()) + r")(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Hosts a task folds at a time; further ones make it hand over the one it hasn't met for longest.
HOSTS_AT_ONCE, SLICES, LONGEST_UNIT = 2_000, 16, 12
# Token streams a task remembers the folded form of.
STREAMS = 10_000


def words_of(names: str) -> set[str]:
    """Words of the class names or ids in an attribute that say what the element is.

    A name that tells of the layout, or of what there isn't, says nothing.
    """
    found: set[str] = set()
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", name))}
        if not words & LAYOUT_WORDS:
            found |= words
    return found


def plain_words_of(names: str) -> set[str]:
    """The same, of those names alone that say nothing else."""
    found: set[str] = set()
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", name))}
        if words <= CHROME_WORDS | FILLER_WORDS:
            found |= words
    return found


def element(name: str, attributes: str, inside: bool = False) -> str:
    """An element as the wrapper knows it: its name, and a mark if class, id or role say it isn't the article's.

    Roles and comments are certain (two marks); other names are believed unless
    what the element holds speaks against them (one mark).  Of an article, and
    ``inside`` one, only names that say nothing else are believed, and no id of
    a section, paragraph or heading, which is where links lead to.
    """
    marks: set[str] = set()
    role = ""
    strict = inside or name == "article"
    anchor = inside and (name in ("section", "p") or name[:1] == "h" and name[1:].isdigit())
    for key, *values in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role"):
            value = next((v for v in values if v), "")
            if key == "role":
                role = value.lower().strip()
            if not (anchor and key == "id"):
                marks |= plain_words_of(value) if strict else words_of(value)
    free = name in ("html", "body", "main")
    if role in CHROME_ROLES or (marks & COMMENT_WORDS and not free):
        return name + "!!"
    if marks & (ADVERT_WORDS if name == "article" else CHROME_WORDS) and not free:
        return name + "!"
    if "header" in marks and name in ("div", "section"):
        return "header"
    return "main" if role == "main" else name


class Page:
    """The structural stream of a page: tokens, and for each text run the path of elements around it.

    Inline elements are part of the text.  Elements that are left open are closed
    as browsers close them: paragraphs and list items by what can't be inside them,
    anything else by the end of what it is in.
    """

    def __init__(self, html: str | None):
        self.tokens: list[str] = []
        self.blocks: list[tuple[tuple[str, ...], str]] = []
        stack: list[tuple[str, str]] = []
        text: list[str] = []
        position = 0
        source = html or ""

        def known(name: str, attributes: str) -> str:
            return element(name, attributes, any(known in ("article", "main") for _, known in stack))

        def flush() -> None:
            if text:
                words = " ".join("".join(text).split())
                text.clear()
                if words:
                    self.tokens.append("#")
                    self.blocks.append((tuple(known for _, known in stack), words))

        def close(upto: int) -> None:
            flush()
            while len(stack) > upto:
                self.tokens.append("/" + stack.pop()[1])

        for found in _LEX.finditer(source):
            if found.start() > position:
                text.append(html_lib.unescape(source[position : found.start()]))
            position = found.end()
            name = found[3]
            if name is None:
                continue
            name = name.lower()
            if name in INLINE:
                marked = known(name, found[4]) if not found[2] else name
                if marked.endswith("!") and found[4].strip().endswith("/") is False:
                    flush()
                    stack.append((name, marked))
                    self.tokens.append(marked)
                elif found[2] and stack and stack[-1][0] == name:
                    close(len(stack) - 1)
                continue
            if name in VOID:
                if name == "br":
                    text.append(" ")
                elif name == "hr":
                    flush()
                continue
            if found[2]:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if at is not None:
                    close(at)
                else:
                    flush()
                continue
            flush()
            if name in CLOSES_P:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
                if at is not None:
                    close(at)
            if name in SIBLINGS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in SIBLINGS[name]:
                        close(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select", "div", "section", "article"):
                        break
            if found[4].rstrip().endswith("/"):
                continue
            stack.append((name, known(name, found[4])))
            self.tokens.append(stack[-1][1])
        if position < len(source):
            text.append(html_lib.unescape(source[position:].partition("<")[0] if re.match(r"</?[a-zA-Z!]", source[position:]) else source[position:]))
        close(0)


# A wrapper is a tuple of items (core, optional); a core is a token or ("+", items).


def fold(items: list) -> list:
    """Neighbouring equal runs of items become one repeated group, shortest runs first, until none is left.

    A repeated group next to a single copy of what it repeats takes the copy in.
    A run that opens or closes an element without the other end is no unit: a
    group of such would change the paths of what follows it.
    """
    items = list(items)
    changed = True
    while changed:
        changed = False
        for length in range(1, LONGEST_UNIT + 1):
            out: list = []
            i = 0
            while i < len(items):
                unit = tuple(items[i : i + length])
                end = i + length
                if len(unit) == length and length > 1 or (len(unit) == 1 and _is_group(unit[0])):
                    while tuple(items[end : end + length]) == unit:
                        end += length
                if end > i + length and _is_whole(unit):
                    single = length == 1
                    out.append(unit[0] if single else (("+", unit), False))
                    changed = True
                    i = end
                elif len(unit) == length and length > 1 and out and out[-1][0] == ("+", unit):
                    changed = True
                    i += length
                elif len(unit) == length and length > 1 and tuple(items[i + length : i + length + 1]) in (((("+", unit), False),), ((("+", unit), True),)):
                    changed = True
                    out.append((("+", unit), False))
                    i += length + 1
                else:
                    out.append(items[i])
                    i += 1
            items = out
    return items


def _is_group(item) -> bool:
    return isinstance(item[0], tuple)


def _is_whole(unit: tuple) -> bool:
    """Whether every element the unit opens is closed in it, and the other way round."""
    depth = 0
    for core, _ in unit:
        if not isinstance(core, tuple) and core != "#":
            depth += -1 if core.startswith("/") else 1
            if depth < 0:
                return False
    return depth == 0


def _placed(items: list, paths: dict[tuple[int, str], int]) -> list[tuple[int, object]]:
    """(number of the path of open elements around it, core) of every item; an end has the path of its start."""
    open_paths, out = [0], []
    for core, _ in items:
        if isinstance(core, tuple) or core == "#":
            out.append((open_paths[-1], core))
        elif core.startswith("/"):
            if len(open_paths) > 1:
                open_paths.pop()
            out.append((open_paths[-1], core))
        else:
            out.append((open_paths[-1], core))
            open_paths.append(paths.setdefault((open_paths[-1], core), len(paths) + 1))
    return out


def wrapper_of(tokens: list[str]) -> tuple:
    return tuple(fold([(t, False) for t in tokens]))


def _grouped_like(items: tuple, other: tuple) -> list:
    """``items`` with single copies of what the other stream repeats turned into repeated groups."""
    units = sorted({core[1] for core, _ in other if isinstance(core, tuple)}, key=len, reverse=True)
    out = list(items)
    for unit in units:
        n, i, seen = len(unit), 0, []
        while i < len(out):
            if tuple(out[i : i + n]) == unit:
                seen.append((("+", unit), False))
                i += n
            else:
                seen.append(out[i])
                i += 1
        out = seen
    return fold(out)


def merge(a: tuple, b: tuple) -> tuple:
    """The wrapper of everything two wrappers describe.

    Items are aligned by what they are and the elements they are in.  A stretch
    where the two differ has no item in common, so that both its sides begin and
    end in the same element: read one after the other, every item keeps its path.
    """
    if a == b:
        return a
    left, right = _grouped_like(a, b), _grouped_like(b, a)
    paths: dict[tuple[int, str], int] = {}
    matcher = SequenceMatcher(None, _placed(left, paths), _placed(right, paths), autojunk=False)
    out: list = []
    for kind, i, j, k, m in matcher.get_opcodes():
        if kind == "equal":
            out += [(x[0], x[1] or y[1]) for x, y in zip(left[i:j], right[k:m])]
        else:
            out += [(core, True) for core, _ in left[i:j]] + [(core, True) for core, _ in right[k:m]]
    return tuple(fold(out))


def merge_all(wrappers) -> tuple:
    """Fold wrappers in a fixed order, shortest first, each distinct one once."""
    out: tuple | None = None
    for wrapper in sorted(set(wrappers), key=lambda w: (len(w), repr(w))):
        out = wrapper if out is None else merge(out, wrapper)
    return out or ()


def to_text(wrapper: tuple) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def from_text(text: str) -> tuple:
    def tuples(x):
        return tuple(tuples(y) for y in x) if isinstance(x, list) else x

    return tuples(json.loads(text))


def slots(wrapper: tuple) -> set[tuple[str, ...]]:
    """Paths of the elements around the wrapper's text slots."""
    found: set[tuple[str, ...]] = set()
    stack: list[str] = []

    def walk(items: tuple) -> None:
        for core, _ in items:
            if isinstance(core, tuple):
                walk(core[1])
            elif core == "#":
                found.add(tuple(stack))
            elif core.startswith("/"):
                if core[1:] in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(core[1:]) :]
            else:
                stack.append(core)

    walk(wrapper)
    return found


def is_chrome(path: tuple[str, ...]) -> bool:
    """Whether a slot lies for certain in a menu, footer, aside, dialog, script, style or comment.

    Forms and headers, and elements that only their names mark, are left to what a
    page has in them.
    """
    return any(name.endswith("!!") or name.rstrip("!") in CHROME_TAGS for name in path)


def content_slots(wrapper: tuple) -> list[str]:
    """Paths, joined by blanks, of the slots that are not certainly chrome."""
    return sorted(" ".join(path) for path in slots(wrapper) if not is_chrome(path))


def block_key(path: tuple[str, ...], words: str) -> int:
    """What a slot and its text are known by."""
    return int.from_bytes(hashlib.blake2b(f"{' '.join(path)}\0{words}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@dataclass
class Fixed:
    """Slots with the same text on all pages of a host that name no article, and whether those pages differ at all."""

    keys: frozenset | None = None  # None: no such page yet
    page: int = 0
    several: bool = False

    def joined(self, other: Fixed) -> Fixed:
        if self.keys is None or other.keys is None:
            return other if self.keys is None else self
        return Fixed(self.keys & other.keys, min(self.page, other.page), self.several or other.several or self.page != other.page)


def fixed_of(blocks: list[tuple[tuple[str, ...], str]]) -> Fixed:
    if any("article" in path or "main" in path for path, _ in blocks):
        return Fixed()
    keys = frozenset(block_key(path, words) for path, words in blocks if not is_chrome(path))
    return Fixed(keys, hash(keys), False) if keys else Fixed()


_HOST = "host string, wrapper string, fixed array<bigint>, page bigint, several boolean"


def _host_rows(entries: list[tuple[str, tuple, Fixed]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h for h, _, _ in entries], type=pa.string()), pa.array([to_text(w) for _, w, _ in entries], type=pa.string()),
            pa.array([None if f.keys is None else sorted(f.keys) for _, _, f in entries], type=pa.list_(pa.int64())),
            pa.array([f.page for _, _, f in entries], type=pa.int64()), pa.array([f.several for _, _, f in entries], type=pa.bool_()),
        ],
        names=["host", "wrapper", "fixed", "page", "several"],
    )


def _infer(batches):
    held: OrderedDict[str, tuple[tuple, set, Fixed]] = OrderedDict()
    folded: dict[tuple, tuple] = {}
    for batch in batches:
        out = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html)
            stream, fixed = tuple(page.tokens), fixed_of(page.blocks)
            if stream not in folded:
                if len(folded) >= STREAMS:
                    folded.clear()
                folded[stream] = wrapper_of(list(stream))
            found = folded[stream]
            if host in held:
                wrapper, seen, before = held[host]
                if found not in seen:
                    seen.add(found)
                    wrapper = merge(wrapper, found)
                held[host] = (wrapper, seen, before.joined(fixed))
                held.move_to_end(host)
            else:
                held[host] = (found, {found}, fixed)
                if len(held) > HOSTS_AT_ONCE:
                    old, (wrapper, _, before) = held.popitem(last=False)
                    out.append((old, wrapper, before))
        if out:
            yield _host_rows(out)
    yield _host_rows([(h, w, f) for h, (w, _, f) in held.items()])


def _combine(batches, keys: list[str]):
    for table in whole_groups(batches, keys):
        found: dict[str, list[tuple]] = {}
        fixed: dict[str, Fixed] = {}
        for host, wrapper, texts, page, several in zip(*(table.column(n).to_pylist() for n in ("host", "wrapper", "fixed", "page", "several")), strict=True):
            found.setdefault(host, []).append(from_text(wrapper))
            fixed[host] = fixed.get(host, Fixed()).joined(Fixed(None if texts is None else frozenset(texts), page, several))
        yield _host_rows([(h, merge_all(ws), fixed[h]) for h, ws in found.items()])


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, fixed, page, several) of every host of ``pages``; pages without a host are one host, the empty one.

    ``fixed`` are the slots with one text on all pages that name no article, as ``block_key``;
    they tell template from data only if ``several`` of those pages differ.
    """
    rows = split_url(pages.select(F.col(url).alias("_url"), F.col(html).alias("html")), "_url").select("host", "html").where(F.col("html").isNotNull())
    first = rows.mapInArrow(_infer, _HOST).withColumn("slice", F.pmod(F.xxhash64("wrapper"), F.lit(SLICES)).cast("int"))
    second = first.repartition("host", "slice").sortWithinPartitions("host", "slice").mapInArrow(lambda it: _combine(it, ["host", "slice"]), _HOST)
    return second.repartition("host").sortWithinPartitions("host").mapInArrow(lambda it: _combine(it, ["host"]), _HOST)


def _slots(batches):
    for batch in batches:
        paths = [content_slots(from_text(w)) for w in batch.column("wrapper").to_pylist()]
        template = [t if several and t else [] for t, several in zip(batch.column("fixed").to_pylist(), batch.column("several").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, type=pa.list_(pa.string())), pa.array(template, type=pa.list_(pa.int64()))], names=["host", "slots", "template"])


def page_text(html: str | None, content: set[str], template: frozenset | set = frozenset()) -> str:
    """The page's blocks in content slots: those inside an article, else inside the main element, else all but the ``template``'s.

    What is in a marked element, a form or a header is left out, unless the elements
    of its path hold most of the page's text, or the form or header holds an article.
    On a page without an article or main element outside marked ones, those inside
    them stay as well.  An article that holds less than half of what the main
    element around it holds is a teaser.
    """
    blocks = [(path, words) for path, words in Page(html).blocks if " ".join(path) in content]
    held: dict[tuple[str, ...], int] = {}
    for path, words in blocks:
        for depth, name in enumerate(path, 1):
            if name.endswith("!") or name in AROUND:
                held[path[:depth]] = held.get(path[:depth], 0) + len(words)
    total = sum(len(words) for _, words in blocks)

    def small(path: tuple[str, ...], depth: int) -> bool:
        name, above, below = path[depth - 1], path[: depth - 1], path[depth:]
        if name.endswith("!"):
            return 2 * held[path[:depth]] <= total
        if name not in AROUND or (name == "header" and ("article" in above or "main" in above)):
            return False
        return "article" not in below and "main" not in below and 3 * held[path[:depth]] <= 2 * total

    def minor(path: tuple[str, ...], begin: int = 0) -> bool:
        return any(small(path, depth) for depth in range(begin + 1, len(path) + 1))

    unmarked = [(path, words) for path, words in blocks if not minor(path)] if held else blocks
    inside = {zone: [(path, words) for path, words in unmarked if zone in path] for zone in ("article", "main")}
    size = {zone: sum(len(words) for _, words in found) for zone, found in inside.items()}
    for zone in ("article", "main"):
        teaser = zone == "article" and 2 * size["article"] < sum(len(words) for path, words in inside["main"])
        if inside[zone] and not teaser:
            return "\n\n".join(words for _, words in inside[zone])
    if held:
        begins = [next((d for d, name in enumerate(path) if name in ("article", "main")), 0) for path, _ in blocks]
        unmarked = [block for block, begin in zip(blocks, begins) if not minor(block[0], begin)]
    if template and not any("article" in path or "main" in path for path, _ in unmarked):
        # A page of nothing but template is a copy of what all pages hold, and stays.
        unmarked = [(path, words) for path, words in unmarked if block_key(path, words) not in template] or unmarked
    return "\n\n".join(words for _, words in unmarked)


def _apply(batches):
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("html", "slots", "template"))
        texts = [page_text(h, set(s or ()), set(t or ())) for h, s, t in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, type=pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every row: its main text's blocks in its host's content slots, joined by an empty line.

    Character references are decoded, white space inside a block is one blank.
    NULL and empty html, and pages whose host's wrapper has no content slot, have
    the empty text.  Repeated rows repeat; NULL ids and urls are kept.  A page of any
    length is read whole, in memory in proportion to it.
    """
    found = cut_lineage(infer_wrappers(pages, url, html).mapInArrow(_slots, "host string, slots array<string>, template array<bigint>"))
    small = send_if_small(found, F.length("host") + F.length(F.array_join("slots", " ")) + 8 * F.size("template") + 64)
    kind = pages.schema[page_id].dataType.simpleString()
    rows = split_url(pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")), "url")
    rows = rows.join(small, "host", "left").select("id", "url", "html", "slots", "template")
    out = rows.mapInArrow(_apply, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(page_id), F.col(url).alias(url), "text")


def report(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars)."""
    return extract(pages, page_id, url, html).withColumn("n_chars", F.length("text").cast("long"))
