"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of each host.

A page becomes a stream of block tags and strings. Runs of equal token sequences fold into repeated groups. The streams of a
host are aligned in a tree of small groups: tokens that both have stay, what only one has becomes an optional group. Strings
are aligned by their paths of tags: one that every page of the host has at its path is a constant of the wrapper, every other
is a slot's. A tag is its element and those of its class, id and role names that tell what it is for, so names of single
pages don't part the pages of a host.

Constants are template and are never text, wherever they stand, once a host has LEAST_PAGES pages of different strings; the
slots are what can be text. Which of a page's slots are the article's is read off their paths: those inside the article's
element, or elsewhere in the body where a page has none, without menus, headers, footers, sidebars, notices, adverts, forms
and comments. Of a page that holds nothing but constants, and of hosts with fewer pages, paths alone decide.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.llm.words import columns
from reelyard.storage import keep, release

FAN = 48  # streams that are aligned one after another
LEAST_PAGES = 8
HOSTS = 1024  # of which a task holds constants at once
BROADCAST_BYTES = 8 << 20

# Elements and the names in class, id and role that tell what a part of a page is for.
HIDDEN = "script style noscript template svg iframe object title textarea select canvas math"
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q s samp small source span strike strong sub sup time tt u var wbr br input meta link"
ASIDE = "nav header footer aside form button dialog menu fieldset"
ASIDE_NAMES = "nav navbar navigation menu sidebar side ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion notice alert cookie cookies consent popup modal overlay share sharing social related recommended breadcrumb breadcrumbs comment comments reply replies respond disqus newsletter subscribe subscription pagination pager login signup search footer header masthead copyright widget toolbar"
MAIN_NAMES = "article main content post entry story body"
PLACES = "header content article post posts entry story site page top bottom left right main global primary secondary bar box list section wrap wrapper container block item items area link links menu inner title"
HEAD = "meta link base basefont bgsound noframes html"
ALONE = "p li dt dd option tr td th"

_inline, _aside, _aside_names, _main_names, _places, _head, _alone = (frozenset(x.split()) for x in (INLINE, ASIDE, ASIDE_NAMES, MAIN_NAMES, PLACES, HEAD, ALONE))
KINDS = ("article", "main", "article aside", "main aside", "body")  # of places, the best first
_token = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"'/]++|/(?!>)|\"[^\"]*\"|'[^']*')*+/>"
    r"|<(?P<hidden>" + "|".join(HIDDEN.split()) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
_names = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_space = re.compile(r"\s+")
_parts = re.compile(r"[^a-z0-9]+")
_headings = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_odd = re.compile(r"[^a-z0-9:_-]")  # characters that paths and wrappers use themselves


@lru_cache(1 << 16)
def telling(names: str) -> tuple[str, ...]:
    """What class, id and role names tell of an element's purpose, each once: the names of MAIN_NAMES that are parts of a
    name, and !name for a name of ASIDE_NAMES that is whole or only stands with PLACES, as site-footer does."""
    found = set()
    for name in names.lower().split():
        parts = [p for p in _parts.split(name) if p and not p.isdigit()]
        asides = [p for p in parts if p in _aside_names and (len(parts) == 1 or p != "header" or not {"article", "post", "entry", "story"} & set(parts))]
        if asides and all(p in _aside_names or p in _places for p in parts):
            found.add("!" + asides[0])
        else:
            found.update(p for p in parts if p in _main_names)
    return tuple(sorted(found))


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("open", tag), ("close", name), ("text", raw) and ("inline", name) of a page; a tag is its name and telling names.

    Texts of a closed head are left out; one that isn't closed ends at the first tag of the body.
    """
    at, head = 0, None
    for m in _token.finditer(page):
        if m.start() > at:
            if head is None:
                yield "text", page[at : m.start()]
            else:
                head.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = _odd.sub("_", name.lower())
        if name == "head":
            head = None if m["close"] else []
            continue
        if head is not None:
            if name in _head and not (name == "html" and m["close"]):
                continue
            yield from (("text", t) for t in head)
            head = None
        if name in _inline:
            yield "inline", name
        elif m["close"]:
            yield "close", name
        else:
            found = _names.findall(m["rest"]) if m["rest"] else ()
            if name in _headings:  # their ids are words of the heading
                found = [f for f in found if f[0].lower() != "id"]
            yield "open", ".".join((name, *telling(" ".join("".join(f[1:]) for f in found)))) if found else name
    if head:
        yield from (("text", t) for t in head)
    if at < len(page):
        yield "text", page[at:]


def walk(page: str) -> Iterator[tuple[str, tuple[str, ...] | str]]:
    """("open", tag), ("close", tag) with the closings that HTML implies, and ("text", (path, raw)) or ("inline", (path, name))."""
    stack: list[str] = []
    for kind, what in tokens(page):
        if kind == "open":
            name = what.split(".")[0]
            if name in _alone and stack and stack[-1].split(".")[0] == name or stack and stack[-1].split(".")[0] == "p":
                yield "close", stack.pop()
            if name != "hr":
                stack.append(what)
                yield "open", what
        elif kind == "close":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].split(".")[0] == what), None)
            if depth is not None:
                while len(stack) > depth:
                    yield "close", stack.pop()
        else:
            yield kind, ("/".join(stack), what)


_fold = re.compile(r"(.{1,32}?)\1+", re.S)


class Alphabet:
    """Single characters for symbols, so that streams fold and align as strings."""

    def __init__(self):
        self.of: dict[str, str] = {}
        self.name: dict[str, str] = {}

    def char(self, symbol: str) -> str:
        c = self.of.get(symbol)
        if c is None:
            c = self.of[symbol] = chr(0x10000 + len(self.of))
            self.name[c] = symbol
        return c


def parse(text: str) -> list:
    """Wrapper text to [(symbol, optional)], a repeated group being a symbol of its own."""
    out, depth, start = [], 0, 0
    for part in text.split(" ") if text else []:
        if depth == 0:
            start = len(out)
            out.append([])
        out[start].append(part)
        depth += part.count("(") - part.count(")")
        if depth == 0:
            joined = " ".join(out[start])
            out[start] = (joined[1:-2], True) if joined.endswith(")?") else (joined, False)
    return out


def folded(symbols: list[str]) -> str:
    """A stream with its runs of equal sequences folded into (...)+ groups."""
    letters = Alphabet()
    line = "".join(letters.char(s) for s in symbols)
    while True:
        short = _fold.sub(lambda m: letters.char("(" + " ".join(letters.name[c] for c in m[1]) + ")+"), line)
        if short == line:
            return " ".join(letters.name[c] for c in line)
        line = short


def blocks(steps: list) -> Iterator[tuple[str, str]]:
    """(path, text) of the blocks of a walk that aren't blank; blocks end where a block's tag opens or closes."""
    now: list[str] = []
    path = ""
    for kind, what in [*steps, ("close", "")]:
        if kind == "text":
            path = what[0]
            now.append(what[1])
        elif kind == "inline":
            if what[1] == "br":
                now.append(" ")
        elif now:
            text = _space.sub(" ", html.unescape("".join(now))).strip()
            if text:
                yield path, text
            now = []


def string_key(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass"))


def shape(page: str | None) -> tuple[str, list[str], np.ndarray]:
    """A page's folded token stream, where neighbouring texts are one slot, the paths of its slots in order, each once, and
    the keys of its strings at their paths, in order of value, each once."""
    symbols: list[str] = []
    paths: dict[str, None] = {}
    steps = list(walk(page or ""))
    for kind, what in steps:
        if kind == "open":
            symbols.append(what)
        elif kind == "close":
            symbols.append("/" + what.split(".")[0])
        elif kind == "text" and what[1].strip():
            paths[what[0]] = None
            if not symbols or symbols[-1] != "#":
                symbols.append("#")
    strings = np.unique(np.array([string_key(p, t) for p, t in blocks(steps) if purpose(p) != "aside"], np.uint64))
    return folded(symbols), list(paths), strings


def structure(page: str | None) -> str:
    """A page's folded token stream."""
    return shape(page)[0]


class Constants:
    """The strings that all pages of a host have, and keys of up to LEAST_PAGES of its pages of different strings. Adding
    pages or other such records gives the same in any order."""

    def __init__(self):
        self.strings: np.ndarray | None = None
        self.pages: set[int] = set()

    def add(self, strings: np.ndarray, pages: Iterable[int]) -> None:
        self.strings = strings if self.strings is None else np.intersect1d(self.strings, strings, assume_unique=True)
        if len(self.pages) < LEAST_PAGES:
            self.pages = set(sorted(self.pages.union(pages))[:LEAST_PAGES])

    def row(self) -> tuple[bytes, bytes]:
        return self.strings.tobytes(), np.array(sorted(self.pages), np.uint64).tobytes()

    @property
    def template(self) -> np.ndarray:
        return self.strings if len(self.pages) >= LEAST_PAGES else self.strings[:0]


def align(a: str, b: str) -> str:
    """The wrapper of two wrappers: common symbols stay, in order, the others become optional."""
    if a == b or not b:
        return a
    if not a:
        return b
    left, right = parse(a), parse(b)
    for mine, other in ((left, right), (right, left)):  # one occurrence of what repeats on the other side is such a group
        for group in {s for s, _ in other if s.endswith(")+")} - {s for s, _ in mine}:
            body = parse(group[1:-2])
            for i in range(len(mine) - len(body), -1, -1):
                if [s for s, _ in mine[i : i + len(body)]] == [s for s, _ in body]:
                    mine[i : i + len(body)] = [(group, any(o for _, o in mine[i : i + len(body)]))]
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[i][0] == right[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and left[i][0] == right[j][0]:
            out.append((left[i][0], left[i][1] or right[j][1]))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((left[i][0], True))
            i += 1
        else:
            out.append((right[j][0], True))
            j += 1
    return " ".join(f"({s})?" if o else s for s, o in out)


def slots(wrapper: str) -> list[str]:
    """The paths of a wrapper's text slots, groups opened."""
    found, stack = [], []
    for symbol in re.sub(r"[()?+]", " ", wrapper).split():
        if symbol == "#":
            found.append("/".join(stack))
        elif symbol.startswith("/"):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].split(".")[0] == symbol[1:]), None)
            if depth is not None:
                del stack[depth:]
        else:
            stack.append(symbol)
    return list(dict.fromkeys(found))


@lru_cache(1 << 16)
def purpose(path: str) -> str:
    """One of KINDS, or aside: what the elements on a slot's path say of it.

    An aside's name on an element around an <article> or <main> may be that of a layout, so such a place is only less good.
    """
    tags = [tag.split(".") for tag in path.split("/")]
    inner = max((i for i, tag in enumerate(tags) if tag[0] in ("article", "main")), default=-1)
    found, inside, doubt = "body", False, ""
    for i, (name, *words) in enumerate(tags):
        if name in _aside and not (name == "header" and inside) and not (name == "form" and i < inner):
            return "aside"
        if name not in ("html", "body", "article", "main") and any(w.startswith("!") for w in words):
            if i > inner:
                return "aside"
            doubt = " aside"
        if name == "article":
            found, inside = "article", True
        elif found != "article" and (name == "main" or name not in ("html", "body") and not _main_names.isdisjoint(words)):
            found = "main"
    return found + doubt


def article_slots(paths: Iterable[str]) -> list[str]:
    """The slots of the article among the paths of slots: of the best kind of place that they have."""
    by = {p: purpose(p) for p in paths}
    kind = next((k for k in KINDS if k in by.values()), None)
    return [p for p, k in by.items() if k == kind]


def extract(page: str | None, known: frozenset[str], constants: frozenset[int] = frozenset()) -> str:
    """The texts of the article's slots: of the strings at known paths that aren't constants of the wrapper, those of the best
    kind of place; of all strings where the page has constants alone."""
    steps = list(walk(page or ""))
    found = [(path, text, not constants or string_key(path, text) not in constants) for path, text in blocks(steps) if path in known]
    if any(free and purpose(path) != "aside" for path, _, free in found):
        wanted = frozenset(article_slots({path for path, _, free in found if free}))
        return "\n".join(text for path, text, free in found if free and path in wanted)
    wanted = frozenset(article_slots({path for path, _, _ in found}))
    return "\n".join(text for path, text, _ in found if path in wanted)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def infer(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """host, wrapper, wanted (slots that may be of an article, by the page), constants (keys of the strings that all of a
    host's pages have, as packed uint64) for the pages' hosts.

    Equal structures count once: they are grouped before anything is aligned. A host's structures are aligned in groups of
    about `fan`, their wrappers again, and so on, so a host with many pages never meets in one task; constants are
    intersected within tasks first.
    """
    both = "host string, shape string, paths array<string>, strings binary, pages binary"

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = {"host": pa.string(), "shape": pa.string(), "paths": pa.list_(pa.string()), "strings": pa.binary(), "pages": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Constants] = {}
        for hosts, texts in columns(batches, "host", "html"):
            found = {}
            for host, text in zip(hosts, texts, strict=True):
                stream, paths, strings = shape(text)
                found[host, stream, tuple(paths), None, None] = None
                held.setdefault(host, Constants()).add(strings, [xxhash.xxh3_64_intdigest(strings.tobytes())])
            yield rows(list(found))
            if len(held) > HOSTS:
                yield rows([(h, None, None, *c.row()) for h, c in held.items()])
                held = {}
        yield rows([(h, None, None, *c.row()) for h, c in held.items()])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        wrapper = ""
        for stream in sorted(set(part["shape"]), key=lambda s: (-len(s), s)):
            wrapper = align(wrapper, stream)
        return pd.DataFrame({"host": [part["host"].iloc[0]], "shape": [wrapper], "paths": [sorted(set().union(*part["paths"]))]})

    def common(part: pd.DataFrame) -> Constants:
        out = Constants()
        for strings, seen in zip(part["strings"], part["pages"], strict=True):
            out.add(np.frombuffer(strings, np.uint64), np.frombuffer(seen, np.uint64).tolist())
        return out

    def met(part: pd.DataFrame) -> pd.DataFrame:
        strings, seen = common(part).row()
        return pd.DataFrame({"host": [part["host"].iloc[0]], "strings": [strings], "pages": [seen]})

    def template(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [part["host"].iloc[0]], "constants": [common(part).template.tobytes()]})

    found = keep(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(shapes, both), "shapes")
    streams = found.where("shape is not null").select("host", "shape", "paths").distinct()
    most = streams.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > fan:
        groups = -(-most // fan)
        streams = streams.withColumn("lot", F.pmod(F.xxhash64("shape"), F.lit(groups))).groupBy("host", "lot").applyInPandas(merged, "host string, shape string, paths array<string>")
        most = groups
    whole = streams.groupBy("host").applyInPandas(merged, "host string, shape string, paths array<string>")
    parts = found.where("strings is not null").withColumn("lot", F.pmod(F.xxhash64("strings", "pages"), F.lit(64))).groupBy("host", "lot").applyInPandas(met, "host string, strings binary, pages binary")
    constants = parts.groupBy("host").applyInPandas(template, "host string, constants binary")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, texts, paths, fixed in columns(batches, "host", "shape", "paths", "constants"):
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "wrapper": pa.array(texts, pa.string()), "wanted": pa.array([[p for p in ps if purpose(p) != "aside"] for ps in paths], pa.list_(pa.string())), "constants": pa.array(fixed, pa.binary())})

    out = keep(whole.join(constants, "host").mapInArrow(wanted, "host string, wrapper string, wanted array<string>, constants binary"), "wrappers")
    release(found)
    return out


def main_texts(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host of every page by its host's wrapper.

    A null or empty html gives an empty text; a null or odd url belongs to the host ""; repeated rows give repeated rows; an
    empty table gives none; other columns are not read. Wrappers are broadcast while they are small, else joined by host.
    """
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length(F.concat_ws("", "wanted")) + F.length("constants"))).first()[0] or 0
    known = wrappers.select(F.col("host").alias("_host"), "wanted", "constants")
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = named.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, F.col("host") == F.col("_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, hosts, texts, slots_, fixed in columns(batches, "page_id", "url", "host", "html", "wanted", "constants"):
            sets = {h: (frozenset(w or ()), frozenset(np.frombuffer(c or b"", np.uint64).tolist())) for h, w, c in zip(hosts, slots_, fixed, strict=True)}
            out = [extract(t, *sets[h]) for h, t in zip(hosts, texts, strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64()), "host": pa.array(hosts, pa.string())})

    return joined.select("page_id", "url", "host", "html", "wanted", "constants").mapInArrow(run, "page_id long, url string, text string, n_chars long, host string")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_texts(pages, infer(pages))
