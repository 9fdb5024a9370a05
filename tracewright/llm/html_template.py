"""Main text of web pages by equivalence-class template deduction.

After Arasu and Garcia-Molina, "Extracting structured data from web pages" (2003), for all hosts at once:

1. Tokens (html_page.py): starts and ends of elements and blocks of text, by path. Tokens of a host that occur
   equally often in each of its pages share an occurrence vector and form an equivalence class. Vectors hold
   counts, not 0 and 1, and are compared by a fingerprint: the XOR over pages of a hash of page and count.
2. Tokens that occur k times on most pages (SUPPORT of them) have k roles, by their order on the page: each is
   a token of its own, once a page. A class is valid if it has two tokens and occurs in SUPPORT of the host's pages
   and in LEAST_PAGES, if its tokens come in the same order on every page, and if its spans nest with those of
   other classes; of two classes that cross, the one of fewer tokens goes. Of tokens that are once a page those go
   that change their place among the others of their class.
3. Valid classes nest into the host's template. A slot is a gap between two tokens of a class, inside the slot
   that the span stands in.
4. What a slot holds decides its role. Its novelty is the share of its text that isn't a repetition of text on
   other pages, of any host. Slots that are mostly links are menus; slots of less than half the novelty of the
   host's largest other slot hold what comes round: notices, adverts, footers; so do slots with less than a
   tenth of the new text of the element that it stands in, unless they are in that element too. Text tokens of the template are constant.
   All of that is cut, and what the remaining slots hold is the text of a page.

All sums are partial aggregates by host and token, class or slot; no host's pages are brought together. What a
host's template holds is bounded by the length of a page, as each of its tokens is in most of the host's pages.

Inside an article or main element a template doesn't cut what is constant or comes round, for series and shared
passages are the article's; it cuts menus there. Where a page has such an element the rest of the page is left
out. Navigation, headers, footers, asides, forms and the like by tag or role are never text. Class names and
ids (html_page.py) mark boilerplate that no template tells from text, such as reader comments, but not on html and
body, nor on what an article or main stands in. If everything of a page is marked, the marks don't count.

Hosts of fewer than LEAST_PAGES different pages, and those where less than VARYING of the text varies (they hold
copies of one page), have no template: tags, roles and names decide there, and blocks that are mostly links go.

Defined results: null html and pages without main text give an empty string. Pages of a null url are
one host. Unclosed and stray tags are closed or skipped as HTML has it. Rows that repeat come back as often as
they came; equal pages of a host count once for its template. Long pages are read whole, as one Python object of a task. Slots that
tie for the largest new text go by their number, crossing classes of equal size by theirs. Columns other than page_id, url and
html don't matter and aren't returned. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, slices
from .html_page import Token, read

SUPPORT, LEAST_PAGES, VARYING = 0.9, 3, 0.2
#: Templates of so many numbers in all are broadcast (16 MB); more are joined by host.
MOST_BROADCAST = 2_000_000
CONSTANT, LINKS, ROUND, MINOR = 0, 1, 2, 3
#: In place of the characters of a text, what a token is.
_TAG, _HARD, _END, _OPEN = -1, -2, -3, -4


@dataclass
class Template:
    """of: the class of each token; size: tokens of each class; times: how often a token whose roles are told apart occurs on a
    page; roles: LINKS, ROUND or MINOR of slots that aren't text; region: the start of the element that MINOR doesn't
    hold in, 0 if there is none; turns: the roles of each token in order; once: all of them."""

    of: dict[int, int] = field(default_factory=dict)
    size: dict[int, int] = field(default_factory=dict)
    times: dict[int, int] = field(default_factory=dict)
    roles: dict[int, int] = field(default_factory=dict)
    region: int = 0
    turns: dict[int, list[int]] = field(default_factory=dict)
    once: frozenset[int] = frozenset()

    def __post_init__(self):
        self.turns = {n: [_mixed(n, k + 1) for k in range(t)] for n, t in self.times.items()}
        self.once = frozenset(x for own in self.turns.values() for x in own)


@lru_cache(1 << 16)
def _mixed(*parts: int) -> int:
    """63 bits of hash of whole numbers; those of a host's template come on each of its pages."""
    x = 0x243F6A8885A308D3
    for part in parts:
        x = ((x ^ part) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
    return (x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 1


def numbered(tokens: list[Token]) -> list[int]:
    """The number of each token: of a block by its path and its text."""
    return [t.number if t.text is None else t.number ^ t.hash | 1 for t in tokens]


def with_roles(numbers: list[int], template: Template) -> list[int]:
    """The tokens of a page, those of several roles told apart. A page where one occurs more or less often hasn't its roles."""
    turns = template.turns
    count: dict[int, int] = {}
    for number in numbers:
        if number in turns:
            count[number] = count.get(number, 0) + 1
    left = {n: iter(turns[n]) for n, k in count.items() if k == len(turns[n])}
    return [next(left[n]) if n in left else n for n in numbers]


def cut(tokens: list[int], template: Template) -> tuple[list[int], dict[int, list[list[int]]], set[int]]:
    """The slot of each token, CONSTANT for the template's own; the tokens of each complete span by class; and the
    classes that cross a larger one or begin a span anew before it is complete."""
    of, size = template.of, template.size
    # open spans: class, their tokens in order and as a set, address of the span
    stack: list[tuple[int, list[int], set[int], int]] = []
    slots, spans, bad, here = [], {}, set(), 1
    for token in tokens:
        c = of.get(token)
        if c is None:
            slots.append(here)
            continue
        slots.append(CONSTANT)
        at = len(stack) - 1
        while at >= 0 and stack[at][0] != c:
            at -= 1
        if at >= 0 and token in stack[at][2]:
            bad.add(c)
            del stack[at:]
            at = -1
        if at < 0:
            stack.append((c, [token], {token}, _mixed(here, c)))
        else:
            for crossed, *_ in stack[at + 1 :]:
                bad.add(c if (size[c], c) < (size[crossed], crossed) else crossed)
            del stack[at + 1 :]
            stack[at][1].append(token)
            stack[at][2].add(token)
            if len(stack[at][1]) == size[c]:
                spans.setdefault(c, []).append(stack.pop()[1])
        here = _mixed(stack[-1][3], len(stack[-1][1])) if stack else 1
    return slots, spans, bad


def main_text(page: str | None, template: Template | None = None) -> str:
    """The main text of a page of a host of the given template."""
    if not page:
        return ""
    tokens = read(page)
    template = template or _NONE
    roles = with_roles(numbered(tokens), template)
    # blocks with the role of their slot, None for text
    found: list[tuple[Token, int | None]] = []
    end = None
    for t, role, slot in zip(tokens, roles, cut(roles, template)[0], strict=True):
        if t.opens and role == template.region:
            end = t.number | 1
        elif t.number == end:
            end = None
        if t.text is not None and not t.hard:
            judged = CONSTANT if slot == CONSTANT else template.roles.get(slot)
            found.append((t, None if judged == MINOR and end is not None else judged))
    inside = [(t, r) for t, r in found if t.main]
    if inside:
        least = min(t.rank for t, _ in ([x for x in inside if x[0].article] or inside))
        inside = [(t, r) for t, r in inside if t.rank <= least]
        # an article may be a list of links
        kept = [t for t, r in inside if r != LINKS] or [t for t, _ in inside]
    elif template.of:
        kept = [t for t, r in found if r is None]
    else:
        kept = [t for t, _ in found if 2 * t.linked < len(t.text)]
    return "\n\n".join(t.text for t in [t for t in kept if not t.soft] or kept)


_NONE = Template()


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _sizes(tokens: list[Token]) -> list[int]:
    """Of each token the characters of its text, or what else it is; _HARD for text that is boilerplate by tag or role."""
    return [(_OPEN if t.opens else _END if t.ends else _TAG) if t.text is None else _HARD if t.hard else len(t.text) for t in tokens]


def _host_id(url):
    return F.xxhash64(_host(url))


def _read(pages: DataFrame) -> DataFrame:
    """host (a hash), page (a hash of the page), numbers (paths), sizes, linked, texts (hashes of blocks): the tokens of each page."""

    def run(batches):
        kinds = pa.int64(), pa.int32(), pa.int32(), pa.int64()
        for piece, _ in slices(batches, "html"):
            rows = [read(x) for x in piece.column(2).to_pylist()]
            lists = [[t.number for t in r] for r in rows], [_sizes(r) for r in rows], [[t.linked for t in r] for r in rows], [[t.hash for t in r] for r in rows]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True))], names=["host", "page", "numbers", "sizes", "linked", "texts"])

    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(_host_id(F.col("url")).alias("host"), F.xxhash64(html).alias("page"), html.alias("html"))
    return rows.mapInArrow(run, "host long, page long, numbers array<long>, sizes array<int>, linked array<int>, texts array<long>")


def _flat(paths: pa.ListArray, texts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all tokens of a batch, as numbered() has them, and where each page's begin; the last end too."""
    number, text = paths.flatten().to_numpy(), texts.flatten().to_numpy()
    ends = np.r_[0, np.cumsum(pa.compute.list_value_length(paths).to_numpy())]
    return np.where(text != 0, number ^ text | 1, number), ends


def _numbers(batch: pa.RecordBatch) -> list[list[int]]:
    flat, ends = _flat(batch.column(batch.schema.get_field_index("numbers")), batch.column(batch.schema.get_field_index("texts")))
    flat = flat.tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _classes(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """host, number, class, times of the tokens of each host that may form a template; times where it is the same on most pages."""

    def run(batches):
        for b in batches:
            hosts, pages = b.column(0).to_numpy(), b.column(1).to_numpy()
            flat, ends = _flat(b.column(2), b.column(3))
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            order = np.lexsort((flat, row))
            flat, row = flat[order], row[order]
            first = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])]) if len(flat) else np.empty(0, dtype=np.intp)
            times, number, row = np.diff(np.r_[first, len(flat)]), flat[first], row[first]
            host, vector = hosts[row], pages[row]
            order = np.lexsort((times, number, host))
            times, number, host, vector = times[order], number[order], host[order], vector[order]
            new = np.r_[True, (host[1:] != host[:-1]) | (number[1:] != number[:-1]) | (times[1:] != times[:-1])] if len(host) else np.empty(0, dtype=bool)
            first = np.flatnonzero(new)
            vectors = np.bitwise_xor.reduceat(vector, first) if len(first) else vector
            columns = host[first], number[first], times[first], np.diff(np.r_[first, len(host)]), vectors
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["host", "number", "times", "pages", "vector"])

    counted = tokens.select("host", "page", "numbers", "texts").mapInArrow(run, "host long, number long, times long, pages long, vector long")
    by_times = counted.groupBy("host", "number", "times").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"))
    seen = by_times.groupBy("host", "number").agg(
        F.sum("pages").alias("pages"), F.max(F.struct("pages", "times", "vector")).alias("most"), F.bit_xor(F.xxhash64("times", "vector")).alias("vector")
    )
    often = seen.join(sizes, "host").where((F.col("all") >= LEAST_PAGES) & (F.col("pages") >= SUPPORT * F.col("all")))
    same = F.col("most.pages") >= SUPPORT * F.col("all")
    # a class's name is its vector
    name = F.when(same, F.xxhash64(F.lit("same"), "most.vector")).otherwise(F.col("vector"))
    return often.select("host", "number", name.alias("class"), F.when(same, F.col("most.times")).alias("times"))


def _with_roles(classes: DataFrame) -> DataFrame:
    """host, token, class, number and times (null for tokens of varying counts): a row for each role of each token."""

    def run(batches):
        for b in batches:
            rows = [(h, _mixed(n, i + 1) if t else n, c, n, t) for h, n, c, t in zip(*(x.to_pylist() for x in b.columns), strict=True) for i in range(t or 1)]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["host", "token", "class", "number", "times"])

    return classes.select("host", "number", "class", "times").mapInArrow(run, "host long, token long, class long, number long, times long")


def _gathered(classes: DataFrame) -> DataFrame:
    """__host, tokens_of, class_of, numbers_of, times_of: a row for each host."""
    rows = classes.groupBy("host").agg(F.collect_list(F.struct("token", "class", "number", "times")).alias("t"))
    return rows.select(F.col("host").alias("__host"), F.col("t.token").alias("tokens_of"), F.col("t.class").alias("class_of"), F.col("t.number").alias("numbers_of"), F.col("t.times").alias("times_of"))


_GATHERED = ["tokens_of", "class_of", "numbers_of", "times_of"]


class _Templates:
    """Templates of hosts, each made once as long as there are MOST of them at most."""

    MOST = 500

    def __init__(self):
        self.known: dict[int, Template | None] = {}

    def of(self, host: int, columns: list, i: int) -> Template | None:
        if host not in self.known:
            if len(self.known) >= self.MOST:
                self.known.clear()
            tokens, of, numbers, times, *roles = (c[i].as_py() for c in columns)
            template = None
            if tokens is not None:
                size: dict[int, int] = {}
                for c in of:
                    size[c] = size.get(c, 0) + 1
                known = {n: t for n, t in zip(numbers, times, strict=True) if t}
                template = Template(dict(zip(tokens, of, strict=True)), size, known, *((dict(zip(roles[0] or (), roles[1] or (), strict=True)), roles[2]) if roles else ()))
            self.known[host] = template
        return self.known[host]


def _with(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """rows with the template of their host; templates are broadcast where they are small."""
    n = templates.agg(F.sum(F.size("tokens_of"))).first()[0] or 0
    small = F.broadcast(templates) if n <= MOST_BROADCAST else templates
    return rows.join(small, rows["host"] == small["__host"], "left").drop("__host")


def _valid(tokens: DataFrame, classes: DataFrame, keep: Scratch) -> DataFrame:
    """The rows of classes whose tokens keep one order and whose spans nest on all pages."""

    def run(batches):
        known = _Templates()
        for b in batches:
            # of a class of tokens that are once a page the least and greatest place of each; of others those of the order's hash
            found: dict[tuple, list] = {}
            for i, (host, numbers) in enumerate(zip(b.column(0).to_pylist(), _numbers(b), strict=True)):
                template = known.of(host, b.columns[3:7], i)
                page = with_roles(numbers, template)
                _, spans, bad = cut(page, template)
                for c in bad:
                    found.setdefault((host, c, 0), [1 << 62, -1, False])[2] = True
                for c, own in spans.items():
                    places = enumerate(own[0]) if own[0][0] in template.once else ((_mixed(*x), 0) for x in own)
                    for place, token in places:
                        seen = found.setdefault((host, c, token), [place, place, False])
                        seen[0], seen[1] = min(seen[0], place), max(seen[1], place)
            rows = [(*k, *v) for k, v in found.items()]
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 5, pa.bool_()), strict=True)], names=["host", "class", "token", "low", "high", "bad"])

    rows = _with(tokens.select("host", "numbers", "texts"), keep.keep(_gathered(classes), "candidates")).where("tokens_of is not null")
    checked = rows.select("host", "numbers", "texts", *_GATHERED).mapInArrow(run, "host long, class long, token long, low long, high long, bad boolean")
    found = keep.keep(checked.groupBy("host", "class", "token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("bad").alias("bad")), "checked")
    crossing = found.where("bad or (token = 0 and low <> high)").select("host", "class").distinct()
    moving = found.where("token <> 0 and low <> high").select("host", "token")
    return classes.join(crossing, ["host", "class"], "left_anti").join(moving, ["host", "token"], "left_anti")


def _regions(numbers: list[int], roles: list[int], sizes: list[int], once: frozenset[int]) -> list[int]:
    """The start of the innermost element of the template, of those once a page, that each token stands in; 0 without one."""
    stack, ends, out = [(0, 0)], set(), []
    for number, role, size in zip(numbers, roles, sizes, strict=True):
        if size == _OPEN and role in once:
            stack.append((number | 1, role))
            ends.add(number | 1)
        elif size == _END and number in ends:
            while (end := stack.pop()[0]) != number:
                ends.discard(end)
            if all(number != x for x, _ in stack):
                ends.discard(number)
        out.append(stack[-1][1])
    return out


def _roles(tokens: DataFrame, templates: DataFrame, keep: Scratch) -> DataFrame:
    """__host, slots_of, roles_of, region, copies: slots of each host that don't hold text; whether the host has copies only."""

    def run(batches):
        known = _Templates()
        for b in batches:
            found: dict[tuple, list] = {}
            for i, (numbers, host, sizes, linked, texts) in enumerate(zip(_numbers(b), *(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)):
                template = known.of(host, b.columns[5:9], i)
                page = with_roles(numbers, template)
                regions = _regions(numbers, page, sizes, template.once)
                for text, chars, links, slot, region in zip(texts, sizes, linked, cut(page, template)[0], regions, strict=True):
                    if chars >= 0:
                        own = found.setdefault((host, slot, text), [0, chars, links, region])
                        own[0] += 1
            rows = [(*k, *v) for k, v in found.items()]
            cols = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["host", "slot", "text", "n", "chars", "linked", "region"])

    rows = _with(tokens.select("host", "numbers", "sizes", "linked", "texts"), templates).where("tokens_of is not null")
    rows = rows.select("host", "numbers", "sizes", "linked", "texts", *_GATHERED).mapInArrow(run, "host long, slot long, text long, n long, chars long, linked long, region long")
    texts = rows.groupBy("host", "slot", "text").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"), F.max("linked").alias("linked"), F.max("region").alias("region"))
    # what is left of a text is a row for each host and slot
    texts = texts.withColumn("everywhere", F.sum("n").over(W.partitionBy("text")))
    slots = keep.keep(texts.groupBy("host", "slot").agg(
        F.sum(F.col("n") * F.col("chars")).alias("all"), F.sum(F.col("n") * F.col("chars") / F.col("everywhere")).alias("new"), F.sum(F.col("n") * F.col("linked")).alias("linked"), F.max("region").alias("region")
    ), "slots")
    menu, constant = F.col("linked") * 2 > F.col("all"), F.col("slot") == CONSTANT
    slots = slots.withColumn("novelty", F.try_divide("new", "all"))
    top = slots.where(~menu & ~constant).groupBy("host").agg(F.max(F.struct("new", "slot", "novelty", "region")).alias("top"))
    beside = slots.where(~menu & ~constant).join(top, "host").where("region = top.region").groupBy("host").agg(F.sum("new").alias("beside"))
    round_, minor = F.col("novelty") * 2 < F.col("top.novelty"), F.col("new") * 10 < F.col("beside")
    judged = slots.join(top.join(beside, "host"), "host", "left").withColumn("role", F.when(~constant, F.when(menu, LINKS).when(round_, ROUND).when(minor, MINOR)))
    # what of a host's text, menus aside, isn't constant
    varies = F.try_divide(F.sum(F.when(~menu & ~constant, F.col("all")).otherwise(0)), F.sum(F.when(~menu, F.col("all")).otherwise(0)))
    marked = F.collect_list(F.when(F.col("role").isNotNull(), F.struct("slot", "role"))).alias("r")
    out = judged.groupBy("host").agg(marked, F.coalesce(F.max("top.region"), F.lit(0)).alias("region"), F.coalesce(varies < VARYING, F.lit(True)).alias("copies"))
    return out.select(F.col("host").alias("__host"), F.col("r.slot").alias("slots_of"), F.col("r.role").alias("roles_of"), "region", "copies")


def templates(pages: DataFrame) -> DataFrame:
    """__host, tokens_of, class_of, numbers_of, times_of, slots_of, roles_of, region: the template of each host of pages(page_id, url, html) that has one."""
    keep = Scratch(pages.sparkSession)
    # equal pages of a host count once; their tokens are as long as a page's tags, so these rows may meet
    tokens = keep.keep(_read(pages).dropDuplicates(["host", "page"]), "tokens")
    sizes = tokens.groupBy("host").agg(F.count("*").alias("all"))
    candidates = keep.keep(_several(_with_roles(_classes(tokens, sizes))), "classes")
    gathered = keep.keep(_gathered(_several(_valid(tokens, candidates, keep))), "valid")
    roles = _roles(tokens, gathered, keep)
    out = checkpointed(gathered.join(roles, "__host").where("not copies").drop("copies"))
    keep.clear()
    return out


def _several(classes: DataFrame) -> DataFrame:
    """Without the classes of one token."""
    large = classes.groupBy("host", "class").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    return classes.join(large, ["host", "class"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    rows = _with(pages.withColumn("host", _host_id(F.col("url"))), templates(pages))

    def run(batches):
        known = _Templates()
        for piece, at in slices(batches, "html"):
            hosts = piece.column(3).to_pylist()
            out = [main_text(page, known.of(host, piece.columns[4:], i)) for i, (host, page) in enumerate(zip(hosts, piece.column(2).to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host", *_GATHERED, "slots_of", "roles_of", "region").mapInArrow(run, "page_id long, url string, text string, n_chars long")
