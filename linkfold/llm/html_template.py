"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are the begins and ends of its containers (a tag with its class, under the tags that hold it) and its texts.  Over the
pages of a host every token has an occurrence vector, one count for each page; the vector is held as a sum of hashes of (page, count),
which merges by aggregation, so a host with a third of all pages is no task's burden.  Tokens with equal vectors, on a tenth of the host's
pages at least, are a class.  A second look at the pages tells which classes are valid: their tokens come in one order on every page
that has them, repeated as a whole, and always inside the same slot of the same other class.  Valid classes nest into the host's
template.  A text that shares the class of its container, or that of the whole page, belongs to the template; what is left in the slots is the pages' own.  Of the
template's containers the one that gathers the article's slots is chosen, menus and the like are cut out of it by tag and class, and
the blocks in its slots are the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.scratch import stored

#: A class is on so many pages of its host at least, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.1
#: Numbers in host templates that are broadcast at most (32 MB); beyond, pages and templates are shuffled by host.
BROADCAST_NUMBERS = 4_000_000
#: Templates that a Python worker keeps unpacked at a time.
KEPT_TEMPLATES = 500
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MARKING = frozenset(["class", "id", "role"])
_PART = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_OUT_TAGS = frozenset("head script style noscript template iframe svg select nav footer aside form button textarea title menu dialog object canvas".split())
_OUT_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer dialog footer "
    "gdpr login menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion related "
    "replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar complementary contentinfo alert".split()
)
#: Inline elements that are no part of a text, and attributes that may say so of others.
_OUT_INLINE = frozenset("label video audio datalist meter progress".split())
_TELLING = re.compile("class|id|role|hidden", re.IGNORECASE)
_HEAD_WORDS = frozenset(["header", "masthead"])
#: Words that say nothing of a part's purpose: "ad-box" is an advert, "no-sidebar" and "share-price" are not what one of their words says.
_NEUTRAL = frozenset(
    "area bar block bottom box buttons center col column container fixed form group holder inner item items left links list main outer page panel post posts primary reader "
    "right row secondary section site slot sticky top unit user widget widgets wrap wrapper".split()
)
_MAIN_TAGS = frozenset(["article", "main"])
_NORMAL, _MAIN, _PARAGRAPH = 0, 1, 2
_END = 0x5BD1E9955BD1E995


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _hash(*parts: object) -> int:
    return _signed(xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")))


def marked(name: str, words: frozenset[str]) -> bool:
    """Whether a class name as a whole, all its parts but neutral ones, consists of ``words``."""
    parts = [p.lower() for p in _PART.findall(name)]
    return any(p in words for p in parts) and all(p in words or p in _NEUTRAL or p.isdigit() for p in parts)


class Page:
    """Containers and texts of one page in page order, read in time linear in its length and depth."""

    def __init__(self, text: str | None):
        #: Of each container: its token, its kind, the container that holds it, its depth, and whether it is excluded; the first is the page.
        self.token, self.kind, self.holder, self.depth, self.out = [0], [_NORMAL], [-1], [0], [False]
        #: Begins, ends and texts in page order; of each text its container, its token, and its words.
        self.tokens: list[int] = []
        self.blocks: list[tuple[int, int, str]] = []
        stack, tags, opened, mains = [0], [""], {}, 0
        parts: list[str] = []
        text = text or ""
        #: An inline element whose text is left out: its name, how many of that name are open in it, and the depth at which it began.
        left, count, began = "", 0, 0

        def flush() -> None:
            if parts:
                words = entities.unescape("".join(parts)).split()
                if words:
                    words = " ".join(words)
                    token = _hash(self.token[stack[-1]], words)
                    self.blocks.append((stack[-1], token, words))
                    self.tokens.append(token)
                parts.clear()

        def close() -> str:
            nonlocal mains, left
            tag = tags.pop()
            if left and len(stack) <= began:
                left = ""  # it ends with the container that holds it, closed or not
            self.tokens.append(self.token[stack.pop()] ^ _END)
            opened[tag] -= 1
            mains -= tag in _MAIN_TAGS
            return tag

        at = 0
        while True:
            mark = _MARK.search(text, at)
            if mark is None:
                if not left:
                    parts.append(text[at:])
                break
            if mark.start() > at and not left:
                parts.append(text[at : mark.start()])
            at = mark.end()
            name = (mark[2] or "").lower()
            if not name:
                continue
            holds = name in _BLOCK or name in _OUT_TAGS
            if holds:
                flush()
            elif name == "br":
                parts.append(" ")
            if mark[1]:
                if opened.get(name):
                    while close() != name:
                        pass
                elif left == name:
                    count -= 1
                    left = left if count else ""
                continue
            if name in _VOID:
                continue
            if name in _RAW:
                end = _RAW[name].search(text, at)
                at = end.end() if end else len(text)
                continue
            if not holds:
                if left:
                    count += left == name
                elif self.inline_out(name, mark[3]):
                    left, count, began = name, 1, len(stack)
                continue
            # an open paragraph ends where a block begins, an open list item or cell where the next does
            if tags[-1] == "p" or tags[-1] == name and name in ("li", "dt", "dd", "td", "th", "tr"):
                close()
            marks, hidden = self.marks(mark[3])
            out = self.out[stack[-1]] or name in _OUT_TAGS or hidden
            if name not in ("body", "html", *_MAIN_TAGS):
                out = out or any(marked(m, _OUT_WORDS) for m in marks) or (not mains and (name == "header" or any(marked(m, _HEAD_WORDS) for m in marks)))
            self.token.append(_hash(self.token[stack[-1]], name, *sorted(marks)))
            self.kind.append(_MAIN if name in _MAIN_TAGS else _PARAGRAPH if name == "p" else _NORMAL)
            self.holder.append(stack[-1])
            self.depth.append(len(stack))
            self.out.append(out)
            stack.append(len(self.token) - 1)
            tags.append(name)
            opened[name] = opened.get(name, 0) + 1
            mains += name in _MAIN_TAGS
            self.tokens.append(self.token[-1])
        flush()
        while len(stack) > 1:
            close()

    @classmethod
    def inline_out(cls, name: str, attributes: str) -> bool:
        """Whether the text of an inline element is left out, by its name, its marks or as hidden."""
        if name in _OUT_INLINE or ("-" in name and marked(name, _OUT_WORDS)):
            return True
        if not attributes or not _TELLING.search(attributes):
            return False
        marks, hidden = cls.marks(attributes)
        return hidden or any(marked(m, _OUT_WORDS) for m in marks)

    @staticmethod
    def marks(attributes: str) -> tuple[set[str], bool]:
        """Class names, id and role, and whether the element is hidden."""
        if not attributes:
            return set(), False
        names, hidden = set(), False
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if key in ("hidden", "aria-hidden"):
                hidden = hidden or value.lower() != "false"
            elif key in _MARKING:
                names.update(value.split())
        return names, hidden

    def gathered(self, counts: list[bool]) -> dict[int, tuple[int, int, int]]:
        """(characters, depth, kind) of each container's token, over the unexcluded blocks that count."""
        chars = [0] * len(self.token)
        for (node, _, words), counted in zip(self.blocks, counts, strict=True):
            if counted and not self.out[node]:
                chars[node] += len(words)
        for node in range(len(chars) - 1, 0, -1):  # containers come before what they hold
            chars[self.holder[node]] += chars[node]
        found: dict[int, tuple[int, int, int]] = {}
        for node in range(1, len(chars)):
            if chars[node]:
                n, depth, kind = found.get(self.token[node], (0, self.depth[node], self.kind[node]))
                found[self.token[node]] = n + chars[node], depth, kind
        return found

    def within(self, slot: int) -> list[bool]:
        """Whether each container lies in one of token ``slot``, or is one."""
        inside = [False] * len(self.token)
        for node in range(1, len(inside)):
            inside[node] = inside[self.holder[node]] or self.token[node] == slot
        return inside


def main_slot(chars: dict[int, tuple[int, int, int]]) -> int | None:
    """Of containers with (characters, depth, kind), the innermost article or main element that holds the most, else the innermost with most of the text."""
    main = {t: (d, n) for t, (n, d, kind) in chars.items() if kind == _MAIN and n}
    if main:
        most = max(n for _, n in main.values())
        return max((t for t, (_, n) in main.items() if 2 * n > most), key=lambda t: (*main[t], t))
    most = max((n for n, _, _ in chars.values()), default=0)
    rest = {t: (d, n) for t, (n, d, kind) in chars.items() if kind == _NORMAL and n and 5 * n >= 4 * most}
    return max(rest, key=lambda t: (*rest[t], t), default=None)


def _numbers(packed: object, width: int) -> list[tuple[int, ...]]:
    return list(map(tuple, np.asarray(packed, dtype=np.int64).reshape(-1, width).tolist())) if packed is not None else []


class _Unpacked:
    """What a worker keeps of host templates between pages: unpacked once for each host."""

    def __init__(self, make):
        self.make, self.known = make, {}

    def __call__(self, host: int, packed: object):
        if packed is None:
            return None
        found = self.known.get(host)
        if found is None:
            if len(self.known) >= KEPT_TEMPLATES:
                self.known.clear()
            found = self.known[host] = self.make(packed)
        return found


def own_blocks(page: Page, classes: dict[int, int]) -> list[bool]:
    """Whether each block is the page's own: its token isn't in the class of its container, nor in that of the outermost one, which has what is on every page once."""
    whole = classes.get(page.token[1]) if len(page.token) > 1 else None
    return [token not in classes or classes[token] not in (classes.get(page.token[node]), whole) for node, token, _ in page.blocks]


def order_and_nesting(page: Page, classes: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(class, its order on this page, the class around it, that class's slot) of the classes on a page; a class without an order has that of this page alone."""
    places: dict[int, list[int]] = {}
    for at, token in enumerate(page.tokens):
        cls = classes.get(token) or classes.get(token ^ _END)
        if cls is not None:
            places.setdefault(cls, []).append(at)
    names = sorted(places)
    where = [np.array(places[c]) for c in names]
    low, high = np.array([w[0] for w in where]), np.array([w[-1] for w in where])
    narrowest = np.full(len(names), np.iinfo(np.int64).max)
    around, slot = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    orders = []
    for c, at in zip(names, where, strict=True):
        tokens = [page.tokens[i] for i in at]
        period = len(set(tokens))
        whole = tokens == tokens[:period] * (len(tokens) // period)
        orders.append(_hash(*tokens[:period]) if whole else _hash(*page.tokens))
        if len(at) > 1:
            k = np.searchsorted(at, low)
            inside = (k > 0) & (k < len(at)) & (at[np.minimum(k, len(at) - 1)] > high)
            width = np.where(inside, at[np.minimum(k, len(at) - 1)] - at[np.maximum(k, 1) - 1], np.iinfo(np.int64).max)
            closer = width < narrowest
            narrowest[closer], around[closer], slot[closer] = width[closer], c, k[closer] % period
    return list(zip(names, orders, around.tolist(), slot.tolist(), strict=True))


class Template:
    """A host's valid classes, nested, and the container that gathers the article's slots."""

    def __init__(self, packed: object):
        rows = _numbers(packed, 5)
        around = {key: a for kind, key, a, _, _ in rows if kind == 0}

        def nested(cls: int) -> bool:
            """Whether all classes around this one are valid; a class is never around itself, as its slot is narrower than the class."""
            seen = set()
            while cls and cls in around and cls not in seen:
                seen.add(cls)
                cls = around[cls]
            return cls == 0

        valid = {cls for cls in around if nested(cls)}
        self.classes = {key: a for kind, key, a, _, _ in rows if kind == 2 and a in valid}
        self.main = main_slot({key: (n, depth, tag) for kind, key, n, depth, tag in rows if kind == 1 and key in self.classes})


def _host(url: str) -> Column:
    """A number for the URL's host, in any case; null without one."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "^.*?://([^/?#]*)", 1))
    return F.when(rest != "", F.xxhash64(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _by_host(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Each page with its host's numbers, which are broadcast while they are few."""
    size = templates.agg(F.sum(F.size("packed")).alias("n")).first()["n"] or 0
    return pages.join(F.broadcast(templates) if size <= BROADCAST_NUMBERS else templates, "host", "left")


def candidate_classes(pages: DataFrame) -> DataFrame:
    """(host, token, class) of tokens on enough of a host's pages; equal classes are equal occurrence vectors."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[int, int], list[int]] = {}
            for page_id, host, text in zip(batch["page_id"], batch["host"], batch["html"], strict=True):
                page, counts = Page(text), {}
                for token in page.token[1:]:
                    counts[token] = counts.get(token, 0) + 1
                for _, token, _ in page.blocks:
                    counts[token] = counts.get(token, 0) + 1
                own, parts = _hash(page_id, text), {}
                for token, n in [*counts.items(), (0, 1)]:
                    part = parts.get(n)
                    if part is None:
                        part = parts[n] = xxhash.xxh3_64_intdigest(f"{own} {n}")
                    sums = found.setdefault((host, token), [0, 0])
                    sums[0] = (sums[0] + part) & (2**64 - 1)
                    sums[1] += 1
            rows = [(h, t, _signed(v), n) for (h, t), (v, n) in found.items()]
            yield pd.DataFrame(rows, columns=["host", "token", "vector", "pages"])

    counted = pages.filter("host is not null").select("page_id", "host", "html").mapInPandas(count, "host long, token long, vector long, pages long")
    # vectors are summed modulo 2**64, in halves so that no sum overflows
    low, high = F.sum(F.col("vector").bitwiseAND(F.lit(2**32 - 1))), F.sum(F.shiftrightunsigned("vector", 32))
    sums = counted.groupBy("host", "token").agg(low.alias("low"), high.alias("high"), F.sum("pages").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    vector = F.xxhash64(F.pmod("low", F.lit(2**32)), F.pmod(F.col("high") + F.shiftrightunsigned("low", 32), F.lit(2**32)), "pages")
    sums = stored(sums.select("host", "token", vector.alias("class"), "pages"), "tokens")
    hosts = sums.filter("token = 0").select("host", F.col("pages").alias("of"))
    return sums.filter("token != 0").join(hosts, "host").filter(F.col("pages") >= LEAST_SHARE * F.col("of")).select("host", "token", "class")


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, packed): the valid classes of each host with their nesting, its template's containers, and its tokens, for ``Template``.

    A host's numbers are bounded by its pages' length, as every token is on a tenth of the pages at least.  Hosts with fewer pages than
    ``LEAST_PAGES``, and URLs without a host, have no template.
    """
    tokens = stored(candidate_classes(pages), "classes")
    packed = tokens.groupBy("host").agg(F.flatten(F.collect_list(F.array("token", "class"))).alias("packed"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacked = _Unpacked(lambda packed: dict(_numbers(packed, 2)))
        for batch in batches:
            found: dict[tuple[int, int, int], list[int]] = {}
            for host, text, numbers in zip(batch["host"], batch["html"], batch["packed"], strict=True):
                classes = unpacked(host, numbers)
                page = Page(text)
                rows = [(0, c, order, around, _hash(around, slot), 0) for c, order, around, slot in order_and_nesting(page, classes)]
                rows += [(1, t, depth, kind, 0, n) for t, (n, depth, kind) in page.gathered(own_blocks(page, classes)).items() if t in classes]
                for kind, key, x, y, z, n in rows:
                    seen = found.get((host, kind, key))
                    if seen is None:
                        found[host, kind, key] = [x, x, y, z, z, n]
                    else:
                        found[host, kind, key] = [min(seen[0], x), max(seen[1], x), max(seen[2], y), min(seen[3], z), max(seen[4], z), seen[5] + n]
            yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["host", "kind", "key", "x0", "x1", "y", "z0", "z1", "n"])

    schema = "host long, kind long, key long, x0 long, x1 long, y long, z0 long, z1 long, n long"
    seen = _by_host(pages.filter("host is not null").select("host", "html"), packed).filter("packed is not null").mapInPandas(look, schema)
    seen = stored(seen.groupBy("host", "kind", "key").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.max, "y"), (F.min, "z0"), (F.max, "z1"), (F.sum, "n"))]), "seen")
    row = lambda *columns: F.array(*[c.cast("long") if isinstance(c, Column) else F.lit(c).cast("long") for c in columns]).alias("row")
    valid = seen.filter("kind = 0 and x0 = x1 and z0 = z1").select("host", row(0, F.col("key"), F.col("y"), 0, 0))
    gathered = seen.filter("kind = 1").select("host", row(1, F.col("key"), F.col("n"), F.col("x0"), F.col("y")))
    rows = valid.unionByName(gathered).unionByName(tokens.select("host", row(2, F.col("token"), F.col("class"), 0, 0)))
    return rows.groupBy("host").agg(F.flatten(F.collect_list("row")).alias("packed"))


def extract(page: Page, template: Template | None) -> str:
    """The blocks in the main container's slots, joined by an empty line.

    The template's texts go, unless they are over half of what the container holds: such pages are copies of each other.
    """
    own = own_blocks(page, template.classes) if template else [True] * len(page.blocks)
    slot, gathered = template.main if template else None, page.gathered(own) or page.gathered([True] * len(own))
    if slot not in gathered or any(kind == _MAIN for _, _, kind in gathered.values()) and gathered[slot][2] != _MAIN:
        slot = main_slot(gathered)
    inside = page.within(slot) if slot is not None else [True] * len(page.token)
    kept = [(words, mine) for (node, _, words), mine in zip(page.blocks, own, strict=True) if inside[node] and not page.out[node]]
    copied = 2 * sum(len(w) for w, mine in kept if mine) < sum(len(w) for w, _ in kept)
    return "\n\n".join(w for w, mine in kept if mine or copied)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text for each row of ``pages`` (page_id, url, html; others are ignored).

    A block's white space is one blank, blocks are in page order with an empty line between.  A null or empty html gives an empty text; a
    null URL has no host, and pages without one, or of hosts with few pages, are read by themselves; repeated rows are treated alike.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host("url").alias("host"))
    templates = stored(host_templates(pages), "templates")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacked = _Unpacked(Template)
        for batch in batches:
            texts = [extract(Page(h), unpacked(host, t)) for host, h, t in zip(batch["host"], batch["html"], batch["packed"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})

    return _by_host(pages, templates).select("page_id", "url", F.coalesce("host", F.lit(0)).alias("host"), "html", "packed").mapInPandas(read, "page_id long, url string, text string")
