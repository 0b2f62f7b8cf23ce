"""Main text of web pages by equivalence-class template deduction.

Pass 1 reads every page as tokens: its elements by their place in the page (the path of tag
and class names) and its text blocks by place and content.  Over all distinct pages of a host
(copies count once, so a repeated article does not become template), tokens that share one
occurrence vector (the same count on every page) form an equivalence class.  The vector is summed into a fingerprint, so a host of any size is a partial aggregate
and never a list of pages.  Classes on most pages of the host are valid; nested by their
paths they are the host's template, the remaining positions are its slots.

Containers that share a place are told apart by their order, so two unnamed ones are two tokens.

Pass 2 reads every page against its host's template.  The article is a slot of the template: the
innermost container that is once on every page and holds most of the host's text.  Marks of the page
(article and main elements, roles) only fit the slot's edges to the article: one that encloses the slot widens it, ones
inside it that hold most of its text narrow it.  Without a template, or where the page lacks the slot, the marks
decide, and without these the largest container.  Inside the article, blocks of menus, adverts, notices, forms,
comments and the like are left out.  Text of the template is left out where the
article is not marked; inside a marked article nothing goes only because it repeats.  An article that lies loose
in the body is what is not in the template's other, small containers there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import discard, session, stored
from faultlens.llm.urlfilter import host_of

MIN_SHARE = 0.9             # of a host's distinct pages that a valid class must be on
MIN_PAGES = 3               # distinct pages from which a host has a template
BROADCAST_BYTES = 32 << 20  # templates together; beyond it they are joined by host
OUT_BYTES = 8 << 20

# Element names by their role in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg iframe textarea select button audio video canvas annotation "
                 "annotation-xml title".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre "
                   "section summary table tbody td tfoot th thead tr ul".split())
_OUT = frozenset("nav aside footer form menu dialog fieldset head".split())
_MAIN = frozenset("article main".split())
# Roles and name parts (of class and id) that mark what is no part of an article.
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar "
                       "toolbar".split())
_OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
                       "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup "
                       "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comment "
                       "comments disqus reply replies respond share sharing social related recommended widget login search "
                       "pagination pager skip".split())
_AD_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
_COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
_MAIN_WORDS = frozenset("article articlebody main maincontent content entry story post body".split())
_CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
              "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
              "option": frozenset(["option"])}
_STOP = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
         "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]),
         "option": frozenset(["select"])}
# Containers: what can be a slot for a whole article.
_SLOTS = frozenset("article main div section td body html".split())
_ORDERED = _SLOTS | frozenset("nav aside header footer form ul ol table blockquote".split())    # siblings are told apart by order,
MAX_ORDER = 9               # up to so many
SIDE_SHARE = 0.2            # of the loose article's text that another container in the body holds less of
_HEADER = 1     # what an element is: page header; other boilerplate; main content; comments
_BOILER, _CONTENT, _COMMENTS, _NAMED = 2, 4, 8, 16     # _NAMED: boilerplate by a word of class or id only
_PURE, _ADVERT = 32, 64     # class and id hold no other words; an advert by such a word
# Words that make a name one of a state ("comments-open", "has-sidebar").
_STATES = frozenset("has with without no open opened closed enabled disabled on off allowed".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                     r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?",
                        re.I | re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("tag", "path", "kind", "parent", "linked", "order")

    def __init__(self, tag: str, path: str, kind: int, parent: Element | None):
        self.tag, self.path, self.kind, self.parent = tag, path, kind, parent
        self.linked = 0     # characters of its own text that are links
        self.order: dict[str, int] | None = None    # children by name so far

    def name(self, child: str, tag: str) -> str:
        """A child's part of the path: with its order among the containers of that name, from the second on."""
        if tag not in _ORDERED:
            return child
        self.order = self.order or {}
        n = self.order[child] = min(self.order.get(child, 0) + 1, MAX_ORDER)
        return child if n == 1 else f"{child}~{n}"


def _attributes(raw: str) -> tuple[str, int]:
    """Name for the path (from class), and what the attributes say the element is."""
    kind, shown, names = 0, "", set()
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for part in value.split():
                words = {w.lower() for w in _WORD.findall(part)}
                names |= words
                if words & _COMMENT_WORDS and not words & _STATES:
                    kind |= _COMMENTS
            if name == "class" and value:
                shown = "." + ".".join(sorted(value.lower().split()))
        elif name == "role":
            if value.lower() in _OUT_ROLES:
                kind |= _BOILER
            elif value.lower() in ("main", "article"):
                kind |= _CONTENT
        elif name == "itemprop":
            if value.lower() == "articlebody":
                kind |= _CONTENT
            elif value.lower() == "comment":
                kind |= _BOILER | _COMMENTS
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" \
                or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            kind |= _BOILER
    if names & _OUT_WORDS:
        kind |= _NAMED if names - _OUT_WORDS else _NAMED | _PURE
    if names & _AD_WORDS:
        kind |= _ADVERT
    return shown, kind


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """The page's elements, and its text blocks in page order, each with the element it lies in.

    Unclosed and misplaced tags are accepted.  An article or main element that opens inside an
    unclosed menu, advert or page header ends it.  Scripts, styles, form controls, comments and
    declarations carry no text; line breaks are white space.
    """
    root = Element("", "", 0, None)
    elements, blocks, at = [], [], root
    pieces: list[str] = []
    place = muted = 0       # muted: depth inside an inline advert or hidden span
    link = False

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                blocks.append((at, text))

    def up_to(tags: frozenset[str], stop: frozenset[str]) -> Element | None:
        e = at
        while e is not None and e.tag not in tags:
            if e.tag in stop:
                return None
            e = e.parent
        return e

    size = len(page)
    while place < size:
        m = _MARKUP.search(page, place)
        if m is None:
            if not muted:
                pieces.append(page[place:])
            break
        if m.start() > place and not muted:
            pieces.append(page[place:m.start()])
            at.linked += (m.start() - place) * link
        place = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "a":
            link = not m[1]
        if m[1]:
            if tag == "span":
                muted -= muted > 0
            if tag not in _BLOCK:
                continue
            muted, link = 0, False
            e = up_to(frozenset([tag]), frozenset())
            flush()
            if e is not None and e.parent is not None:
                at = e.parent
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, place)
                if tag == "title" or end is not None or tag in ("script", "style"):
                    place = end.end() if end else size
            continue
        if tag in ("br", "hr", "wbr"):
            pieces.append(" " if tag != "wbr" else "")
            if tag == "hr":
                flush()
            continue
        if tag in _VOID:
            continue
        name, kind = _attributes(m[3]) if m[3].strip() else ("", 0)
        if tag == "span":
            muted += bool(muted or kind & (_BOILER | _ADVERT))
            continue
        if tag not in _BLOCK:
            continue
        muted = 0
        flush()
        if tag in ("article", "main", "body", "html"):      # no class word makes these boilerplate
            if kind & _COMMENTS and tag == "article" and up_to(frozenset(["article"]), frozenset()):
                kind |= _BOILER     # but an article within an article can be a comment
            else:
                kind &= ~(_NAMED | _PURE | (0 if kind & _BOILER else _COMMENTS))
        if tag in _MAIN:
            kind |= _CONTENT
            e, outer = at, None
            while e is not None:        # a menu or advert that was never closed ends here
                if e.kind & (_BOILER | _NAMED | _HEADER) and not e.kind & _COMMENTS:
                    outer = e
                e = e.parent
            if outer is not None and outer.tag not in _OUT - {"nav", "head"} and outer.parent is not None:
                at = outer.parent
        elif tag in _OUT:
            kind |= _BOILER
        elif tag == "header":
            kind |= _HEADER
        if tag in _CLOSED_BY:
            e = up_to(_CLOSED_BY[tag], _STOP[tag])
            at = e.parent if e is not None and e.parent is not None else at
        if at.tag == "p" or re.fullmatch("h[1-6]", at.tag) and re.fullmatch("h[1-6]", tag):
            at = at.parent
        if tag == "body":
            e = up_to(frozenset(["head"]), frozenset())
            at = e.parent if e is not None else at
        at = Element(tag, f"{at.path}/{at.name(tag + name, tag)}", kind, at)
        elements.append(at)
    flush()
    return elements, blocks


def text_token(path: str, text: str) -> str:
    return f"{path}#{xxhash.xxh64_hexdigest(text.encode())}"


def page_tokens(page: str) -> tuple[Counter, Counter]:
    """(occurrences of every token, characters of text in every container that no mark excludes)."""
    elements, blocks = parse(page)
    chars: Counter = Counter()
    for b, t in blocks:
        if not _left_out(b, None):
            e = b
            while e is not None:
                if e.tag in _SLOTS:
                    chars[e.path] += len(t)
                e = e.parent
    return Counter([e.path for e in elements]) + Counter([text_token(e.path, t) for e, t in blocks]), chars


TEMPLATE = ("host string, n_pages long, classes array<struct<tokens:array<string>,chars:array<long>,pages:long,"
            "per_page:double,parent:int>>")


def _nest(host: str, n_pages: int, rows: list[tuple[str, int, int, int, int]]) -> dict:
    """Order a host's valid tokens into classes and link each class to the one that encloses it."""
    groups: dict[tuple[int, int, int], list[str]] = {}
    held = {}
    for token, pages, total, vector, chars in rows:
        groups.setdefault((vector, pages, total), []).append(token)
        held[token] = chars
    classes = sorted(((sorted(tokens), pages, total) for (_, pages, total), tokens in groups.items()),
                     key=lambda c: (min(t.count("/") for t in c[0]), c[0]))
    class_of = {t: i for i, c in enumerate(classes) for t in c[0]}
    out = []
    for i, (tokens, pages, total) in enumerate(classes):
        path, parent = min(tokens, key=lambda t: (t.count("/"), t)).split("#")[0], -1
        while path and parent < 0:
            path = path.rpartition("/")[0]
            found = class_of.get(path, i)
            parent = found if found != i else -1
        out.append({"tokens": tokens, "chars": [held[t] for t in tokens], "pages": pages, "per_page": total / pages, "parent": parent})
    return {"host": host, "n_pages": n_pages, "classes": out}


def deduce_templates(pages: DataFrame, min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, n_pages, classes: each host's template, from all its distinct pages (page_id, url, html).

    A class holds the tokens with one occurrence vector, with the characters of text that containers among
    them held on all pages; ``parent`` is the index of the class that encloses it (-1: none).  Hosts with fewer than ``min_pages`` distinct pages have no template.
    """
    session(pages)
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # Each html of a host counts once; a map task sends one copy of it, so repeated pages stay small.
    rows = (rows.groupBy("host", F.sha2("html", 256).alias("digest")).agg(F.first("html").alias("html"))
            .select("host", "html", F.xxhash64("digest").alias("page")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch, one row for each host and token: pages, total and the summed vector."""
        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for host, page, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, chars = page_tokens(page)
                tokens[""] = 1      # counts the host's pages
                for token, n in tokens.items():
                    s = sums.setdefault((host, token), [0, 0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[3] += chars.get(token, 0)
                    s[2] = (s[2] + key * (2 * n + 1)) & 0xFFFFFFFFFFFFFFFF
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1] for k in keys], pa.int64()),
                 pa.array(np.array([sums[k][2] for k in keys], dtype=np.uint64).view(np.int64) >> 2),
                 pa.array([sums[k][3] for k in keys], pa.int64())],
                names=["host", "token", "pages", "total", "vector", "chars"])

    # The vectors lose two bits so that their sum has room; it only has to be the same for the same counts.
    stats = (rows.mapInArrow(run, "host string, token string, pages long, total long, vector long, chars long")
             .groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"),
                                           F.sum(F.pmod("vector", F.lit((1 << 43) - 57))).alias("vector"),
                                           F.sum("chars").alias("chars")))
    stats, path = stored(stats.where(F.col("pages") >= min_pages), "html_tokens")
    hosts, host_path = stored(stats.where("token = ''").select("host", F.col("pages").alias("n_pages")), "html_hosts")
    valid = (stats.where("token <> ''").join(hosts, "host").where(F.col("pages") >= F.col("n_pages") * min_share)
             .select("host", "n_pages", "token", "pages", "total", "vector", "chars"))

    def nest(pdf):
        import pandas as pd
        first = pdf.iloc[0]
        return pd.DataFrame([_nest(first["host"], int(first["n_pages"]), list(
            zip(pdf["token"], *(pdf[c].astype(int) for c in ("pages", "total", "vector", "chars")), strict=True)))])

    # A host has few valid tokens, however many pages: each is on most of them.
    out, _ = stored(valid.groupBy("host").applyInPandas(nest, TEMPLATE), "html_templates")
    discard(out.sparkSession, path, host_path)
    return out


class Template:
    """What extraction asks of a host's template."""

    def __init__(self, row: dict | None):
        classes = row["classes"] if row else []
        self.once = {t for c in classes if c["per_page"] == 1 for t in c["tokens"]}
        self.text = {t for c in classes for t in c["tokens"] if "#" in t}
        held = {t: n for c in classes if c["per_page"] == 1 for t, n in zip(c["tokens"], c["chars"]) if n}
        most = max(held.values(), default=0)
        # Containers with more than half of the text enclose each other; the innermost is the article's slot.
        self.slot = max((t for t, n in held.items() if 2 * n > most), key=lambda t: (t.count("/"), t), default=None)
        self.sides = set()      # small containers beside an article that lies loose in the body
        if self.slot and self.slot.rpartition("/")[2].partition(".")[0] in ("body", "html"):
            self.sides = {t for t, n in held.items() if t.startswith(self.slot + "/") and n < SIDE_SHARE * held[self.slot]}


def _left_out(e: Element, until: Element | None) -> bool:
    while e is not None and e is not until:
        if e.kind & (_BOILER | _NAMED) or e.kind & _HEADER and until is None:
            return True
        e = e.parent
    return False


def _inside(e: Element, outer: Element) -> bool:
    while e is not None:
        if e is outer:
            return True
        e = e.parent
    return False


def _unname(elements: list[Element], blocks: list[tuple[Element, str]], template: Template) -> None:
    """Class and id words do not exclude an element that holds most of the page's text.

    Text of the template, of boilerplate by tag or role, and of comments does not count.  Lists of
    links stay excluded, and so do comments and elements named by nothing but such words
    ("ad", "cookie-notice"), unless a main heading or the marked article is inside.
    """
    if not any(e.kind & _NAMED for e in elements):
        return
    own: Counter = Counter()
    for b, t in blocks:
        if text_token(b.path, t) not in template.text:
            own[b] += len(t)
    text, counted, linked, out, holds = {}, {}, {}, {}, set()
    for e in elements:      # parents come before what they hold
        up = out.get(e.parent, False)
        out[e] = up or bool(e.kind & _BOILER or e.kind & _NAMED and e.kind & _COMMENTS)
        text[e], counted[e], linked[e] = own[e], 0 if out[e] else own[e], e.linked
    total = sum(counted.values()) + sum(n for e, n in own.items() if e not in text)
    for e in reversed(elements):
        if e.tag == "h1" or e.kind & _CONTENT and not e.kind & _BOILER:
            holds.add(e)
        if e.parent in text:
            text[e.parent] += text[e]
            counted[e.parent] += counted[e]
            linked[e.parent] += linked[e]
            if e in holds:
                holds.add(e.parent)
    for e in elements:
        if e.kind & _NAMED and 2 * (text[e] if e in holds else counted[e]) > total and 2 * linked[e] <= text[e] \
                and (e in holds or not e.kind & (_COMMENTS | _PURE)):
            e.kind &= ~(_NAMED | _COMMENTS)


def extract(page: str | None, template: Template) -> str:
    """The page's main text: one line per block; empty if there is none."""
    elements, blocks = parse(page or "")
    _unname(elements, blocks, template)
    marked = [e for e in elements if e.kind & _CONTENT and not _left_out(e, None)]
    # The innermost kind of mark counts: articles within a main element, else the main element.
    articles = [e for e in marked if e.tag == "article"] or marked
    tops = [e for e in articles if not any(o is not e and _inside(e, o) for o in articles)]
    slot = next((e for e in elements if e.path == template.slot and not _left_out(e, None)), None)
    if slot is not None:
        around = [e for e in tops if _inside(slot, e)]
        within = [e for e in tops if e is not slot and _inside(e, slot)]
        tops = around or (within if 2 * _chars(blocks, within) >= _chars(blocks, [slot]) else [])
    if tops:
        keep = [(b, t, next((o for o in tops if _inside(b, o)), None)) for b, t in blocks]
        return "\n".join(t for b, t, o in keep if o is not None and not _left_out(b, o))
    keep = [(b, t) for b, t in blocks if not _left_out(b, None) and text_token(b.path, t) not in template.text]
    if slot is not None:
        return "\n".join(t for b, t in keep if _inside(b, slot) and not _aside(b, slot, template))
    largest = _largest_slot([(b, t) for b, t in keep], elements, template)
    return "\n".join(t for b, t in keep if largest is None or _inside(b, largest))


def _chars(blocks: list[tuple[Element, str]], within: list[Element]) -> int:
    return sum(len(t) for b, t in blocks if any(_inside(b, e) for e in within))


def _aside(e: Element | None, slot: Element, template: Template) -> bool:
    """Whether the block lies in one of the template's small containers beside a loose article."""
    while template.sides and e is not None and e is not slot:
        if e.path in template.sides:
            return True
        e = e.parent
    return False


def _largest_slot(blocks: list[tuple[Element, str]], elements: list[Element], template: Template) -> Element | None:
    """The innermost element (of the template's once-a-page classes, if it has one) that holds most of the
    text; in pages without such a slot, elements named as content come first."""
    total = sum(len(t) for _, t in blocks)
    held: Counter = Counter()
    for b, t in blocks:
        e = b
        while e is not None:
            held[e] += len(t)
            e = e.parent
    named = [e for e in elements if held[e] and {w for w in _WORD.findall(e.path.rpartition("/")[2])} & _MAIN_WORDS
             and e.tag in ("div", "section", "td")]
    fitting = [e for e in elements if e.tag in ("div", "section", "td", "body") and 2 * held[e] > total
               and (not template.once or e.path in template.once)]
    best = template.once and fitting or [e for e in named if 2 * held[e] > total] or fitting
    return max(best, key=lambda e: e.path.count("/")) if best else None


def main_text(pages: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """page_id, url, text (empty if none) of every row of ``pages`` (page_id, url, html).

    A null html is empty.  Rows with a null url, or one without a host, share the empty host.
    Repeated rows give repeated results; other columns are not read; an empty table gives an
    empty result.
    """
    spark = session(pages)
    templates = deduce_templates(pages) if templates is None else templates
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                        host_of(F.col("url")).alias("host"))
    known = templates.select(F.col("host"), F.struct("n_pages", "classes").alias("template"))
    size = templates.agg(F.sum(F.length(F.to_json("classes")) + F.length("host"))).first()[0] or 0
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left") \
        .select("page_id", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Template] = {}
        for batch in batches:
            texts, begin, size = [], 0, 0
            for i in range(batch.num_rows):
                host = batch.column(3)[i].as_py()
                if host not in seen:
                    if len(seen) > 1_000:
                        seen.clear()
                    seen[host] = Template(batch.column(4)[i].as_py())
                texts.append(extract(batch.column(2)[i].as_py(), seen[host]))
                size += len(texts[-1])
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, len(texts)), batch.column(1).slice(begin, len(texts)),
                         pa.array(texts, pa.string())], names=["page_id", "url", "text"])
                    texts, begin, size = [], i + 1, 0

    out = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType())])
    return joined.mapInArrow(run, out)
