"""Operator 8, HTML extraction with wrappers: union-free regular expressions inferred for each host.

A page becomes a stream of block tags and text blocks. Two streams of a host are aligned level by level: equal tags
merge; where the sequences differ, neighbouring equals fold into repeated groups, and what only one side still has
becomes optional; equal text stays text of the template, differing text becomes a slot. Merging is done per batch,
then per host in two salted steps, so a host with a third of all pages never meets in one task. The host's wrapper
tells where the article is, by its slots, and which text is the template's; each page is then read through it.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import Written, broadcast_if_small, slices

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"))
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSES = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
    "option": frozenset(("option",)), "body": frozenset(("head",)), "tbody": frozenset(("thead", "tbody", "tr", "td", "th")), "tfoot": frozenset(("tbody", "tr", "td", "th")),
}
SCOPE = frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "td", "th", "blockquote", "aside", "nav", "header", "footer", "form"))
#: Elements that never hold main text.
DROP = frozenset("nav footer aside form script style noscript template iframe textarea select button option object svg math canvas audio video head title menu dialog input label".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id names that mark what is not the article, and words that may stand beside them in a name.
DROP_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars "
    "footer comment comments commentlist disqus reply replies notice notices cookie cookies consent gdpr newsletter subscribe subscription share sharing social related recommended popup modal overlay "
    "widget widgets login signup search toolbar pagination pager masthead topbar paywall skip".split()
)
BESIDE_WORDS = frozenset(
    "site page top bottom box container wrapper wrap block list item items link links bar area slot unit header left right inner outer sticky global main primary secondary section panel module form button "
    "buttons text message content column group title body author meta posts articles stories user users reader readers media icons icon".split()
)
#: Elements and words that mark the article.
KEEP_WORDS = frozenset("article post entry story".split())

#: A tag ends at the first > outside well-formed quotes; quotes that nothing opens are signs like others.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|(?<!=)["'])*+)>|([^<]+|<(?![a-zA-Z/])|</(?![a-zA-Z]))""", re.S
)
#: A tag with quotes that do not close ends at the next angle bracket.
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>?")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_MARKS = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")


def _drops(name: str) -> bool:
    """Whether a class or id name marks what is not the article: of its words one does, and none tells of something else."""
    words = [w for w in _MARKS.split(name) if len(w) > 1]
    return any(w in DROP_WORDS for w in words) and all(w in DROP_WORDS or w in BESIDE_WORDS for w in words)


def signature(tag: str, attributes: str) -> str:
    """tag and the marks of its attributes that steer extraction: a wrapper is told apart by nothing else."""
    if not attributes or "=" not in attributes:
        return tag
    marks = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "hidden", "aria-hidden"):
            value = value.strip("\"'").lower()
            if name == "role":
                marks.update("drop" if w in DROP_ROLES else "keep" for w in value.split() if w in DROP_ROLES or w in ("main", "article"))
            elif name == "itemprop":
                marks.update(("keep",) if "articlebody" in value else ())
            elif name in ("class", "id"):
                for w in value.split():
                    if _drops(w):
                        marks.add("drop")
                    elif not KEEP_WORDS.isdisjoint(_MARKS.split(w)):
                        marks.add("keep")
            elif value == "true" or value == "hidden":
                marks.add("drop")
    if tag in ("html", "body"):
        return tag
    return f"{tag} {'drop' if 'drop' in marks else 'keep'}" if marks else tag


def events(page: str) -> Iterator[tuple[str, str]]:
    """("open", signature), ("close", tag), ("void", tag) and ("text", raw text), with left-out end tags supplied."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where each tag is open; nesting has no limit, so the stack is not searched

    def last(tags: frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(down: int) -> Iterator[tuple[str, str]]:
        while len(stack) > down:
            top = stack.pop()
            places[top].pop()
            yield "close", top

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at) or _BROKEN.match(page, at)
        at = m.end()
        closing, tag, attributes = m.groups()[:3]
        text = m[4] if m.re is _TOKEN else None
        if text is not None:
            yield "text", text
            continue
        if tag is None:
            continue
        tag = tag.lower().replace("|", "")
        if closing:
            if places.get(tag):
                yield from close(places[tag][-1])
            continue
        # A block ends an open paragraph and what is open inside it.
        if tag in BLOCK and places.get("p") and last(SCOPE) < places["p"][-1]:
            yield from close(places["p"][-1])
        if tag in CLOSES:
            ended = last(CLOSES[tag])
            if ended > last(SCOPE - CLOSES[tag]):
                # All that is open from the innermost such element on.
                yield from close(ended)
        if tag in VOID or attributes.endswith("/"):
            yield "void", tag
            continue
        yield "open", signature(tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                yield "raw", page[at:stop]
            at = end.end() if end else n
            yield "close", tag
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(tag)
    yield from close(0)


def dropped(sig: str, inside_article: bool) -> bool:
    tag, _, mark = sig.partition(" ")
    return tag in DROP or mark == "drop" or (tag == "header" and not inside_article)


def marks_article(sig: str) -> bool:
    tag, _, mark = sig.partition(" ")
    return tag in ("article", "main") or mark == "keep"


def blocks(page: str) -> Iterator[tuple[str, str, int]]:
    """The page as ("open", signature), ("close", "") and ("text", block, characters inside links).

    Blocks are decoded and their white space is one space; elements that are no blocks belong to the text around them. What
    no article holds (by tag or mark) is left out with all inside it.
    """
    kept: list[str] = []  # text of the block at hand
    linked = links = 0
    stack: list[int] = []  # of each open element: 0 part of a block, 1 a block, 2 left out, 3 a link
    out = 0

    def end() -> Iterator[tuple[str, str, int]]:
        nonlocal linked
        if kept:
            text = _SPACE.sub(" ", html_lib.unescape("".join(kept))).strip()
            kept.clear()
            if text:
                yield "text", text, min(linked, len(text))
        linked = 0

    for kind, value in events(page):
        if kind == "open":
            tag, _, mark = value.partition(" ")
            if out or dropped(value, True):
                if not out and tag in BLOCK:
                    yield from end()
                stack.append(2)
                out += 1
            elif tag in BLOCK or mark:
                yield from end()
                yield "open", value, 0
                stack.append(1)
            else:
                if tag in ("td", "th"):
                    kept.append(" ")
                stack.append(3 if tag == "a" else 0)
                links += tag == "a"
        elif kind == "close":
            was = stack.pop()
            if was == 2:
                out -= 1
            elif was == 1:
                yield from end()
                yield "close", "", 0
            elif was == 3:
                links -= 1
        elif out:
            continue
        elif kind == "text":
            kept.append(value)
            linked += len(value.strip()) if links else 0
        elif kind == "raw":  # shown as it stands
            kept.append(value.replace("&", "&amp;"))
        elif value in BLOCK:
            yield from end()
        elif value == "br":
            kept.append(" ")
    yield from end()


# A wrapper node is [signature, optional, repeated, kids, characters outside links, characters inside links, seen]: seen
# holds the three smallest of the distinct hashes of its texts (of the root: of its pages), so one hash means equal text.
TEXT, MOST_SEEN = "#", 3


def page_tree(page: str) -> list:
    """The page as a wrapper of itself."""
    root = ["", False, False, [], 0, 0, [xxhash.xxh64_intdigest(page)]]
    stack = [root]
    for kind, value, linked in blocks(page):
        if kind == "open":
            node = [value, False, False, [], 0, 0, []]
            stack[-1][3].append(node)
            stack.append(node)
        elif kind == "close":
            stack.pop()
        else:
            stack[-1][3].append([TEXT, False, False, [], len(value) - linked, linked, [xxhash.xxh64_intdigest(value)]])
    return root


def _run(task: Generator):
    """The result of a recursive generator that yields its sub-tasks; pages may nest deeper than Python's stack."""
    tasks, value = [task], None
    while tasks:
        try:
            tasks.append(tasks[-1].send(value))
            value = None
        except StopIteration as done:
            tasks.pop()
            value = done.value
    return value


def merge(a: list, b: list) -> list:
    """The smallest wrapper that matches what either matches."""
    return _run(_merging(a, b))


def _folding(kids: list[list]) -> Generator:
    """Repeated groups: from the first child with a signature on, all children up to its next occurrence repeat."""
    out: list[list] = []
    place: dict[str, int] = {}
    for kid in kids:
        i = place.get(kid[0])
        if i is None:
            place[kid[0]] = len(out)
            out.append(kid)
        else:
            out[i] = (yield _merging(out[i], kid)) if out[i][3] or kid[3] else _joined(out[i], kid, [])
            out[i][2] = True
            for j in range(i + 1, len(out)):
                if not out[j][2]:
                    out[j] = [*out[j][:2], True, *out[j][3:]]
    return out


def _joined(a: list, b: list, kids: list[list]) -> list:
    seen = a[6] if a[6] == b[6] else sorted({*a[6], *b[6]})[:MOST_SEEN]
    return [a[0], a[1] or b[1], a[2] or b[2], kids, a[4] + b[4], a[5] + b[5], seen]


def _merging(a: list, b: list) -> Generator:
    """Children of equal sequences merge one by one; else both sides fold and align by their longest common sequence."""
    x, y = a[3], b[3]
    kids: list[list] = []
    if [k[0] for k in x] != [k[0] for k in y]:
        x, y = (yield _folding(x)), (yield _folding(y))
    if [k[0] for k in x] == [k[0] for k in y]:
        for p, q in zip(x, y, strict=True):
            kids.append((yield _merging(p, q)) if p[3] or q[3] else _joined(p, q, []))
    else:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
        i, j = 0, 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i][0] == y[j][0]:
                kids.append((yield _merging(x[i], y[j])) if x[i][3] or y[j][3] else _joined(x[i], y[j], []))
                i, j = i + 1, j + 1
            elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
                kids.append([x[i][0], True, *x[i][2:]])
                i += 1
            else:
                kids.append([y[j][0], True, *y[j][2:]])
                j += 1
        kids = yield _folding(kids)
    return _joined(a, b, kids)


def _flat(node: list) -> str:
    """The wrapper as JSON: nodes in order, each with its number of children in place of them."""
    out, todo = [], [node]
    while todo:
        now = todo.pop()
        out.append([*now[:3], len(now[3]), *now[4:]])
        todo.extend(reversed(now[3]))
    return json.dumps(out, separators=(",", ":"))


def _tree(flat: str) -> list:
    done: list[list] = []
    for row in reversed(json.loads(flat)):
        done.append([*row[:3], [done.pop() for _ in range(row[3])], *row[4:]])
    return done[0]


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression of tags, for people: # is a slot, = text of the template."""
    out: list[str] = []
    todo: list[list | str] = [node]
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            out.append(now)
            continue
        many = "*" if now[1] and now[2] else "+" if now[2] else "?" if now[1] else ""
        if now[0] == TEXT:
            out.append(("=" if len(now[6]) == 1 else "#") + many)
        elif now[0]:
            out.append(f"(<{now[0]}>")
            todo.append("</>)" + many)
        todo.extend(reversed(now[3]))
    return "".join(out)


def _articles(wrapper: list, told: bool) -> tuple[list[list], bool]:
    """The nodes that hold the article, and whether marks tell so. ``told``: text that never differs weighs nothing.

    Marked elements with weight come first; without any, the way goes down while one child holds most of the weight.
    """
    order, todo = [], [wrapper]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node[3])
    weight: dict[int, int] = {}  # text outside links; children come first
    for node in reversed(order):
        own = 0 if told and len(node[6]) == 1 else node[4]
        weight[id(node)] = own + sum(weight[id(k)] for k in node[3])
    marked, todo = [], [wrapper]
    while todo:
        for kid in todo.pop()[3]:
            if not dropped(kid[0], False):
                if marks_article(kid[0]) and weight[id(kid)] > 0:
                    marked.append(kid)
                else:
                    todo.append(kid)
    if marked:
        return marked, True
    node = wrapper
    while weight[id(node)]:
        kids = [k for k in node[3] if not dropped(k[0], False)]
        best = max(kids, key=lambda k: weight[id(k)], default=None)
        alike = any(k is not best and k[0] == best[0] and weight[id(k)] for k in kids)
        if best is None or alike or best[2] or best[0] == TEXT or best[0].split(" ")[0] in ("p", "ul", "ol", "table") or weight[id(best)] < 0.6 * weight[id(node)]:
            break
        node = best
    return [node], False


def rules(wrapper: list) -> str:
    """How to read a page: the nodes on the way to the article and inside it that matter, as JSON in the order of _flat.

    Each is [key, holds the article, left out, hashes of template text, number of children]; the key is the signature, with
    its number among equal ones where the host's pages have them all alike. Template text is one that no page of the host
    lacks and none differs in. It counts only where at least three pages differ and some slot of the article has three
    texts: pages that are copies of each other tell nothing about their template.
    """
    told = len(wrapper[6]) == MOST_SEEN
    found, marked = _articles(wrapper, told)
    varied, todo = False, list(found)
    while todo and not varied:
        node = todo.pop()
        varied = node[0] == TEXT and len(node[6]) == MOST_SEEN
        todo.extend(node[3])
    if told and not (varied and marked):
        again, by_marks = _articles(wrapper, False)
        if by_marks or not varied:  # a marked article that never differs goes before unmarked text that does
            found, marked, varied = again, by_marks, False
    places = {id(n) for n in found}
    # Children before parents: what is needed of each node.
    needed: dict[int, list] = {}
    order: list[tuple[list, bool, bool, bool]] = []
    walk = [(wrapper, False, True, False)]
    while walk:
        node, inside, always, top = walk.pop()
        own = id(node) in places
        order.append((node, inside or own, always, top))
        walk.extend((k, inside or own, always and not k[1], own) for k in node[3])
    for node, inside, always, top in reversed(order):
        own = id(node) in places
        here = always and varied and inside
        texts = sorted({k[6][0] for k in node[3] if k[0] == TEXT and here and not k[1] and len(k[6]) == 1})
        plain, linked, todo = 0, 0, [node] if top and not marked and node[0].split(" ")[0] in ("div", "ul", "ol", "section", "table") else []
        while todo:  # a list of links beside an unmarked article
            one = todo.pop()
            plain, linked = plain + one[4], linked + one[5]
            todo.extend(one[3])
        out = linked > 4 * plain
        times: dict[str, int] = {}
        for k in node[3]:
            times[k[0]] = times.get(k[0], 0) + 1
        kids, number = [], {}
        for k in node[3]:
            number[k[0]] = number.get(k[0], 0) + 1
            if id(k) in needed:
                kids.append([k[0] if times[k[0]] == 1 else f"{k[0]}|{number[k[0]]}", *needed[id(k)][1:]])
        if own or texts or out or kids or node is wrapper:
            needed[id(node)] = [node[0], own, out, texts, kids]
    flat, todo = [], [needed[id(wrapper)]]
    while todo:
        now = todo.pop()
        flat.append([now[0], int(now[1]), int(now[2]), now[3], len(now[4])])
        todo.extend(reversed(now[4]))
    return json.dumps(flat, separators=(",", ":"))


class Rule:
    """One node of the rules; kids by key, and the signatures whose keys are numbered."""

    __slots__ = ("article", "kids", "numbered", "out", "texts")

    def __init__(self, article: bool, out: bool, texts: frozenset[int], kids: dict[str, Rule]):
        self.article, self.out, self.texts, self.kids = article, out, texts, kids
        self.numbered = frozenset(k.split("|")[0] for k in kids if "|" in k)


def load_rules(flat: str) -> Rule:
    done: list[tuple[str, Rule]] = []
    for key, article, out, texts, n in reversed(json.loads(flat)):
        done.append((key, Rule(bool(article), bool(out), frozenset(texts), dict(done.pop() for _ in range(n)))))
    return done[0][1]


def read(page: str, rule: Rule) -> str:
    """The blocks of a page in the article, one a line, without what the rules leave out and without template text."""
    lines: list[str] = []
    # The rule here, in the article, left out, and how many children of a numbered signature there were.
    stack: list[tuple[Rule | None, bool, bool, dict[str, int]]] = [(rule, rule.article, False, {})]
    for kind, value, _ in blocks(page):
        here, inside, out, count = stack[-1]
        if kind == "open":
            below = None
            if here is not None and value in here.numbered:
                count[value] = count.get(value, 0) + 1
                below = here.kids.get(f"{value}|{count[value]}")
            elif here is not None:
                below = here.kids.get(value)
            own = below is not None and below.article
            stack.append((below, inside or own, out or (below is not None and below.out) or (not own and dropped(value, inside)), {}))
        elif kind == "close":
            stack.pop()
        elif inside and not out and not (here is not None and here.texts and xxhash.xxh64_intdigest(value) in here.texts):
            lines.append(value)
    return "\n".join(lines)


def extract(page: str, rule: Rule | None) -> str:
    """Read a page through its host's rules; a page in which they find no article is its own wrapper."""
    text = read(page, rule) if rule is not None else ""
    if not text and page.strip():
        text = read(page, load_rules(rules(page_tree(page))))
    return text


def extract_alone(page: str) -> str:
    """Read a page that has no host: it is its own wrapper."""
    return extract(page, None)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> one partial wrapper for each host of a batch."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for batch in batches:
        known: dict[str, list] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if page:
                tree = page_tree(page)
                known[host] = merge(known[host], tree) if host in known else tree
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(known), pa.string()), pa.array([part // 16] * len(known), pa.int32()), pa.array([_flat(w) for w in known.values()], pa.string())], ["host", "salt", "wrapper"]
        )


def _merge_all(table: pa.Table) -> list:
    # Stable order: the result does not depend on which task came first.
    flat = sorted(table.column("wrapper").to_pylist())
    out = _tree(flat[0])
    for one in flat[1:]:
        out = merge(out, _tree(one))
    return out


def _merge_salted(table: pa.Table) -> pa.Table:
    return pa.table({"host": [table.column("host")[0].as_py()], "wrapper": [_flat(_merge_all(table))]})


def _merge_host(table: pa.Table) -> pa.Table:
    wrapper = _merge_all(table)
    return pa.table({"host": [table.column("host")[0].as_py()], "expression": [expression(wrapper)], "rules": [rules(wrapper)]})


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, expression, rules) of all pages' hosts; a null url has the host ""."""
    partial = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_infer, "host string, salt int, wrapper string")
    salted = partial.groupBy("host", "salt").applyInArrow(_merge_salted, "host string, wrapper string")
    return salted.groupBy("host").applyInArrow(_merge_host, "host string, expression string, rules string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, Rule | None] = {None: None}
    for batch in batches:
        for rows in slices(batch, 2):
            texts = []
            for page, flat in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                if flat not in known:
                    if len(known) > 10_000:
                        known = {None: None}
                    known[flat] = load_rules(flat)
                texts.append(extract(page or "", known[flat]))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html, more): page_id, url, text, n_chars.

    text holds the article's blocks in page order, joined by newlines, with character references decoded and white space
    inside a block turned into one space; headings inside the article belong to it. Text that all pages of a host share
    is its template's, once three pages differ. Null or empty html, and pages without an article, give an empty text. A
    host with one page is its own wrapper. Markup that is broken ends at the next angle bracket. Repeated rows give a
    row each; an empty table gives no rows; other columns are ignored.
    """
    known = Written(wrappers(pages).select(F.col("host").alias("__host"), "rules"), "wrappers").df
    side = broadcast_if_small(known, 64, extra=F.length("__host") + F.length("rules"))
    base = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("__of"))
    joined = base.join(side, F.col("__of") == F.col("__host"), "left").select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", "rules")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
