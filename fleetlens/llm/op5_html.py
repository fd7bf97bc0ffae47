"""Main text of web pages by wrapper inference: union-free regular expressions from same-host pages.

A page is parsed to the stream of its structural tags and texts. Pages of a host are aligned one after the other: equal
tags merge, a tag only some pages have becomes optional, neighbours that repeat (alone or as a group) become a repetition,
texts that differ become slots and equal ones stay constant. The result, the wrapper, is the template of the host; in it
the named main parts are found (article or main elements), and every page is then read through its host's wrapper: a page
without a named part is read whole, but for texts that the wrapper shows as constant and for marked furniture. Wrappers merge associatively: each batch of pages gives one partial wrapper
per host, and these are merged in groups of at most ``FAN_IN`` until one is left, so no task sees a whole host.

Defined results: NULL and empty html give an empty text; a NULL, relative or repeated url is a host like any other; repeated
rows are read one by one; below ``DEEPEST`` levels elements only separate blocks (no text is lost).
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, own_columns, saved, table
from fleetlens.llm.registry import query

FAN_IN = 256
DEEPEST = 150
LONGEST_PERIOD = 3
FEWEST_CONSTANT = 3  # pages of different content that must agree before a text counts as constant
SHOWN = 200          # characters of a constant text that the wrapper shows

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<text>[^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody thead tfoot tr ul "
    "caption head".split())
CLOSES_P = BLOCK - frozenset("tbody thead tfoot tr caption html body head".split())
#: A start tag ends an open element of these, unless one of the second set is in between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}

# What is not main text, by element, role and class or id word.
SKIP_TAGS = frozenset(
    "head script style title noscript template nav footer aside form button select input textarea label iframe object embed "
    "svg canvas dialog menu audio video map noembed noframes search".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer notice notices cookie cookies consent gdpr popup modal newsletter subscribe "
    "subscription comment comments respond disqus share sharing social related pagination pager widget toolbar login "
    "signup".split())
MAIN_TAGS = frozenset(["article", "main"])


class Element:
    __slots__ = ("tag", "label", "skip", "main", "kids", "depth")

    def __init__(self, tag: str, label: str, skip: bool, main: bool, depth: int):
        self.tag, self.label, self.skip, self.main, self.depth = tag, label, skip, main, depth
        self.kids: list = []


def element(tag: str, attrs: str, depth: int) -> Element:
    words: list[str] = []
    role = ""
    if attrs.strip("/ \t\r\n"):
        for name, value in ATTRIBUTE.findall(attrs):
            name = name.lower()
            if name in ("class", "id", "role"):
                value = entities.unescape(value.strip("\"'")).lower()
                if name == "role":
                    role = value.strip()
                else:
                    words += re.split(r"[^a-z]+", value)
    words = [w for w in words if w]
    skip = tag in SKIP_TAGS or role in SKIP_ROLES or any(w in SKIP_WORDS for w in words) or tag == "header"
    main = (tag in MAIN_TAGS or role == "main") and not (skip and tag not in MAIN_TAGS) and not any(w in SKIP_WORDS for w in words)
    label = tag + "".join(sorted({"." + w for w in words})) + (f"@{role}" if role else "")
    return Element(tag, label.replace(">", ""), skip, main, depth)


def parse(page: str) -> Element:
    """The page as a tree of structural elements and texts; plain inline elements are left out, their text is not."""
    root = Element("#page", "#page", False, False, 0)
    stack, at, size = [root], 0, len(page)
    deep: dict[str, int] = {}  # open blocks below the deepest level

    def close(until: int) -> None:
        del stack[until:]

    while at < size:
        found = TOKEN.match(page, at)
        if found is None:  # a "<" that begins no complete tag
            stack[-1].kids.append(page[at])
            at += 1
            continue
        at = found.end()
        text = found["text"]
        if text is not None:
            stack[-1].kids.append(text)
            continue
        if found["tag"] is None:
            continue
        tag = found["tag"].lower()
        if found["end"]:
            if deep.get(tag):
                deep[tag] -= 1
                stack[-1].kids.append(Element("hr", "hr", False, False, DEEPEST))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("button", "td", "th", "table", "object"):
                    break
        if tag in IMPLIED:
            ends, bars = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bars:
                    break
                if stack[i].tag in ends:
                    close(i)
                    if tag != "tr":
                        break
        if tag == "br":
            stack[-1].kids.append(" ")
            continue
        node = element(tag, found["attrs"], stack[-1].depth + 1)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if not end:
                at = size
            else:
                at = page.find(">", end.start()) + 1 or size
            continue
        if tag in VOID:
            if tag == "hr":
                stack[-1].kids.append(node)
            continue
        if len(stack) > DEEPEST:  # too deep for an element of its own: a block still begins here
            if tag in BLOCK:
                stack[-1].kids.append(Element("hr", "hr", False, False, DEEPEST))
                if tag not in IMPLIED and tag != "p":
                    deep[tag] = deep.get(tag, 0) + 1
            continue
        parent = stack[-1]
        plain = tag not in BLOCK and not node.skip and not node.main
        if not plain:
            parent.kids.append(node)
        else:
            node.kids = parent.kids  # inline: its texts are its parent's
        stack.append(node)
    return root


# --- wrappers: nodes are dicts with label l, pages n, optional o, repeated r, skip x, main m, kids k; texts have
# --- constant text t as shown (None: a slot), hash h of it all and contents p of up to FEWEST_CONSTANT different pages

def folded(kids: list[dict]) -> list[dict]:
    """Neighbours that repeat, alone or in groups of up to ``LONGEST_PERIOD``, as one repeated node."""
    for period in range(1, LONGEST_PERIOD + 1):
        out: list[dict] = []
        i = 0
        while i < len(kids):
            group = kids[i:i + period]
            labels = [g["l"] for g in group]
            j = i + period
            merged = None
            while j + period <= len(kids) and [k["l"] for k in kids[j:j + period]] == labels:
                merged = [merged_nodes(a, b, True) for a, b in zip(merged or group, kids[j:j + period])]
                j += period
            if merged is None:
                out.append(kids[i])
                i += 1
            elif period == 1:
                out.append(merged[0] | {"r": 1})
                i = j
            else:
                out.append({"l": "(" + " ".join(labels) + ")", "n": group[0]["n"], "o": 0, "r": 1, "k": merged})
                i = j
        kids = out
    return kids


def merged_nodes(a: dict, b: dict, same_page: bool = False) -> dict:
    n = max(a["n"], b["n"]) if same_page else a["n"] + b["n"]
    out = {"l": a["l"], "n": n, "o": a["o"] | b["o"], "r": a["r"] | b["r"]}
    if a["l"] == "#text":
        if a["t"] is None or b["t"] is None or a["h"] != b["h"] or same_page:
            return out | {"t": None}
        return out | {"t": a["t"], "h": a["h"], "p": sorted({*a["p"], *b["p"]})[:FEWEST_CONSTANT]}
    for flag in ("x", "m"):
        if a.get(flag):
            out[flag] = 1
    return out | {"k": merged_kids(a["k"], b["k"], same_page)}


def merged_kids(a: list[dict], b: list[dict], same_page: bool = False) -> list[dict]:
    """Aligned: matched nodes merge, the others become optional."""
    left, right = [x["l"] for x in a], [x["l"] for x in b]
    if left == right:
        return [merged_nodes(x, y, same_page) for x, y in zip(a, b)]
    out: list[dict] = []
    for what, i, i2, j, j2 in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if what == "equal":
            out += [merged_nodes(x, y, same_page) for x, y in zip(a[i:i2], b[j:j2])]
        else:
            out += [x | {"o": 1} for x in a[i:i2] + b[j:j2]]
    return folded(out)


def plain_text(raw: str) -> str:
    return " ".join(entities.unescape(raw).split())


def hash_of(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))


def runs(node: Element) -> Iterator[str | Element]:
    """The children, with neighbouring texts as one."""
    held: list[str] = []
    for kid in node.kids:
        if isinstance(kid, str):
            held.append(kid)
        else:
            if held:
                yield "".join(held)
                held = []
            yield kid
    if held:
        yield "".join(held)


def content(node: Element) -> str:
    """What a page says outside of furniture."""
    return "\n".join(plain_text(x) if isinstance(x, str) else content(x) for x in runs(node) if isinstance(x, str) or not x.skip)


def skeleton(node: Element, page: str | None = None) -> dict:
    """A page's own wrapper; ``page`` is the hash of its content."""
    page = hash_of(content(node)) if page is None else page
    kids: list[dict] = []
    for kid in runs(node):
        if isinstance(kid, str):
            text = plain_text(kid)
            if text:
                kids.append({"l": "#text", "n": 1, "o": 0, "r": 0, "t": text[:SHOWN], "h": hash_of(text), "p": [page]})
        else:
            kids.append(skeleton(kid, page))
    out = {"l": node.label, "n": 1, "o": 0, "r": 0, "k": folded(kids)}
    return out | ({"x": 1} if node.skip else {}) | ({"m": 1} if node.main else {})


def rendered(node: dict) -> str:
    """The wrapper as a regular expression over tags and texts; PCDATA is a slot."""
    if node["l"] == "#text":
        body = "#PCDATA" if node["t"] is None else f'"{node["t"]}"'
    elif node["l"].startswith("("):
        body = " ".join(rendered(k) for k in node["k"])
    else:
        body = " ".join([f"<{node['l']}>", *[rendered(k) for k in node["k"]], f"</{node['l'].split('.')[0].split('@')[0]}>"])
    return f"( {body} )+" if node["r"] else f"( {body} )?" if node["o"] else body


def heads(label: str) -> bool:
    """A header without a word or role of furniture: a page's own heading can stand in it."""
    names, _, role = label.partition("@")
    tag, *words = names.split(".")
    return tag == "header" and role not in SKIP_ROLES and not any(w in SKIP_WORDS for w in words)


def walked(node: dict, path: str = "", skip: bool = False, headers: bool = False) -> Iterator[tuple[str, dict, bool]]:
    """(path, node, in furniture); ``headers``: a plain header is none."""
    group = node["l"].startswith("(")
    path = path if group else f"{path}>{node['l']}"
    skip = skip or bool(node.get("x")) and not (headers and heads(node["l"]))
    yield path, node, skip
    for kid in node.get("k", ()):
        yield from walked(kid, path, skip, headers)


def roles(wrapper: dict) -> dict:
    """What to read of a host's pages: paths named main, and the constant texts."""
    named = {p: s for p, n, s in walked(wrapper) if n.get("m")}
    clear = [p for p, s in named.items() if not s]
    articles = [p for p in clear if p.rsplit(">", 1)[1].startswith("article")]
    constant, slots = [], False
    for path, node, skip in walked(wrapper, headers=True):
        if node["l"] == "#text" and not skip:
            if node["t"] is not None and len(node["p"]) >= FEWEST_CONSTANT:
                constant.append([path, node["h"]])
            else:
                slots = True
    # without a text that varies nothing tells boilerplate from the text of one page
    return {"main": articles or clear or list(named), "constant": constant if slots else []}


def main_text(page: str, role: dict) -> str:
    """The main text of a page read through its host's wrapper."""
    root = parse(page)
    mains = set(role["main"])
    constants = {tuple(c) for c in role["constant"]}
    blocks: list[str] = []
    parts: list[str] = []
    varies = seen_main = False  # varies: the open block has a text that is not constant

    def flush() -> None:
        nonlocal varies
        text = plain_text("".join(parts))
        if text and varies:
            blocks.append(text)
        parts.clear()
        varies = False

    def read(node: Element, path: str, inside: str, chosen: set) -> None:
        nonlocal seen_main, varies
        path = f"{path}>{node.label}"
        if not inside and path in chosen:
            inside, seen_main = path, True
        elif inside and node.skip and not heads(node.label):
            if node.tag in BLOCK:
                flush()
            return
        elif not inside and node.skip and not any(c.startswith(path + ">") for c in chosen):
            return
        block = node.tag in BLOCK or node.tag in ("td", "th")
        if block and inside:
            flush()
        for kid in runs(node):
            if isinstance(kid, str):
                if inside:
                    parts.append(kid)
                    varies = varies or bool(mains & chosen) or not constants or (
                        (text := plain_text(kid)) != "" and (f"{path}>#text", hash_of(text)) not in constants)
            else:
                read(kid, path, inside, chosen)
        if block and inside:
            flush()

    read(root, "", "", mains)
    if not seen_main:
        blocks.clear()
        parts.clear()
        read(root, "", "", {">#page"})
    flush()
    return "\n\n".join(blocks)


def hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    return own_columns(pages, "page_id", "url", "html").withColumn("host", host)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) over all pages."""
    def partial():
        def step(batch: pa.RecordBatch) -> dict:
            found: dict[str, dict] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                own = skeleton(parse(page.as_py() or ""))
                found[host] = merged_nodes(found[host], own) if host in found else own
            return {"host": list(found), "wrapper": [json.dumps(w, ensure_ascii=False) for w in found.values()]}
        return step

    parts = saved(arrow_map(hosted(pages).select("host", "html"), partial, "host string, wrapper string"))
    while True:
        most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return parts
        # each host's parts go to as many groups as keep them small
        count = parts.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / FAN_IN).alias("groups"))
        salted = parts.join(count, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.col("groups")))

        def merge(key, group):
            whole = None
            for text in sorted(group.column("wrapper").to_pylist()):
                own = json.loads(text)
                whole = own if whole is None else merged_nodes(whole, own)
            return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(whole, ensure_ascii=False)]})

        parts = saved(salted.groupBy("host", "salt").applyInArrow(merge, "host string, wrapper string"))


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html)."""
    wrappers = infer_wrappers(pages) if wrappers is None else wrappers

    def of_host():
        return lambda batch: {"host": batch.column("host"), "role": [
            json.dumps(roles(json.loads(w.as_py())), ensure_ascii=False) for w in batch.column("wrapper")]}

    role = saved(arrow_map(wrappers.select("host", "wrapper"), of_host, "host string, role string"))
    # one row per host, read from files, so the planner knows its size and broadcasts it only below its threshold
    rows = hosted(pages).join(role, "host", "left")
    kind = rows.schema["page_id"].dataType.simpleString()

    def read():
        known: dict[str, dict] = {}

        def step(batch: pa.RecordBatch) -> dict:
            texts = []
            for page, role in zip(batch.column("html"), batch.column("role")):
                text = role.as_py()
                if text not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[text] = json.loads(text)
                texts.append(main_text(page.as_py() or "", known[text]))
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
                    "n_chars": [len(t) for t in texts]}
        return step

    return arrow_map(rows.select("page_id", "url", "html", "role"), read, f"page_id {kind}, url string, text string, n_chars bigint")


@query("op5_html")
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
