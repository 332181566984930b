"""Main text of web pages by wrapper induction: pages of a host are aligned, what stays the same is template."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.llm.text import fresh
from lathe.session import materialise

#: Pages of a host that its wrapper is induced from at most: those of the smallest hashes, copies left out.
EXEMPLARS = 16
#: A slot's text is template if this share of the exemplars that have the slot, three at least, have it there.
CONSTANT, LEAST_EXEMPLARS = 0.8, 3
#: A slot is a menu if over this share of its characters are link text.
LINKED = 0.6
#: A page that has this share of its plain text in common with one exemplar is a copy of it and shows nothing about the template.
COPIED = 0.5
#: Levels below a pair of nodes that the matching looks at to choose the pair, and runs of siblings that are aligned in order.
SIGHT, WIDE = 4, 48

# Names that HTML gives to its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select head".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
# Words of class and id names that usually mark what isn't the article, and words beside which the weaker of them don't.
STRONG_WORDS = frozenset("ad ads adv advert adverts advertisement advertising comment comments commentlist commentform disqus cookie cookies newsletter promo related respond responses share sharing sidebar social sponsor sponsored subscribe".split())
ASIDE_WORDS = STRONG_WORDS | frozenset("banner breadcrumb breadcrumbs consent footer gdpr header login masthead menu modal nav navbar navigation notice notices pager pagination popup promotion search signup toolbar topbar widget".split())
ARTICLE_WORDS = frozenset("article entry headline main post story title".split())
#: Ends of longer words, and words that an article element or an element inside a line must begin with to be left out.
TELLING = ("sidebar", "commentlist", "cookiebar", "navbar")
COPY_WORDS = frozenset("ad ads advert adverts advertisement comment comments commentlist promo related sponsored teaser".split())
INLINE_WORDS = frozenset("ad ads adv advert adverts advertisement promo share sharing social sponsor sponsored".split())
#: A name that begins so tells of a state of the page, not what the element is.
STATES = ("has-", "have-", "no-", "not-", "is-", "with-", "without-", "show-", "hide-", "js-")

_TOKEN = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Node:
    """A block element, or a run of text in one (label #text). aside: known by names not to be of the article; inside: in article or main."""

    label: str
    aside: bool = False
    inside: bool = False
    children: list[Node] = field(default_factory=list)
    text: str = ""
    linked: int = 0
    named: bool = False
    holds: bool = False


def _attributes(attributes: str) -> tuple[bool, str, list[list[str]]]:
    """(not displayed, class without digits, words of each name) of a start tag."""
    hidden, kind, names = False, "", []
    for key, *values in _NAMED.findall(attributes):
        value, key = "".join(values).lower(), key.lower()
        if key in ("class", "id", "role"):
            names += [words for token in value.split() if not token.startswith(STATES) and (words := _WORD.findall(token))]
            kind = " ".join(_DIGITS.sub("", value).split()) if key == "class" else kind
        else:
            hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    return hidden, kind, names


def _names_aside(tag: str, names: list[list[str]]) -> bool:
    """Whether an element's names say that it is no part of the article. An article has to begin a name so, as names of its parts are often put on it."""
    if tag in ("article", "main", "body"):
        return any(words[0] in COPY_WORDS for words in names)
    if tag not in BLOCKS:
        return tag != "a" and any(words[0] in INLINE_WORDS for words in names)
    words = {w for token in names for w in token}
    if words & STRONG_WORDS or any(w.endswith(TELLING) for w in words):
        return True
    return bool(words & ASIDE_WORDS) and not words & ARTICLE_WORDS


def _surely(names: list[list[str]]) -> list[list[str]]:
    """The names that are one word and a strong one: what `ad-free`, `related-work` or `login-wall-off` say of an element isn't sure."""
    return [words for words in names if len(words) == 1 and words[0] in STRONG_WORDS]


def parse(page: str, judge: bool = True, surely: bool = False) -> Node:
    """The tree of block elements with their text, mending unclosed and stray tags the way browsers do; time grows with the length.

    With judge, buttons, hidden elements and adverts inside a line leave no text, and blocks are marked as aside: navigation,
    footers, forms, headers outside the article, and what is named so. Names on what holds an article, a main or an h1, and a form
    around one, are about the page and mark nothing. With surely, names of several words and the weaker words mark nothing either.
    """
    root = Node("html")
    stack: list[tuple[str, Node]] = [("html", root)]
    nodes: list[tuple[Node, int, str]] = [(root, 0, "html")]
    places, open_at = [0], defaultdict(list)
    held: list[str] = []
    links, linked, unclosed = 0, 0, set()
    muted: tuple[str, int] | None = None
    nested = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1][1].children.append(Node("#text", text=text, linked=linked))
                nodes.append((stack[-1][1].children[-1], places[-1], "#text"))
        linked = 0

    def close(name: str, stops: tuple[str, ...]) -> None:
        nonlocal muted
        if not open_at[name] or any(open_at[s] and open_at[s][-1] > open_at[name][-1] for s in stops):
            return
        flush()
        for _ in range(len(stack) - open_at[name][-1]):
            open_at[stack.pop()[0]].pop()
            places.pop()
        if muted and len(stack) < muted[1]:
            muted = None

    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at and not muted:
            held.append(page[at:stop])
            linked += (stop - at) if links else 0
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                close(tag, ())
            if muted and tag == muted[0]:
                nested -= 1
                muted = muted if nested else None
            continue
        if tag in RAW:
            if not found[3].endswith("/") and tag not in unclosed:
                last = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                if last or tag != "head":
                    at = last.end() if last else end
                else:
                    unclosed.add(tag)
            continue
        if muted:
            nested += tag == muted[0]
        elif tag == "a":
            links += 1
        elif tag in ("br", "hr", "img", "wbr", "input"):
            held.append(" ")
        if tag not in BLOCKS:
            if judge and not muted and tag not in VOID and not found[3].endswith("/"):
                hidden, _, names = _attributes(found[3]) if found[3] else (False, "", [])
                if tag == "button" or hidden or _names_aside(tag, _surely(names) if surely else names):
                    held.append(" ")
                    muted, nested = (tag, len(stack)), 1
            continue
        flush()
        links = 0
        if tag in ("html", "body"):
            continue
        if tag in CLOSES:
            for name in CLOSES[tag][0].split():
                close(name, CLOSES[tag][1])
        else:
            close("p", ("td", "th", "button"))
        if tag in VOID:
            continue
        parent = stack[-1][1]
        hidden, kind, names = _attributes(found[3]) if found[3] else (False, "", [])
        inside = parent.inside or tag in ("article", "main")
        sure = hidden or bool(muted) or (tag in ASIDE_TAGS and tag != "form") or (tag == "header" and not inside)
        node = Node(f"{tag}.{kind}" if kind else tag, sure, inside, named=tag == "form" or _names_aside(tag, _surely(names) if surely else names), holds=tag in ("article", "main", "h1"))
        parent.children.append(node)
        open_at[tag].append(len(stack))
        stack.append((tag, node))
        nodes.append((node, places[-1], tag))
        places.append(len(nodes) - 1)
    flush()
    for node, up, _ in reversed(nodes):
        nodes[up][0].holds |= node.holds and not node.aside
    for i, (node, up, tag) in enumerate(nodes):
        if i:
            above = nodes[up][0]
            own = node.named and not (node.holds and tag not in ("article", "main", "h1"))
            node.aside, node.inside = judge and (node.aside or above.aside or own), node.inside or above.inside
    return root


def _key(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _runs(members: list[Node]) -> list[tuple[str, list[Node]]]:
    """The children of some nodes of one label: neighbours of one label are a run; later nodes join the first node's runs.

    Lists of over WIDE runs have one run for each label, and if these are too many one for each tag.
    """
    runs: list[tuple[str, list[Node]]] = []
    first: dict[str, tuple[str, list[Node]]] = {}
    for member in members:
        before = None
        for child in member.children:
            if before is None or before[0] != child.label:
                before = first.get(child.label) if len(members) > 1 else None
                if before is None:
                    before = (child.label, [])
                    runs.append(before)
                    first.setdefault(child.label, before)
            before[1].append(child)
    for name in (lambda label: label, lambda label: label.split(".")[0]):
        if len(runs) > WIDE:
            merged: dict[str, list[Node]] = {}
            for label, nodes in runs:
                merged.setdefault(name(label), []).extend(nodes)
            runs = list(merged.items())
    return runs


def folded(node: Node) -> tuple[str, list, list[Node]]:
    """(label, children, text nodes): runs of siblings of one label become one child, so lists of any length align."""
    out: tuple[str, list, list[Node]] = (node.label, [], [])
    todo = [(out, [node])]
    while todo:
        made, members = todo.pop()
        if made[0] == "#text":
            made[2].extend(members)
            continue
        for label, nodes in _runs(members):
            made[1].append((label, [], []))
            todo.append((made[1][-1], nodes))
    return out


def match(a: list, b: list, sight: int = SIGHT) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two ordered lists of trees: the size of the largest top-down matching and its top pairs.

    Only `sight` levels below the lists count, so that aligning whole trees level by level stays near linear in their size.
    """
    weight = {}
    places: dict[str, list[int]] = defaultdict(list)
    for j, y in enumerate(b):
        places[y[0]].append(j)
    for i, x in enumerate(a):
        for j in places.get(x[0], ()):
            weight[i, j] = 1 + (match(x[1], b[j][1], sight - 1)[0] if sight and x[1] and b[j][1] else 0)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        row, above = best[i], best[i - 1]
        for j in range(1, len(b) + 1):
            row[j] = max(above[j], row[j - 1], above[j - 1] + weight.get((i - 1, j - 1), 0))
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if (i - 1, j - 1) in weight and best[i][j] == best[i - 1][j - 1] + weight[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


def _leaves(tree: tuple) -> list[Node]:
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out += node[2]
        todo += reversed(node[1])
    return out


def induce(pages: list[str]) -> list:
    """A wrapper (see _flat) for the merged tree of the pages.

    The first page's folded tree is the start; each other is aligned with it, adds its texts to the slots it matches and inserts
    what it has besides. A page that shares COPIED of its plain text (no links, no asides) with an earlier one is left out, as
    what copies have in common isn't template.
    """
    merged: list = ["html", [], {}, 0, 0, 0]  # label, children, exemplars by text, exemplars, characters, linked characters
    seen: list[set[str]] = []
    for page in pages:
        tree = folded(parse(page))
        texts = {_key(n.text): len(n.text) for n in _leaves(tree) if not n.aside and not n.linked}
        if not texts or any(sum(n for key, n in texts.items() if key in known) >= COPIED * sum(texts.values()) for known in seen):
            continue
        seen.append(set(texts))
        _merge(merged, tree)
    return _flat(merged)


def _merge(top: list, tree: tuple) -> None:
    todo = [(top, tree)]
    while todo:
        into, tree = todo.pop()
        into[3] += 1
        if tree[0] == "#text":
            for key in {_key(n.text) for n in tree[2]}:
                into[2][key] = into[2].get(key, 0) + 1
            into[4] += sum(len(n.text) for n in tree[2])
            into[5] += sum(n.linked for n in tree[2])
        partner = {j: i for i, j in match(into[1], tree[1])[1]}
        children, at = [], 0
        for j, child in enumerate(tree[1]):
            if j in partner:
                children += into[1][at : partner[j] + 1]
                at = partner[j] + 1
            else:
                children.append([child[0], [], {}, 0, 0, 0])
            todo.append((children[-1], child))
        into[1] = children + into[1][at:]


def _flat(merged: list) -> list:
    """The wrapper: [number of the parent, label, keys of constant texts, menu] of each node, parents first; JSON without nesting.

    Nodes that neither are nor hold template are left out where they are over SIGHT levels away from any that do.
    """
    nodes: list[list] = []
    todo: list[tuple[int, list]] = [(-1, merged)]
    while todo:
        up, (label, children, texts, n, size, linked) = todo.pop()
        constant = sorted(k for k, times in texts.items() if n >= LEAST_EXEMPLARS and times >= CONSTANT * n)
        nodes.append([up, label, constant, int(n >= LEAST_EXEMPLARS and linked > LINKED * size)])
        todo += [(len(nodes) - 1, c) for c in reversed(children)]
    near = [0 if node[2] or node[3] else SIGHT + 1 for node in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        near[nodes[i][0]] = 0 if not near[i] else near[nodes[i][0]]
    for i in range(1, len(nodes)):
        near[i] = min(near[i], near[nodes[i][0]] + 1)
    kept = {i: k for k, i in enumerate(i for i in range(len(nodes)) if not i or near[i] <= SIGHT)}
    return [[kept.get(node[0], -1), *node[1:]] for i, node in enumerate(nodes) if i in kept]


def _grown(flat: list) -> tuple:
    """The tree of a flat wrapper: (label, children, keys, menu)."""
    nodes = [(label, [], frozenset(keys), menu) for _, label, keys, menu in flat]
    for (up, *_), node in zip(flat[1:], nodes[1:], strict=True):
        nodes[up][1].append(node)
    return nodes[0]


def _template(tree: tuple, wrapper: tuple) -> set[int]:
    """Ids of the text nodes that the wrapper knows as template: constant text where it was constant, and menus."""
    dropped: set[int] = set()
    todo = [(tree, wrapper)]
    while todo:
        node, by = todo.pop()
        if node[0] == "#text":
            dropped.update(id(n) for n in node[2] if by[3] or (by[2] and _key(n.text) in by[2]))
        todo += [(node[1][j], by[1][i]) for i, j in match(by[1], node[1])[1]]
    return dropped


def _in_order(root: Node) -> list[tuple[Node, str]]:
    """The text nodes in page order, each with its block's label."""
    out, todo = [], [(root, "")]
    while todo:
        node, label = todo.pop()
        if node.label == "#text":
            out.append((node, label))
        todo += [(c, node.label) for c in reversed(node.children)]
    return out


def extract(page: str | None, wrapper: list | tuple | None = None) -> str:
    """The article: text of the varying slots that no name marks as something else.

    Where article and main elements hold as much of that text as is outside of them, h1 apart, what is outside is left out. Names aren't believed against a
    whole page: where they leave no text but headings, only those that are sure mark anything, if that leaves more.
    """
    if not page:
        return ""
    text, body = _article(parse(page), wrapper)
    if not body:
        more, body = _article(parse(page, surely=True), wrapper)
        text = more if body else text
    return text


def _article(tree: Node, wrapper: list | tuple | None) -> tuple[str, bool]:
    """The text of a parsed page, and whether it is more than headings."""
    dropped: set[int] = set()
    if wrapper:
        dropped = _template(folded(tree), _grown(wrapper) if isinstance(wrapper, list) else wrapper)
    kept = [(n, label) for n, label in _in_order(tree) if not n.aside and id(n) not in dropped]
    inside = sum(len(n.text) for n, _ in kept if n.inside)
    outside = sum(len(n.text) for n, label in kept if not n.inside and label.split(".")[0] != "h1")
    narrow = 0 < outside <= inside
    shown = [(n, label.split(".")[0]) for n, label in kept if n.inside or not narrow or label.split(".")[0] == "h1"]
    return "\n\n".join(n.text for n, _ in shown), any(label not in HEADINGS for _, label in shown)


def main_text(pages: DataFrame, exemplars: int = EXEMPLARS) -> DataFrame:
    """pages (page_id, url, html) with text (the article, empty if none) and n_chars (its code points).

    Each host's wrapper is induced from up to `exemplars` of its pages: equal and empty ones count once and not at all, and those
    of the smallest hashes of their content are taken, found by narrow rows alone. Every page of the host is then aligned with it and extracted whole. Exemplar keys and wrappers are written
    first, so that the planner knows their sizes when it joins them: small ones are broadcast, others meet the pages by host,
    where Spark splits hosts with many pages.

    Null or empty html: empty text. Null or hostless url: no wrapper, names of elements alone decide. Null page_ids and
    repeated rows are pages like others, though repeats count once for a wrapper. Columns named text and n_chars are replaced;
    other extra columns stay. Empty input: empty result.
    """
    host, mark, turn = (fresh(pages.columns, n) for n in ("host", "mark", "turn"))
    base = pages.drop("text", "n_chars").withColumn(host, F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))))
    hashed = base.where(F.col(host).isNotNull() & (F.trim("html") != "")).select(host, "html", F.xxhash64("html").alias(mark))
    first = F.row_number().over(W.Window.partitionBy(host).orderBy(mark))
    chosen = hashed.select(host, mark).distinct().withColumn(turn, first).where(F.col(turn) <= exemplars)
    chosen = materialise(chosen.select(host, mark), "wrapper-exemplars")
    samples = hashed.join(chosen, [host, mark], "left_semi").groupBy(host, mark).agg(F.min("html").alias("html"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(mark)
        return pd.DataFrame({"host": [group[host].iloc[0]], "wrapper": [json.dumps(induce(list(group["html"])), separators=(",", ":"))]})

    wrappers = materialise(samples.groupBy(host).applyInPandas(learn, "host string, wrapper string"), "wrappers").withColumnsRenamed({"host": host, "wrapper": turn})

    def extracted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, tuple] = {}
        for page, wrapper in batches:
            out = []
            for one, by in zip(page.to_pylist(), wrapper.to_pylist(), strict=True):
                if by is not None and by not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[by] = _grown(json.loads(by))
                out.append(extract(one, known.get(by)))
            yield pa.array(out, pa.string())

    joined = base.join(wrappers, host, "left")
    return joined.withColumn("text", F.arrow_udf(extracted, "string")(F.col("html"), F.col(turn))).withColumn("n_chars", F.char_length("text").cast("long")).drop(host, turn)
