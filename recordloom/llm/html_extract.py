"""Main text of web pages by equivalence-class template deduction.

A tag is a token together with the tags around it; text is a token with its
whole block and the tags around it. For every host and token, partial
aggregates give the support (pages), the occurrences, and a fingerprint of the
occurrence vector (the sum over pages of a hash of the page times the
occurrences there). Tokens of one host with the same vector are an
equivalence class. The class with the greatest support whose tokens occur once
a page is the template's trunk. A class is valid if it is large enough, its
tokens come in one order on all pages, and every repetition of it lies between
the same two trunk tokens, so it is nested there. Text tokens of valid classes
are template text, inside articles too. The slots are what the template
encloses, so the text in them varies. The main slot is the outermost article
that holds most of that text, or else the lowest container of the template
that encloses all of it that is not of a boilerplate role. What is left of it
once boilerplate roles and template text are taken out is extracted.

A text counts as template text only if it stands beside different contents
(told by a page's longest block of text), so copies of one page don't make its
text a template.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import OWN, discard, materialise, table
from .textkit import tidy

TEXT, N_CHARS = OWN + "main", OWN + "n_chars"
#: Pages of a host from which a template is deduced at least; the share of a host's pages that a template token is in at least; the share of varying text that an article holds at least to be the main slot.
LEAST_PAGES, SUPPORT, MAIN_SHARE = 3, 0.5, 0.6
#: Tokens of a class at least, and of one with text inside articles; bits of the sketch that tells contents apart.
LEAST_SIZE, LEAST_SIZE_INSIDE, CONTENTS = 2, 3, 63

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
CONTAINERS = frozenset("article main section div td body center".split())
MAIN = frozenset(["article", "main"])
BOILERPLATE = frozenset("nav footer aside form head script style noscript template button select option textarea iframe svg menu dialog object audio video canvas title xmp noframes".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer header masthead "
    "menu nav navbar navigation newsletter notice notices popup promo promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that begin a name which tells what stands beside or around; words with which a header or footer is a part of the content.
BESIDE = frozenset("has with without no not is layout".split())
OF_CONTENT = frozenset("article chapter content entry post section story title".split())
#: A start of one of these ends an open element of the same set, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_HEADING_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())


class Element:
    __slots__ = ("tag", "path", "boilerplate", "main")

    def __init__(self, tag: str, path: str, boilerplate: bool, main: bool):
        self.tag, self.path, self.boilerplate, self.main = tag, path, boilerplate, main


ROOT = Element("", "", False, False)


def tells_boilerplate(value: str, inside_main: bool) -> bool:
    """Whether a class or id names boilerplate. A header or footer of an article doesn't, nor does a name like has-sidebar."""
    for name in value.split():
        parts = _PART.findall(name)
        found = BOILERPLATE_NAMES.intersection(parts)
        if found and parts[0] not in BESIDE and not (found <= {"header", "footer"} and (inside_main or not OF_CONTENT.isdisjoint(parts))):
            return True
    return False


def opened(tag: str, rest: str, parent: Element) -> Element:
    """An element; its path has the tags around it, each with the parts of its class, id and role."""
    names, roles, named = [], False, False
    main = parent.main or tag in MAIN
    if rest and "=" in rest:
        for m in _ATTRIBUTE.finditer(rest):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                roles |= value.strip() in BOILERPLATE_ROLES
            else:
                named = named or tells_boilerplate(value, main)
            names += _PART.findall(value)
    boilerplate = parent.boilerplate or tag in BOILERPLATE or roles or (tag == "header" and not parent.main) or (tag not in ("html", "body") and named)
    return Element(tag, f"{parent.path}/{tag}" + "".join("." + n for n in sorted(set(names))), boilerplate, main)


def blocks(html: str) -> Iterator[tuple[Element, str]]:
    """The elements of a page and its blocks of text, in page order: (element, "") where one opens, (innermost block element, text) for text.

    Character references are decoded and runs of white space are one space;
    a block ends where an element that is not inline begins or ends.
    """
    stack = [ROOT]
    block: list[str] = []
    holder = ROOT
    at, n = 0, len(html)

    def flush():
        text = " ".join("".join(block).split()) if block else ""
        block.clear()
        return text

    while at < n:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            if not block:
                holder = stack[-1]
            block.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "br":
                block.append(" ")
            elif tag in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k]
                        break
                    if stack[k].tag not in INLINE:
                        break
            else:
                if text := flush():
                    yield holder, text
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            continue
        rest = m["rest"] or m["rest2"] or ""
        if tag == "br":
            block.append(" ")
            continue
        if tag not in INLINE:
            if text := flush():
                yield holder, text
            if tag in _HEADING_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag not in INLINE:
                        break
            elif tag in CLOSES:
                ends, inside = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        del stack[k:]
                        break
                    if stack[k].tag in inside:
                        break
        element = opened(tag, rest, stack[-1])
        yield element, ""
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else n
        elif tag not in VOID and not (rest.endswith("/") and tag in ("svg", "path", "use")):
            if tag in INLINE:
                inline = stack[-1]
                element = Element(tag, inline.path, element.boilerplate, element.main)
            stack.append(element)
    if text := flush():
        yield holder, text


def host(url) -> F.Column:
    """The host of a url in lower case; null without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def tokens_of(html: str) -> Iterator[tuple[str, Element, str]]:
    """The tokens of a page in page order, with their element and text; tags inside blocks are none."""
    for element, words in blocks(html):
        if words:
            yield f"{element.path}#{xxhash.xxh3_64_hexdigest(words)}", element, words
        elif element.tag not in INLINE:
            yield element.path, element, ""


def occurrences(pages: DataFrame) -> DataFrame:
    """Of hosts and tokens in a task's batch: pages, occurrences, two sums over pages that fingerprint the occurrence vector, characters, and a sketch of the contents they stand beside.

    pages has host, page (a hash) and html.
    """
    shape = "host string, token string, path string, kind string, boilerplate boolean, inside boolean, support long, total long, v1 long, v2 long, chars long, seen long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for h, page, text in zip(*(c for c in batch.columns)):
                h, page, text = h.as_py(), page.as_py(), text.as_py() or ""
                here: dict[tuple, list[int]] = {}
                longest = ""
                for token, element, words in tokens_of(text):
                    s = here.setdefault((token, element.path, "#text" if words else element.tag, element.boilerplate, element.main), [0, 0])
                    s[0] += 1
                    s[1] += len(words)
                    if len(words) > len(longest) and not element.boilerplate:
                        longest = words
                a, b = page & 0x7FFFFFFF, page >> 32 & 0x7FFFFFFF
                seen = 1 << xxhash.xxh3_64_intdigest(longest) % CONTENTS
                for key, (count, chars) in here.items():
                    s = sums.setdefault((h, *key), [0, 0, 0, 0, 0, 0])
                    for k, x in enumerate((1, count, a * count, b * count, chars)):
                        s[k] += x
                    s[5] |= seen
            if sums:
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in zip(*sums)), *(pa.array(x, pa.int64()) for x in zip(*sums.values()))], names=[c.split(" ")[0] for c in shape.split(", ")])

    return pages.mapInArrow(tidy(run), shape)


def order_of(tokens: list[tuple[str, int]]) -> str | None:
    """The order in which the tokens of a class (with the gap of the trunk that each is in) come on a page; None if it isn't one order, repeated, each time in the same gap."""
    names = [t for t, _ in tokens]
    size = len(set(names))
    if names != names[:size] * (len(names) // size) or len({g for _, g in tokens}) > 1:
        return None
    return f"{xxhash.xxh3_64_hexdigest(chr(10).join(names[:size]))}|{tokens[0][1]}"


def orders(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """host, class and the order (null: none) of its tokens, of all pages that have it. classes has host and known, the tokens and classes of the host; class 0 is the trunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, None] = {}
            tables: dict[str, dict[str, int]] = {}
            for h, text, known in zip(*batch.columns):
                h = h.as_py()
                if h not in tables:
                    tables[h] = {x["token"]: x["class"] for x in known.as_py()}
                of, parts, gap = tables[h], {}, 0
                for token, _, _ in tokens_of(text.as_py() or ""):
                    if (k := of.get(token)) is not None:
                        gap += k == 0
                        parts.setdefault(k, []).append((token, 0 if k == 0 else gap))
                found |= dict.fromkeys((h, k, order_of(x)) for k, x in parts.items() if gap or k == 0)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int32(), pa.string()))], names=["host", "class", "order"])

    return pages.select("host", "html").join(classes, "host").mapInArrow(tidy(run), "host string, class int, order string")


def templates(pages: DataFrame) -> DataFrame:
    """host, main (the path of the main slot, or null) and constant (text tokens of the template) of each host with enough pages. pages has host, page and html."""
    key = ["host", "token", "path", "kind", "boilerplate", "inside"]
    tokens = occurrences(pages).groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("support", "total", "v1", "v2", "chars")), F.bit_or("seen").alias("seen"))
    tokens = materialise(tokens, "tokens")
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    sizes = sizes.join(tokens.groupBy("host").agg(F.bit_count(F.bit_or("seen")).alias("contents")), "host")
    frequent = tokens.join(sizes, "host").filter(F.col("support") >= F.greatest(F.lit(LEAST_PAGES), F.col("pages") * SUPPORT))
    # equivalence classes: the tokens of a host with one occurrence vector; the trunk is the first
    member = F.struct("token", "path", "kind", "boilerplate", "inside", (F.bit_count("seen") >= F.greatest(F.lit(2), F.col("contents") * SUPPORT)).alias("varied"))
    classes = frequent.groupBy("host", "support", "total", "v1", "v2").agg(F.collect_list(member).alias("tokens")).filter(F.size("tokens") >= LEAST_SIZE)
    rank = F.struct((F.col("total") != F.col("support")).alias("repeats"), (-F.col("support")).alias("s"), (-F.size("tokens")).alias("n"), "v1", "v2", F.col("tokens"))
    ranked = materialise(classes.groupBy("host").agg(F.sort_array(F.collect_list(rank)).alias("c")).select("host", F.posexplode("c").alias("class", "c")).select("host", "class", "c.repeats", "c.tokens"), "classes")
    numbered = ranked.select("host", "class", F.explode("tokens.token").alias("token")).groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("known"))
    valid = orders(pages, numbered).groupBy("host", "class").agg(F.count(F.when(F.col("order").isNull(), 1)).alias("none"), F.min("order").alias("a"), F.max("order").alias("b")).filter("none = 0 and a = b").select("host", "class")
    text = ranked.join(valid, ["host", "class"]).select("host", F.size("tokens").alias("size"), F.explode("tokens").alias("t")).filter("t.kind = '#text' and t.varied").filter(~F.col("t.inside") | (F.col("size") >= LEAST_SIZE_INSIDE))
    text = materialise(text.select("host", F.col("t.token").alias("token")), "constant")
    # the text in slots, counted for every element around it
    varying = tokens.filter("kind = '#text' and not boilerplate").join(sizes, "host").join(text, ["host", "token"], "left_anti").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    steps = F.split("path", "/")
    around = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    held = varying.filter("path <> ''").select("host", F.explode(around).alias("path"), "chars").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    every = varying.groupBy("host").agg(F.sum("chars").alias("all"))
    article = F.col("kind").isin(*MAIN)
    holds = F.when(article, F.col("chars") >= MAIN_SHARE * F.col("all")).otherwise(F.col("chars") == F.col("all"))
    depth = F.size(F.split("path", "/"))
    best = F.struct(article.alias("a"), F.when(article, -depth).otherwise(depth).alias("d"), F.col("chars").alias("c"), "path")
    once = frequent.filter((F.col("total") == F.col("support")) & F.col("kind").isin(*CONTAINERS) & ~F.col("boilerplate"))
    main = once.select("host", "path", "kind").join(held, ["host", "path"]).join(every, "host").filter(holds).groupBy("host").agg(F.max(best)["path"].alias("main"))
    constant = text.groupBy("host").agg(F.collect_list("token").alias("constant"))
    known = sizes.select("host").join(main, "host", "left").join(constant, "host", "left").select("host", "main", F.coalesce("constant", F.array().cast("array<string>")).alias("constant"))
    known = materialise(known, "templates")
    discard(tokens, ranked, text)
    return known


def extract(html: str, main: str | None = None, constant: frozenset[str] = frozenset()) -> str:
    """The main text of a page, given the main slot's path and the template text of its host, if known."""
    found = [(e, t) for e, t in blocks(html) if t and not e.boilerplate]
    inside = [(e, t) for e, t in found if main and (e.path + "/").startswith(main + "/")]
    if not inside:
        inside = [(e, t) for e, t in found if e.main] or found
    return "\n".join(t for e, t in inside if not constant or f"{e.path}#{xxhash.xxh3_64_hexdigest(t)}" not in constant)


def extract_main(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default) with TEXT, the main text, and N_CHARS, its code points.

    Hosts with fewer than LEAST_PAGES pages, and pages without a host, have no
    template: of such a page its article or main element is taken, or else
    what is not of a boilerplate role. So is a page that the main slot of its
    host's template doesn't occur in. Null and empty html give an empty text.
    Rows that repeat a page are extracted alike; ids may be null. An empty
    table gives no rows; other columns are passed on as they are.
    """
    keep = [c for c in pages.columns if c not in (TEXT, N_CHARS)] if keep is None else keep
    own = [OWN + x for x in ("host", "html", "template_main", "template_text")]
    page = F.xxhash64(F.col(page_id), F.col(url), F.col(html))
    known = pages.select(host(F.col(url)).alias("host"), page.alias("page"), F.col(html).alias("html")).filter("host <> ''")
    deduced = templates(known).withColumnsRenamed({"host": own[0], "main": own[2], "constant": own[3]})
    rows = pages.select(*keep, host(F.col(url)).alias(own[0]), F.col(html).alias(own[1])).join(deduced, own[0], "left").select(*keep, *own[1:])
    schema = pages.select(*keep).withColumns({TEXT: F.lit(""), N_CHARS: F.lit(0).cast("long")}).schema
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py() or "", m.as_py(), frozenset(c.as_py() or ())) for h, m, c in zip(*batch.columns[n:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, TEXT, N_CHARS])

    return rows.mapInArrow(tidy(run), schema)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract_main(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return got.select("page_id", "url", F.col(TEXT).alias("text"), F.col(N_CHARS).alias("n_chars"))
