"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and path, and each is paired with the neighbour on its host whose path has
the longer common beginning. All lines that the markup leaves, a declared article's among them, are
aligned with the neighbour's by their longest common subsequence, and the shared lines are deleted:
menus, notices and footers of a site stand on both pages. Then the markup checks what is left: what it
declares as boilerplate goes, whether the neighbour has it or not, and so does what stands outside a
declared article. Only hashes of lines are exchanged between pages; the pages' own text is moved once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentscan.llm.common import map_text, written

#: Elements that begin and end a block of text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul title head".split()
)
#: Elements that hold no main text.
BOILERPLATE = set("head title script style noscript template nav footer aside form button select option textarea input label menu dialog iframe object embed svg math canvas audio video search".split())
#: Elements without content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: ARIA roles, and class names and ids, of boilerplate.
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login comments comment commentlist "
    "respond disqus share sharing social related recommended pagination pager skip toolbar topbar masthead widget".split()
)
#: What a class name or id of boilerplate may have besides, as in cookie-banner-wrapper.
QUALIFIERS = set("site main page top bottom left right upper lower inner outer primary secondary global mobile desktop list area box slot unit wrapper wrap container section block panel bar body item items link links button buttons icon icons form title text bottombar meta info js sticky fixed".split())
#: Fixed value: articles that share a greater part of their lines are copies, whose shared lines are no boilerplate.
COPY = 0.75
_PART = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Elements that end an open paragraph, and those that end an open one of their own kind.
_ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "title"}
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}


#: Elements whose content is not markup.
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_TAG = re.compile(r"[A-Za-z][^\s/>]*")
_MARK = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


def _tag_end(html: str, at: int) -> int:
    """Place of the > that ends a tag, or -1; a quote counts only after an equals sign."""
    while m := _MARK.search(html, at):
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while html[before].isspace():
            before -= 1
        at = html.find(m[0], m.end()) + 1 if html[before] == "=" else m.end()
        if at == 0:
            return -1
    return -1


def _named(tag: str, given: dict[str, str]) -> set[str]:
    """Names of boilerplate among an element's class names and ids.

    A whole name counts, as do parts that hyphens join, if all of them are names of boilerplate or
    qualifiers: cookie-banner is a banner, but no-sidebar, has-comments and share-of-market say
    nothing. The page's own elements name its layout and not their text.
    """
    if tag in ("html", "body"):
        return set()
    found = set()
    for token in (given.get("class", "") + " " + given.get("id", "")).lower().split():
        parts = {x for x in _PART.split(token) if x}
        if parts and parts <= NAMES | QUALIFIERS | {"header"}:
            found |= parts - QUALIFIERS
    return found


class Lines:
    """The blocks of text of a page: (text, inside the declared article, declared as boilerplate).

    One pass that never looks at a place twice, so that broken or hostile markup costs no more than
    its length. A comment, tag or raw element without an end takes the rest of the page.
    """

    def __init__(self):
        self.open: list[tuple[str, bool, bool]] = []  # element, article, boilerplate
        self.counts: Counter[str] = Counter()
        self.held: list[str] = []
        self.lines: list[tuple[str, bool, bool]] = []
        self.state = (False, False)

    def feed(self, html: str) -> None:
        at = 0
        while (lt := html.find("<", at)) >= 0:
            if lt > at:
                self.held.append(unescape(html[at:lt]))
            at = lt
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = end + 3 if end >= 0 else len(html)
            elif html[at + 1 : at + 2] in ("!", "?") or html[at + 1 : at + 2] == "/" and not html[at + 2 : at + 3].isalpha():
                end = html.find(">", at)
                at = end + 1 if end >= 0 else len(html)
            elif m := _TAG.match(html, at + 2 if html.startswith("/", at + 1) else at + 1):
                tag, closes = m[0].lower(), html[at + 1] == "/"
                end = _tag_end(html, m.end())
                if end < 0:
                    at = len(html)
                    continue
                if closes:
                    self.end_tag(tag)
                else:
                    self.start_tag(tag, html[m.end() : end])
                at = end + 1
                if not closes and tag in _RAW:
                    close = re.compile(f"</{tag}", re.IGNORECASE).search(html, at)
                    at = close.start() if close else len(html)
            else:
                self.held.append("<")
                at += 1
        self.held.append(unescape(html[at:]))
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.lines.append((text, *self.state))
        self.held = []

    def start_tag(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.held.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        ends = (_SELF.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())) if self.open else ()
        if ends and self.open[-1][0] in ends:
            self._close(len(self.open) - 1)
        given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if rest.strip() else {}
        article, bad = self.state
        role = given.get("role", "").lower()
        named = _named(tag, given)
        article = article or tag in ("article", "main") or role in ("main", "article")
        bad = bad or tag in BOILERPLATE or role in ROLES or bool(named - {"header"}) or "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", "")))
        bad = bad or (tag == "header" or "header" in named) and not article
        self.open.append((tag, article, bad))
        self.counts[tag] += 1
        self.state = (article, bad)

    def end_tag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.counts[tag]:
            i = len(self.open) - 1
            while self.open[i][0] != tag:
                i -= 1
            self._close(i)

    def _close(self, i: int) -> None:
        for tag, _, _ in self.open[i:]:
            self.counts[tag] -= 1
        del self.open[i:]
        self.state = self.open[-1][1:] if self.open else (False, False)


def lines_of(html: str | None) -> list[tuple[str, bool, bool]]:
    p = Lines()
    p.feed(html or "")
    return p.lines


def shared(mine: list[int], other: list[int]) -> list[int]:
    """Indices of ``mine`` in a longest common subsequence with ``other``.

    A row of the table of lengths is one number: bit j is 0 where the length rises at line j of
    ``other``, so that a whole row is made by a few operations. Every so-many-th row is kept; the rows
    between are made again while the way back is read, so memory grows with the root of the rows.
    """
    place: dict[int, int] = {}
    seen = set(mine)
    for j, x in enumerate(x for x in other if x in seen):
        place[x] = place.get(x, 0) | 1 << j
    rows = [i for i, x in enumerate(mine) if x in place]
    width = sum(x in seen for x in other)
    full = (1 << width) - 1
    gap = max(1, int(len(rows) ** 0.5))

    def after(v: int, i: int) -> int:
        both = v & place[mine[i]]
        return ((v + both) | (v - both)) & full

    kept, v = [], full
    for n, i in enumerate(rows):
        if n % gap == 0:
            kept.append(v)
        v = after(v, i)
    out, j = [], width
    for n in range((len(kept) - 1) * gap, -1, -gap):
        part, made = rows[n : n + gap], [kept[n // gap]]
        for i in part:
            made.append(after(made[-1], i))
        for r in range(len(part), 0, -1):
            while j and made[r] >> (j - 1) & 1:
                j -= 1
            if not j:
                return out[::-1]
            if made[r - 1] >> (j - 1) & 1:  # the length rises here in this row first: a match
                out.append(part[r - 1])
                j -= 1
    return out[::-1]


def main_text(lines: list[tuple[str, bool, bool]], drop: set[int]) -> str:
    """The kept lines, joined by two line breaks.

    ``drop`` holds numbers of lines that the neighbour has as well. A page with an article keeps the
    article's other lines, or all of them, if it is a copy of the neighbour's; one without keeps what
    differencing leaves, or all, if it would leave nothing.
    """
    own = [(i, t) for i, (t, article, bad) in enumerate(lines) if article and not bad]
    plain = own or [(i, t) for i, (t, _, bad) in enumerate(lines) if not bad]
    left = [t for i, t in plain if i not in drop]
    if own and len(own) - len(left) > COPY * len(own):
        left = []
    return "\n\n".join(left or [t for _, t in plain])


def _hashes(part: pa.RecordBatch) -> list[pa.Array]:
    """Hashes of the lines that the markup leaves, and their numbers."""
    hs, at = [], []
    for html in part.column("__text__").to_pylist():
        own = [(i, int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)) for i, (t, _, bad) in enumerate(lines_of(html)) if not bad]
        at.append([i for i, _ in own])
        hs.append([h for _, h in own])
    return [pa.array(hs, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))]


def _texts(part: pa.RecordBatch) -> list[pa.Array]:
    drops = part.column("drop").to_pylist()
    out = [main_text(lines_of(html), set(d or ())) for html, d in zip(part.column("__text__").to_pylist(), drops, strict=True)]
    return [pa.array(out, pa.string())]


def _align(batches):
    for b in batches:
        rows = zip(b["hashes"].to_pylist(), b["other"].to_pylist(), b["numbers"].to_pylist(), strict=True)
        drop = [[at[i] for i in shared(mine or [], other or [])] for mine, other, at in rows]
        yield pa.RecordBatch.from_arrays([b["k"], pa.array(drop, pa.list_(pa.int32()))], names=["k", "drop"])


def _common(batches):
    """The lengths of the common beginnings of whole paths."""
    for b in batches:
        n = [len(commonprefix(ab)) for ab in zip(b["path"].to_pylist(), b["path2"].to_pylist(), strict=True)]
        keep = ["k", "k2", "hashes", "hashes2"]
        yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(n, pa.int32())], names=[*keep, "common"])


def neighbours(light: DataFrame) -> DataFrame:
    """For each row (k, host, path, page_id, hashes): k and the hashes of the nearest path on its host.

    Rows are sorted across the cluster by range; their places in the whole order come from the ranges'
    sizes (one number each), and each meets the row after it by place. Between the two neighbours the
    longer common beginning of the paths decides, then the earlier page.
    """
    keys = ["host", "path", "page_id", "k"]
    parts = int(light.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(light.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"p": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranged")
    base, total = {}, 0
    for r in ranged.groupBy("p").count().orderBy("p").collect():  # one row for each range
        base[r["p"]] = total
        total += r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("p")) if base else F.lit(0)
    placed = ranged.withColumn("g", F.col("i") + offset)
    b = placed.select((F.col("g") - 1).alias("g"), *[F.col(c).alias(f"{c}2") for c in ("k", "host", "path", "hashes")])
    pairs = placed.join(b, "g").where("host = host2")
    near = pairs.select("k", "k2", "hashes", "hashes2", "path", "path2").mapInArrow(_common, "k long, k2 long, hashes array<long>, hashes2 array<long>, common int")
    each = near.select(F.col("k2").alias("k"), F.struct("common", F.lit(1).alias("before"), F.col("hashes").alias("other")).alias("n")).unionByName(near.select("k", F.struct("common", F.lit(0).alias("before"), F.col("hashes2").alias("other")).alias("n")))
    return each.groupBy("k").agg(F.max_by("n", F.struct("n.common", "n.before")).alias("n")).select("k", "n.other")


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``pages``' columns ``keep`` (page_id, url and html are read) with text and n_chars.

    A null or empty html has the empty text; a null or odd url has the empty host, where pages are
    paired as on any other. Repeated rows count as one page for the pairing and get equal results.
    A page alone on its host loses only what its markup declares. An empty table gives no rows.
    Columns of ``pages`` with the added names are replaced.
    """
    cols = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    url = F.coalesce(F.col("url"), F.lit(""))
    k = F.xxhash64("page_id", "url", F.col("url").isNull(), "html", F.col("html").isNull())
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)?([^?#]*)", 1)
    keyed = pages.select(k.alias("k"), host.alias("host"), path.alias("path"), "page_id", "html")
    added = T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("numbers", T.ArrayType(T.IntegerType()))])
    light = written(map_text(keyed, "html", added, lambda: _hashes, ["k", "host", "path", "page_id"]), "lines").dropDuplicates(["k"])
    light = written(light, "pages")
    found = light.join(neighbours(light), "k").select("k", "hashes", "numbers", "other")
    drops = written(found.mapInArrow(_align, "k long, drop array<int>").where(F.size("drop") > 0), "drops")

    whole = pages.select(*[F.col(f"`{c}`") for c in cols], F.col("html").alias("__html__"), k.alias("__k__"))
    joined = whole.join(drops.withColumnRenamed("k", "__k__"), "__k__", "left")
    out = map_text(joined, "__html__", T.StructType([T.StructField("text", T.StringType())]), lambda: _texts, [*cols, "drop"])
    return out.select(*[F.col(f"`{c}`") for c in cols], "text", F.length("text").cast("long").alias("n_chars"))
