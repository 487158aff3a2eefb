"""Stored web pages: reading, links, problems, crawl order, politeness, freshness."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .lineage import cut

_DROPPED = {"script", "style", "noscript", "template", "svg"}
_BLOCKS = {"p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "table", "ul", "ol", "title", "body"}
PAGE = pa.struct([("title", pa.string()), ("lines", pa.list_(pa.string())), ("links", pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())]))), ("jsonld", pa.list_(pa.string()))])


class _Reader(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.lines, self.links, self.jsonld = url, "", [], [], []
        self.now, self.skip, self.in_title, self.link, self.ld = [], 0, False, None, None

    def _end_line(self):
        line = " ".join("".join(self.now).split())
        if line:
            self.lines.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        of = dict(attrs)
        if tag == "script" and (of.get("type") or "").lower() == "application/ld+json":
            self.ld = []
        elif tag in _DROPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and of.get("href"):
            self.link = [urljoin(self.url, of["href"].strip()), []]
        if tag in _BLOCKS:
            self._end_line()

    def handle_endtag(self, tag):
        if tag == "script" and self.ld is not None:
            self.jsonld.append("".join(self.ld).strip())
            self.ld = None
        elif tag in _DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.link:
            self.links.append({"href": self.link[0], "label": " ".join("".join(self.link[1]).split())})
            self.link = None
        if tag in _BLOCKS:
            self._end_line()

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        elif not self.skip:
            if self.in_title:
                self.title += data
            else:
                self.now.append(data)
            if self.link:
                self.link[1].append(data)


def read_page(html: str, url: str) -> dict:
    """Title, text lines, absolute links with labels, and JSON-LD blocks of one page."""
    reader = _Reader(url)
    reader.feed(html)
    reader.close()
    reader._end_line()
    return {"title": " ".join(reader.title.split()), "lines": reader.lines, "links": reader.links, "jsonld": reader.jsonld}


def page(html, url) -> Column:
    """:func:`read_page` over Arrow batches: Spark has no HTML reader. Nulls are blank pages."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, urls in batches:
            yield pa.array([read_page(b.as_py() or "", u.as_py() or "") for b, u in zip(bodies, urls, strict=True)], PAGE)

    return F.arrow_udf(run, from_arrow_type(PAGE))(html, url)


def links_of(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, pos, href, label) by pattern, without a reader: for well-formed links."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a [^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("pos", "href"))


def title_of(html) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), r"\s+", " "))


def plain_link(href) -> Column:
    """The number or address of a tel: or mailto: link, unescaped."""
    bare = F.regexp_replace(F.regexp_replace(href, "^(?i)(tel|mailto):", ""), r"\?.*$", "")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def unescape_link(href: str) -> str:
    return unquote(re.sub(r"\?.*$", "", re.sub(r"^(?i:tel|mailto):", "", href)))


def response_problem(status: Column, error: Column) -> Column:
    """What a response says is wrong (F21); NULL for a good one."""
    return F.when(error.isNotNull() & (error != ""), F.lit("unreachable")).when(status.isin(401, 403, 429), F.lit("blocked")).when(status.isin(404, 410), F.lit("gone")).when(status >= 400, F.lit("error"))


def page_suspicion(text: Column, parked: str, spam: str, expected: str, head: int = 6000, least: int = 300) -> Column:
    """Why a page looks wrong (F20): parked by its first characters, spam, or a long text without any expected word."""
    return F.when(F.substring(text, 1, head).rlike(parked), F.lit("parked")).when(text.rlike(spam), F.lit("spam")).when((F.length(text) >= least) & ~text.rlike(expected), F.lit("off topic")).otherwise(F.lit(""))


def unreadable(chars: Column, links: Column) -> Column:
    """Hardly any text and hardly any link."""
    return (chars < 150) & (links < 5)


def target_kind(url: Column, social: list[str], listings: list[str]) -> Column:
    """none, social, listing or own, by the host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^\s*(?:https?://)?([^/?#:\s]+)", 1)), r"^www\.", "")
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "none").when(host.isin(*social), "social").when(host.isin(*listings), "listing").otherwise("own")


def in_scope(links: DataFrame, seen: DataFrame, hosts: DataFrame, skip: str, prefix: str = "/") -> DataFrame:
    """Links worth a visit (F18, C9): http, host in scope, path under the prefix, no skipped pattern, not seen."""
    host, path = F.regexp_replace(F.lower(F.regexp_extract("href", r"^https?://([^/?#:]+)", 1)), r"^www\.", ""), F.regexp_extract("href", r"^https?://[^/?#]+([^?#]*)", 1)
    rows = links.where(F.col("href").rlike("^https?://") & ~F.col("href").rlike(skip) & F.startswith(F.when(path == "", "/").otherwise(path), F.lit(prefix)))
    return rows.withColumn("host", host).join(hosts, "host", "left_semi").join(seen, "href", "left_anti")


def top_pages(pages: DataFrame, host: str, order: list, n: int = 30) -> DataFrame:
    """The first n pages of each host in visiting order (O7); limited within each task before the shuffle."""
    return pages.withColumn("turn", F.row_number().over(Window.partitionBy(host).orderBy(*order))).where(F.col("turn") <= n)


def crawl_depths(edges: DataFrame, roots: DataFrame, most: int = 3) -> DataFrame:
    """(page, depth) of pages within ``most`` links of a root (C3, E16): one frontier join a round."""
    reached = roots.select("page").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for d in range(1, most + 1):
        found = edges.join(frontier.select(F.col("page").alias("src")), "src").select(F.col("dst").alias("page")).distinct()
        frontier = cut(found.join(reached.select("page"), "page", "left_anti").withColumn("depth", F.lit(d)))
        reached = reached.unionByName(frontier)
    return reached


def allowed_by_robots(robots, agent: str, url) -> Column:
    """What a site's rules say of a link (C4); no rules allow everything."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, RobotFileParser] = {}
        for rules, urls in batches:
            out = []
            for r, u in zip(rules, urls, strict=True):
                text = r.as_py() or ""
                if text not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[text] = RobotFileParser()
                    known[text].parse(text.splitlines())
                out.append(known[text].can_fetch(agent, u.as_py() or ""))
            yield pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(robots, url)


def polite_starts(requests: DataFrame, host: str, arrival: str, order: list[str], delay: float = 1.0) -> DataFrame:
    """``start`` of each request so that a host gets one every ``delay`` seconds (C5), in closed form."""
    w = Window.partitionBy(host).orderBy(*order)
    k = F.row_number().over(w) - 1
    free = F.col(arrival) - F.col("k") * F.lit(delay)
    return requests.withColumn("k", k).withColumn("start", F.max(free).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k") * F.lit(delay)).drop("k")


def fresh(responses: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Cached responses that still count (SC9): young enough, and neither failed nor a server's error."""
    return responses.where((F.col("fetched_at") > now - F.make_dt_interval(F.lit(days))) & (F.col("status") != 0) & (F.col("status") < 500))
