"""Page queries: candidates, links, problems, crawl order, politeness, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from locarium.operators import cascade as C
from locarium.operators import pages as G

from .registry import load, query

_CAND = """(SELECT k // 4 AS id, CASE k % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS source, k % 4 AS source_rank, k % 3 AS sub_rank, k % 90 + 0.5::DOUBLE AS lat, CASE WHEN k % 5 < 3 THEN 'roof' ELSE 'area' END AS quality,
  k % 7 < 3 AS house, CASE WHEN k % 11 <> 0 THEN 'TX' END AS region, CASE WHEN k % 6 = 0 THEN '' ELSE k || ' Main, Waco, TX 76' || lpad(CAST(k % 100 AS VARCHAR), 3, '0') END AS matched FROM (SELECT o_orderkey AS k FROM orders))"""


def _candidates(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    return load(spark, sf_dir, "orders").select(
        F.floor(k / 4).alias("id"), F.when(k % 4 == 0, "first").when(k % 4 == 1, "second").otherwise("third").alias("source"), (k % 4).alias("source_rank"), (k % 3).alias("sub_rank"), (k % 90 + F.lit(0.5)).alias("lat"),
        F.when(k % 5 < 3, "roof").otherwise("area").alias("quality"), (k % 7 < 3).alias("house"), F.when(k % 11 != 0, "TX").alias("region"),
        F.when(k % 6 == 0, "").otherwise(F.concat(s(k), F.lit(" Main, Waco, TX 76"), F.lpad(s(k % 100), 3, "0"))).alias("matched"),
    )


def _ok(source="source"):
    rule = C.accepted(F.col(source), F.col("sub_rank"), F.col("quality"), F.col("house"), F.col("region"), {"first": 0, "third": 2}, {"first": ["roof"]}, ("third",))
    return rule & C.agrees(F.lit("Waco"), F.lit("TX"), F.lit(""), F.col("matched"))


_OK = "((source <> 'first' OR sub_rank <= 0) AND (source <> 'third' OR sub_rank <= 2) AND (source <> 'first' OR quality = 'roof') AND (source <> 'third' OR (house AND region IS NOT NULL)) AND matched <> '')"


@query(f"""WITH c AS (SELECT *, coalesce({_OK}, false) AS ok, {{'a': source_rank, 'b': sub_rank}} AS place FROM {_CAND}), b AS (SELECT id, min(place) FILTER (WHERE ok) AS best FROM c GROUP BY id)
SELECT b.id, h.source, h.lat, h.matched, (SELECT count(*) FROM c f WHERE f.id = b.id AND NOT f.ok AND (b.best IS NULL OR f.place < b.best)) AS failed FROM b LEFT JOIN c h ON h.id = b.id AND h.ok AND h.place = b.best""")
def geocode_cascade(spark, sf_dir):
    """The first acceptable candidate, and how many failed before it."""
    best = C.first_acceptable(_candidates(spark, sf_dir), "id", _ok(), ["source_rank", "sub_rank"], F.col("source"))
    return best.select("id", "source", "lat", "matched", F.size("notes").cast("long").alias("failed"))


_LINK = r"""(SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a [^>]*?href="([^"]*)"', 1)) AS href FROM pages)"""


@query(rf"SELECT page_id, href, count(*) AS n FROM {_LINK} GROUP BY ALL")
def page_links(spark, sf_dir):
    """Links of whole pages."""
    return G.links_of(load(spark, sf_dir, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf_dir):
    """Titles as they stand in the source."""
    return load(spark, sf_dir, "pages").select("page_id", G.title_of("html").alias("title"))


@query()
def page_lines(spark, sf_dir):
    """Text lines, links and JSON-LD blocks of whole pages, by a reader."""
    p = load(spark, sf_dir, "pages").select("page_id", G.page("html", "url").alias("p"))
    return p.select("page_id", F.col("p.title").alias("title"), F.size("p.lines").alias("lines"), F.size("p.links").alias("links"), F.sha2(F.array_join("p.lines", "\n").cast("binary"), 256).alias("text_sha256"))


@query("""SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'unreachable' WHEN s IN (401, 403, 429) THEN 'blocked' WHEN s IN (404, 410) THEN 'gone' WHEN s >= 400 THEN 'error' END AS problem FROM (SELECT page_id, [200, 403, 404, 503, 429, 410][page_id % 6 + 1] AS s FROM pages)""")
def page_problem_labels(spark, sf_dir):
    """What a stored response says is wrong."""
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 403, 404, 503, 429, 410)]), (F.col("page_id") % 6 + 1).cast("int"))
    return load(spark, sf_dir, "pages").select("page_id", G.response_problem(status, F.when(F.col("page_id") % 13 == 0, "timeout")).alias("problem"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(html, '(?s)<[^>]*>', ' ', 'g') AS text, len(regexp_extract_all(html, '<a ')) AS links FROM pages)
SELECT page_id, CASE WHEN regexp_matches(substr(text, 1, 6000), '%%%') THEN 'parked' WHEN regexp_matches(text, '\bcard\b') THEN 'spam' WHEN length(text) >= 300 AND NOT regexp_matches(text, '\b(the|de|der)\b') THEN 'off topic' ELSE '' END AS reason,
  length(text) < 150 AND links < 5 AS unreadable FROM t""")
def page_looks_wrong(spark, sf_dir):
    """Parked, spam or off topic by configured patterns; hardly any text."""
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", r"(?s)<[^>]*>", " ").alias("text"), F.regexp_count("html", F.lit("<a ")).alias("links"))
    return p.select("page_id", G.page_suspicion(F.col("text"), "%%%", r"\bcard\b", r"\b(the|de|der)\b").alias("reason"), G.unreadable(F.length("text"), F.col("links")).alias("unreadable"))


@query(r"""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'none' WHEN h IN ('a.example.net', 'm.ththth.example.net') THEN 'social' WHEN h IN ('ththre.example.com') THEN 'listing' ELSE 'own' END AS kind
FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:https?://)?([^/?#:]+)', 1)), '^www\\.', '') AS h FROM pages)""")
def target_kinds(spark, sf_dir):
    """own site, social page, listing, or none, by configured hosts."""
    url = F.when(F.col("page_id") % 9 == 0, " ").otherwise(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", G.target_kind(url, ["a.example.net", "m.ththth.example.net"], ["ththre.example.com"]).alias("kind"))


@query(r"""WITH l AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^https?://[^/?#]+') || href ELSE href END AS href, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host FROM """ + _LINK + r""")
SELECT href, count(*) AS n FROM l WHERE starts_with(href, 'http') AND NOT regexp_matches(href, '(?i)\.(pdf|jpg)$|/the\b') AND host LIKE '%.example.com' AND regexp_replace(lower(regexp_extract(href, '^https?://([^/?#:]+)', 1)), '^www\.', '') = host
  AND href NOT IN (SELECT url FROM pages) GROUP BY href""")
def crawl_links(spark, sf_dir):
    """Links in scope that nobody has seen."""
    links = G.links_of(load(spark, sf_dir, "pages"))
    root = F.regexp_extract("url", "^https?://[^/?#]+", 0)
    links = links.withColumn("href", F.when(F.startswith("href", F.lit("/")), F.concat(root, "href")).otherwise(F.col("href")))
    host = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"^https?://([^/?#:]+)", 1)), r"^www\.", "")
    links = links.where(host("url").like("%.example.com") & (host("url") == host("href")))
    hosts = links.select(host("url").alias("host")).distinct()
    seen = load(spark, sf_dir, "pages").select(F.col("url").alias("href"))
    return G.in_scope(links, seen, hosts, r"(?i)\.(pdf|jpg)$|/the\b").groupBy("href").agg(F.count("*").alias("n"))


@query("""SELECT page_id, host, CAST(turn AS INTEGER) AS turn FROM (SELECT page_id, page_id % 7 AS host, row_number() OVER (PARTITION BY page_id % 7 ORDER BY CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END, page_id % 4, page_id) AS turn FROM pages) WHERE turn <= 30""")
def top_pages_per_host(spark, sf_dir):
    """The first thirty pages of each host: good ones, then by depth, then arrival."""
    k = F.col("page_id")
    rows = load(spark, sf_dir, "pages").select("page_id", (k % 7).alias("host"))
    return G.top_pages(rows, "host", [F.when(k % 3 == 0, 0).otherwise(1), k % 4, k])


_EDGES = "(SELECT o_custkey AS src, (o_custkey * 3 + o_orderkey) % 1000 AS dst FROM orders)"


@query(f"""WITH RECURSIVE r AS (SELECT 1 AS page, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN {_EDGES} e ON e.src = r.page WHERE depth < 3)
SELECT CAST(page AS BIGINT) AS page, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY page""")
def bfs_depth(spark, sf_dir):
    """Pages within three links of a root."""
    edges = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 3 + F.col("o_orderkey")) % 1000).alias("dst"))
    return G.crawl_depths(edges, spark.range(1, 2).select(F.col("id").alias("page")))


@query("SELECT page_id, page_id % 4 <> 0 OR NOT starts_with(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/en') AS allowed FROM pages")
def robots_allowed(spark, sf_dir):
    """C4: links that the site's rules allow."""
    rules = F.when(F.col("page_id") % 4 == 0, "User-agent: *\nDisallow: /en\n")
    return load(spark, sf_dir, "pages").select("page_id", G.allowed_by_robots(rules, "locarium", F.col("url")).alias("allowed"))


@query("""WITH q AS (SELECT event_id, user_id, CAST(event_id % 50 AS DOUBLE) / 10 AS t, row_number() OVER w - 1 AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id % 50, event_id))
SELECT event_id, round(max(t - k * 1.0) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + k * 1.0, 6) AS start FROM q""")
def politeness_schedule(spark, sf_dir):
    """One request a second and host, in closed form."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 50).alias("o"), ((F.col("event_id") % 50).cast("double") / 10).alias("t"))
    return G.polite_starts(e, "user_id", "t", ["o", "event_id"]).select("event_id", F.round("start", 6).alias("start"))


@query("SELECT event_id FROM (SELECT event_id, ts, [200, 0, 404, 503][event_id % 4 + 1] AS status FROM events) WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAYS AND status <> 0 AND status < 500")
def cache_fresh(spark, sf_dir):
    """SC9 E9: stored responses that still count at a given time."""
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 0, 404, 503)]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = load(spark, sf_dir, "events").select("event_id", F.col("ts").alias("fetched_at"), status.alias("status"))
    return G.fresh(rows, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("SELECT id, CAST(min(n) AS INTEGER) AS n FROM (SELECT o_custkey AS id, o_orderkey % 4 AS n, [200, 404, 200][o_orderkey % 3 + 1] AS status, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'x' END AS body FROM orders) WHERE status = 200 AND body <> '' GROUP BY id")
def first_answer(spark, sf_dir):
    """The first spelling that answers."""
    k = F.col("o_orderkey")
    tries = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (k % 4).cast("int").alias("n"), F.element_at(F.array(F.lit(200), F.lit(404), F.lit(200)), (k % 3 + 1).cast("int")).alias("status"), F.when(k % 5 == 0, "").otherwise("x").alias("body"))
    return C.first_answer(tries.withColumnRenamed("n", "turn"), "id", "turn").select("id", F.col("turn").alias("n"))


@query("SELECT s_suppkey, '+' || s_suppkey || ' 5' AS phone, 'a b' || s_suppkey || '@x.org' AS mail FROM supplier")
def contact_links(spark, sf_dir):
    """Numbers and addresses of tel: and mailto: links."""
    s = F.col("s_suppkey").cast("string")
    return load(spark, sf_dir, "supplier").select("s_suppkey", G.plain_link(F.concat(F.lit("tel:+"), s, F.lit("%205"))).alias("phone"), G.plain_link(F.concat(F.lit("mailto:a%20b"), s, F.lit("@x.org?subject=1"))).alias("mail"))
