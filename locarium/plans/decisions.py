"""Fact and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from locarium.functions import text as T
from locarium.operators import decide as D
from locarium.operators import facts as A

from .registry import load, query


@query("SELECT source, lang, doc_id, n_chars FROM (SELECT *, rank() OVER (PARTITION BY source, lang ORDER BY n_chars // 50 DESC) AS r FROM documents) WHERE r = 1 QUALIFY count(*) OVER (PARTITION BY source, lang) = 1")
def unique_argmax(spark, sf_dir):
    """The best of each group, none on a tie."""
    docs = load(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return A.unique_best(docs, ["source", "lang"], [F.floor(F.col("n_chars") / 50).desc()])


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1")
def modal_value(spark, sf_dir):
    """The commonest value, the first seen of equal ones."""
    return A.modal_value(load(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source"], "lang", "doc_id")


@query("SELECT event_type AS kind, user_id AS value, count(DISTINCT event_id % 40) AS pages FROM events GROUP BY ALL HAVING count(DISTINCT event_id % 40) >= 2")
def sitewide_values(spark, sf_dir):
    """Values on several pages."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("value"), (F.col("event_id") % 40).alias("url"))
    return A.sitewide(e, ["kind", "value"], "url")


@query("SELECT user_id, count_if(event_type = 'view') AS votes, count_if(event_type = 'click') AS against FROM events GROUP BY 1 HAVING count_if(event_type = 'click') <= count_if(event_type = 'view')")
def role_votes(spark, sf_dir):
    """As many mentions for as against."""
    return A.role_votes(load(spark, sf_dir, "events"), ["user_id"], "event_type", "view", "click")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT substr(o_orderpriority, 1, 1) IN ('1', '2')) = 1")
def single_value_only(spark, sf_dir):
    """Groups with one key, by the first spelling."""
    key = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    return A.single_value(load(spark, sf_dir, "orders"), ["o_custkey"], key, "o_orderpriority", "o_orderkey")


@query()
def greedy_clusters(spark, sf_dir):
    """Values by the first cluster whose head matches."""
    k = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("place"), k.alias("ord"), F.concat((k % 4).cast("string"), F.lit(" Main St"), F.when(k % 3 == 0, " North").otherwise("")).alias("address"))
    return A.greedy_clusters(rows, ["place"], "address", "ord", T.addresses_match)


@query("SELECT event_id, 'Thing' AS type, CAST(json_extract(props, '$.k') AS VARCHAR) AS name FROM events")
def jsonld_walk(spark, sf_dir):
    """Objects of JSON at any depth; those with a type."""
    text = F.concat(F.lit('{"a": [{"b": {"@type": "Thing", "name": '), F.get_json_object("props", "$.k"), F.lit("}}]}"))
    e = load(spark, sf_dir, "events").select("event_id", F.explode(A.jsonld_objects(text)).alias("o"))
    return e.where("o.type is not null").select("event_id", "o.type", "o.name")


@query()
def nearest_label(spark, sf_dir):
    """S-21 D1: the role word nearest to each address of whole texts."""
    docs = load(spark, sf_dir, "documents").where(F.contains("text", F.lit("@")))
    found = A.labelled_matches("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", {"mail": "office", "the": "common", "de": "common"})
    return docs.select("doc_id", F.posexplode(found).alias("pos", "m")).select("doc_id", "pos", "m.value", "m.role")


_LINES = "(SELECT o_custkey AS page, o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'Role ' || o_orderstatus WHEN 1 THEN 'Name ' || o_orderkey ELSE 'text' END AS line FROM orders)"


@query(f"""SELECT page, ord, line AS name, CASE WHEN below LIKE 'Role%' THEN below ELSE above END AS role FROM (SELECT *, lag(line) OVER w AS above, lead(line) OVER w AS below FROM {_LINES} WINDOW w AS (PARTITION BY page ORDER BY ord))
WHERE line LIKE 'Name%' AND (below LIKE 'Role%' OR above LIKE 'Role%')""")
def neighbour_roles(spark, sf_dir):
    """S-20: a name with the role on the line below, or above."""
    k = F.col("o_orderkey")
    lines = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), k.alias("ord"), F.when(k % 3 == 0, F.concat(F.lit("Role "), "o_orderstatus")).when(k % 3 == 1, F.concat(F.lit("Name "), k.cast("string"))).otherwise("text").alias("line"))
    return A.neighbour_roles(lines, "page", "ord", "line", "^Role", "^Name")


#: Facts derived from orders: values, roles, pages, page data and listings in all mixtures; people beside them.
_FACTS = """(SELECT o_custkey AS id, o_orderkey % 2 = 1 AS mail, CASE WHEN o_orderkey % 2 = 1 THEN ['info', 'giving', 'ann', 'doe', 'lead'][o_orderkey % 5 + 1] || '@x' || (o_orderkey // 8 % 2) || '.org' ELSE 'v' || (o_orderkey // 2 % 4) END AS value,
  ['main', 'lead', ''][o_orderkey % 3 + 1] AS role, 'https://x.org/' || ['', 'contact-us', 'blog/1', 'staff', 'history'][o_orderkey // 4 % 5 + 1] AS url, 'call ' || ['Doe', 'Roedoe', 'Lee'][o_orderkey // 2 % 3 + 1] || ' now' AS evidence,
  o_orderkey % 11 = 0 AS structured, o_orderkey // 3 % 7 = 0 AS listed, o_orderkey AS ord FROM orders)"""
_RECORDS = "(SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN 'v' || (c_custkey % 5) ELSE NULL END AS current_value FROM customer)"


def _pick(values: list[str], by) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _facts(spark, sf_dir):
    k = F.col("o_orderkey")
    div = lambda n: F.floor(k / n)
    s = lambda x: x.cast("string")
    value = F.when(k % 2 == 1, F.concat(_pick(["info", "giving", "ann", "doe", "lead"], k), F.lit("@x"), s(div(8) % 2), F.lit(".org"))).otherwise(F.concat(F.lit("v"), s(div(2) % 4)))
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), (k % 2 == 1).alias("mail"), value.alias("value"), _pick(["main", "lead", ""], k).alias("role"), F.concat(F.lit("https://x.org/"), _pick(["", "contact-us", "blog/1", "staff", "history"], div(4))).alias("url"),
        F.concat(F.lit("call "), _pick(["Doe", "Roedoe", "Lee"], div(2)), F.lit(" now")).alias("evidence"), (k % 11 == 0).alias("structured"), (div(3) % 7 == 0).alias("listed"), k.alias("ord"),
    )


def _records(spark, sf_dir):
    c = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 3 == 0, "N/A").when(c % 3 == 1, F.concat(F.lit("v"), (c % 5).cast("string"))).alias("current_value"))


def _main_sql(facts: str, mailbox: bool) -> str:
    excluded = "AND NOT regexp_matches(split_part(value, '@', 1), 'giving|news|music')" if mailbox else ""
    return f"""(SELECT id, value, source_url, sitewide FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY (main > 0 OR data) DESC, pages DESC) AS r FROM (
  SELECT id, value, count(DISTINCT url) AS pages, count(*) FILTER (role = 'main') AS main, bool_or(structured) AS data, count(DISTINCT url) >= 2 OR bool_or(structured OR listed) AS sitewide,
    bool_or(role = 'main' AND (url = 'https://x.org/' OR contains(url, 'contact'))) AS contact, arg_min(url, ord) AS source_url
  FROM {facts} WHERE {'mail' if mailbox else 'NOT mail'} {excluded} GROUP BY id, value HAVING count(*) FILTER (role = 'lead') <= count(*) FILTER (role = 'main'))) WHERE r = 1 QUALIFY count(*) OVER (PARTITION BY id) = 1 AND (sitewide OR contact))"""


def _offer_sql(own: str, every: str, mail: str) -> str:
    return f"""SELECT r.id, current_value, coalesce(o.value, e.value) AS new_value, CASE WHEN blank THEN 'add' ELSE 'replace' END AS action, CASE WHEN o.id IS NULL THEN e.source_url ELSE o.source_url END AS source_url
FROM (SELECT *, current_value IS NULL OR current_value = 'N/A' AS blank FROM {_RECORDS}) r LEFT JOIN {own} o ON o.id = r.id LEFT JOIN {every} e ON e.id = r.id AND blank
WHERE coalesce(o.value, e.value) IS NOT NULL AND (blank OR (o.sitewide AND coalesce(o.value, e.value) <> current_value AND NOT EXISTS (SELECT 1 FROM {_FACTS} f WHERE f.id = r.id AND {mail} AND NOT listed AND f.value = current_value)))"""


_OWN = f"(SELECT * FROM {_FACTS} WHERE NOT listed)"


@query("SELECT false AS mail, * FROM (" + _offer_sql(_main_sql(_OWN, False), _main_sql(_FACTS, False), "NOT mail") + ") UNION ALL SELECT true, * FROM (" + _offer_sql(_main_sql(_OWN, True), _main_sql(_FACTS, True), "mail") + ")")
def decide_changes(spark, sf_dir):
    """Add or replace main numbers and mailboxes; own facts before listed ones."""
    records, facts = _records(spark, sf_dir), _facts(spark, sf_dir)
    parts = [D.offers(records, facts.where("mail" if m else "not mail"), lambda f, m=m: D.main_contact(f, m), lambda a, b: a == b).withColumn("mail", F.lit(m)) for m in (False, True)]
    return parts[0].unionByName(parts[1]).drop("evidence")


def _lead_sql(mailbox: bool) -> str:
    named = "(contains(split_part(value, '@', 1), last) OR contains(split_part(value, '@', 1), given) OR split_part(value, '@', 1) IN ('lead', 'director'))" if mailbox else "lower(split_part(evidence, ' ', 2)) = last"
    return f"""SELECT id, value, {'true' if mailbox else 'false'} AS mail FROM (SELECT id, value, rank() OVER (PARTITION BY id ORDER BY count(DISTINCT url) DESC) AS r FROM (
  SELECT f.*, CASE WHEN id % 2 = 0 THEN 'doe' ELSE 'lee' END AS last, CASE WHEN id % 2 = 0 THEN 'ann' ELSE 'bo_no' END AS given FROM {_FACTS} f WHERE {'mail' if mailbox else 'NOT mail'})
  GROUP BY id, value HAVING bool_or(role = 'lead' AND (listed OR {named}))) WHERE r = 1 QUALIFY count(*) OVER (PARTITION BY id) = 1"""


@query(_lead_sql(False) + " UNION ALL " + _lead_sql(True))
def lead_contacts(spark, sf_dir):
    """D3: the lead's own number and mailbox, labelled and named."""
    facts = _facts(spark, sf_dir)
    leads = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "Dr. Ann Doe, Jr.").otherwise("Bo Lee").alias("name"))
    return D.lead_contact(facts.where("not mail"), leads).select("id", "value", F.lit(False).alias("mail")).unionByName(D.lead_contact(facts.where("mail"), leads, mailbox=True).select("id", "value", F.lit(True).alias("mail")))


_PEOPLE = """(SELECT o_custkey AS id, ['Ann Doe', 'Bo Roe', 'A. Doe', 'Cy Poe-Doe'][p + 1] AS value, ['doe', 'roe', 'doe', 'poe-doe'][p + 1] AS last, ['other', 'weak', 'lead'][1 + CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 3 ELSE o_orderkey % 2 END] AS role,
  'https://x.org/' || ['', 'staff/all', 'history', 'blog', 'our-staff'][o_orderkey // 4 % 5 + 1] AS url, o_orderkey // 3 % 7 = 0 AS listed, o_orderkey AS ord
  FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey // 2 % 4 ELSE o_custkey % 3 - 1 END AS p FROM orders))"""


def _people(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = F.when(c % 3 == 0, F.floor(k / 2) % 4).otherwise(c % 3 - 1)
    return load(spark, sf_dir, "orders").select(
        c.alias("id"), _pick(["Ann Doe", "Bo Roe", "A. Doe", "Cy Poe-Doe"], p).alias("value"), F.element_at(F.array(F.lit("other"), F.lit("weak"), F.lit("lead")), (F.when(c % 2 == 0, k % 3).otherwise(k % 2) + 1).cast("int")).alias("role"),
        F.concat(F.lit("https://x.org/"), _pick(["", "staff/all", "history", "blog", "our-staff"], F.floor(k / 4))).alias("url"), F.lit("e").alias("evidence"), (F.floor(k / 3) % 7 == 0).alias("listed"), k.alias("ord"),
    )


def _person_sql(own: bool) -> str:
    return f"""(SELECT id, arg_min(value, ord) AS name FROM (SELECT *, count(*) FILTER (role = 'lead') OVER (PARTITION BY id) AS leads, max(last) FILTER (role = 'weak') OVER (PARTITION BY id) = min(last) FILTER (role = 'weak') OVER (PARTITION BY id) AS one_weak
  FROM {_PEOPLE} WHERE NOT contains(url, 'history') {'AND NOT listed' if own else ''}) WHERE (role = 'lead' OR (leads = 0 AND role = 'weak' AND one_weak)) AND (listed OR url = 'https://x.org/' OR contains(url, 'staff')) GROUP BY id HAVING min(last) = max(last))"""


@query(f"SELECT id, name FROM {_person_sql(False)}")
def lead_people(spark, sf_dir):
    """The one lead on staff pages, weak roles only where no strong one stands."""
    return D.lead_person(_people(spark, sf_dir), "history", "staff").select("id", "name")


@query(f"""SELECT r.id, current_value, CASE WHEN v = 1 THEN 'Prof. ' ELSE '' END || coalesce(o.name, e.name) AS new_value, CASE WHEN v = 0 THEN 'add' ELSE 'replace' END AS action
FROM (SELECT c_custkey AS id, c_custkey % 4 AS v, ['', 'Prof. Zed Zoe', 'Ann Doe', 'Al Poe'][c_custkey % 4 + 1] AS current_value FROM customer) r LEFT JOIN {_person_sql(True)} o ON o.id = r.id LEFT JOIN {_person_sql(False)} e ON e.id = r.id AND v = 0
WHERE coalesce(o.name, e.name) IS NOT NULL AND CASE v WHEN 2 THEN coalesce(o.name, '') IN ('Bo Roe', 'Cy Poe-Doe') AND NOT EXISTS (SELECT 1 FROM {_PEOPLE} p WHERE p.id = r.id AND role <> 'other' AND value IN ('Ann Doe', 'A. Doe')) ELSE true END""")
def lead_name_changes(spark, sf_dir):
    """Another lead, if the current one is named in no such role; a recorded title stays."""
    c = F.col("c_custkey")
    records = load(spark, sf_dir, "customer").select(c.alias("id"), _pick(["", "Prof. Zed Zoe", "Ann Doe", "Al Poe"], c).alias("current_value"))
    return D.name_changes(records, _people(spark, sf_dir), "history", "staff", r"Prof\.|Dr\.").drop("source_url", "evidence")


_PLACES = """(SELECT o_custkey AS id, o_custkey || CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 = 0 THEN ' Elm' ELSE ' Oak' END || [' St, ', ' Street, ', ' St, '][o_orderkey % 3 + 1] || ['Waco', 'Mt Vernon'][o_custkey % 2 + 1] || ', TX' AS value,
  o_custkey % 3 = 0 AND o_orderkey % 4 = 0 AS elm, 'u' || (o_orderkey // 4 % 2) AS url, o_orderkey % 13 = 0 AS structured, o_orderkey AS ord FROM orders)"""


@query(f"""WITH p AS (SELECT id, min(elm) = max(elm) AND (bool_or(structured) OR count(DISTINCT url) >= 2) AS ok, coalesce(arg_min(value, ord) FILTER (structured), (SELECT value FROM {_PLACES} m WHERE m.id = f.id GROUP BY value ORDER BY count(*) DESC, min(ord) LIMIT 1)) AS value FROM {_PLACES} f GROUP BY id),
r AS (SELECT c_custkey AS id, c_custkey % 4 AS v, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN c_custkey || ' North Oak Ave, Waco, TX' WHEN 2 THEN (c_custkey + 1) || ' Old Rd, Waco, TX' ELSE 'PO Box 5' END AS address, CASE WHEN c_custkey % 5 = 0 THEN 'Mount Vernon' ELSE 'Waco' END AS city, CASE WHEN c_custkey % 7 = 0 THEN 'Texas' ELSE 'OH' END AS state FROM customer),
j AS (SELECT r.*, p.value FROM r JOIN p USING (id) WHERE ok AND v <> 1 AND NOT (v = 2 AND id % 8 = 2))
SELECT id, 'address' AS field, address AS current_value, value AS new_value, CASE WHEN address IS NULL THEN 'add' ELSE 'replace' END AS action FROM j
UNION ALL SELECT id, 'city', city, CASE WHEN id % 2 = 0 THEN 'Waco' ELSE 'Mt Vernon' END, 'replace' FROM j WHERE (id % 2 = 0) = (city <> 'Waco') UNION ALL SELECT id, 'state', state, 'TX', 'replace' FROM j WHERE state = 'OH'""")
def address_changes(spark, sf_dir):
    """The site's one address, with city and state."""
    from locarium.operators.extract import STATES

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    value = F.concat(s(c), F.when((c % 3 == 0) & (k % 4 == 0), " Elm").otherwise(" Oak"), _pick([" St, ", " Street, ", " St, "], k), _pick(["Waco", "Mt Vernon"], c), F.lit(", TX"))
    facts = load(spark, sf_dir, "orders").select(c.alias("id"), value.alias("value"), F.concat(F.lit("u"), s(F.floor(k / 4) % 2)).alias("url"), F.lit("e").alias("evidence"), (k % 13 == 0).alias("structured"), k.alias("ord"))
    i = F.col("c_custkey")
    address = F.when(i % 4 == 1, F.concat(s(i), F.lit(" North Oak Ave, Waco, TX"))).when(i % 4 == 2, F.concat(s(i + 1), F.lit(" Old Rd, Waco, TX"))).when(i % 4 == 3, "PO Box 5")
    records = load(spark, sf_dir, "customer").select(i.alias("id"), address.alias("address"), F.when(i % 5 == 0, "Mount Vernon").otherwise("Waco").alias("city"), F.when(i % 7 == 0, "Texas").otherwise("OH").alias("state"))
    # a page shows the number of its addresses, of those in page data too
    numbers = records.select("id", F.when(F.col("id") % 8 == 2, s(F.col("id") + 1)).otherwise("x").alias("number")).unionByName(facts.select("id", T.street_number("value").alias("number")))
    return D.address_changes(records, facts, numbers, STATES).drop("source_url", "evidence")


_LIVE = """(SELECT o_custkey AS id, ['https://www.youtube.com/@c/live', 'https://youtube.com/@C', 'https://vimeo.com/x'][CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 2 ELSE o_orderkey % 3 END + 1] AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'labelled' ELSE '' END AS role, o_orderkey // 3 % 7 = 0 AS listed, o_orderkey AS ord FROM orders)"""


@query(f"""SELECT c_custkey AS id, [NULL, 'n/a', 'https://a.b/c'][c_custkey % 3 + 1] AS current_value, value AS new_value, 'add' AS action FROM customer JOIN (SELECT id, arg_min(value, ord) AS value FROM {_LIVE}
  WHERE NOT listed AND (role = 'labelled' OR (id % 4 < 2 AND contains(value, 'youtube'))) GROUP BY id HAVING bool_and(contains(value, 'youtube')) OR bool_and(contains(value, 'vimeo'))) ON id = c_custkey WHERE c_custkey % 3 < 2""")
def channel_changes(spark, sf_dir):
    """D9 A15 S-25: a blank channel by the only one that the site links as a stream."""
    k, c, i = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    urls = ["https://www.youtube.com/@c/live", "https://youtube.com/@C", "https://vimeo.com/x"]
    value = F.element_at(F.array(*map(F.lit, urls)), (F.when(c % 2 == 0, k % 2).otherwise(k % 3) + 1).cast("int"))
    facts = load(spark, sf_dir, "orders").select(c.alias("id"), value.alias("value"), F.when(k % 5 == 0, "labelled").otherwise("").alias("role"), F.lit("u").alias("url"), F.lit("e").alias("evidence"), (F.floor(k / 3) % 7 == 0).alias("listed"), k.alias("ord"))
    customers = load(spark, sf_dir, "customer")
    records = customers.select(i.alias("id"), F.when(i % 3 == 1, "n/a").when(i % 3 == 2, "https://a.b/c").alias("current_value"))
    talks = customers.select(F.when(i % 4 < 2, i).alias("id"))
    return D.channel_changes(records, facts, talks, T.channel_key).drop("source_url", "evidence")


@query("""WITH s AS (SELECT s_suppkey AS id, lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS n FROM supplier)
SELECT id, kind, value, role, structured FROM (
SELECT id, 'phone' AS kind, '254222' || n AS value, 'main' AS role, false AS structured FROM s UNION ALL SELECT id, 'phone', '254333' || n, 'main', false FROM s UNION ALL SELECT id, 'email', 'info@w' || id || '.org', 'main', false FROM s
UNION ALL SELECT id, 'address', id || ' N Main St, Boston, MA', '', false FROM s UNION ALL SELECT id, 'person', 'Ann Doe', 'lead', false FROM s UNION ALL SELECT id, 'person', 'Bo Roe', 'weak', false FROM s
UNION ALL SELECT id, 'phone', '254444' || n, 'main', false FROM s UNION ALL SELECT id, 'email', 'ann.lead@w.org', 'lead', false FROM s UNION ALL SELECT id, 'livestream', 'https://www.youtube.com/@w' || id, 'labelled', false FROM s
UNION ALL SELECT id, 'phone', '254777' || n, 'main', true FROM s UNION ALL SELECT id, 'address', id || ' Oak Ct, Austin, TX', '', true FROM s)""")
def page_facts(spark, sf_dir):
    """D1 F23 F24 S-15 S-18 S-19 S-20 S-21 S-22 S-32 X3: all kinds of facts of a page, faxes and junk left out."""
    from locarium.operators.extract import page_facts as found

    k = F.col("s_suppkey").cast("string")
    n = F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0")
    text = F.concat(F.lit("Office: (254) 222-"), n, F.lit("\nfax: 254-222-1111\nDirector\nAnn Doe\nCall 254.333."), n, F.lit("\n"), k, F.lit(" NORTH Main Street, Boston, MA 02110\nmail Info@w"), k, F.lit(".org or you@example.com or pic@2x.png\nBo Roe, Assistant"))
    links = [("tel:+1-254-444-{n}", "Front desk"), ("mailto:Ann.Lead@w.org?subject=x", ""), ("https://www.youtube.com/@w{k}#top", "Watch live"), ("https://www.youtube.com/watch?v=1", "one recording"), ("/about", "About")]
    link = lambda href, label: F.struct(F.replace(F.replace(F.lit(href), F.lit("{n}"), n), F.lit("{k}"), k).alias("href"), F.lit(label).alias("label"))
    data = F.concat(F.lit('{"@graph": [{"@type": ["Organization"], "telephone": "254 777 '), n, F.lit('", "address": {"streetAddress": "'), k, F.lit(' OAK Court", "addressLocality": "Austin", "addressRegion": "Texas"}}, {"@type": "Event", "telephone": "254 888 1234"}]}'))
    pages = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.alias("text"), F.array(*[link(*x) for x in links]).alias("links"), data.alias("data"))
    return found(pages, ["id"]).drop("evidence")


@query("SELECT id, field, value, ord FROM (SELECT o_custkey AS id, 'own' AS field, 'v' || o_orderkey AS value, o_orderkey AS ord FROM orders UNION ALL SELECT c_custkey, 'listed', 'w' || c_custkey, 1000000000 + c_custkey FROM customer)")
def fact_union(spark, sf_dir):
    """The site's own facts, then those of listings, in order."""
    own = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("own").alias("field"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("value"), F.col("o_orderkey").alias("ord"))
    listed = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("listed").alias("field"), F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("value"), (F.lit(1_000_000_000) + F.col("c_custkey")).alias("ord"))
    return own.unionByName(listed)


@query("SELECT DISTINCT c_nationkey AS value, CASE WHEN c_nationkey % 4 = 0 THEN 'unlisted' ELSE 'listed' END AS kind FROM customer")
def used_and_listed(spark, sf_dir):
    """U4: values in use that a list has, and those that it lacks."""
    used = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("value"))
    listed = load(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")).alias("value"))
    return used.intersect(listed).withColumn("kind", F.lit("listed")).unionByName(used.distinct().join(listed, "value", "left_anti").withColumn("kind", F.lit("unlisted")))


@query("SELECT page_id, CAST(r AS INTEGER) AS row, ['Alpha', 'Beta'][r + 1] || page_id AS name, CASE WHEN r = 0 THEN '/p' || page_id END AS link FROM pages, (VALUES (0), (1)) AS v(r)")
def listing_items(spark, sf_dir):
    """Rows of listing pages by classes, with the links of their fields."""
    from locarium.operators.extract import listings

    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<ul><li class="card"><a class="name" href="/p'), k, F.lit('">Alpha'), k, F.lit('</a></li><li class="card x"><p class="name">Beta'), k, F.lit("</p></li></ul>"))
    rows = listings(load(spark, sf_dir, "pages").select("page_id", html.alias("html")), ["page_id"], "html", "card", {"name": "name"})
    return rows.select("page_id", F.col("row").cast("int").alias("row"), F.col("fields")["name"].alias("name"), F.col("fields")["name_link"].alias("link"))


@query("SELECT c_custkey AS id, 'lead' AS field, 'L' || (c_custkey % 30) AS current_value, 'L' || c_nationkey AS new_value FROM customer WHERE c_custkey % 30 <> c_nationkey")
def holder_changes(spark, sf_dir):
    """Records that name another than the current holder."""
    records = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("group"), F.concat(F.lit("L"), (F.col("c_custkey") % 30).cast("string")).alias("lead"))
    holders = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group"), F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("holder"))
    return D.lookup_change(records, holders, "group", "lead", lambda a, b: a == b)


@query("WITH c AS (SELECT c_custkey AS id, unnest(['main', 'lead']) AS field, 'p' || unnest([c_custkey % 7, c_custkey % 5]) AS new_value FROM customer) SELECT * FROM c a WHERE field <> 'lead' OR NOT EXISTS (SELECT 1 FROM c b WHERE b.id = a.id AND b.field = 'main' AND b.new_value = a.new_value)")
def distinct_contacts(spark, sf_dir):
    """The lead's contact is never the main one."""
    k = F.col("c_custkey")
    c = load(spark, sf_dir, "customer").select(k.alias("id"), F.explode(F.array(F.struct(F.lit("main").alias("field"), F.concat(F.lit("p"), (k % 7).cast("string")).alias("new_value")), F.struct(F.lit("lead").alias("field"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("new_value")))).alias("c"))
    return D.not_the_same_contact(c.select("id", "c.*"), "lead", "main")


@query(r"SELECT page_id AS id, url, CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://new' || page_id || '.org/' END AS works_at FROM pages WHERE page_id % 3 <> 0")
def moved_site_changes(spark, sf_dir):
    """Sites that answer elsewhere."""
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("url"))
    sites = rows.select("url", F.when(F.col("id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://new"), F.col("id").cast("string"), F.lit(".org/"))).alias("works_at"))
    return D.moved_sites(rows, sites).select("id", F.regexp_replace("url", r"#[0-9]+$", "").alias("url"), "works_at")


@query("SELECT page_id AS id, 'n' || page_id AS name, p AS problem, CAST(CASE p WHEN 'gone' THEN 0 WHEN 'blocked' THEN 1 ELSE 2 END AS INTEGER) AS severity FROM (SELECT page_id, ['gone', 'slow', 'blocked'][page_id % 3 + 1] AS p FROM pages)")
def problem_report(spark, sf_dir):
    """Problems by severity, then name."""
    problem = F.element_at(F.array(F.lit("gone"), F.lit("slow"), F.lit("blocked")), (F.col("page_id") % 3 + 1).cast("int"))
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("name"), problem.alias("problem"))
    return D.ordered_problems(rows, ["gone", "blocked"])


@query("SELECT '<loc>https://x.org/?place=s' || s_suppkey || '</loc>' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '<lastmod>2024-01-0' || (1 + s_suppkey % 9) || '</lastmod>' END AS entry FROM supplier")
def sitemap_rows(spark, sf_dir):
    """SK8: a sitemap entry for each place; blank dates give none."""
    from locarium.sources.sinks import sitemap_entry

    s = F.col("s_suppkey")
    rows = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s.cast("string")).alias("id"), F.when(s % 3 == 0, " ").otherwise(F.concat(F.lit("2024-01-0"), (s % 9 + 1).cast("string"))).alias("updated_on"))
    return rows.select(sitemap_entry(F.lit("https://x.org/"), "id", "updated_on").alias("entry"))


@query("SELECT '- ' || s_name || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ', N' || s_nationkey END || ' (s' || s_suppkey || ')' AS line, (SELECT count(*) FROM supplier) AS total FROM supplier")
def text_index_rows(spark, sf_dir):
    """SK8 A22: a line for each place, and the size of the whole."""
    from locarium.sources.sinks import index_line

    rows = load(spark, sf_dir, "supplier")
    lines = rows.select(index_line("s_name", F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("line"))
    return lines.join(F.broadcast(rows.agg(F.count("*").alias("total"))))
