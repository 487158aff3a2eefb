"""Normaliser queries: phones, names, links, dates, escapes, change log, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from locarium.functions import text as T
from locarium.operators import normalize as N

from .registry import load, places, places_sql, query

#: Phone spellings derived from the key: area a (any three digits), exchange b, line c; d is all ten, f their house style.
_PHONES = """(SELECT *, CASE m WHEN 0 THEN '1-' || a || '-' || b || '-' || c WHEN 1 THEN '(' || a || ') ' || b || '-' || c WHEN 2 THEN a || '.' || b || '.' || c || ' x12' WHEN 3 THEN 'call ' || d || ' or +1 ' || a || ' ' || b || ' ' || c
  WHEN 4 THEN 'N/A - ' || a || '-' || b || '-' || c WHEN 5 THEN 'none' WHEN 6 THEN a || '-555-' || c WHEN 7 THEN a || '/' || b || '/' || c || ' extension 7' WHEN 8 THEN a || '-' || b || '-' || c || ' / ' || a || '.' || b || '.' || c
  WHEN 9 THEN 'n/a ' || a || ' ' || b || ' ' || c || '.' WHEN 10 THEN 'x' || d WHEN 11 THEN d END AS phone
  FROM (SELECT *, a || b || c AS d, '(' || a || ') ' || b || '-' || c AS f FROM (SELECT c_custkey AS id, c_custkey % 13 AS m, CAST(100 + c_custkey * 7 % 900 AS VARCHAR) AS a, CAST(200 + c_custkey * 13 % 350 AS VARCHAR) AS b, lpad(CAST(c_custkey * 17 % 10000 AS VARCHAR), 4, '0') AS c FROM customer)))"""
_TIDY = "CASE m WHEN 2 THEN f || ' ext. 12' WHEN 3 THEN 'call ' || f || ' or ' || f WHEN 6 THEN '(' || a || ') 555-' || c WHEN 7 THEN f || ' ext. 7' WHEN 8 THEN f || ' / ' || f WHEN 9 THEN 'n/a ' || f WHEN 5 THEN 'none' WHEN 10 THEN phone WHEN 12 THEN NULL WHEN 4 THEN {na} ELSE f END"
_FORMAT = _TIDY.replace("{na}", "phone")


def _phones(spark, sf_dir):
    k = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(k, (F.lit(100) + k * 7 % 900).cast("string").alias("a"), (F.lit(200) + k * 13 % 350).cast("string").alias("b"), F.lpad((k * 17 % 10000).cast("string"), 4, "0").alias("c"))
    say = lambda *f: F.concat(*[F.col(x) if x in ("a", "b", "c") else F.lit(x) for x in f])
    spellings = [
        ("1-", "a", "-", "b", "-", "c"), ("(", "a", ") ", "b", "-", "c"), ("a", ".", "b", ".", "c", " x12"), ("call ", "a", "b", "c", " or +1 ", "a", " ", "b", " ", "c"), ("N/A - ", "a", "-", "b", "-", "c"), ("none",), ("a", "-555-", "c"),
        ("a", "/", "b", "/", "c", " extension 7"), ("a", "-", "b", "-", "c", " / ", "a", ".", "b", ".", "c"), ("n/a ", "a", " ", "b", " ", "c", "."), ("x", "a", "b", "c"), ("a", "b", "c"),
    ]
    phone = F.lit(None).cast("string")
    for m, spelling in enumerate(spellings):
        phone = F.when(k % 13 == m, say(*spelling)).otherwise(phone)
    return rows.select(k.alias("id"), phone.alias("phone"))


@query(f"SELECT id, {_FORMAT} AS phone FROM {_PHONES}")
def format_phones(spark, sf_dir):
    """S-1: one spelling for all numbers in a text, those that begin with N/A as they are."""
    return _phones(spark, sf_dir).select("id", T.format_phones("phone").alias("phone"))


@query("SELECT id, " + _TIDY.replace("{na}", "'N/A - ' || f") + f" AS phone FROM {_PHONES}")
def shown_phones(spark, sf_dir):
    """S-2: the spelling in which numbers are shown, N/A or not."""
    return _phones(spark, sf_dir).select("id", T.shown_phones("phone").alias("phone"))


@query(f"""SELECT id, list_filter(CASE WHEN m IN (5, 6, 12) THEN [] WHEN m = 7 THEN CASE WHEN a < '200' AND substr(a, 2, 1) >= '2' THEN [substr(a, 2) || b || c || '7'] ELSE [] END
  WHEN a < '200' THEN [] WHEN m = 8 THEN [d, d] ELSE [d] END, lambda x: substr(x, 4, 3) <> '555') AS digits FROM {_PHONES}""")
def phone_digits(spark, sf_dir):
    """S-4: ten digits of each number in running text, without the reserved exchange."""
    return _phones(spark, sf_dir).select("id", T.phone_digits("phone").alias("digits"))


@query(f"SELECT id, CAST(CASE WHEN m IN (3, 8) THEN 2 ELSE 0 END AS INTEGER) AS numbers FROM {_PHONES} WHERE m IN (3, 5, 8, 10)")
def phone_review(spark, sf_dir):
    """S-3 F26 D14: texts with no readable number, or with several."""
    rows = _phones(spark, sf_dir).withColumn("numbers", T.phone_count("phone"))
    return rows.where("trim(phone) <> '' and numbers <> 1").select("id", "numbers")


@query(r"""WITH f AS (SELECT doc_id, regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '^\s+|\s+$', '', 'g') AS folded FROM documents),
s AS (SELECT doc_id, folded, regexp_replace(regexp_replace(folded, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM f)
SELECT doc_id, length(folded) AS letters, md5(folded) AS folded, md5(CASE WHEN s = '' THEN 'unknown' ELSE s END) AS slug FROM s""")
def fold_slug(spark, sf_dir):
    """S-11 O5: fold and slug of whole texts, as digests."""
    rows = load(spark, sf_dir, "documents").select("doc_id", T.fold("text").alias("folded"))
    return rows.select("doc_id", F.length("folded").cast("long").alias("letters"), F.md5(F.col("folded").cast("binary")).alias("folded"), F.md5(T.slug(F.col("folded")).cast("binary")).alias("slug"))


@query("SELECT id, name FROM (SELECT id, regexp_replace(name, 'e', 'É') AS name, key FROM " + places_sql() + ") ORDER BY name, id")
def folded_sort(spark, sf_dir):
    """Accent- and case-folded order with ties by id."""
    rows = places(spark, sf_dir).select("id", F.regexp_replace("name", "^([^e]*)e", "$1É").alias("name"))
    return rows.withColumn("k", T.fold("name")).orderBy("k", "id").drop("k")


#: Names with titles, roles, generations and degrees derived from the key.
_NAMES = """(SELECT s_suppkey AS id, s_suppkey % 9 AS m, s_name AS n, s_suppkey % 2 = 0 AS hall FROM supplier)"""
_RAW_NAME = "CASE m WHEN 0 THEN 'Professor Ann ' || n || ' (Dean)' WHEN 1 THEN 'the Prof Bo ' || n || ', Jr., Lead' WHEN 2 THEN 'doctor Cy ' || n || ', Iii' WHEN 3 THEN 'Di ' || n || ', Chair, Board' WHEN 4 THEN 'Ed ' || n || ' Ii' WHEN 5 THEN 'Flo ' || n || ', Ph. D., Interim Chair' WHEN 6 THEN 'N/A (none)' WHEN 7 THEN 'Gus ' || n || ', chair' ELSE '' END"
_TITLES = [(r"(?i)\bprof(?:essor)?\b\.?", "Prof."), (r"(?i)\b(?:doctor|dr)\b\.?", "Dr.")]
_ARTICLE = r"Prof\."


def _names(spark, sf_dir):
    n = F.col("s_name")
    forms = [
        F.concat(F.lit("Professor Ann "), n, F.lit(" (Dean)")), F.concat(F.lit("the Prof Bo "), n, F.lit(", Jr., Lead")), F.concat(F.lit("doctor Cy "), n, F.lit(", Iii")), F.concat(F.lit("Di "), n, F.lit(", Chair, Board")),
        F.concat(F.lit("Ed "), n, F.lit(" Ii")), F.concat(F.lit("Flo "), n, F.lit(", Ph. D., Interim Chair")), F.lit("N/A (none)"), F.concat(F.lit("Gus "), n, F.lit(", chair")), F.lit(""),
    ]
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(k.alias("id"), F.element_at(F.array(*forms), (k % 9 + 1).cast("int")).alias("v"), F.when(k % 2 == 0, "Old Hall").otherwise("Old House").alias("name"))


@query(f"""SELECT id, CASE m WHEN 0 THEN 'Prof. Ann ' || n WHEN 1 THEN 'the Prof. Bo ' || n || ', Jr.' WHEN 2 THEN 'Dr. Cy ' || n || ', III' WHEN 3 THEN 'Di ' || n WHEN 4 THEN 'Ed ' || n || ' II' WHEN 5 THEN 'Flo ' || n || ', PhD' WHEN 6 THEN 'N/A' WHEN 7 THEN 'Gus ' || n ELSE '' END AS name,
  CASE m WHEN 0 THEN 'Dean' WHEN 1 THEN 'Lead' WHEN 3 THEN 'Chair, Board' WHEN 5 THEN 'Interim Chair' WHEN 6 THEN 'none' WHEN 7 THEN 'chair' ELSE '' END AS role FROM {_NAMES}""")
def names_titles_roles(spark, sf_dir):
    """S-5 S-6 S-9: respelled titles, roles split off, numerals and degrees in one spelling."""
    rows = _names(spark, sf_dir).withColumn("r", T.split_role(T.respelled("v", _TITLES)))
    return rows.select("id", T.name_case("r.name").alias("name"), F.col("r.role").alias("role"))


_PERSON = "CASE m WHEN 0 THEN 'The Prof. Ann ' || n WHEN 1 THEN 'The Prof. Bo ' || n || ', Jr.' WHEN 2 THEN 'Dr. Cy ' || n || ', III' WHEN 3 THEN 'Di ' || n WHEN 4 THEN 'Ed ' || n || ' II' WHEN 5 THEN 'Flo ' || n || ', PhD' WHEN 6 THEN 'N/A (none)' WHEN 7 THEN 'Gus ' || n ELSE '' END"


@query(f"SELECT id, {_PERSON} AS name FROM {_NAMES}")
def person_formatted(spark, sf_dir):
    """S-7: one person with title and article, without role."""
    return _names(spark, sf_dir).select("id", T.name_case(T.format_person("v", _ARTICLE, _TITLES)).alias("name"))


@query(f"SELECT id, CASE m WHEN 6 THEN 'N/A (none); ;Ed X, Aide' WHEN 8 THEN 'Ed X (Aide)' ELSE {_PERSON} || CASE m WHEN 0 THEN ' (Dean)' WHEN 1 THEN ' (Lead)' WHEN 3 THEN ' (Chair, Board)' WHEN 5 THEN ' (Interim Chair)' WHEN 7 THEN ' (chair)' ELSE '' END || '; Ed X (Aide)' END AS items FROM {_NAMES}")
def list_formatted(spark, sf_dir):
    """S-7 X1: people of a list, each with the role in parentheses."""
    return _names(spark, sf_dir).select("id", T.name_case(T.format_people(F.concat("v", F.lit("; ;Ed X, Aide")), _ARTICLE, _TITLES)).alias("items"))


@query(f"SELECT id, CASE WHEN m = 0 THEN CASE WHEN hall THEN '' ELSE 'Dean' END WHEN m = 5 THEN 'Interim Chair' WHEN m = 7 THEN CASE WHEN hall THEN 'Chair' ELSE '' END END AS title FROM {_NAMES}")
def lead_title_tristate(spark, sf_dir):
    """S-8: no role to go by (NULL), the usual title (blank), or another one; flagged names have another usual one."""
    role = T.split_role(T.respelled("v", _TITLES))["role"]
    return _names(spark, sf_dir).select("id", N.lead_title(role, F.col("name"), {"chair": "Chair", "dean": "Dean"}, "Chair", "Hall", "Dean").alias("title"))


@query(r"SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), lambda e: lower(e)))) AS email FROM documents")
def emails_extracted(spark, sf_dir):
    """F23 S-10: distinct addresses of whole texts, in lower case."""
    return N.emails(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Mon-Fri 9:15-11:45 AM ' WHEN 1 THEN '11:00 AM Hymns, Sept-May, ' WHEN 2 THEN 'Sun 8 AM-9 PM; Jun-Aug 555-1234 ' ELSE 'well-known pp. 3 - 4 ' END || p_name AS prose,
  '"it''s" ' || p_name AS quotes, 'mail ' || lower('Info@' || p_brand || '.ORG') || ' now' AS mail FROM (SELECT p_partkey, p_name, regexp_replace(p_brand, '#', '') AS p_brand FROM part)""")
def prose_normalised(spark, sf_dir):
    """S-10: ranges, quotes and addresses in prose."""
    rows = load(spark, sf_dir, "part")
    mail = F.concat(F.lit("mail Info@"), F.regexp_replace("p_brand", "#", ""), F.lit(".ORG now"))
    texts = ["Mon – Fri 9:15–11:45 AM ", "11:00 AM — Hymns, Sept - May, ", "Sun 8 AM – 9 PM; Jun. — Aug 555-1234 ", "well-known pp. 3 - 4 "]
    prose = F.concat(F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 4 + 1).cast("int")), "p_name")
    return rows.select("p_partkey", T.prose_ranges(prose).alias("prose"), T.straight_quotes(F.concat(F.lit("“it’s” "), "p_name")).alias("quotes"), T.lower_emails(mail).alias("mail"))


@query(f"SELECT id, 'phone' AS field, phone AS old, {_FORMAT} AS new FROM {_PHONES} WHERE phone IS NOT NULL AND phone <> {_FORMAT} UNION ALL SELECT id, 'link', 'http://x' || id || '.org/', 'http://x' || id || '.org' FROM {_PHONES}")
def normalise_changelog(spark, sf_dir):
    """Field, old and new for each value that a rule changes."""
    rows = _phones(spark, sf_dir).withColumn("link", F.concat(F.lit("http://x"), F.col("id").cast("string"), F.lit(".org/")))
    return N.change_log(rows, "id", [("phone", T.format_phones), ("link", T.bare_domain)])


@query(f"SELECT floor(lat / 5) AS lat, floor(lon / 5) AS lon, count(*) AS rows, list_sort(list(id)) AS ids FROM {places_sql('customer')} WHERE lat IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def same_coordinates(spark, sf_dir):
    """Places on one spot."""
    rows = places(spark, sf_dir, "customer").withColumns({c: F.floor(F.col(c) / 5).cast("double") for c in ("lat", "lon")})
    return N.same_coordinates(rows, [])


_ADDRESS = "(SELECT c_custkey AS id, c_custkey || ' Main St, Town ' || c_nationkey || ', ' || CASE WHEN c_custkey % 3 = 0 THEN 'TX' ELSE 'TX ' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS address FROM customer)"


def _addresses(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    return load(spark, sf_dir, "customer").select(k.alias("id"), F.concat(s, F.lit(" Main St, Town "), F.col("c_nationkey").cast("string"), F.lit(", "), F.when(k % 3 == 0, "TX").otherwise(F.concat(F.lit("TX "), F.lpad(s, 5, "0")))).alias("address"))


@query(rf"SELECT id FROM {_ADDRESS} WHERE NOT regexp_matches(address, '\b[0-9]{{5}}(?:-[0-9]{{4}})?$')")
def zip_review(spark, sf_dir):
    """S-30 D14: addresses without a postal code."""
    return _addresses(spark, sf_dir).where(~F.col("address").rlike(r"\b[0-9]{5}(?:-[0-9]{4})?$")).select("id")


@query(rf"SELECT id, trim(string_split(address, ',')[-2]) AS city, regexp_extract(trim(string_split(address, ',')[-1]), '^([A-Z]{{2}})\b', 1) AS state, regexp_extract(address, '\b([0-9]{{5}})(?:-[0-9]{{4}})?$', 1) AS zip FROM {_ADDRESS}")
def address_parts(spark, sf_dir):
    """S-14: city, state and postal code."""
    return _addresses(spark, sf_dir).withColumn("p", T.address_parts("address")).select("id", "p.*")


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:\s]+)', 1)), '^www\.', '') AS domain,
  regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '/$', '') AS short,
  lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '[?#].*$', ''), '/+$', ''), '(?i)/(live|streams|featured|videos|home)$', '')) AS channel FROM pages""")
def url_parts(spark, sf_dir):
    """S-23 S-24 S-25: domain, short form and channel key."""
    return load(spark, sf_dir, "pages").select("page_id", T.domain("url").alias("domain"), T.short_url("url").alias("short"), T.channel_key("url").alias("channel"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://www\.') THEN regexp_replace(url, '^(https?://)www\.', '\1') ELSE regexp_replace(url, '^(https?://)', '\1www.') END AS www,
  CASE WHEN starts_with(url, 'https:') THEN regexp_replace(url, '^https:', 'http:') ELSE regexp_replace(url, '^http:', 'https:') END AS scheme FROM pages""")
def url_alternates(spark, sf_dir):
    """S-23 C8: other spellings of a link to try."""
    return load(spark, sf_dir, "pages").withColumn("o", T.other_spellings("url")).select("page_id", F.col("o")[0].alias("www"), F.col("o")[1].alias("scheme"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d %b %Y') END AS label, strftime(o_orderdate, '%A') AS weekday FROM orders")
def date_labels(spark, sf_dir):
    """S-26 S-31: dates and weekdays as shown; other texts as they are."""
    text = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return load(spark, sf_dir, "orders").select("o_orderkey", T.date_label(text).alias("label"), T.weekday_label("o_orderdate").alias("weekday"))


@query("""SELECT p_partkey, '&lt;b&gt;' || replace(replace(p_name, '&', '&amp;'), '''', '&#39;') || ' &amp; &quot;x&quot;' AS html, 'https://x.org/a?place=' || p_partkey || '%26%20b' AS link FROM part""")
def html_and_links(spark, sf_dir):
    """S-28 S-29: escaped text and share links."""
    rows = load(spark, sf_dir, "part")
    return rows.select("p_partkey", T.html_escape(F.concat(F.lit("<b>"), "p_name", F.lit(' & "x"'))).alias("html"), F.replace(T.share_url(F.lit("https://x.org/a?b=1#c"), F.concat(F.col("p_partkey").cast("string"), F.lit("& b"))), F.lit("+"), F.lit("%20")).alias("link"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '''=' || s_name WHEN 1 THEN '''@' || s_name WHEN 2 THEN s_name ELSE '''-1' END AS cell FROM supplier""")
def csv_guard(spark, sf_dir):
    """SK6: cells that a spreadsheet would run."""
    k = F.col("s_suppkey") % 4
    cell = F.when(k == 0, F.concat(F.lit("="), "s_name")).when(k == 1, F.concat(F.lit("@"), "s_name")).when(k == 2, F.col("s_name")).otherwise("-1")
    return load(spark, sf_dir, "supplier").select("s_suppkey", T.csv_guard(cell).alias("cell"))


@query("SELECT s_suppkey, s_suppkey % 7 IN (0, 1, 3, 5) AS match FROM supplier")
def address_match(spark, sf_dir):
    """S-16 U5 J14: same number, and one street's words among the other's."""
    s = F.col("s_suppkey").cast("string")
    others = [F.concat(s, F.lit(" Main Street")), F.concat(s, F.lit(" NORTH main St., suite 4")), F.concat((F.col("s_suppkey") + 1).cast("string"), F.lit(" North Main Street")), F.concat(s, F.lit(" S. Main Ave")), F.lit("PO Box"), F.concat(s, F.lit(" Old Main Road, Waco, TX")), F.concat(s, F.lit(" North Street"))]
    b = F.element_at(F.array(*others), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", T.addresses_match(F.concat(s, F.lit(" North Main Street")), b).alias("match"))


@query("SELECT s_suppkey, s_suppkey % 9 IN (0, 1, 2, 4, 5, 7) AS match FROM supplier")
def person_match(spark, sf_dir):
    """S-17: surnames, hyphenated parts, initials, honorifics, endings."""
    others = ["Jane Doe", "J. Smith-Doe", "jan DOE", "John Doe", "Doe", "Dr. Jane Roe-Doe, Lead", "Jane Smith", "The Quentin Doe Jr.", ""]
    b = F.element_at(F.array(*map(F.lit, others)), (F.col("s_suppkey") % 9 + 1).cast("int"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", T.same_person(F.lit("Jane Q Doe"), b).alias("match"))
