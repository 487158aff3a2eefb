"""Directory queries: facets, keywords, nearest-first lists, tags, details."""

from __future__ import annotations

from pyspark.sql import functions as F

from locarium.functions import predicates as P
from locarium.functions.geo import label_size, parse_coordinates, postal_code
from locarium.operators import facets as O

from .registry import load, miles_sql, places, places_sql, query

_ORIGIN = (38.9, -97.0)
_M = miles_sql(*_ORIGIN)


@query(f"""
WITH p AS (SELECT *, {_M} AS miles FROM {places_sql()} WHERE nation IN (1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23))
SELECT id, name, CASE WHEN miles < 'infinity' THEN round(miles, 3) END AS miles, (SELECT count(*) FROM p) AS total
FROM p ORDER BY p.miles, name, id LIMIT 50""")
def nearest_places(spark, sf_dir):
    """GE1 O1 O3 O10 F1 F9 A1: facet filter, nearest 50 and the full count."""
    rows = O.faceted(places(spark, sf_dir), {"nation": list(range(1, 25, 2)), "name": []})
    out = O.nearest_first(rows, *_ORIGIN, 50)
    return out.select("id", "name", F.when(F.col("miles") < float("inf"), F.round("miles", 3)).alias("miles"), "total")


@query(f"""
WITH p AS (SELECT * FROM {places_sql("customer")} WHERE lat IS NOT NULL AND lon IS NOT NULL), n AS (SELECT * FROM p ORDER BY {_M}, name, id LIMIT 5)
SELECT least(min(lon), {_ORIGIN[1]}) AS west, least(min(lat), {_ORIGIN[0]}) AS south, greatest(max(lon), {_ORIGIN[1]}) AS east, greatest(max(lat), {_ORIGIN[0]}) AS north, count(*) AS points FROM n""")
def nearest_five_bbox(spark, sf_dir):
    """O4 A5 GE14: the box of the origin and its nearest five."""
    return O.bounding_box(places(spark, sf_dir, "customer"), *_ORIGIN, 5)


@query(f"SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS points FROM {places_sql('customer')} WHERE nation IN (2, 4) AND lat IS NOT NULL AND lon IS NOT NULL")
def filtered_bbox(spark, sf_dir):
    """A5 GE14: the box of what the facets leave."""
    return O.bounding_box(O.faceted(places(spark, sf_dir, "customer"), {"nation": [2, 4]}))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def facet_or_and(spark, sf_dir):
    """OR within a facet, AND across; a facet without a choice adds no predicate."""
    return O.faceted(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderkey": []})


@query("SELECT count_if(o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT')) AS listed, count(*) AS total FROM orders")
def facet_counts_of_total(spark, sf_dir):
    """A1: how many of how many."""
    listed = O.any_of("o_orderstatus", ["F", "P"]) & O.any_of("o_orderpriority", ["1-URGENT"])
    return load(spark, sf_dir, "orders").agg(F.count_if(listed).alias("listed"), F.count("*").alias("total"))


@query("SELECT p_partkey, replace(p_name, ' ', '; ') AS answers FROM part WHERE list_has_any(regexp_split_to_array(replace(p_name, ' ', '; '), ';\\s*'), ['1', '2', 'green', 'part', 'blue'])")
def multi_value_match(spark, sf_dir):
    """Any of several answers in one column."""
    rows = load(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("; ")).alias("answers"))
    return O.faceted(rows, {"answers": ["1", "2", "green", "part", "blue"]}, ("answers",))


_OPTIONS = ["Brand#55", "Brand#13", "Brand#99", "Brand#31", "Brand#11", "Brand#1", "Brand#2", "Brand#3"]


@query(f"SELECT CAST(pos AS INTEGER) AS pos, option FROM (SELECT unnest({_OPTIONS}) AS option, unnest(range({len(_OPTIONS)})) AS pos) WHERE option IN (SELECT p_brand FROM part)")
def facet_values_in_use(spark, sf_dir):
    """Listed options that occur, in listed order."""
    return O.options_in_use(load(spark, sf_dir, "part"), "p_brand", _OPTIONS)


@query("SELECT DISTINCT unnest(string_split(p_type, ' ')) AS answer FROM part")
def distinct_answers(spark, sf_dir):
    """Distinct answers of a column with several."""
    return load(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("answer")).distinct()


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'r')")
def keyword_all_words(spark, sf_dir):
    """Every word somewhere in the visible columns."""
    return O.keyword_search(load(spark, sf_dir, "part"), "  Brand#1 R ", ["p_name", "p_brand", "p_type", "p_size"], hidden=("p_size",)).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus = 'F' THEN 'Filled' WHEN o_orderstatus = 'O' THEN 'Open' END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Urgent' WHEN o_orderpriority = '2-HIGH' THEN 'High' END], lambda x: x IS NOT NULL) AS tags FROM orders""")
def card_tags(spark, sf_dir):
    """the first listed label of each field, one at most."""
    tags = O.card_tags({"o_orderstatus": [("F", "Filled"), ("O", "Open")], "o_orderpriority": [("1-URGENT", "Urgent"), ("2-HIGH", "High")]})
    return load(spark, sf_dir, "orders").select("o_orderkey", tags.alias("tags"))


@query(f"""
WITH p AS (SELECT id, name, CASE WHEN key % 5 = 0 THEN 'N/A - none' WHEN key % 5 = 1 THEN '' ELSE 'p' || key END AS phone, CAST(nation AS VARCHAR) AS nation FROM {places_sql("customer")})
SELECT id, CAST(sp AS INTEGER) AS section_pos, section, CAST(fp AS INTEGER) AS field_pos, field, value FROM (
  SELECT id, 0 AS sp, 'Main' AS section, 0 AS fp, 'name' AS field, name AS value FROM p UNION ALL
  SELECT id, 1, 'Contact', 0, 'phone', phone FROM p UNION ALL SELECT id, 1, 'Contact', 1, 'nation', nation FROM p)
WHERE value IS NOT NULL AND trim(value) <> '' AND NOT regexp_matches(value, '^(?i)\\s*n/a\\b')""")
def detail_rows(spark, sf_dir):
    """Ordered sections and fields, without empty and hidden ones."""
    phone = F.when(F.col("key") % 5 == 0, "N/A - none").when(F.col("key") % 5 == 1, "").otherwise(F.concat(F.lit("p"), F.col("key").cast("string")))
    return O.detail_rows(places(spark, sf_dir, "customer").withColumn("phone", phone), {"Main": ["name"], "Contact": ["phone", "nation", "balance"], "Other": ["lat"]}, hidden=("balance", "lat"))


@query("""
WITH c AS (SELECT c_custkey AS id, 'p' || c_custkey AS phone, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'e' || c_custkey END AS email FROM customer),
d AS (SELECT *, CASE WHEN id % 2 = 0 THEN phone || ' | ' || email WHEN id % 3 = 0 THEN phone ELSE 'desk' END AS other FROM c)
SELECT id, CASE WHEN other = CASE WHEN email = '' THEN phone ELSE phone || ' | ' || email END THEN '' ELSE other END AS other,
  CASE WHEN id % 7 = 0 THEN 'Director' WHEN id % 5 = 0 THEN 'Dean' ELSE 'Lead' END AS title FROM d""")
def contact_and_title(spark, sf_dir):
    """A contact that repeats phone and email is blank; the title given, configured, or standard."""
    k = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("p"), k.cast("string")).alias("phone"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("e"), k.cast("string"))).alias("email"))
    both = F.concat_ws(" | ", "phone", "email")
    rows = rows.withColumn("other", F.when(F.col("id") % 2 == 0, both).when(F.col("id") % 3 == 0, F.col("phone")).otherwise(F.lit("desk")))
    title = F.coalesce(F.when(F.col("id") % 7 == 0, "Director"), F.when(F.col("id") % 5 == 0, "Dean"), F.lit("Lead"))
    return rows.select("id", O.not_repeated(F.col("other"), F.col("phone"), F.col("email")).alias("other"), title.alias("title"))


_VARIANTS = "CASE key % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'N/A - closed' WHEN 4 THEN ' n/a' WHEN 5 THEN 'NASA' ELSE name END"


def _variants(spark, sf_dir):
    k = F.col("key") % 7
    v = F.when(k == 0, None).when(k == 1, "").when(k == 2, "  ").when(k == 3, "N/A - closed").when(k == 4, " n/a").when(k == 5, "NASA").otherwise(F.col("name"))
    return places(spark, sf_dir, "customer").withColumn("v", v)


@query(f"""SELECT count_if(v IS NOT NULL AND trim(v) <> '' AND NOT regexp_matches(v, '^(?i)\\s*n/a\\b')) AS shown, count_if(v IS NULL OR lower(trim(v)) IN ('', 'n/a', 'none')) AS checker_blank,
  count_if(v IS NULL OR v = '') AS merge_blank, count_if(coalesce(trim(v), '') = '') AS required_missing FROM (SELECT {_VARIANTS} AS v FROM {places_sql("customer")})""")
def has_value_counts(spark, sf_dir):
    """the four definitions of blank, counted."""
    rows = _variants(spark, sf_dir)
    return rows.agg(*[F.count_if(f("v")).alias(n) for n, f in (("shown", P.has_value), ("checker_blank", P.checker_blank), ("merge_blank", P.merge_blank), ("required_missing", P.required_missing))])


@query(f"SELECT id, v IS NULL OR lower(trim(v)) IN ('', 'n/a', 'none') AS checker, v IS NULL OR v = '' AS merging FROM (SELECT id, {_VARIANTS} AS v FROM {places_sql('customer')})")
def blank_variants(spark, sf_dir):
    """which rows are blank to the checker and to the merge."""
    return _variants(spark, sf_dir).select("id", P.checker_blank("v").alias("checker"), P.merge_blank("v").alias("merging"))


@query(f"SELECT id, name FROM {places_sql()} WHERE id IN ('s1', 's7', 's99999')")
def place_by_id(spark, sf_dir):
    """Rows by id."""
    return places(spark, sf_dir).where(F.col("id").isin("s1", "s7", "s99999")).select("id", "name")


@query("SELECT p_partkey, regexp_matches(p_type, '(?i)\\bsteel\\b') AS flagged FROM part")
def flagged_layers(spark, sf_dir):
    """F8: a word in the name puts a row in another layer."""
    return load(spark, sf_dir, "part").select("p_partkey", P.named_flag("p_type", "steel").alias("flagged"))


@query(f"SELECT id, name FROM {places_sql()} ORDER BY name, id LIMIT 20")
def locale_sort(spark, sf_dir):
    """By name in the Unicode collation, ties by id."""
    return places(spark, sf_dir).orderBy(F.collate("name", "UNICODE"), "id").limit(20).select("id", "name")


@query("""
WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN (c_custkey % 120) || ', ' || (c_custkey % 200) WHEN 1 THEN ' ' || (c_custkey % 90) || '.5,-' || (c_custkey % 180) || '.25 ' WHEN 2 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') WHEN 3 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '-1234' ELSE 'main street' END AS text FROM customer),
n AS (SELECT *, TRY_CAST(regexp_extract(text, '^\\s*([-+]?[0-9]+(?:\\.[0-9]+)?)\\s*,\\s*([-+]?[0-9]+(?:\\.[0-9]+)?)\\s*$', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(text, '^\\s*([-+]?[0-9]+(?:\\.[0-9]+)?)\\s*,\\s*([-+]?[0-9]+(?:\\.[0-9]+)?)\\s*$', 2) AS DOUBLE) AS b FROM t)
SELECT id, CASE WHEN abs(a) <= 90 AND abs(b) <= 180 THEN a END AS lat, CASE WHEN abs(a) <= 90 AND abs(b) <= 180 THEN b END AS lon, regexp_extract(text, '^\\s*([0-9]{5})(?:-[0-9]{4})?\\s*$', 1) AS zip FROM n""")
def origin_parse(spark, sf_dir):
    """GE15 GE16: coordinates or a postal code as typed."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    five = F.lpad(s(k), 5, "0")
    text = F.when(k % 5 == 0, F.concat(s(k % 120), F.lit(", "), s(k % 200))).when(k % 5 == 1, F.concat(F.lit(" "), s(k % 90), F.lit(".5,-"), s(k % 180), F.lit(".25 "))).when(k % 5 == 2, five).when(k % 5 == 3, F.concat(five, F.lit("-1234"))).otherwise(F.lit("main street"))
    rows = load(spark, sf_dir, "customer").select(k.alias("id"), text.alias("text")).withColumn("c", parse_coordinates(F.col("text")))
    return rows.select("id", "c.lat", "c.lon", postal_code(F.col("text")).alias("zip"))


@query("SELECT z AS zoom, CASE WHEN z < 6 THEN true ELSE false END AS hidden, round(13.0 * pow(2.0, least(0.0, z - 6)), 4) AS size FROM (SELECT CAST(r_regionkey AS INTEGER) + 3 AS z FROM region)")
def label_sizes(spark, sf_dir):
    """GE9: label sizes by zoom."""
    z = (F.col("r_regionkey") + 3).cast("int")
    return load(spark, sf_dir, "region").select(z.alias("zoom"), (z < 6).alias("hidden"), F.round(label_size(z), 4).alias("size"))


@query(f"SELECT id, printf('%.1f mi', {_M}) AS said FROM {places_sql()} WHERE lat IS NOT NULL")
def miles_text(spark, sf_dir):
    """F16: miles with one decimal."""
    rows = O.with_miles(places(spark, sf_dir).where(P.has_coordinates()), *_ORIGIN)
    return rows.select("id", F.format_string("%.1f mi", "miles").alias("said"))


#: Ten controls: the field that each is about, and whether it holds several answers.
CONTROLS = {f"pick-{n}": (f"a{n}", n % 3 == 0) for n in range(1, 11)}


@query("SELECT c_custkey FROM customer WHERE c_custkey % 2 IN (1) AND (c_custkey % 4 IN (0, 3) OR c_custkey % 7 IN (0, 3)) AND c_custkey % 11 IN (1, 2, 3, 4, 5)")
def facets_by_control(spark, sf_dir):
    """Ten facets by the names of their controls, some with several answers, most without a choice."""
    k = F.col("c_custkey")
    answers = [F.concat_ws("; ", (k % (n + 1)).cast("string"), (k % 7).cast("string")).alias(f"a{n}") if n % 3 == 0 else (k % (n + 1)).cast("string").alias(f"a{n}") for n in range(1, 11)]
    rows = load(spark, sf_dir, "customer").select(k, *answers)
    chosen = {"pick-1": ["1"], "pick-3": ["0", "3"], "pick-5": [], "pick-10": ["1", "2", "3", "4", "5"]}
    return O.by_controls(rows, CONTROLS, chosen).select("c_custkey")
