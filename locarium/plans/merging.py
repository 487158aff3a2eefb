"""Import queries: validation, merge policies, duplicates, changes, partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from locarium.operators import merge as M

from .registry import load, places, places_sql, query

_FIELDS = ["name", "phone", "note"]
#: Existing rows: a row for each customer; blanks in turn.
_OLD_SQL = """(SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'p' || c_custkey END AS phone,
  CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE '' END AS note FROM customer)"""
#: Two files with a row for each customer under twice and thrice its number; some ids in both, some new.
_NEW_SQL = """(SELECT c_custkey * 2 AS id, 'new ' || c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'q' || c_custkey END AS phone, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'n1' END AS note, 0 AS file_rank, c_custkey AS row_idx FROM customer
  UNION ALL SELECT c_custkey * 3, '', 'r' || c_custkey, 'n2', 1, 100000 - c_custkey FROM customer)"""


def _old(spark, sf_dir):
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 4 != 0, F.concat(F.lit("p"), k.cast("string"))).alias("phone"), F.when(k % 5 == 0, "N/A").otherwise("").alias("note"))


def _new(spark, sf_dir):
    k = F.col("c_custkey")
    customers = load(spark, sf_dir, "customer")
    s = k.cast("string")
    one = customers.select((k * 2).alias("id"), F.concat(F.lit("new "), "c_name").alias("name"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("q"), s)).alias("phone"), F.when(k % 7 != 0, "n1").alias("note"), F.lit(0).alias("file_rank"), k.alias("row_idx"))
    two = customers.select((k * 3).alias("id"), F.lit("").alias("name"), F.concat(F.lit("r"), s).alias("phone"), F.lit("n2").alias("note"), F.lit(1).alias("file_rank"), (F.lit(100000) - k).alias("row_idx"))
    return one.unionByName(two)


_ALL_SQL = f"(SELECT id, name, phone, note, -1 AS file_rank, 0 AS row_idx FROM {_OLD_SQL} UNION ALL SELECT * FROM {_NEW_SQL})"
_FILL = ", ".join(f"coalesce(arg_min({c}, (file_rank, row_idx)) FILTER (WHERE {c} IS NOT NULL AND {c} <> ''), first({c} ORDER BY file_rank, row_idx)) AS {c}" for c in _FIELDS)


@query(f"SELECT id, {_FILL} FROM {_ALL_SQL} GROUP BY id")
def merge_fill(spark, sf_dir):
    """Blanks are filled in order of file and row."""
    return M.merged(_old(spark, sf_dir), _new(spark, sf_dir), _FIELDS, "fill")


@query(f"SELECT id, name, phone, note FROM {_ALL_SQL} QUALIFY row_number() OVER (PARTITION BY id ORDER BY file_rank, row_idx) = 1")
def merge_skip(spark, sf_dir):
    """The first record wins."""
    return M.merged(_old(spark, sf_dir), _new(spark, sf_dir), _FIELDS, "skip")


@query(f"SELECT id, name, phone, note FROM {_ALL_SQL} QUALIFY row_number() OVER (PARTITION BY id ORDER BY file_rank DESC, row_idx DESC) = 1")
def merge_replace(spark, sf_dir):
    """The last record wins, blanks included."""
    return M.merged(_old(spark, sf_dir), _new(spark, sf_dir), _FIELDS, "replace")


_HAD = " OR ".join(f"({c} IS NOT NULL AND {c} <> '' AND NOT coalesce(bool_or({c} IS NOT NULL AND {c} <> '') OVER b, false))" for c in _FIELDS)


@query(f"""
WITH s AS (SELECT *, row_number() OVER w > 1 AS seen, {_HAD} AS fills, (coalesce(name, chr(1)), coalesce(phone, chr(1)), coalesce(note, chr(1))) AS r, lag((coalesce(name, chr(1)), coalesce(phone, chr(1)), coalesce(note, chr(1)))) OVER w AS q
  FROM {_ALL_SQL} WINDOW w AS (PARTITION BY id ORDER BY file_rank, row_idx), b AS (PARTITION BY id ORDER BY file_rank, row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT p, CASE WHEN file_rank < 0 THEN 'old' WHEN NOT seen THEN 'added' WHEN p = 'fill' AND fills THEN 'filled' WHEN p = 'replace' AND r <> q THEN 'replaced' ELSE 'skipped' END AS done FROM s, (VALUES ('fill'), ('skip'), ('replace')) AS v(p))
SELECT p AS policy, count_if(done = 'added') AS added, count_if(done = 'filled') AS filled, count_if(done = 'replaced') AS replaced, count_if(done = 'skipped') AS skipped FROM d GROUP BY p""")
def merge_counters(spark, sf_dir):
    """M4: what each policy does to the incoming records."""
    parts = [M.merge_counters(_old(spark, sf_dir), _new(spark, sf_dir), _FIELDS, p).withColumn("policy", F.lit(p)) for p in ("fill", "skip", "replace")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RAW = """(SELECT CASE WHEN key % 13 = 0 THEN ' ' ELSE id END AS id, CASE WHEN key % 7 = 0 THEN NULL ELSE name END AS name, CASE key % 5 WHEN 0 THEN '"north"' WHEN 1 THEN '"12"' ELSE CAST(lat AS VARCHAR) END AS lat,
  CASE key % 4 WHEN 0 THEN 'true' WHEN 1 THEN '"7"' WHEN 2 THEN '-1.5e3' ELSE CAST(key AS VARCHAR) END AS size, key FROM """ + places_sql() + ")"


def _raw(spark, sf_dir):
    k = F.col("key")
    return places(spark, sf_dir).select(
        F.when(k % 13 == 0, " ").otherwise(F.col("id")).alias("id"), F.when(k % 7 != 0, F.col("name")).alias("name"),
        F.when(k % 5 == 0, '"north"').when(k % 5 == 1, '"12"').otherwise(F.col("lat").cast("string")).alias("lat"), F.when(k % 4 == 0, "true").when(k % 4 == 1, '"7"').when(k % 4 == 2, "-1.5e3").otherwise(k.cast("string")).alias("size"), "key",
    )


@query(f"""SELECT key, list_filter([CASE WHEN key % 13 = 0 THEN 'missing id' END, CASE WHEN key % 7 = 0 THEN 'missing name' END,
  CASE WHEN key % 5 < 2 THEN 'lat is not a number' END, CASE WHEN key % 4 = 1 THEN 'size is not a number' END], lambda x: x IS NOT NULL) AS errors FROM {_RAW}""")
def validate_rows(spark, sf_dir):
    """F11 SK12: the errors of each record, numbers in quotes among them; any error stops an import."""
    return M.validated(_raw(spark, sf_dir), ["id", "name"], ["lat", "size"], flags_ok=("size",)).select("key", "errors")


@query("SELECT 's' || s_suppkey AS id, s_name AS name, '' AS address, NULL::DOUBLE AS lat, '' AS note FROM supplier")
def schema_defaults(spark, sf_dir):
    """F12 SC5: declared fields in declared order; missing ones blank or NULL."""
    rows = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit(1).alias("extra"))
    return M.with_defaults(rows, {"id": "string", "name": "string", "address": "string", "lat": "double", "note": "string"})


@query("WITH k AS (SELECT unnest(json_keys(props)) AS field FROM events) SELECT field, count(*) AS records FROM k WHERE field NOT IN ('k') GROUP BY field UNION ALL SELECT field, count(*) FROM (SELECT unnest(['zz', 'yy']) AS field FROM events WHERE event_id % 3 = 0) GROUP BY field")
def unknown_fields(spark, sf_dir):
    """M6: keys of records that no field declares."""
    events = load(spark, sf_dir, "events").select(F.col("props").alias("json"))
    odd = load(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, '{"zz": 1, "yy": null}').otherwise('{"k": 2}').alias("json"))
    return M.unknown_fields(events.unionByName(odd), ["k"])


@query("SELECT o_custkey AS id, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1 OR o_custkey IS NULL")
def duplicate_ids(spark, sf_dir):
    """M5: ids that occur twice."""
    return M.duplicate_ids(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


#: A change of each order's status (some expect a wrong value), of its priority, of its note (expected to be absent),
#: and of a record that doesn't exist.
_CHANGES = """(SELECT o_orderkey AS id, 'status' AS field, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS current_value, 'Z' AS new_value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, 'none' FROM orders
  UNION ALL SELECT o_orderkey, 'note', NULL, 'added' FROM orders UNION ALL SELECT -1 - o_orderkey, 'note', NULL, 'added' FROM orders)"""


def _records(orders):
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 4 != 0, "n").alias("note"))


def _changes(orders):
    k = F.col("o_orderkey")
    change = lambda i, field, now, new: F.struct(i.alias("id"), F.lit(field).alias("field"), now.alias("current_value"), F.lit(new).alias("new_value"))
    none = F.lit(None).cast("string")
    every = [change(k, "status", F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")), "Z"), change(k, "priority", F.col("o_orderpriority"), "none"), change(k, "note", none, "added"), change(-1 - k, "note", none, "added")]
    return orders.select(F.explode(F.array(*every)).alias("c")).select("c.*")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'Z' END AS status, 'none' AS priority, CASE WHEN o_orderkey % 4 = 0 THEN 'added' ELSE 'n' END AS note FROM orders")
def apply_optimistic(spark, sf_dir):
    """M7: set a field only where it still has the expected value, or is still absent."""
    orders = load(spark, sf_dir, "orders")
    return M.apply_changes(_records(orders), _changes(orders), ["status", "priority", "note"])[0]


@query("""SELECT o_orderkey AS id, 'status' AS field, 'X' AS current_value, 'Z' AS new_value, o_orderstatus AS now, true AS found FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'note', NULL, 'added', 'n', true FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT -1 - o_orderkey, 'note', NULL, 'added', NULL, false FROM orders""")
def apply_failed(spark, sf_dir):
    """M7: changes whose field has another value by now, or whose record isn't there."""
    orders = load(spark, sf_dir, "orders")
    return M.apply_changes(_records(orders), _changes(orders), ["status", "priority", "note"])[1]


def _versions(spark, sf_dir):
    old = load(spark, sf_dir, "supplier").where("s_nationkey <> 4")
    new = old.where("s_nationkey <> 7").withColumn("s_name", F.when((F.col("s_nationkey") % 5 == 0) & (F.col("s_suppkey") % 2 == 0), F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    return old, new.unionByName(load(spark, sf_dir, "supplier").where("s_nationkey = 4"))


@query("""SELECT s_nationkey, CASE WHEN s_nationkey = 4 THEN 'new' ELSE 'changed' END AS change FROM supplier WHERE s_nationkey = 4 OR (s_nationkey % 5 = 0 AND s_suppkey % 2 = 0) GROUP BY ALL""")
def changed_partitions(spark, sf_dir):
    """SK2 SK3 M8 A3: partitions whose content isn't what is stored."""
    return M.changed_partitions(*_versions(spark, sf_dir), ["s_nationkey"], ["s_suppkey", "s_name"]).where("change <> 'orphan'")


@query("SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey = 7")
def orphan_partitions(spark, sf_dir):
    """SK2: stored partitions without rows now."""
    return M.changed_partitions(*_versions(spark, sf_dir), ["s_nationkey"], ["s_suppkey", "s_name"]).where("change = 'orphan'").select("s_nationkey")


@query("SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS state FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey + 5")
def state_names(spark, sf_dir):
    """Codes to names, the code itself where there is none. The code list is fixed and short."""
    codes = load(spark, sf_dir, "nation").select((F.col("n_nationkey") + 5).alias("s_nationkey"), "n_name")
    return load(spark, sf_dir, "supplier").join(codes, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("state"))


@query("SELECT url FROM (SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '[?#].*$', '') FROM pages) GROUP BY url")
def bag_union_distinct(spark, sf_dir):
    """Concatenated inputs, then distinct links."""
    pages = load(spark, sf_dir, "pages")
    return pages.select("url").unionByName(pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url"))).distinct()


@query("SELECT c_nationkey AS site, count(*) AS users, count(DISTINCT c_mktsegment) AS labels FROM customer GROUP BY 1")
def users_per_site(spark, sf_dir):
    """How many records share a site."""
    return load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("site")).agg(F.count("*").alias("users"), F.countDistinct("c_mktsegment").alias("labels"))


@query("SELECT count(*) AS changes, count(DISTINCT id) AS places, count_if(field = 'status') AS status_changes FROM " + _CHANGES)
def run_totals(spark, sf_dir):
    """Totals of a run."""
    return _changes(load(spark, sf_dir, "orders")).agg(F.count("*").alias("changes"), F.countDistinct("id").alias("places"), F.count_if(F.col("field") == "status").alias("status_changes"))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT nullif(o_orderstatus, '')) = 1 THEN max(o_orderstatus) ELSE 'file' END AS label FROM orders GROUP BY 1")
def single_label(spark, sf_dir):
    """The one label of a group, else the file's."""
    rows = load(spark, sf_dir, "orders")
    one = F.countDistinct(F.when(F.col("o_orderstatus") != "", F.col("o_orderstatus"))) == 1
    return rows.groupBy("o_custkey").agg(F.when(one, F.max("o_orderstatus")).otherwise(F.lit("file")).alias("label"))
