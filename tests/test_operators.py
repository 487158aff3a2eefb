import json
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locarium.functions import text as T
from locarium.functions.geo import haversine
from locarium.operators import decide as D
from locarium.operators import extract as E
from locarium.operators import merge as M
from locarium.operators import spatial as S
from locarium.sources import json_sources as J


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_house_style_and_addresses():
    found = lambda t: [a for a, _ in E.find_addresses(t)]
    assert found("Visit us at 12 NORTH MAIN STREET, Waco, Texas 76701. Or 7 Oak Road, Dayton, OH.") == ["12 N Main St, Waco, TX", "7 Oak Rd, Dayton, OH"]
    assert found("On 12 May we met, Waco, TX") == []
    assert found("12 Oak Street, Boston, MA 02110\n12 Oak Court, Austin, TX") == ["12 Oak St, Boston, MA", "12 Oak Ct, Austin, TX"]
    assert found("401 Highway 7 NE, Suite 4, Charleston, West Virginia") == ["401 Hwy 7 NE, Charleston, WV"]
    assert found("Call 843-681-8333 3001 Main St\nHilton Head Island, SC") == ["3001 Main St, Hilton Head Island, SC"]
    assert len(E.STATES) == 51


def test_contact_facts():
    text = "Office: (254) 222-3333\nFax: 254-222-4444\nmail info@Waco.org or pic@2x.png or you@example.com\nDirector Ann Doe\nann@waco.org"
    facts = {(k, v, r) for k, v, r, _ in E.contact_facts(text)}
    assert ("phone", "2542223333", "main") in facts and not any("4444" in v for _, v, _ in facts)
    assert ("email", "info@waco.org", "main") in facts and ("email", "ann@waco.org", "lead") in facts
    assert not any("png" in v or "example" in v for _, v, _ in facts)


def test_nearest_label():
    role = lambda t, at="*": T.nearest_label(t, t.index(at), t.index(at) + 1, {"office": "main", "lead": "lead"}, {"call": "main"})
    assert role("office ........ lead *") == "lead" and role("lead\noffice\n*") == "main"
    assert role("lead\nno label\n*") == ""  # two lines above is too far
    assert role("* lead") == "lead" and role("office" + " " * 141 + "*") == ""
    assert role("call *") == "main" and role("call" + " " * 41 + "*") == ""


def test_normalisers_give_the_stated_forms(spark):
    said = [
        (T.format_phones, "(607) 267-4523/607.746.2826", "(607) 267-4523 / (607) 746-2826"), (T.format_phones, "N/A 254-222-3333", "N/A 254-222-3333"), (T.shown_phones, "N/A 254-222-3333", "N/A (254) 222-3333"), (T.format_phones, "1 254 222 3333, extension 18.", "(254) 222-3333 ext. 18"),
        (T.prose_ranges, "11:00 AM — Hymns", "11:00 AM Hymns"), (T.prose_ranges, "9:15–11:45 AM", "9:15-11:45 AM"), (T.prose_ranges, "Mon – Fri", "Mon-Fri"), (T.prose_ranges, "Sept - May", "Sept-May"), (T.prose_ranges, "a-b, pp. 3 - 4", "a-b, pp. 3 - 4"),
        (T.name_case, "Ann Lee, Iii", "Ann Lee, III"), (T.name_case, "Ann Lee, Ph. D.", "Ann Lee, PhD"), (T.channel_key, "https://www.tube.com/@X/Streams/?a=1", "tube.com/@x"),
    ]
    for f, text, want in said:
        assert one(spark, f(F.lit(text))) == want, text
    r = one(spark, T.split_role(F.lit("Ann Lee, IV, Associate Lead")))
    assert (r["name"], r["role"]) == ("Ann Lee, IV", "Associate Lead")


def test_facts_column(spark):
    rows = spark.createDataFrame([(1, "call (254) 222-3333"), (2, None)], "id int, t string").select("id", F.size(E.facts_column("t")).alias("n")).collect()
    assert {r.id: r.n for r in rows} == {1: 1, 2: 0}


def test_titles_and_lines(spark):
    assert E.recased("HOUSE OF THE SUN") == "House of the Sun" and E.recased("McDonald") == "McDonald"
    lines = ["Director", "Assistant Director", "Former Director", "Ann Mary Doe", "some text"]
    kinds = [r.k for r in spark.createDataFrame([(x,) for x in lines], "l string").select(E.line_kind(F.col("l"), "^Director", "Assistant", "Former").alias("k")).collect()]
    assert kinds == ["lead", "weak", "", "name", "other"]


def test_listing():
    html = '<ul><li class="card"><a class="name" href="/a">Alpha <b>Hall</b></a><span class="tel">1</span></li><li class="card"><p class="name">Beta</p></li></ul>'
    assert E.listing_rows(html, "card", {"name": "name", "tel": "tel"}) == [{"name_link": "/a", "name": "Alpha Hall", "tel": "1"}, {"name": "Beta"}]


def test_decisions(spark):
    schema = "id int, value string, role string, url string, evidence string, structured boolean, listed boolean, ord int"
    fact = lambda i, v, role, path, ev="", n=0, **k: (i, v, role, f"https://x.org/{path}", ev, k.get("structured", False), k.get("listed", False), n)
    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    phones = df(fact(1, "1", "lead", "staff", "Call Lee at"), fact(1, "2", "lead", "staff", "she fell asleep at"), fact(2, "3", "lead", "a", "Lee"), fact(2, "4", "lead", "b", "Lee"))
    leads = spark.createDataFrame([(1, "Bo Lee"), (2, "Bo Lee")], "id int, name string")
    assert [(r.id, r.value) for r in D.lead_contact(phones, leads).collect()] == [(1, "1")]
    boxes = df(fact(1, "music@x.org", "main", "contact"), fact(1, "info@x.org", "main", "contact"), fact(2, "a@x.org", "main", "blog"), fact(3, "b@x.org", "main", "", structured=True))
    assert sorted((r.id, r.value) for r in D.main_contact(boxes, mailbox=True).collect()) == [(1, "info@x.org"), (3, "b@x.org")]
    people = df(fact(1, "Ann Doe", "lead", "blog"), fact(2, "Ann Doe", "lead", "staff"), fact(2, "Bo Roe", "lead", "history"), fact(3, "Cy Poe", "weak", "staff"), fact(4, "Cy Poe", "weak", "staff"), fact(4, "Di Foe", "weak", "blog"))
    assert sorted((r.id, r.name) for r in D.lead_person(people, "history", "staff").collect()) == [(2, "Ann Doe"), (3, "Cy Poe")]
    records = spark.createDataFrame([(2, "Dr. Zed Zoe"), (3, "C. Poe")], "id int, current_value string")
    assert [(r.id, r.new_value) for r in D.name_changes(records, people, "history", "staff", r"Dr\.").collect()] == [(2, "Dr. Ann Doe")]
    other = people.unionByName(df(fact(2, "Zed Zoe", "other", "staff")))
    assert D.name_changes(records, other, "history", "staff", r"Dr\.").count() == 1  # named, but in no such role
    current = spark.createDataFrame([(1, "9"), (2, None)], "id int, current_value string")
    numbers = df(fact(1, "7", "main", "contact"), fact(2, "8", "main", "contact", listed=True))
    assert [(r.id, r.new_value, r.action) for r in D.offers(current, numbers, D.main_contact, lambda a, b: a == b).collect()] == [(2, "8", "add")]


def test_an_address_whose_number_is_shown_stays(spark):
    records = spark.createDataFrame([(k, "12 North Oak Ave, Waco, TX", "Waco", "TX") for k in range(1, 5)], "id int, address string, city string, state string")
    facts = [(1, "12 Elm St, Waco, TX", "a", False, 1), (1, "12 Elm St, Waco, TX", "b", False, 2), (2, "14 Elm St, Waco, TX", "a", False, 1), (2, "14 Elm St, Waco, TX", "b", False, 2), (3, "12 Elm St, Waco, TX", "a", True, 1), (4, "12 Elm St, Waco, TX", "a", True, 1)]
    facts = spark.createDataFrame(facts, "id int, value string, url string, structured boolean, ord int").withColumn("evidence", F.lit("e"))
    shown = spark.createDataFrame([(4, "12")], "id int, number string")
    assert {(r.id, r.field, r.new_value) for r in D.address_changes(records, facts, shown, {}).collect()} == {(2, "address", "14 Elm St, Waco, TX"), (3, "address", "12 Elm St, Waco, TX")}


def test_changes_and_hashes_keep_apart(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "a", None)], "id int, a string, b string")
    changes = spark.createDataFrame([(1, "a", None, "new"), (2, "a", None, "no"), (2, "b", None, "add"), (3, "a", None, "none")], "id int, field string, current_value string, new_value string")
    done, failed = M.apply_changes(rows, changes, ["a", "b"])
    assert sorted((r.id, r.a, r.b) for r in done.collect()) == [(1, "new", "x"), (2, "a", "add")]
    assert sorted((r.id, r.found) for r in failed.collect()) == [(2, True), (3, False)]
    part = lambda *rows: spark.createDataFrame([(k, *r) for k, r in rows], "k string, a string, b string")
    for one_row, other in ((("a|b", "c"), ("a", "b|c")), (("\\N", "c"), (None, "c")), (("ab", ""), ("a", "b")), (("", None), (None, ""))):
        assert [r.change for r in M.changed_partitions(part(("p", one_row)), part(("p", other)), ["k"], ["a", "b"]).collect()] == ["changed"]
    assert M.changed_partitions(part((None, ("x", "y"))), part((None, ("x", "y"))), ["k"], ["a", "b"]).count() == 0


def test_merge_equals_the_loop(spark):
    rng = random.Random(2)
    values = [None, "", "a", "b", "N/A"]
    old = [(str(k), rng.choice(values), rng.choice(values)) for k in range(0, 30, 2)]
    new = [(str(rng.randrange(30)), rng.choice(values), rng.choice(values), n // 40, n) for n in range(120)]
    a = spark.createDataFrame(old, "id string, x string, y string")
    b = spark.createDataFrame(new, "id string, x string, y string, file_rank int, row_idx int")
    for policy in ("fill", "skip", "replace"):
        want = {i: [x, y] for i, x, y in old}
        counted = dict.fromkeys(("added", "filled", "replaced", "skipped"), 0)
        for i, x, y, _, _ in sorted(new, key=lambda r: r[3:]):
            if i not in want:
                want[i] = [x, y]
                counted["added"] += 1
                continue
            was = list(want[i])
            if policy == "fill":
                want[i] = [w if w not in (None, "") else v if v not in (None, "") else w for w, v in zip(was, (x, y))]
            elif policy == "replace":
                want[i] = [x, y]
            changed = want[i] != was
            counted[{"fill": "filled", "replace": "replaced"}.get(policy, "skipped") if changed else "skipped"] += 1
        assert {r.id: [r.x, r.y] for r in M.merged(a, b, ["x", "y"], policy).collect()} == want
        assert M.merge_counters(a, b, ["x", "y"], policy).first().asDict() == counted


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_fold_is_stable(s):
    assert T.fold_text(T.fold_text(s)) == T.fold_text(s)


def test_normalisers_are_stable(spark):
    for f, texts in ((T.format_phones, ["1-254-222-3333 x4", "(254) 222-3333 ext. 4", "N/A 254.222.3333"]), (T.short_url, ["https://www.a.org/"]), (T.straight_quotes, ["“a”"])):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(f("t").alias("a")).withColumn("b", f("a")).collect()
        assert all(r.a == r.b for r in rows)
    assert one(spark, T.format_phones(F.lit("call 1-254-222-3333 x4"))) == "call (254) 222-3333 ext. 4"


def test_haversine_is_symmetric(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([tuple(rng.uniform(-89, 89) for _ in range(4)) for _ in range(200)], "a double, b double, c double, d double")
    assert all(math.isclose(r.x, r.y, rel_tol=1e-9) for r in rows.select(haversine(*map(F.col, "abcd")).alias("x"), haversine(*map(F.col, "cdab")).alias("y")).collect())
    assert one(spark, haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == float("inf")


def boxes_of(spark, n):
    """Unit squares, each 3 degrees east of the one before, as features that an explode makes from a small table."""
    corner = lambda dx, dy: F.struct((F.col("id") * 3 + dx).cast("double").alias("x"), F.lit(float(dy)).alias("y"))
    ring = F.array(*[corner(*p) for p in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return S.segments_of(spark.range(n).select("id", F.array(F.array(ring)).alias("geom")))


def test_near_edges_broadcasts_no_edges(spark):
    points = spark.range(50).select(F.col("id").alias("point"), (F.col("id") * 3 + 1.25).alias("x"), F.lit(0.5).alias("y"))
    found = S.near_edges(points, boxes_of(spark, 50), 0.3)
    assert {(r.point, r.id, round(r.distance, 3)) for r in found.collect()} == {(k, k, 0.25) for k in range(50)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_assigned_broadcasts_no_edges(spark):
    points = spark.range(100).select(F.col("id").alias("point"), (F.floor(F.col("id") / 2) * 3 + F.when(F.col("id") % 2 == 0, 0.5).otherwise(1.25)).alias("x"), F.lit(0.5).alias("y"))
    found = S.assigned(points, boxes_of(spark, 50), 0.3)
    assert {tuple(r) for r in found.collect()} == {(k, k // 2, "edge" if k % 2 else "inside") for k in range(100)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_labels_of_many_polygons_at_once(spark):
    """No call of Python for each polygon, wherever the batches end; holes, ties and long polygons included."""
    ring = lambda *pts: [{"x": float(x), "y": float(y)} for x, y in (*pts, pts[0])]
    holed = [ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((1, 1), (5, 1), (5, 8), (1, 8))]
    steps = [ring(*[(x / 10, 0) for x in range(20)], *[(2, y / 10) for y in range(20)], (2, 2), (0, 2))]
    some = [("holed", [holed]), ("long", [steps, [ring((50, 0), (51, 0), (51, 1))]]), ("ell", [[ring((0, 4), (4, 4), (4, 6), (2, 6), (2, 10), (0, 10))]])]
    segments = S.segments_of(spark.createDataFrame(some, "id string, geom array<array<array<struct<x: double, y: double>>>>"))
    segments = segments.unionByName(boxes_of(spark, 40).withColumn("id", F.col("id").cast("string")))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for n in ("10000", "7", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            df = S.label_points(segments)
            found.append({r.id: (r.x, r.y) for r in df.collect()})
            assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found[0] == found[1] == found[2] and len(found[0]) == 43
    assert all(found[0][str(k)] == (k * 3 + 0.5, 0.5) for k in range(40))
    off = lambda i, x, y: math.hypot(found[0][i][0] - x, found[0][i][1] - y)
    assert off("long", 1, 1) < 0.01 and off("holed", 7, 4.5) < 2.6 and off("ell", 1.17, 5) < 0.3


def test_topology(spark, tmp_path):
    topo = {"type": "Topology", "transform": {"scale": [0.5, 0.5], "translate": [10, 0]}, "arcs": [[[0, 0], [4, 0], [0, 4]], [[4, 4], [-4, 0], [0, -4]]], "objects": {"units": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "id": 7, "arcs": [[0, 1]]}, {"type": "Polygon", "id": 8, "arcs": [[-2, -1]], "properties": {"name": "x"}}]}}}
    (tmp_path / "t.json").write_text(json.dumps(topo))
    shapes = J.read_topojson(spark, str(tmp_path / "t.json"), "units")
    areas = {r.id: r.area for r in S.ring_areas(S.segments_of(shapes)).collect()}
    assert areas == {"7": 4.0, "8": -4.0}
