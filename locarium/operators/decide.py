"""Corrections from facts: what to change in which record, and what to report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locarium.functions.predicates import checker_blank
from locarium.functions.text import addresses_match, city_key, domain, person_words, same_person, street_number, surname

from .facts import unique_best


#: Pages that speak of contacts, and mailboxes that are for one purpose only.
CONTACT_PAGES = "^/?$|contact|about|visit|office"
NOT_MAIN_MAILBOX = "financ|giving|give|donat|pledge|treasur|bookkeep|account|music|choir|organ|youth|child|school|preschool|formation|outreach|prayer|webmaster|news|communicat|altar|flower|events"


def path_of(url) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def value_groups(facts: DataFrame) -> DataFrame:
    """A row for each (id, value) of facts (id, value, role, url, evidence, structured, listed, ord): distinct pages,
    whether it is shown site-wide, votes for roles, and its first source. All of it combines before the shuffle."""
    on_contact = (F.col("role") == "main") & path_of("url").rlike(f"(?i){CONTACT_PAGES}")
    counted = facts.groupBy("id", "value").agg(
        F.countDistinct("url").alias("pages"), F.bool_or("structured").alias("structured"), F.bool_or("listed").alias("listed"), F.count_if(F.col("role") == "main").alias("main"), F.count_if(F.col("role") == "lead").alias("lead"),
        F.bool_or(on_contact).alias("contact"), F.min_by(F.struct("url", F.substring("evidence", 1, 300).alias("evidence")), "ord").alias("source"),
    )
    return counted.withColumn("sitewide", (F.col("pages") >= 2) | F.col("structured") | F.col("listed"))


def main_contact(facts: DataFrame, mailbox: bool = False) -> DataFrame:
    """(id, value, source, sitewide): the main number or mailbox (D2). A value that more mentions give to the lead
    doesn't count, nor does a mailbox for one purpose; the best by role and pages must be the only one, and be shown
    site-wide or for the office on a contact page."""
    groups = value_groups(facts).where("lead <= main")
    if mailbox:
        groups = groups.where(~F.substring_index("value", "@", 1).rlike(f"(?i){NOT_MAIN_MAILBOX}"))
    best = unique_best(groups, ["id"], [((F.col("main") > 0) | F.col("structured")).desc(), F.desc("pages")])
    return best.where("sitewide or contact").select("id", "value", "source", "sitewide")


def lead_contact(facts: DataFrame, leads: DataFrame, mailbox: bool = False, boxes: tuple[str, ...] = ("lead", "director")) -> DataFrame:
    """(id, value, source, sitewide): the lead's own number or mailbox (D3): labelled for the lead, and either listed
    or showing the lead's name - a mailbox by surname, by a given name of three letters, or one of ``boxes``; a number by the
    surname as a word of its evidence. ``leads``: id, name. The one on most pages must be the only one."""
    words = person_words("name")
    rows = facts.join(leads.select("id", words.alias("w")).where(F.size("w") > 0), "id")
    last, given = F.element_at("w", -1), F.slice("w", 1, F.size("w") - 1)
    box = F.substring_index("value", "@", 1)
    named = F.contains(box, last) | F.exists(given, lambda g: (F.length(g) >= 3) & F.contains(box, g)) | box.isin(*boxes)
    if not mailbox:
        text = F.concat(F.lit(" "), F.regexp_replace(F.lower("evidence"), "[^a-z'-]+", " "), F.lit(" "))
        named = F.contains(F.regexp_replace(text, "[-']", " "), F.concat(F.lit(" "), F.regexp_replace(last, "[-']", " "), F.lit(" ")))
    good = rows.where((F.col("role") == "lead") & (F.col("listed") | named)).select("id", "value").distinct()
    best = unique_best(value_groups(facts).join(good, ["id", "value"], "left_semi"), ["id"], [F.desc("pages")])
    return best.select("id", "value", "source", "sitewide")


def offers(records: DataFrame, facts: DataFrame, choose, same, avoid: DataFrame | None = None) -> DataFrame:
    """(id, current_value, new_value, action, source_url, evidence) of one field.

    ``records``: id, current_value. ``choose(facts)`` gives the value to offer; that of the site's own facts
    counts, that of all facts (with those of listings) only where the field is blank and the site offers none. A
    current value is replaced only by one that is shown site-wide, and only if the site itself shows the current
    one nowhere. ``same(current, value)`` says whether they are the same; ``avoid`` (id, value) isn't offered.
    """
    own = facts.where("not listed")
    blank = checker_blank("current_value")
    mine = choose(own).select("id", F.struct("value", "source", "sitewide").alias("own"))
    every = choose(facts).select("id", F.struct("value", "source", "sitewide").alias("every"))
    shown = own.join(records, "id").where(same(F.col("current_value"), F.col("value"))).select("id").distinct().withColumn("shown", F.lit(True))
    rows = records.join(mine, "id", "left").join(every, "id", "left").join(shown, "id", "left")
    rows = rows.withColumn("hit", F.coalesce("own", F.when(blank, F.col("every")))).where("hit is not null")
    if avoid is not None:
        rows = rows.join(avoid.select("id", F.col("value").alias("_avoid")).distinct(), (rows["id"] == avoid["id"]) & (F.col("hit.value") == F.col("_avoid")), "left_anti")
    ok = rows.where(blank | (F.col("hit.sitewide") & F.col("shown").isNull()))
    return _changes(ok, F.col("hit.value"), F.col("hit.source"))


def _changes(rows: DataFrame, new, source=None) -> DataFrame:
    """Changes of rows with id and current_value; empty ones and those that change nothing are dropped."""
    action = F.when(checker_blank("current_value"), "add").otherwise("replace").alias("action")
    said = [] if source is None else [source["url"].alias("source_url"), source["evidence"].alias("evidence")]
    return rows.select("id", "current_value", new.alias("new_value"), action, *said).where("new_value <> '' and not new_value <=> current_value")


def not_the_same_contact(changes: DataFrame, field: str, other: str) -> DataFrame:
    """A change of one contact that equals the other's new value is dropped."""
    taken = changes.where(F.col("field") == other).select("id", F.col("new_value").alias("_v")).distinct()
    mine = changes.where(F.col("field") == field)
    kept = mine.join(taken, (mine["id"] == taken["id"]) & (mine["new_value"] == taken["_v"]), "left_anti")
    return changes.where(F.col("field") != field).unionByName(kept)


def lookup_change(records: DataFrame, table: DataFrame, key: str, field: str, same) -> DataFrame:
    """Changes from a table of current holders."""
    rows = records.join(table, key).where(~same(F.col(field), F.col("holder")))
    return rows.select("id", F.lit(field).alias("field"), F.col(field).alias("current_value"), F.col("holder").alias("new_value"))


def moved_sites(records: DataFrame, sites: DataFrame) -> DataFrame:
    """Records whose site answers at another host."""
    host = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"^(?:https?://)?([^/?#:]+)", 1)), r"^www\.", "")
    return records.join(sites, "url").where(host(F.col("works_at")) != host(F.col("url"))).select("id", "url", "works_at")


def ordered_changes(changes: DataFrame) -> DataFrame:
    return changes.orderBy(F.lower("name"), "id", "field")


def ordered_problems(problems: DataFrame, severity: list[str]) -> DataFrame:
    """By severity, then name (O8); others last."""
    place: Column = F.lit(len(severity))
    for k, s in reversed(list(enumerate(severity))):
        place = F.when(F.col("problem") == s, F.lit(k)).otherwise(place)
    return problems.withColumn("severity", place).orderBy("severity", F.lower("name"), "id")


def lead_person(facts: DataFrame, history: str, staff: str) -> DataFrame:
    """(id, name, source) of the lead (D4). ``facts``: id, value (a name), role, url, evidence, listed, ord.

    Pages whose path matches ``history`` don't count. With no strong role, weak ones count if they all have one
    surname. Of these only those of listings, home pages and pages that match ``staff`` stay, and they must have one surname.
    """
    last = surname("value")
    rows = facts.withColumns({"last": last, "path": path_of("url")}).where(~F.col("path").rlike(f"(?i){history}"))
    per = rows.groupBy("id").agg(F.count_if(F.col("role") == "lead").alias("leads"), F.countDistinct(F.when(F.col("role") == "weak", F.col("last"))).alias("weak"))
    rows = rows.join(per, "id").where("role = 'lead' or (leads = 0 and role = 'weak' and weak = 1)")
    rows = rows.where(F.col("listed") | F.col("path").isin("", "/") | F.col("path").rlike(f"(?i){staff}"))
    first = F.min_by(F.struct(F.col("value").alias("name"), F.struct("url", F.substring("evidence", 1, 300).alias("evidence")).alias("source")), "ord")
    return rows.groupBy("id").agg(F.countDistinct("last").alias("n"), first.alias("p")).where("n = 1").select("id", "p.*")


def name_changes(records: DataFrame, facts: DataFrame, history: str, staff: str, titles: str, same=same_person) -> DataFrame:
    """Changes of the lead's name (D6): the site's lead, or for a blank field that of all facts. Not if the current one
    is the same person, or is named anywhere in a strong or weak role. A recorded title (a pattern) stays in front of a name without."""
    mine = lead_person(facts.where("not listed"), history, staff).select("id", F.struct("name", "source").alias("own"))
    every = lead_person(facts, history, staff).select("id", F.struct("name", "source").alias("every"))
    blank = checker_blank("current_value")
    rows = records.join(mine, "id", "left").join(every, "id", "left").withColumn("hit", F.coalesce("own", F.when(blank, F.col("every")))).where("hit is not null")
    named = facts.where(F.col("role").isin("lead", "weak")).join(records, "id").where(same(F.col("current_value"), F.col("value"))).select("id").distinct().withColumn("named", F.lit(True))
    rows = rows.join(named, "id", "left").where(blank | (F.col("named").isNull() & ~same(F.col("current_value"), F.col("hit.name"))))
    title = F.regexp_extract(F.coalesce("current_value", F.lit("")), rf"^((?:{titles}))(?:\s|$)", 1)
    name = F.when((title != "") & (surname("hit.name") != "") & ~F.col("hit.name").rlike(rf"(?i)^(?:the |{titles})"), F.concat_ws(" ", title, "hit.name")).otherwise(F.col("hit.name"))
    return _changes(rows, name, F.col("hit.source"))


def address_changes(records: DataFrame, facts: DataFrame, shown_numbers: DataFrame, codes: dict[str, str]) -> DataFrame:
    """(id, field, current_value, new_value, action, source_url, evidence) of address, city and state.

    ``records``: id, address, city, state. ``facts``: id, value, url, evidence, structured, ord. ``shown_numbers``: id,
    number that the site's pages show; those of addresses that aren't page data are shown anyway. All addresses of a site
    must match the first (one cluster), none of them the current one, whose number is shown nowhere; they stand on two
    pages, or one comes from page data. That one is taken, else the commonest, the first of equals. City and state change
    only with it. ``codes``: state names to codes.
    """
    same_number = ~F.coalesce("structured", F.lit(False)) & (street_number("address") != "") & (street_number("value") == street_number("address"))
    heads = facts.groupBy("id").agg(F.min_by("value", "ord").alias("head"))
    rows = facts.join(heads, "id").join(records.select("id", F.coalesce("address", F.lit("")).alias("address")), "id")
    counted = rows.groupBy("id", "value").agg(F.bool_and(addresses_match("head", "value")).alias("one"), F.bool_or(addresses_match("address", "value") | same_number).alias("shown"), F.count("*").alias("n"), F.min("ord").alias("ord"), F.min_by(F.struct("url", "evidence"), "ord").alias("source"), F.min(F.when(F.col("structured"), F.struct("ord", "value", F.struct("url", "evidence").alias("source")))).alias("data"))
    common = F.max_by(F.struct("value", "source"), F.struct("n", (-F.col("ord")).alias("first")))
    per = counted.groupBy("id").agg(F.bool_and("one").alias("one"), F.bool_or("shown").alias("shown"), F.min("data").alias("data"), common.alias("common"))
    pages = facts.groupBy("id").agg(F.countDistinct("url").alias("pages"))
    per = per.join(pages, "id").where("one and not shown and (data is not null or pages >= 2)")
    per = per.withColumn("best", F.when(F.col("data").isNotNull(), F.struct("data.value", "data.source")).otherwise(F.col("common")))
    number = street_number(F.coalesce("address", F.lit("")))
    rows = records.withColumn("number", number).join(per.select("id", "best"), "id").join(shown_numbers.select("id", F.lower("number").alias("number")).distinct(), ["id", "number"], "left_anti")
    parts = F.transform(F.split("best.value", ","), lambda p: F.trim(p))
    known = F.create_map(*[F.lit(v) for pair in [*codes.items(), *((c.lower(), c) for c in codes.values())] for v in pair])
    code = lambda x: F.coalesce(F.element_at(known, F.lower(F.regexp_replace(F.trim(x), r"^\.|\.$", ""))), F.lit(""))
    city, state = F.when(F.size(parts) >= 3, parts[1]).otherwise(""), F.when(F.size(parts) >= 2, code(F.element_at(parts, -1))).otherwise("")
    moved = [
        F.struct(F.lit("address").alias("field"), F.col("address").alias("current_value"), F.col("best.value").alias("new_value")),
        F.when((city != "") & (city_key(city) != city_key("city")), F.struct(F.lit("city").alias("field"), F.col("city").alias("current_value"), city.alias("new_value"))),
        F.when((state != "") & (state != code(F.coalesce("state", F.lit("")))), F.struct(F.lit("state").alias("field"), F.col("state").alias("current_value"), state.alias("new_value"))),
    ]
    out = rows.select("id", F.explode(F.array_compact(F.array(*moved))).alias("c"), F.col("best.source").alias("source")).select("id", "c.*", "source")
    return out.select("id", "field", "current_value", "new_value", F.when(checker_blank("current_value"), "add").otherwise("replace").alias("action"), "source.url", "source.evidence").withColumnRenamed("url", "source_url").where("new_value <> '' and not new_value <=> current_value")


def channel_changes(records: DataFrame, facts: DataFrame, streaming: DataFrame, key, host: str = "youtube.com") -> DataFrame:
    """Changes that fill a blank channel (D9) by the only one that the site itself links: in a link that speaks of streams,
    or at ``host`` if a page of the site does (``streaming``: id). ``facts``: id, value, role, url, evidence, listed, ord."""
    talks = streaming.select("id").distinct().withColumn("talks", F.lit(True))
    at_host = (domain("value") == host) | F.endswith(domain("value"), F.lit(f".{host}"))
    rows = facts.where("not listed").join(talks, "id", "left").where((F.col("role") == "labelled") | (F.col("talks").isNotNull() & at_host))
    one = rows.groupBy("id").agg(F.countDistinct(key(F.col("value"))).alias("n"), F.min_by(F.struct("value", F.struct("url", "evidence").alias("source")), "ord").alias("f")).where("n = 1")
    return _changes(records.where(checker_blank("current_value")).join(one, "id"), F.col("f.value"), F.col("f.source"))
