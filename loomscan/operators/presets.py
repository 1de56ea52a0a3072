"""Mapping rows compiled to runtime maps, maps read back from templates, templates checked, presets applied, versions cloned.

A map is a table first: every row of a preset, and every rule of a template, gives entries (preset_id, page_type, part, name,
value, at). Entries of one name fold in a partial aggregate, wherever they come from, so a preset on top of the map that a
source already has is a union. Only then do the names that are left of a preset meet in one row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions.html import written_nodes
from loomscan.operators.mapping import publish
from loomscan.operators.selectors import selector_extract
from loomscan.plans.shared import materialize
from loomscan.sources.views import view, with_views

#: Parts of a page type's name and the identifiers of such pages, in the order of trial; those of all others.
IDENTIFIERS = (
    (("event",), ("/events/", "/event/")),
    (("artist", "profile", "person"), ("/artists/", "/people/")),
    (("venue", "gallery", "location"), ("/venues/", "/locations/", "/galleries/")),
    (("exhibition",), ("/exhibitions/",)),
    (("artwork",), ("/artworks/", "/works/")),
    (("listing", "directory"), ("/", "/index", "/list")),
)
OTHER_IDENTIFIERS = ("/",)
#: Parts of a field's name that make its selector one to follow, to page on by, an asset; parts that give an asset its role; modes of assets.
FOLLOWED = ("url", "link", "source_url", "ticket", "website")
PAGED = ("next", "page")
ASSETS = ("image", "avatar", "thumbnail", "hero", "gallery", "logo", "document")
ROLES = (("document", "document"), ("thumbnail", "thumbnail"), ("hero", "hero"), ("avatar", "profile"))
OTHER_ROLE = "gallery"
ASSET_MODES = ("image", "asset")
#: Identifiers and selectors that match nearly anything, and the least length of an identifier.
BROAD_IDENTIFIERS, LEAST_IDENTIFIER = ("/", ".", "/."), 3
BROAD_SELECTORS = ("p", "div", "a")

FIRST_ROW = -(1 << 61)
ENTRY = "struct<part:string,name:string,value:string,k:int>"
#: What row_entries reads of a row.
ROW = ("preset_id", "sort_order", "page_type_key", "page_type_label", "selector", "attribute_name", "extraction_mode", "destination_entity", "destination_field", "category_target", "is_required", "is_enabled")
_LISTS = "array<string>"
TEMPLATE = (
    f"struct<extraction_rules:map<string,struct<css_selectors:map<string,string>,identifiers:{_LISTS}>>,"
    f"page_type_rules:map<string,struct<page_type_label:string,destination_entities:{_LISTS},target_record_types:{_LISTS},required_fields:{_LISTS}>>,"
    f"follow_rules:map<string,struct<selectors:{_LISTS},pagination_selectors:{_LISTS},max_depth:int>>,"
    f"asset_rules:map<string,struct<selectors:{_LISTS},roles:map<string,string>>>,"
    "crawl_plan:struct<phases:array<struct<phase_name:string,base_url:string,url_pattern:string,pagination_type:string,num_pages:int,page_role:string>>>>"
)
_OWN = ("extraction_rules", "page_type_rules", "follow_rules", "asset_rules", "crawl_plan", "record_type_rules", "runtime_map_source", "applied_preset_id", "applied_preset_name")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _filled(c: str, other: Column | str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other) if isinstance(other, str) else other)


def identifiers(page_type: Column) -> Column:
    """The identifiers that pages of a type have by default."""
    low, found = F.lower(page_type), F.lit(None).cast(_LISTS)
    for words, made in reversed(IDENTIFIERS):
        found = F.when(_holds(low, words), _texts(made)).otherwise(found)
    return F.coalesce(found, _texts(OTHER_IDENTIFIERS))


def _entry(part: str, name: Column, value: Column | None = None, k: Column | int = 0) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    return F.struct(F.lit(part).alias("part"), name.alias("name"), (name if value is None else value).cast("string").alias("value"), k.cast("int").alias("k"))


def _listed(part: str, values: Column) -> Column:
    """Entries of a list, null for a null one."""
    return F.transform(values, lambda v, k: _entry(part, v, k=k))


def row_entries(rows: DataFrame) -> DataFrame:
    """Entries of a preset's enabled rows.

    rows: preset_id, sort_order (long), page_type_key, page_type_label, selector, attribute_name, extraction_mode,
    destination_entity, destination_field, category_target, is_required, is_enabled. Null or empty: a page type is unknown, a field
    raw_value, a label the page type; a row without a selector adds to no list of selectors. Orders are above those of templates, which start at -2^62. Other columns are ignored.
    """
    r = rows.where("is_enabled").select(
        "preset_id", F.col("sort_order").cast("long").alias("sort_order"), _filled("page_type_key", "unknown").alias("page_type"), F.nullif("page_type_label", F.lit("")).alias("label"), F.nullif("selector", F.lit("")).alias("sel"),
        _filled("destination_field", "raw_value").alias("field"), F.nullif("destination_entity", F.lit("")).alias("entity"), F.coalesce("is_required", F.lit(False)).alias("need"),
        *[F.lower(_filled(c, "")).alias(c[0]) for c in ("attribute_name", "category_target", "extraction_mode")],
    )
    low, href = F.lower("field"), F.col("a") == "href"
    role = F.lit(OTHER_ROLE)
    for word, name in reversed(ROLES):
        role = F.when(low.contains(word), name).otherwise(role)
    asset = _holds(low, ASSETS) | F.col("e").isin(*ASSET_MODES)
    follow = _holds(low, FOLLOWED) | href | (asset & F.lower("sel").contains("href"))
    has, entity = F.col("sel").isNotNull(), F.col("entity").isNotNull()
    made = F.array(
        _entry("label", F.lit(""), F.coalesce("label", "page_type")), F.when(has, _entry("selector", F.col("field"), F.col("sel"))),
        F.when(entity, _entry("both", F.col("entity"))), F.when(F.col("need"), _entry("required", F.col("field"))),
        F.when(has & follow, _entry("follow", F.col("sel"))), F.when(has & (F.col("c").contains("pagination") | _holds(low, PAGED)), _entry("pagination", F.col("sel"))),
        F.when(has & asset, _entry("asset", F.col("sel"), role)),
    )
    every = F.array_compact(made.cast(f"array<{ENTRY}>"))
    return r.select("preset_id", "page_type", F.col("sort_order").alias("at"), F.explode(every).alias("e")).select("preset_id", "page_type", "e.part", "e.name", "e.value", F.struct("at", "e.k").alias("at"))


def outermost(rows: DataFrame) -> DataFrame:
    """Of a preset's enabled rows (as row_entries takes them) that are alike but for their order, the first and the last: all that page_rules takes of their entries.

    For maps of many rows: alike rows meet before entries are made, in a partial aggregate on whole numbers that needs no sort.
    """
    alike, order = [c for c in ROW if c != "sort_order"], F.col("sort_order").cast("long")
    ends = rows.where("is_enabled").groupBy(*alike, order.isNull().alias("unplaced")).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    return ends.select(*alike, F.explode(F.array_distinct(F.array("first", "last"))).alias("sort_order"))


def template_entries(templates: DataFrame) -> DataFrame:
    """Entries of templates (preset_id, template: JSON text); they come before those of any row. What is no JSON object, or has no such rules, gives none."""
    t = templates.select("preset_id", F.from_json("template", TEMPLATE).alias("t")).where("t is not null")
    none = F.array().cast(f"array<{ENTRY}>")
    keys = F.array_distinct(F.concat(*[F.coalesce(F.map_keys(f"t.{p}"), F.array().cast(_LISTS)) for p in ("extraction_rules", "page_type_rules", "follow_rules", "asset_rules")]))
    t = t.select("preset_id", "t", F.posexplode(keys).alias("place", "page_type"))
    x, p, f, a = (F.try_element_at(f"t.{n}", F.col("page_type")) for n in ("extraction_rules", "page_type_rules", "follow_rules", "asset_rules"))
    selectors = F.filter(F.map_entries(x["css_selectors"]), lambda s: F.trim(s["value"]) != "")
    parts = [
        F.when(p.isNotNull(), F.array(_entry("label", F.lit(""), F.coalesce(p["page_type_label"], "page_type")))), F.transform(selectors, lambda s, k: _entry("selector", s["key"], s["value"], k)), _listed("identifier", x["identifiers"]),
        _listed("entity", p["destination_entities"]), _listed("record_type", p["target_record_types"]), _listed("required", p["required_fields"]), _listed("follow", f["selectors"]), _listed("pagination", f["pagination_selectors"]),
        F.when(f["max_depth"].isNotNull(), F.array(_entry("depth", F.lit(""), f["max_depth"]))), F.transform(a["selectors"], lambda s, k: _entry("asset", s, F.coalesce(F.try_element_at(a["roles"], s), F.lit(OTHER_ROLE)), k)),
    ]
    every = F.filter(F.concat(*[F.coalesce(c.cast(f"array<{ENTRY}>"), none) for c in parts]), lambda e: e["name"].isNotNull())
    at = (F.col("place") - (1 << 62)).alias("at")
    return t.select("preset_id", "page_type", at, F.explode(every).alias("e")).select("preset_id", "page_type", "e.part", "e.name", "e.value", F.struct("at", "e.k").alias("at"))


def page_rules(entries: DataFrame) -> DataFrame:
    """The rules of each page type of a preset, every list in order of first entry.

    Of a field the first selector stands, of a page type the first label and depth, of an asset the last role. Ties of order go by value.
    Columns: preset_id, page_type, at, label (null without one), depth, selectors (field, selector), identifiers, entities, record_types, required, follow, pagination, assets (selector, role).
    """
    one = entries.groupBy("preset_id", "page_type", "part", "name").agg(F.min(F.struct("at", "value")).alias("first"), F.max(F.struct("at", "value"))["value"].alias("last"))
    every = F.array_sort(F.collect_list(F.struct("first.at", "part", "name", "first.value", "last"))).alias("e")
    g = one.groupBy("preset_id", "page_type").agg(F.min("first.at").alias("at"), (F.max("first.at")["at"] > FIRST_ROW).alias("has_rows"), every)
    of = lambda *parts: F.filter("e", lambda e: e["part"].isin(*parts))
    names = lambda *parts: F.array_distinct(F.transform(of(*parts), lambda e: e["name"]))
    only = lambda part: F.get(of(part), 0)["value"]
    by_default = F.when(F.col("has_rows"), identifiers(F.col("page_type"))).otherwise(F.array().cast(_LISTS))
    return g.select(
        "preset_id", "page_type", "at", only("label").alias("label"), F.coalesce(only("depth").cast("int"), F.lit(1)).alias("depth"),
        F.transform(of("selector"), lambda e: F.struct(e["name"].alias("field"), e["value"].alias("selector"))).alias("selectors"),
        F.array_distinct(F.concat(names("identifier"), by_default)).alias("identifiers"), names("entity", "both").alias("entities"), names("record_type", "both").alias("record_types"),
        names("required").alias("required"), names("follow").alias("follow"), names("pagination").alias("pagination"), F.transform(of("asset"), lambda e: F.struct(e["name"].alias("selector"), e["last"].alias("role"))).alias("assets"),
    )


def _by_key(items: Column, key: str, value) -> Column:
    return F.map_from_entries(F.transform(items, lambda x: F.struct(x[key].alias("key"), value(x).alias("value"))))


def phases(page_types: Column, url: Column) -> Column:
    """The root of a source and a phase for each page type by name, but for root_page and unknown; null without a URL."""
    base = F.regexp_replace(url, "/+$", "")

    def phase(name, pattern, paging, n, role):
        return F.struct(name.alias("phase_name"), base.alias("base_url"), pattern.alias("url_pattern"), paging.alias("pagination_type"), n.alias("num_pages"), role.alias("page_role"))

    def named(t):
        plain = F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), "^_+|_+$", "")
        deep = t.contains("detail")
        return phase(F.concat(F.lit("crawl_"), F.coalesce(F.nullif(plain, F.lit("")), F.lit("generic"))), F.get(identifiers(t), 0), F.when(deep, "follow_links").otherwise("none"), F.when(deep, 100).otherwise(25), t)

    root = phase(F.lit("root"), F.lit("/"), F.lit("none"), F.lit(1), F.lit(None).cast("string"))
    rest = F.transform(F.filter(F.array_sort(page_types), lambda t: ~t.isin("root_page", "unknown")), named)
    return F.when(url != "", F.concat(F.array(root), rest))


def runtime_maps(rules: DataFrame, presets: DataFrame) -> DataFrame:
    """(preset_id, runtime_map: JSON text) of page_rules' rows and of presets (preset_id, name, url; page_types, by which phases are made, if it has them, else all; base, a map that was there before, if it has it).

    A preset without rules gets an empty map. The base's other keys stay, and its phases do where the source has no URL. A page type is in page_type_rules if it has a label.
    """
    own = ["at", "page_type", "label", "depth", "selectors", "identifiers", "entities", "record_types", "required", "follow", "pagination", "assets"]
    g = rules.groupBy("preset_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("p"))
    seen = "page_types" if "page_types" in presets.columns else F.transform("p", lambda x: x["page_type"]).alias("page_types")
    base = F.col("base") if "base" in presets.columns else F.lit(None).cast("string")
    empty = F.array().cast(g.schema["p"].dataType)
    g = presets.join(g, "preset_id", "left").withColumn("p", F.coalesce("p", empty)).select("preset_id", "p", F.col("name").alias("preset"), "url", seen, base.alias("base"))
    p = F.col("p")
    types = F.array_distinct(F.flatten(F.transform(p, lambda x: x["record_types"])))
    with_type = lambda t: F.filter(p, lambda x: F.array_contains(x["record_types"], t))
    records = F.map_from_entries(F.transform(types, lambda t: F.struct(t.alias("key"), F.struct(
        F.transform(with_type(t), lambda x: x["page_type"]).alias("page_roles"), F.array_distinct(F.flatten(F.transform(with_type(t), lambda x: F.transform(x["selectors"], lambda s: s["field"])))).alias("fields")).alias("value"))))
    kept = F.from_json("base", TEMPLATE)["crawl_plan"]["phases"]
    none = F.array().cast("array<struct<phase_name:string,base_url:string,url_pattern:string,pagination_type:string,num_pages:int,page_role:string>>")
    whole = F.to_json(F.struct(
        _by_key(p, "page_type", lambda x: F.struct(_by_key(x["selectors"], "field", lambda s: s["selector"]).alias("css_selectors"), x["identifiers"].alias("identifiers"))).alias("extraction_rules"),
        _by_key(F.filter(p, lambda x: x["label"].isNotNull()), "page_type", lambda x: F.struct(x["label"].alias("page_type_label"), x["page_type"].alias("page_role"), x["entities"].alias("destination_entities"), x["record_types"].alias("target_record_types"), x["required"].alias("required_fields"))).alias("page_type_rules"),
        _by_key(p, "page_type", lambda x: F.struct(x["follow"].alias("selectors"), x["pagination"].alias("pagination_selectors"), x["depth"].alias("max_depth"))).alias("follow_rules"),
        _by_key(p, "page_type", lambda x: F.struct(F.transform(x["assets"], lambda a: a["selector"]).alias("selectors"), _by_key(x["assets"], "selector", lambda a: a["role"]).alias("roles"))).alias("asset_rules"),
        F.struct(F.coalesce(phases(F.col("page_types"), F.col("url")), kept, none).alias("phases")).alias("crawl_plan"), records.alias("record_type_rules"),
        F.lit("applied_preset").alias("runtime_map_source"), F.col("preset_id").alias("applied_preset_id"), F.col("preset").alias("applied_preset_name"),
    ))
    other = F.to_json(F.map_filter(F.expr("try_variant_get(try_parse_json(base), '$', 'map<string,variant>')"), lambda k, _: ~k.isin(*_OWN)))
    joined = F.concat(F.substring(other, F.lit(1), F.length(other) - 1), F.lit(","), F.substring(whole, F.lit(2), F.length(whole)))
    return g.select("preset_id", F.when(F.length(other) > 2, joined).otherwise(whole).alias("runtime_map"))


def preset_apply(sources: DataFrame, presets: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, active_preset_id, structure_map) of each source after its chosen preset is laid over the map it had.

    sources: id, url, structure_map (JSON text or null), preset_id (null: none chosen). presets: preset_id, source_id, name. A preset of another
    source, and one without rows, changes nothing; disabled rows count as rows. The source's map comes first: its selectors, labels and depths stand.
    """
    live = sources.join(presets.select("preset_id", "source_id", "name"), (sources["preset_id"] == presets["preset_id"]) & (sources["id"] == presets["source_id"])).select("id", "url", "structure_map", presets["preset_id"], "name")
    live = live.join(rows.select("preset_id").distinct(), "preset_id", "left_semi")
    mine = rows.join(live.select("preset_id"), "preset_id", "left_semi")
    seen = mine.where("is_enabled").groupBy("preset_id").agg(F.collect_set(_filled("page_type_key", "unknown")).alias("page_types"))
    every = row_entries(mine).unionByName(template_entries(live.select("preset_id", F.col("structure_map").alias("template"))))
    head = live.select("preset_id", "name", "url", F.col("structure_map").alias("base")).join(seen, "preset_id", "left").withColumn("page_types", F.coalesce("page_types", F.array().cast(_LISTS)))
    made = runtime_maps(page_rules(every), head)
    done = live.select("id", F.col("preset_id").alias("applied")).join(made.withColumnRenamed("preset_id", "applied"), "applied")
    return sources.select("id", "structure_map").join(done, "id", "left").select("id", F.col("applied").alias("active_preset_id"), F.coalesce("runtime_map", "structure_map").alias("structure_map"))


def template_validate(templates: DataFrame) -> DataFrame:
    """(id, errors, ok, usable, refusals) of templates (id, template: JSON text), rules in order of their names.

    errors are codes, with the page type and field where there is one; ok without any. usable: the map has phases, extraction rules or a
    mining map. refusals: identifiers and selectors that match nearly anything, or are missing; the first is the one to report. Null is no JSON.
    """
    obj = lambda v: F.call_function("try_variant_get", v, F.lit("$"), F.lit("map<string,variant>"))
    arr = lambda v: F.call_function("try_variant_get", v, F.lit("$"), F.lit("array<variant>"))
    text = lambda v: F.call_function("try_variant_get", v, F.lit("$"), F.lit("string"))
    plain = lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")
    none = F.array().cast(_LISTS)
    part = lambda name: F.try_element_at("m", F.lit(name))
    held = lambda v: F.coalesce(F.size(F.map_keys(obj(v))) > 0, F.lit(False))
    some = lambda v: F.coalesce(F.size(arr(v)) > 0, F.lit(False))
    null = lambda v: v.isNull() | F.is_variant_null(v)
    t = templates.select("id", F.try_parse_json("template").alias("v")).withColumn("m", obj(F.col("v")))
    steps = F.try_element_at(obj(part("crawl_plan")), F.lit("phases"))
    rules = F.array_sort(F.map_entries(F.coalesce(obj(part("extraction_rules")), F.expr("cast(map() as map<string,variant>)")).alias("r")), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    whole = [F.when(obj(part("crawl_plan")).isNull(), "missing_crawl_plan").when(~some(steps), "empty_phases"), F.when(~(held(part("extraction_rules")) | held(part("mining_map")) | held(part("page_type_rules"))), "invalid_structure")]
    t = t.withColumn("rules", rules)

    def of_rule(r):
        """Errors of one page type's rule."""
        css = F.try_element_at(obj(r["value"]), F.lit("css_selectors"))
        bad = F.filter(F.map_entries(obj(css)), lambda s: (F.schema_of_variant(s["value"]) != "STRING") | (plain(text(s["value"])) == ""))
        named = F.transform(F.array_sort(F.transform(bad, lambda s: s["key"])), lambda k: F.concat(F.lit("invalid_selector_format:"), r["key"], F.lit("."), k))
        return F.when(obj(r["value"]).isNull(), F.array(F.concat(F.lit("invalid_structure:"), r["key"]))).when(null(css), none).when(obj(css).isNull(), F.array(F.concat(F.lit("invalid_selector_format:"), r["key"]))).otherwise(named)

    def refused(r):
        """What a careful reader refuses in one page type's rule."""
        ids, css = arr(F.try_element_at(obj(r["value"]), F.lit("identifiers"))), F.try_element_at(obj(r["value"]), F.lit("css_selectors"))
        told = F.transform(ids, lambda i: plain(F.coalesce(text(i), F.lit("None"))))
        broad = F.transform(F.filter(told, lambda i: i.isin(*BROAD_IDENTIFIERS) | (F.length(i) < LEAST_IDENTIFIER)), lambda i: F.concat(F.lit("broad_identifier:"), r["key"], F.lit(":"), i))
        pairs = F.array_sort(F.transform(F.map_entries(obj(css)), lambda s: F.struct(s["key"].alias("key"), plain(F.coalesce(text(s["value"]), F.lit("None"))).alias("value"))))
        wide = F.transform(F.filter(pairs, lambda s: (s["value"] == "") | s["value"].isin(*BROAD_SELECTORS) | F.lower(s["value"]).isin(*BROAD_SELECTORS)), lambda s: F.concat(F.when(s["value"] == "", "empty_selector:").otherwise("broad_selector:"), r["key"], F.lit("."), s["key"]))
        first = F.when(~F.coalesce(F.size(ids) > 0, F.lit(False)), F.array(F.concat(F.lit("no_identifiers:"), r["key"]))).otherwise(broad)
        return F.concat(first, F.when(css.isNull(), none).when(obj(css).isNull(), F.array(F.concat(F.lit("selectors_no_object:"), r["key"]))).otherwise(wide))

    errors = F.when(F.col("v").isNull(), F.array(F.lit("invalid_json"))).when(F.col("m").isNull(), F.array(F.lit("invalid_structure"))).otherwise(F.concat(F.array_compact(F.array(*whole)), F.flatten(F.transform("rules", of_rule))))
    refusals = F.when(F.size("rules") == 0, F.array(F.lit("no_rules"))).otherwise(F.flatten(F.transform("rules", refused)))
    return t.select("id", errors.alias("errors"), (some(steps) | held(part("mining_map")) | held(part("extraction_rules"))).alias("usable"), refusals.alias("refusals")).withColumn("ok", F.size("errors") == 0)


def preset_snapshot(rows: DataFrame, statuses: tuple[str, ...] = ("approved",), taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(presets, preset rows) made of versions' rows with one of the statuses (version_id, source_id, name, status and a row's columns).

    presets: preset_id (that of the version), source_id, name, row_count, page_type_count (types that are known). Versions without such rows, and names that the source has already (taken: source_id, name), give none.
    """
    kept = rows.where(F.col("status").isin(*statuses))
    if taken is not None:
        kept = kept.join(taken.select("source_id", "name").distinct(), ["source_id", "name"], "left_anti")
    head = kept.groupBy(F.col("version_id").alias("preset_id"), "source_id", "name").agg(F.count("*").alias("row_count"), F.count_distinct("page_type_key").alias("page_type_count"))
    return head, kept.withColumnRenamed("version_id", "preset_id").drop("status", "source_id", "name")


def clone_to_draft(versions: DataFrame, rows: DataFrame, signals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(drafts, their rows): the active version of each source copied to a draft with the next number.

    versions: version_id, source_id, version_number, state (active: published and in use). rows: version_id and any columns but draft_of; their status becomes
    changed_from_published. signals (source_id, signal_id): only these sources, and the latest signal is noted. Sources without an active version have no draft.
    """
    number = versions.groupBy("source_id").agg((F.max("version_number") + 1).alias("version_number"), F.max(F.when(F.col("state") == "active", F.struct("version_number", "version_id")))["version_id"].alias("draft_of")).where("draft_of is not null")
    note = F.struct(F.lit(True).alias("drift_triggered"), F.col("signal_id").alias("generated_from_signal_id"), F.col("draft_of").alias("based_on_active_mapping_version"))
    if signals is not None:
        number = number.join(signals.groupBy("source_id").agg(F.max("signal_id").alias("signal_id")), "source_id").withColumn("summary", F.to_json(note))
    else:
        number = number.withColumn("summary", F.lit("{}"))
    drafts = number.select("source_id", "version_number", "draft_of", F.lit("draft").alias("state"), "summary")
    copied = rows.withColumnRenamed("version_id", "draft_of").join(drafts.select("draft_of", "source_id", "version_number"), "draft_of").withColumn("status", F.lit("changed_from_published"))
    return drafts, copied


def extraction_table(rules: DataFrame) -> DataFrame:
    """(preset_id, page_type, field, selector): the rules as selectors.selector_extract takes them."""
    return rules.select("preset_id", "page_type", F.explode("selectors").alias("s")).select("preset_id", "page_type", "s.field", "s.selector")


def follow_table(rules: DataFrame) -> DataFrame:
    """(preset_id, page_type, selector, max_depth): the rules as selectors.follow_links takes them."""
    return rules.select("preset_id", "page_type", F.explode("follow").alias("selector"), F.col("depth").alias("max_depth"))


def asset_table(rules: DataFrame) -> DataFrame:
    """(preset_id, page_type, selector, role): the rules as selectors.asset_urls takes them."""
    return rules.select("preset_id", "page_type", F.explode("assets").alias("s")).select("preset_id", "page_type", "s.selector", "s.role")


def _rows(s, d):
    return view(s, d, "mapping_rows_v")


def _dealt(rows: DataFrame) -> DataFrame:
    """Enabled rows, those of a preset together: for many presets of few rows each, which then meet as rows once and not as entries of every level."""
    return rows.where("is_enabled").select(*ROW).repartition("preset_id")


def _presets(s, d):
    return view(s, d, "jobs_v").select(F.col("id").alias("preset_id"), "source_id", F.concat(F.lit("preset "), F.col("id")).alias("name"))


def _owned(s, d):
    """Mapping rows of versions that have a source."""
    return _rows(s, d).withColumnRenamed("preset_id", "version_id").join(_presets(s, d).withColumnRenamed("preset_id", "version_id"), "version_id")


def _versions(s, d):
    """The jobs of a source as its versions: the latest with approved rows is active."""
    v = view(s, d, "jobs_v").select("source_id", F.col("id").alias("version_id"))
    state = publish(v, _rows(s, d).where("status = 'approved'").groupBy(F.col("preset_id").alias("version_id")).agg(F.count("*").alias("approved")))
    return state.withColumn("version_number", F.row_number().over(Window.partitionBy("source_id").orderBy("version_id")))


def _chosen(s, d):
    """Each source with its last preset and, of some, the map it had."""
    last = _presets(s, d).groupBy(F.col("source_id").alias("id")).agg(F.max("preset_id").alias("preset_id"))
    return view(s, d, "sources_v").select("id", "url").join(last, "id", "left").join(view(s, d, "templates_v").select("id", F.col("template").alias("structure_map")), "id", "left")


def _flat(rules):
    pair = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit("="), x[b])), " | ").alias(c)
    return rules.select("preset_id", "page_type", "label", "depth", pair("selectors", "field", "selector"), *[F.array_join(c, " | ").alias(c) for c in ("identifiers", "entities", "required", "follow", "pagination")], pair("assets", "selector", "role"))


def _runtime_extract(s, d):
    """All pages by the rules of all rows as one map; page types are dealt by id."""
    rules = page_rules(row_entries(outermost(_rows(s, d).withColumn("preset_id", F.lit(0)))))
    asked = materialize(extraction_table(rules).drop("preset_id"), "rules")  # read for the steps and for what was asked
    kinds = ("artist_detail", "event_detail", "listing", "root_page", "Venue Page", "artwork_detail", "exhibition", "unknown")
    pages = view(s, d, "pages").withColumn("page_type", F.element_at(_texts(kinds), (F.col("page_id") % 8 + 1).cast("int")))
    return selector_extract(pages, written_nodes(pages, keep=("page_type",)), asked, on=("page_type",))


QUERIES = {
    "runtime_map": lambda s, d: _flat(page_rules(row_entries(_dealt(_rows(s, d))))),
    "template_export": lambda s, d: runtime_maps(page_rules(row_entries(_dealt(_rows(s, d)))), _presets(s, d).withColumn("url", F.concat(F.lit("https://s"), F.col("source_id"), F.lit(".example.com/")))),
    "template_validate": lambda s, d: template_validate(view(s, d, "templates_v")).select("id", "ok", "usable", *[F.array_join(c, ",").alias(c) for c in ("errors", "refusals")]),
    "preset_apply": lambda s, d: preset_apply(_chosen(s, d), _presets(s, d), _rows(s, d)),
    "preset_snapshot": lambda s, d: preset_snapshot(_owned(s, d), taken=_presets(s, d).where("preset_id % 7 = 0"))[0],
    "version_clone": lambda s, d: clone_to_draft(_versions(s, d), _rows(s, d).withColumnRenamed("preset_id", "version_id"))[1].select("source_id", "version_number", "draft_of", "sort_order", "destination_field", "status"),
    "drift_remap": lambda s, d: clone_to_draft(_versions(s, d), _rows(s, d).withColumnRenamed("preset_id", "version_id"), view(s, d, "signals_v").select("source_id", F.col("id").alias("signal_id")))[0],
    "runtime_extract": _runtime_extract,
}

_FIELD = "coalesce(nullif(destination_field, ''), 'raw_value')"
_ENTRIES = f"""b as (select *, coalesce(nullif(page_type_key, ''), 'unknown') as pt, {_FIELD} as f, lower({_FIELD}) as lf, nullif(selector, '') as sel from mapping_rows_v where is_enabled),
c as (select *, regexp_matches(lf, 'image|avatar|thumbnail|hero|gallery|logo|document') or lower(coalesce(extraction_mode, '')) in ('image', 'asset') as asset from b),
e as (select preset_id, pt, 'label' as part, '' as name, coalesce(nullif(page_type_label, ''), pt) as value, sort_order as o from c
union all select preset_id, pt, 'selector', f, sel, sort_order from c where sel is not null
union all select preset_id, pt, 'entity', destination_entity, '', sort_order from c where destination_entity <> ''
union all select preset_id, pt, 'required', f, '', sort_order from c where is_required
union all select preset_id, pt, 'follow', sel, '', sort_order from c where sel is not null and (regexp_matches(lf, 'url|link|source_url|ticket|website') or lower(coalesce(attribute_name, '')) = 'href' or (asset and contains(lower(sel), 'href')))
union all select preset_id, pt, 'pagination', sel, '', sort_order from c where sel is not null and (contains(lower(coalesce(category_target, '')), 'pagination') or regexp_matches(lf, 'next|page'))
union all select preset_id, pt, 'asset', sel, case when contains(lf, 'document') then 'document' when contains(lf, 'thumbnail') then 'thumbnail' when contains(lf, 'hero') then 'hero' when contains(lf, 'avatar') then 'profile' else 'gallery' end, sort_order from c where sel is not null and asset),
g as (select preset_id, pt, part, name, min(o) as o, arg_min(value, o) as first, arg_max(value, o) as last from e group by all)"""


def _agg(part: str, text: str = "name") -> str:
    return f"coalesce(string_agg({text}, ' | ' order by o) filter (part = '{part}'), '')"


_IDS = "case when contains(lower(pt), 'event') then '/events/ | /event/' when regexp_matches(lower(pt), 'artist|profile|person') then '/artists/ | /people/' when regexp_matches(lower(pt), 'venue|gallery|location') then '/venues/ | /locations/ | /galleries/' when contains(lower(pt), 'exhibition') then '/exhibitions/' when contains(lower(pt), 'artwork') then '/artworks/ | /works/' when regexp_matches(lower(pt), 'listing|directory') then '/ | /index | /list' else '/' end"
_CHECKED = """t as (select id, case when json_valid(template) then template::json end as v from templates_v),
m as (select id, v, case when json_type(v) = 'OBJECT' then v end as m from t),
p as (select id, v, m, case when json_type(m->'extraction_rules') = 'OBJECT' then m->'extraction_rules' end as x, coalesce(json_type(m->'crawl_plan') = 'OBJECT', false) as plan,
coalesce(json_array_length((m->'crawl_plan')->'phases') > 0, false) as steps, coalesce(len(json_keys(m->'extraction_rules')) > 0, false) as has_x, coalesce(len(json_keys(m->'mining_map')) > 0, false) as has_m, coalesce(len(json_keys(m->'page_type_rules')) > 0, false) as has_p from m),
r as (select id, key, json_extract(x, '$."' || key || '"') as r from (select id, x, unnest(json_keys(x)) as key from p)),
c as (select id, key, r, r->'css_selectors' as css, r->'identifiers' as ids from r),
s as (select id, key, f, json_extract(css, '$."' || f || '"') as sv from (select id, key, css, unnest(json_keys(css)) as f from c where json_type(css) = 'OBJECT')),
se as (select id, key, string_agg('invalid_selector_format:' || key || '.' || f, ',' order by f) filter (json_type(sv) <> 'VARCHAR' or trim(sv->>'$') = '') as e,
string_agg(case when trim(sv->>'$') = '' then 'empty_selector:' else 'broad_selector:' end || key || '.' || f, ',' order by f) filter (lower(trim(coalesce(sv->>'$', 'None'))) in ('', 'p', 'div', 'a')) as w from s group by all),
ie as (select id, key, string_agg('broad_identifier:' || key || ':' || i, ',' order by n) filter (length(i) < 3) as b from (select id, key, n, trim(coalesce(json_extract(ids, '$[' || n || ']')->>'$', 'None')) as i from (select id, key, ids, unnest(range(json_array_length(ids)::bigint)) as n from c where json_type(ids) = 'ARRAY')) group by all),
q as (select c.id, c.key, case when json_type(r) <> 'OBJECT' then 'invalid_structure:' || c.key when css is null or json_type(css) = 'NULL' then null when json_type(css) <> 'OBJECT' then 'invalid_selector_format:' || c.key else se.e end as e,
concat_ws(',', case when json_array_length(ids) > 0 then ie.b else 'no_identifiers:' || c.key end, case when json_type(css) <> 'OBJECT' then 'selectors_no_object:' || c.key else se.w end) as f
from c left join se on se.id = c.id and se.key = c.key left join ie on ie.id = c.id and ie.key = c.key),
a as (select id, string_agg(e, ',' order by key) as e, string_agg(nullif(f, ''), ',' order by key) as f from q group by 1)"""
_DRAFTS = "a as (select preset_id, count(*) as n from mapping_rows_v where status = 'approved' group by 1), v as (select source_id, id as version_id, row_number() over (partition by source_id order by id) as version_number, n is not null as ok from jobs_v left join a on preset_id = id), d as (select source_id, max(version_number) + 1 as version_number, max(case when ok then version_id end) as draft_of from v group by 1 having draft_of is not null)"

ORACLE = {k: with_views(v) for k, v in {
    "runtime_map": f"with {_ENTRIES} select preset_id, pt as page_type, max(first) filter (part = 'label') as label, 1 as depth, {_agg('selector', "name || '=' || first")} as selectors, {_IDS} as identifiers, {_agg('entity')} as entities, {_agg('required')} as required, {_agg('follow')} as follow, {_agg('pagination')} as pagination, {_agg('asset', "name || '=' || last")} as assets from g group by preset_id, pt",
    "template_validate": f"with {_CHECKED} select p.id, steps or has_m or has_x as usable, case when v is null then 'invalid_json' when m is null then 'invalid_structure' else concat_ws(',', case when not plan then 'missing_crawl_plan' when not steps then 'empty_phases' end, case when not (has_x or has_m or has_p) then 'invalid_structure' end, a.e) end as errors, errors = '' as ok, case when has_x then coalesce(a.f, '') else 'no_rules' end as refusals from p left join a on a.id = p.id",
    "preset_snapshot": "select preset_id, source_id, 'preset ' || preset_id as name, count(*) as row_count, count(distinct page_type_key) as page_type_count from mapping_rows_v join jobs_v on id = preset_id where mapping_rows_v.status = 'approved' and preset_id % 7 <> 0 group by all",
    "version_clone": f"with {_DRAFTS} select source_id, version_number, draft_of, sort_order, destination_field, 'changed_from_published' as status from d join mapping_rows_v on preset_id = draft_of",
    "drift_remap": f"with {_DRAFTS}, g as (select source_id, max(id) as signal_id from signals_v group by 1) select d.source_id, version_number, draft_of, 'draft' as state, '{{\"drift_triggered\":true,\"generated_from_signal_id\":' || signal_id || ',\"based_on_active_mapping_version\":' || draft_of || '}}' as summary from d join g on g.source_id = d.source_id",
}.items()}
