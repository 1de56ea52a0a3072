"""CSS selectors over page nodes as structural joins, and the extractions that stand on them.

A selector is compiled to steps, rows of a table; all rules' steps meet the nodes in one equi-join on id, class or tag. The
steps are then tied together one by one, on one shuffle by rule and page: nodes are numbered in document order and know the last
number inside them, so their intervals nest or are apart, and a node is inside one of those found so far if the greatest end
among those before it reaches it. Children and siblings are windows on the parent. No pairs are formed.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions import scores as S
from loomscan.functions import urls as U
from loomscan.functions.gestalt import reaches, sequence_ratio
from loomscan.functions.html import TEXT, written_nodes
from loomscan.plans.shared import materialize
from loomscan.sources.views import view

_TOKEN = re.compile(
    r"(?P<then>\s*[>+~,]\s*|\s+)|(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^)]*)\))?"
)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?P<b>[+-]\s*\d+)?|(?P<only>[+-]?\d+))\s*")
_NAMED = {"first-child": ("place", 0, 1), "last-child": ("from_end", 0, 1), "first-of-type": ("of_type", 0, 1), "last-of-type": ("of_type_from_end", 0, 1)}
_COUNTED = {"nth-child": "place", "nth-last-child": "from_end", "nth-of-type": "of_type", "nth-last-of-type": "of_type_from_end"}
STEPS = "array<struct<alt:int,step:int,steps:int,then:string,key:string,tag:string,element_id:string,classes:array<string>,attrs:array<struct<name:string,op:string,value:string>>,nth:array<struct<what:string,a:int,b:int>>>>"


def _nth(arg: str) -> tuple[int, int] | None:
    m = _NTH.fullmatch(arg or "")
    if not m:
        return None
    if m["word"]:
        return 2, int(m["word"] == "odd")
    if m["only"]:
        return 0, int(m["only"])
    return int({"": "1", "+": "1", "-": "-1"}.get(m["a"], m["a"])), int((m["b"] or "0").replace(" ", ""))


def compiled(selector: str | None) -> list[tuple] | None:
    """The steps of a selector list, as rows of STEPS; None for one that is empty, malformed or uses what is not known here."""
    out: list[tuple] = []
    alt, chain, now, then = 0, [], None, ""
    text = (selector or "").strip()
    at = 0

    def blank() -> dict:
        return {"tag": "*", "element_id": None, "classes": [], "attrs": [], "nth": []}

    def close_chain() -> bool:
        nonlocal alt, chain
        if not chain:
            return False
        for k, (how, c) in enumerate(chain):
            key = f"#{c['element_id']}" if c["element_id"] else f".{c['classes'][0]}" if c["classes"] else c["tag"]
            out.append((alt, k, len(chain), how, key, c["tag"], c["element_id"], c["classes"], c["attrs"], c["nth"]))
        alt, chain = alt + 1, []
        return True

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            return None
        at = m.end()
        if m["then"] is not None:
            if now is None:
                return None
            chain.append((then, now))
            now, then = None, m["then"].strip() or " "
            if then == ",":
                close_chain()
                then = ""
            continue
        fresh = now is None
        now = now or blank()
        if m["tag"]:
            if not fresh:
                return None
            now["tag"] = m["tag"].lower()
        elif m["id"]:
            now["element_id"] = m["id"]
        elif m["cls"]:
            now["classes"].append(m["cls"])
        elif m["attr"]:
            value = m["val"] or ""
            now["attrs"].append((m["attr"].lower(), m["op"] or "", value[1:-1] if value[:1] in "\"'" and value else value))
        else:
            name = m["pseudo"].lower()
            rule = _NAMED.get(name) or ((_COUNTED[name], *n) if name in _COUNTED and (n := _nth(m["arg"])) else None)
            if rule is None:
                return None
            now["nth"].append(rule)
    if now is None:
        return None
    chain.append((then, now))
    close_chain()
    return out


def _fits() -> Column:
    """Whether a node (n.*) has all that a step (s.*) asks for."""
    value = lambda a: F.element_at(F.col("n.attrs"), a["name"])
    attr = lambda a: (
        F.when(value(a).isNull(), False).when(a["op"] == "", True).when(a["op"] == "=", value(a) == a["value"]).when(a["op"] == "~=", F.array_contains(F.split(value(a), r"\s+"), a["value"]) & (a["value"] != ""))
        .when(a["op"] == "|=", (value(a) == a["value"]) | F.startswith(value(a), F.concat(a["value"], F.lit("-")))).when(a["value"] == "", False)
        .when(a["op"] == "^=", F.startswith(value(a), a["value"])).when(a["op"] == "$=", F.endswith(value(a), a["value"])).otherwise(F.contains(value(a), a["value"]))
    )
    count = lambda x: F.when(x["what"] == "place", F.col("n.place")).when(x["what"] == "from_end", F.col("n.siblings") - F.col("n.place") + 1).when(x["what"] == "of_type", F.col("n.of_type")).otherwise(F.col("n.alike") - F.col("n.of_type") + 1)
    nth = lambda x: F.when(x["a"] == 0, count(x) == x["b"]).otherwise(((count(x) - x["b"]) * F.signum(x["a"]) >= 0) & (F.pmod(count(x) - x["b"], F.abs(x["a"])) == 0))
    tag = (F.col("s.tag") == "*") | (F.col("s.tag") == F.col("n.tag"))
    return tag & (F.col("s.element_id").isNull() | F.col("n.element_id").eqNullSafe(F.col("s.element_id"))) & (F.size(F.array_except("s.classes", "n.classes")) == 0) & F.forall("s.attrs", attr) & F.forall("s.nth", nth)


def select_nodes(nodes: DataFrame, rules: DataFrame, on: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(on, rule, page_id, node, last, carry): the elements that each rule (rule, selector) selects, once each.

    on: columns that nodes and rules must share, such as a page type; carry: columns of the nodes to return (parent and place aside). Selectors may use tags, #id, .class, attributes with all six comparisons, the nth- pseudo-classes,
    blanks, >, + and ~, and commas; a rule whose selector is none of these selects nothing.
    """
    # written, so that its size is known and decides how it meets the nodes
    steps = materialize(rules.select(*on, "rule", F.explode(F.udf(compiled, STEPS, useArrow=False)("selector")).alias("s")).select(*on, "rule", "s.*"), "steps")
    used = {r["step"]: r["then"] for r in steps.groupBy("step").agg(F.collect_set("then").alias("then")).collect()}  # a row for each place in a selector
    keys = F.concat(F.array("tag", F.lit("*")), F.transform("classes", lambda c: F.concat(F.lit("."), c)), F.when(F.col("element_id").isNotNull(), F.array(F.concat(F.lit("#"), F.col("element_id")))).otherwise(F.array().cast("array<string>")))
    n = nodes.where(F.col("tag") != TEXT).withColumn("key", F.explode(F.array_distinct(keys))).alias("n")
    meet = functools.reduce(Column.__and__, [F.col(f"n.{c}") == F.col(f"s.{c}") for c in (*on, "key")])
    rows = n.join(steps.alias("s"), meet).where(_fits()).select(*[F.col(f"n.{c}") for c in on], "s.rule", "s.alt", "s.step", "s.steps", "s.then", "n.page_id", "n.node", "n.last", F.coalesce("n.parent", F.lit(-1)).alias("parent"), "n.place", *[F.col(f"n.{c}").alias(f"_{c}") for c in carry])
    chain = [*on, "rule", "alt", "page_id"]
    if len(used) > 1:
        rows = rows.repartition(*chain)  # all windows below stand on this one shuffle
    for k in range(1, len(used)):
        before, then, holds = F.col("step") == k - 1, F.col("then"), F.lit(False)
        if " " in used[k]:
            w = Window.partitionBy(*chain).orderBy("node", F.when(before, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumn("_reach", F.max(F.when(before, F.col("last"))).over(w))
            holds |= (then == " ") & (F.col("_reach") >= F.col("node"))
        if ">" in used[k]:
            rows = rows.withColumn("_up", F.when(before, F.col("node")).otherwise(F.col("parent")))
            rows = rows.withColumn("_child", F.max(before).over(Window.partitionBy(*chain, "_up")))
            holds |= (then == ">") & F.col("_child")
        if {"+", "~"} & set(used[k]):
            w = Window.partitionBy(*chain, "parent").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumn("_prior", F.max(F.when(before, F.col("place"))).over(w))
            holds |= ((then == "+") & (F.col("_prior") == F.col("place") - 1)) | ((then == "~") & F.col("_prior").isNotNull())
        # rows of this step stay where they are tied to the step before, whose rows then go unless they end their selector
        rows = rows.where(F.when(F.col("step") == k, F.coalesce(holds, F.lit(False))).otherwise(~before | (F.col("steps") == k))).drop("_reach", "_up", "_child", "_prior")
    ends = rows.where("step = steps - 1").select(*on, "rule", "page_id", "node", "last", *[F.col(f"_{c}").alias(c) for c in carry])
    return ends.dropDuplicates([*on, "rule", "page_id", "node"])  # alternatives of a rule may select one element


def page_texts(nodes: DataFrame) -> DataFrame:
    """(page_id, texts): all texts of a page (at, piece) in document order; pages without any are left out."""
    return nodes.where(F.col("tag") == TEXT).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), F.col("text").alias("piece")))).alias("texts"))


def with_text(hits: DataFrame, nodes: DataFrame, joined: str = " ") -> DataFrame:
    """hits (page_id, node, last and more) with text: all texts inside, in order; empty without any."""
    inside = F.filter("texts", lambda x: x["at"].between(F.col("node"), F.col("last")))
    text = F.array_join(F.transform(inside, lambda x: x["piece"]), joined)
    return hits.join(page_texts(nodes), "page_id", "left").withColumn("text", F.coalesce(text, F.lit(""))).drop("texts")


SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def field_value(field: Column, tag: Column, attrs: Column, text: Column, base: Column) -> Column:
    """What a field takes from an element: an address of mail, a URL from its attributes, or its text; null if there is nothing.

    The attribute is chosen first and made absolute once, as that is a large expression.
    """
    f, content = F.lower(F.trim(field)), F.nullif(F.trim(text), F.lit(""))
    email, image = F.contains(f, F.lit("email")), f.rlike("avatar|image|photo|logo")
    url = f.endswith("_url") | f.rlike("website|canonical|link")
    held = F.when(email, F.array(F.lit("href"))).when(tag == "meta", F.array(*map(F.lit, ("content", "href", "src")))).when(tag == "link", F.array(*map(F.lit, ("href", "content"))))
    held = held.when((tag == "img") | image, F.array(*map(F.lit, ("src", "data-src", "data-original", "href")))).otherwise(F.array(*map(F.lit, ("href", "src", "content"))))
    usable = lambda v: (v != "") & ~v.startswith("#") & ~F.lower(v).startswith("javascript:") & (base.isNotNull() | v.rlike(SCHEME))
    raw = F.get(F.filter(F.transform(held, lambda n: F.trim(F.element_at(attrs, n))), usable), 0)
    taken = F.when(raw.rlike(SCHEME), raw).otherwise(U.resolve(base, raw))
    href = F.nullif(F.trim(F.element_at(attrs, "href")), F.lit(""))
    plain = F.when(email, F.coalesce(U.normalize_email(content), content)).otherwise(content)
    return F.when((email & href.isNotNull()) | (~email & (image | url)), F.coalesce(F.when(email, U.normalize_email(href)), taken, F.when(~email, content))).otherwise(plain)


def values_of(pages: DataFrame, nodes: DataFrame, rules: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, field, values): what the rules (field, selector) select on each page (page_id, url), in document order; fields without a value are left out."""
    full = with_text(select_nodes(nodes, rules.withColumnRenamed("field", "rule"), on, ("tag", "attrs")), nodes).join(pages.select("page_id", "url"), "page_id")
    told = full.select("page_id", F.col("rule").alias("field"), "node", field_value(F.col("rule"), F.col("tag"), F.col("attrs"), F.col("text"), F.col("url")).alias("value"))
    held = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("node", "value")))  # a filter on the value would compute it twice
    return told.groupBy("page_id", "field").agg(F.transform(F.array_sort(held), lambda x: x["value"]).alias("values")).where(F.size("values") > 0)


def selector_extract(pages: DataFrame, nodes: DataFrame, rules: DataFrame, patterns: tuple[tuple[str, str], ...] = (), on: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, data, confidence) of each page: values by field, one or a list, as JSON; 100 less 10 for each field of its rules, and each pattern, that gives nothing.

    patterns (field, regular expression) are searched in the whole text of the page, case aside; the first group is the value, or all that matches where there is none.
    """
    whole = page_texts(nodes).select("page_id", F.array_join(F.transform("texts", lambda x: x["piece"]), "\n").alias("whole"))
    rows = pages.select("page_id", *on).join(whole, "page_id", "left")
    for k, (_, p) in enumerate(patterns):
        group = int(re.compile(p).groups > 0)
        rows = rows.withColumn(f"p{k}", F.when(F.col("whole").rlike(f"(?i){p}"), F.regexp_extract("whole", f"(?i){p}", group)))
    found = values_of(pages, nodes, rules, on).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("field", "values"))).alias("found"))
    asked = rules.groupBy(*on).agg(F.count_distinct("field").alias("asked")) if on else rules.agg(F.count_distinct("field").alias("asked"))
    rows = rows.join(found, "page_id", "left").join(asked, list(on), "left") if on else rows.join(found, "page_id", "left").crossJoin(F.broadcast(asked))  # one row
    extra = F.array_compact(F.array(*[F.when(F.col(f"p{k}").isNotNull(), F.struct(F.lit(f).alias("field"), F.array(f"p{k}").alias("values"))) for k, (f, _) in enumerate(patterns)])) if patterns else F.array()
    every = F.concat(F.coalesce("found", F.array().cast("array<struct<field:string,values:array<string>>>")), extra.cast("array<struct<field:string,values:array<string>>>"))
    pair = lambda x: F.concat(_json(x["field"]), F.lit(":"), F.when(F.size(x["values"]) == 1, _json(F.get(x["values"], 0))).otherwise(_json(x["values"])))
    data = F.concat(F.lit("{"), F.array_join(F.transform(every, pair), ","), F.lit("}"))
    miss = F.coalesce("asked", F.lit(0)) + len(patterns) - F.size(every)
    return rows.select("page_id", data.alias("data"), F.greatest(F.lit(0), 100 - 10 * miss).cast("int").alias("confidence"))


def _json(value: Column) -> Column:
    """A string or list as JSON text."""
    whole = F.to_json(F.struct(value.alias("v")))  # {"v":...}
    return F.substring(whole, 6, 1 << 30).substr(F.lit(1), F.length(whole) - 6)


def follow_links(pages: DataFrame, nodes: DataFrame, rules: DataFrame, seen: DataFrame | None = None, default: tuple[str, ...] = ("_Navigation", "unknown")) -> DataFrame:
    """(page_id, target, depth): the links that a page's type lets it follow, on its own host and port, once each, one deeper than the page; none from the type's max_depth on.

    pages: page_id, url, page_type, depth. rules: page_type, selector, max_depth. Pages of the default types without rules follow links of nav, main, then any. seen (target) is left out.
    """
    spark = pages.sparkSession
    plain = spark.createDataFrame([(t, s) for t in default for s in ("nav a[href]", "main a[href]", "a[href]")], "page_type string, selector string").join(rules.select("page_type").distinct(), "page_type", "left_anti")
    every = rules.select("page_type", "selector").unionByName(plain).withColumn("rule", F.col("selector"))
    open_pages = pages.join(rules.groupBy("page_type").agg(F.max("max_depth").alias("max_depth")), "page_type", "left").where(F.col("depth") < F.coalesce("max_depth", F.lit(1)))
    typed = nodes.join(open_pages.select("page_id", "page_type"), "page_id")
    href = select_nodes(typed, every, ("page_type",), ("attrs",)).select("page_id", F.trim(F.element_at("attrs", "href")).alias("href")).where("href <> '' and not startswith(href, '#') and not startswith(href, 'javascript:')")
    place = lambda u: F.regexp_extract(u, "^[A-Za-z]+://([^/?#]*)", 1)
    out = href.join(pages.select("page_id", "url", "depth"), "page_id").withColumn("target", U.resolve(F.col("url"), F.col("href"))).where(place(F.col("target")) == place(F.col("url")))
    out = out.select("page_id", "target", (F.col("depth") + 1).alias("depth")).distinct()
    return out.join(seen.select("target"), "target", "left_anti").select("page_id", "target", "depth") if seen is not None else out


def asset_urls(pages: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, asset): of what the page type's rules (page_type, selector) select, the first of src, data-src and href that holds no data, absolute and without fragment, once a page."""
    typed = nodes.join(pages.select("page_id", "page_type"), "page_id")
    full = select_nodes(typed, rules.withColumn("rule", F.col("selector")), ("page_type",), ("attrs",)).join(pages.select("page_id", "url"), "page_id")
    at = lambda n: F.when(~F.trim(F.element_at("attrs", n)).startswith("data:"), F.nullif(F.trim(F.element_at("attrs", n)), F.lit("")))
    value = F.coalesce(at("src"), at("data-src"), at("href"))
    asset = F.when(value.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.regexp_replace(value, "#.*$", "")).otherwise(U.resolve(F.col("url"), value))
    return full.select("page_id", asset.alias("asset")).where("asset is not null").distinct()


#: The blocks of a page that may be items, the least length of their text, and of an item's; for each kind of page what an item is, what holds its title, and how much text stands for a missing one.
BLOCKS, LEAST_BLOCK, LEAST_ITEM = ("li", "article", "p"), 8, 12
ITEMS = {"artist_exhibitions": ("exhibition", ("strong", "b", "h3", "h4"), None), "artist_articles": ("article", ("strong", "b", "h3", "h4", "a"), 160), "artist_press": ("press", ("strong", "b", "h3", "h4", "a"), 160), "artist_memories": ("memory", (), 120)}
#: Dates in the text of an item.
DATES = r"\b(?:\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}|\d{4})\b"


def related_items(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """The items of pages (page_id, url, page_type) whose type lists some: kind, raw_text, title, dates, years, link and fingerprint, by block.

    A title is the whole text of the first element inside that may hold one, else the text's beginning: up to a comma for exhibitions, where it is cut at 160 characters.
    """
    typed = pages.where(F.col("page_type").isin(*ITEMS)).select("page_id", "url", "page_type")
    own = nodes.join(typed.select("page_id"), "page_id", "left_semi")
    blocks = with_text(own.where(F.col("tag").isin(*BLOCKS)).select("page_id", "node", "last"), own).where(F.length("text") >= LEAST_ITEM).join(typed, "page_id")
    inner = own.where(F.col("tag").isin("strong", "b", "h3", "h4", "a")).select("page_id", F.col("node").alias("at"), F.col("last").alias("end"), F.col("tag").alias("inner"), F.element_at("attrs", "href").alias("href"))
    pairs = blocks.select("page_id", "node", "last", "page_type").join(inner, "page_id").where("at > node and at <= last")
    may = functools.reduce(Column.__or__, [(F.col("page_type") == t) & F.col("inner").isin(*tags) for t, (_, tags, _) in ITEMS.items() if tags])
    first = pairs.groupBy("page_id", "node").agg(F.min(F.when(may, F.struct("at", "end"))).alias("head"), F.min(F.when(F.col("inner") == "a", F.struct("at", "href"))).alias("a"), F.min(F.when((F.col("inner") == "a") & F.col("href").isNotNull(), F.struct("at", "href"))).alias("link"))
    heads = with_text(first.where("head is not null").select("page_id", F.col("head.at").alias("node"), F.col("head.end").alias("last")).distinct(), own).select("page_id", F.col("node").alias("head_at"), F.col("text").alias("headline"))
    full = blocks.join(first, ["page_id", "node"], "left").withColumn("head_at", F.col("head.at")).join(heads, ["page_id", "head_at"], "left")
    raw = F.col("text")
    dates = F.regexp_extract_all(raw, F.lit(f"({DATES})"), F.lit(1))
    when = F.nullif(F.array_join(F.slice(dates, 1, 2), " - "), F.lit(""))
    year = F.nullif(F.regexp_extract(when, "(19[0-9]{2}|20[0-9]{2})", 1), F.lit(""))
    years = S.year_range(raw)
    by = lambda k: functools.reduce(lambda w, x: w.when(F.col("page_type") == x[0], x[1][k]), ITEMS.items(), F.when(F.lit(False), None))
    begin = F.when(F.col("page_type") == "artist_exhibitions", F.substring(F.split(raw, ",")[0], 1, 160)).when(F.col("page_type") == "artist_memories", F.substring(raw, 1, 120)).otherwise(F.substring(raw, 1, 160))
    shows, dated = F.col("page_type") == "artist_exhibitions", F.col("page_type").isin("artist_articles", "artist_press")
    return full.select(
        "page_id", "node", by(0).alias("kind"), raw.alias("raw_text"), F.coalesce("headline", begin).alias("title"), F.when(shows, when).alias("date_text"), F.when(shows, years[0]).alias("year_start"), F.when(shows, years[1]).alias("year_end"),
        F.when(shows & F.contains(F.lower(raw), F.lit("solo")), "solo").alias("solo_or_group"), F.when(dated & year.isNotNull(), F.concat(year, F.lit("-01-01"))).alias("publication_date"),
        F.when(dated, U.resolve(F.col("url"), F.col("link.href"))).alias("link"), F.sha1(F.concat_ws("|", "url", raw)).alias("fingerprint"),
    )


#: Hosts and file types of images that show nothing, the least side of one, and where its address may stand.
TRACKERS = ("google-analytics.com", "googletagmanager.com", "facebook.com", "doubleclick.net", "analytics.", "pixel.")
NO_IMAGES = ("svg", "ico", "gif")
LEAST_SIDE = 100
IMAGE_ATTRS = ("src", "data-src", "data-lazy-src", "data-original")


def extract_images(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, src, alt, width, height, context, occurrences, role, confidence, reason): every image address of a page once, by its first place, with the text of what it stands in.

    Left out are data in place of an address, trackers, drawings and icons by their ending, and images that say both sides and have one under 100. occurrences counts the page's tags with that address.
    """
    images = nodes.where("tag = 'img'").join(pages.select("page_id", "url"), "page_id")
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.trim(F.element_at("attrs", a)).alias("raw")) for k, a in enumerate(IMAGE_ATTRS)])
    side = lambda a: F.nullif(F.nullif(F.regexp_replace(F.element_at("attrs", a), "[^0-9]", ""), F.lit("")).try_cast("int"), F.lit(0))
    rows = images.select("page_id", "url", "node", "parent", "classes", F.coalesce(F.element_at("attrs", "alt"), F.lit("")).alias("alt"), side("width").alias("width"), side("height").alias("height"), F.explode(places).alias("p"))
    rows = rows.where("p.raw <> '' and not startswith(p.raw, 'data:')").withColumn("src", F.when(F.col("p.raw").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("p.raw")).otherwise(U.resolve(F.col("url"), F.col("p.raw"))))
    small = F.coalesce((F.col("width") < LEAST_SIDE) | (F.col("height") < LEAST_SIDE), F.lit(False)) & F.col("width").isNotNull() & F.col("height").isNotNull()
    ending = F.lower(F.regexp_extract("src", r"\.([^.]*)$", 1))
    one = rows.where(~small).groupBy("page_id", "src").agg(F.min(F.struct("node", "p.k", "parent", "alt", "width", "height", "classes")).alias("i"), F.count_distinct("node").cast("int").alias("occurrences"))
    # written, as it is read twice and as filters on an address, which only then follow, would compute it anew for each
    first = materialize(one, "images").where(F.col("src").isNotNull() & ~U.holds(U.host(F.col("src")), TRACKERS) & ~ending.isin(*NO_IMAGES))
    around = nodes.select("page_id", F.col("node").alias("parent"), "last")
    flat = first.select("page_id", "src", "occurrences", "i.*")
    context = with_text(flat.select("page_id", "parent").distinct().join(around, ["page_id", "parent"]).select("page_id", F.col("parent").alias("node"), "last"), nodes, "").select("page_id", F.col("node").alias("parent"), F.col("text").alias("context"))
    full = flat.join(context, ["page_id", "parent"], "left").withColumn("context", F.coalesce("context", F.lit("")))
    role = S.image_role(F.col("src"), F.col("alt"), F.col("context"), F.array_join("classes", " "), F.col("occurrences"))
    return full.withColumn("r", role).select("page_id", "src", "alt", "width", "height", "context", "occurrences", "r.*")


def relaxed(selector: str) -> list[str]:
    """Looser forms of a selector: without its first parent, its last part alone, its tag alone, its first class alone."""
    parts = [p.strip() for p in selector.split(">") if p.strip()]
    out = [" > ".join(parts[1:]), parts[-1]] if len(parts) > 1 else []
    bare = selector.strip()
    if "." in bare and not bare.startswith("."):
        tag, _, rest = selector.partition(".")
        out += ([tag] if tag else []) + ([f".{rest.split('.')[0]}"] if rest else [])
    elif bare.count(".") > 1:
        out.append("." + bare.strip(".").split(".")[0])
    return out


def selector_candidates(nodes: DataFrame, expected: DataFrame, old: dict[str, str] | None = None, least: float = 0.6, few: int = 3) -> DataFrame:
    """(field, selector, confidence, strategy, hits): selectors that may find a field again, best confidence of each.

    expected (page_id, field, expected): what stood in the field. Texts of a page whose ratio to it, case aside, reaches `least` count for their element's tag and for each of its classes; the
    few commonest of either are candidates, more certain the more of the field's pages they have. Beside them: the old selector's looser forms, and one by the field's name.
    """
    old = old or {}
    wanted = expected.where("trim(expected) <> ''").select("page_id", "field", F.lower(F.trim("expected")).alias("expected"))
    texts = nodes.where(F.col("tag") == TEXT).select("page_id", "parent", F.lower("text").alias("value"))
    near = texts.join(wanted, "page_id").where(reaches(F.col("value"), F.col("expected"), least)).where(sequence_ratio(F.col("expected"), F.col("value")) >= least)
    hit = near.join(nodes.select("page_id", F.col("node").alias("parent"), "tag", "classes"), ["page_id", "parent"])
    named = F.concat(F.array(F.struct(F.lit("tag_frequency").alias("strategy"), F.col("tag").alias("selector"))), F.transform("classes", lambda c: F.struct(F.lit("class_frequency").alias("strategy"), F.concat(F.lit("."), c).alias("selector"))))
    count = hit.select("field", F.explode(named).alias("c")).groupBy("field", "c.strategy", "c.selector").agg(F.count("*").alias("hits"))
    place = F.row_number().over(Window.partitionBy("field", "strategy").orderBy(F.desc("hits"), "selector"))
    best = count.withColumn("place", place).where(F.col("place") <= few).join(expected.groupBy("field").agg(F.count_distinct("page_id").alias("pages")), "field")
    rate = F.col("hits") / F.greatest("pages", F.lit(1))
    told = best.select("field", "selector", F.when(F.col("strategy") == "tag_frequency", F.least(F.lit(0.75), 0.5 + 0.2 * rate)).otherwise(F.least(F.lit(0.8), 0.55 + 0.25 * rate)).alias("confidence"), "strategy", "hits")
    looser = [(f, r, 0.65, "relax_existing_selector", None) for f, s in old.items() for r in relaxed(s)]
    fields = expected.select("field").distinct()
    fallback = fields.select("field", F.concat(F.lit("[data-field*='"), "field", F.lit("'], ."), "field", F.lit(", [class*='"), "field", F.lit("']")).alias("selector"), F.lit(0.45).alias("confidence"), F.lit("field_name_fallback").alias("strategy"), F.lit(None).cast("long").alias("hits"))
    every = told.unionByName(fallback).unionByName(nodes.sparkSession.createDataFrame(looser, "field string, selector string, confidence double, strategy string, hits long").join(fields, "field", "left_semi"))
    best = every.groupBy("field", "selector").agg(F.max(F.struct("confidence", "strategy", "hits")).alias("b"))
    return best.select("field", "selector", F.round("b.confidence", 6).alias("confidence"), "b.strategy", "b.hits")


def html_preview(nodes: DataFrame, most: int = 1000, head: int = 700, tail: int = 300) -> DataFrame:
    """(page_id, preview): title, description, headings and paragraphs of a page, a line each; a long one keeps its beginning and end."""
    spans = with_text(nodes.where("tag in ('title', 'h1', 'h2', 'p')").select("page_id", "node", "last"), nodes).select("page_id", "node", "text")
    meta = nodes.where("tag = 'meta' and lower(attrs['name']) = 'description'").select("page_id", "node", F.trim(F.element_at("attrs", "content")).alias("text"))
    lines = spans.unionByName(meta).where("text <> ''").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return lines.select("page_id", F.when(F.length("t") <= most, F.col("t")).otherwise(F.concat(F.substring("t", 1, head), F.lit("\n"), F.expr(f"right(t, {tail})"))).alias("preview"))


def _nodes(s, d):
    return written_nodes(view(s, d, "pages"))


def _pictured(s, d):
    """The pages with an image in each link of their lists, some of them repeated, small or drawn."""
    image = r'<img class="thumb" alt="$2" src="/img/$1.jpg" width="400" height="300"><img data-src="$1.svg"><img src="/img/$1.jpg"><img src="/px/$1.png" width="1" height="1">$2'
    return view(s, d, "pages").withColumn("html", F.regexp_replace("html", r'(?<=<li><a href="/)([^"<>]*)">([^<]*)', r'$1">' + image))


def _typed(s, d):
    kinds = list(ITEMS)
    return view(s, d, "pages").withColumn("page_type", F.element_at(F.array(*map(F.lit, [*kinds, "unknown"])), (F.col("page_id") % 5 + 1).cast("int"))).withColumn("depth", (F.col("page_id") % 3).cast("int"))


RULES = [("title", "article > h1, head > title"), ("body", "article p:nth-of-type(n+2)"), ("link", "nav li:first-child a[href]"), ("ad", "div.ad"), ("missing", "main .missing + p")]
FOLLOW = [("artist_exhibitions", "nav ul > li a[href^='/']", 2), ("artist_articles", "article ~ footer a", 3)]


def _frame(s, rows, schema):
    return s.createDataFrame(rows, schema)


def _field_rules(s):
    return _frame(s, RULES, "field string, selector string")


def _by_type(s):
    return _frame(s, [(t, f, sel) for t in (*ITEMS, "unknown") for f, sel in RULES if t != "artist_press" or f == "title"], "page_type string, field string, selector string")


QUERIES = {
    "page_nodes": _nodes,
    "selector_extract": lambda s, d: selector_extract(view(s, d, "pages"), _nodes(s, d), _field_rules(s), (("heading", r"\b(\d{4})\b"),)),
    "backfill_extract": lambda s, d: selector_extract(_typed(s, d), written_nodes(_typed(s, d), keep=("page_type",)), _by_type(s), on=("page_type",)),
    "follow_links": lambda s, d: follow_links(_typed(s, d), _nodes(s, d), _frame(s, FOLLOW, "page_type string, selector string, max_depth int")),
    "asset_urls": lambda s, d: asset_urls(_pictured(s, d).withColumn("page_type", F.lit("any")), written_nodes(_pictured(s, d)), _frame(s, [("any", "nav a > img:nth-of-type(2n)"), ("any", "img.thumb")], "page_type string, selector string")),
    "related_items": lambda s, d: related_items(_typed(s, d), _nodes(s, d)),
    "extract_images": lambda s, d: extract_images(_pictured(s, d), written_nodes(_pictured(s, d))),
    "html_preview": lambda s, d: html_preview(_nodes(s, d)),
    "selector_candidates": lambda s, d: selector_candidates(_nodes(s, d), view(s, d, "pages").select("page_id", F.lit("title").alias("field"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("expected")), {"title": "header > h2.title"}),
}
ORACLE = {}
