"""Like names and the matching rules against loops over all pairs."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomscan.operators import entities, names

SYLLABLES = ["an", "bel", "cor", "de", "é", "fi", "gu", "日", "ho", "x", " ", "-", "lll", "Ma"]


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def words(n, seed):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 9))) for _ in range(n)]
    for base in out[: n // 2]:
        cut = rnd.randrange(len(base))
        out.append(base[:cut] + rnd.choice(SYLLABLES) + base[cut + rnd.randint(0, 2) :])
    return [*out, "a" * 300, "a" * 299 + "b", "alexander", "alexandre", ""]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.7, 0.9, 0.94, 1.0])
def test_similar_names_are_those_of_a_loop(spark, threshold):
    left, right = [(k % 3, w) for k, w in enumerate(words(60, 1))], [(k % 3, w) for k, w in enumerate(words(60, 2) + words(20, 1))]
    want = {(g, a, b): ratio(a, b) for g, a in left for h, b in right if g == h and a and b and ratio(a, b) >= threshold}
    rows = lambda x: spark.createDataFrame([*x, (None, "alexander"), (1, None)], "g int, name string")
    got = names.similar_names(rows(left), rows(right), ["g"], threshold).collect()
    assert len(got) == len(want) and {(r["g"], r["l_name"], r["r_name"]): pytest.approx(r["ratio"]) for r in got} == want and want


def plain_best(records, known, least=0.72):
    out = {}
    for r in records:
        best = None
        fields = names.SECONDARY.get(r["entity_type"], ())
        for e in known:
            name = (r["name"] or "").lower().strip(" ")
            if e["entity_type"] != r["entity_type"] or not name:
                continue
            same = [str(r[f]).strip(" ").lower() == str(e[f]).strip(" ").lower() for f in fields if r[f] not in (None, "") and e[f] not in (None, "")]
            n = ratio(name, (e["name"] or "").lower().strip(" "))
            total = 0.7 * n + 0.3 * (sum(same) / len(fields) if fields else 0)
            if total >= least - 1e-9 and (best is None or (-round(total, 6), e["id"]) < (-best[1], best[0])):
                best = (e["id"], round(total, 6), n)
        if best:
            out[r["id"]] = best
    return out


ENTITY = "id int, entity_type string, name string, birth_year int, nationality string, medium string, year int, address string"


def made(seed, start, n=150):
    rnd = random.Random(seed)
    pool = words(25, 3)
    return [(start + k, rnd.choice(["artist", "artwork", "venue", "organization"]), rnd.choice(pool + [None]), rnd.choice([None, 1980, 1981]), rnd.choice([None, "", "uk", " UK", "fr"]), rnd.choice(["oil", "ink", None]), rnd.choice([2000, 2001]), rnd.choice(["a st", "b st", None])) for k in range(n)]


@pytest.mark.parametrize("least", [0.72, 0.5])
def test_best_entity_is_that_of_a_loop(spark, least):
    records, known = spark.createDataFrame(made(1, 1000), ENTITY), spark.createDataFrame(made(2, 0), ENTITY)
    want = plain_best(records.collect(), known.collect(), least)
    got = {r["r_id"]: (r["l_id"], pytest.approx(r["score"]), pytest.approx(r["name_score"])) for r in names.best_entity(records, known, least=least).collect()}
    assert got == want and want


def test_best_entity_of_the_tables_is_that_of_a_loop(spark):
    records, known = names._sides(spark, "/root/testdata/sf0.001")
    want = plain_best(records.collect(), known.collect())
    assert {r["r_id"]: (r["l_id"], pytest.approx(r["score"]), pytest.approx(r["name_score"])) for r in names.best_entity(records, known).collect()} == want and want


def test_alexander_is_alexandre(spark):
    row = lambda i, n: spark.createDataFrame([(i, "artist", n, 1980, "uk", None, None, None)], ENTITY)
    best = names.best_entity(row(1, "Alexander"), row(2, "Alexandre")).first()
    assert best["l_id"] == 2 and best["score"] == pytest.approx(0.7 * 16 / 18 + 0.3, abs=1e-6)
    assert entities.resolve(row(1, "Alexander").withColumn("confidence", F.lit(40)), names.best_entity(row(1, "Alexander"), row(2, "Alexandre"))).first()["decision"] == "link_to_entity"


def test_resolution_needs_name_and_score(spark):
    people = spark.createDataFrame([(1, "artist", "Alex Brown", 1980, "uk", 40), (2, "artist", "Alex Browne", 1980, "uk", 40), (3, "artist", "Alex Brown", None, None, 90), (4, "artist", "", 1980, "uk", 10), (5, "venue", "Alex Brown", None, None, 40), (6, "artist", "Alex Brown", 1980, "uk", 1)], "id int, entity_type string, name string, birth_year int, nationality string, confidence int")
    known = spark.createDataFrame([(11, "artist", "alex brown ", 1980, "UK"), (12, "artist", "Alex Brown", 1970, "fr")], "id int, entity_type string, name string, birth_year int, nationality string")
    linked = spark.createDataFrame([(6, 99)], "r_id int, entity_id long")
    got = {r["r_id"]: r for r in entities.resolve(people, names.best_entity(people, known), linked).collect()}
    assert {i: (r["decision"], r["entity_id"], r["method"]) for i, r in got.items()} == {
        1: ("link_to_entity", 11, "exact"), 2: ("link_to_entity", 11, "fuzzy"), 3: ("create_new_entity", None, "exact"), 4: ("create_new_entity", None, "exact"), 5: ("create_new_entity", None, "exact"), 6: ("already_linked", 99, None),
    }
    assert got[1]["confidence"] == 1.0 and got[3]["confidence"] == 0.9 and got[4]["confidence"] == 0.5 and got[2]["confidence"] == pytest.approx(0.7 * 20 / 21 + 0.3, abs=1e-5)
    half = spark.createDataFrame([(7, "artist", "Alex Brown", 1980, "de", 40)], people.schema)
    r = entities.resolve(half, names.best_entity(half, known)).first()
    assert (r["decision"], r["entity_id"], r["method"], r["review"], r["confidence"]) == ("create_entity_flag_review", 11, "manual", True, 0.85)


STORED = "id int, source_id int, record_type string, name string, fingerprint string, birth_year int, nationality string, website_url string, year int, medium string"


def plain_dedupe(stored, incoming):
    norm = lambda x: str(x).strip(" ").lower()
    fold = lambda n: "".join(c for c in " ".join((n or "").lower().split()) if c in "abcdefghijklmnopqrstuvwxyz0123456789 ")
    out = {}
    for r in incoming:
        best, mine = None, fold(r["name"])
        fields, strong = names.IDENTITY.get(r["record_type"], ()), names.STRONG.get(r["record_type"], ())
        own = [e for e in stored if e["source_id"] == r["source_id"] and e["record_type"] == r["record_type"]]
        for e in own:
            n = ratio(fold(e["name"]), mine)
            if n < 0.7:
                continue
            both = [f for f in fields if f in r and r[f] is not None and e[f] is not None]
            equal = [f for f in both if norm(r[f]) == norm(e[f])]
            score = 0.75 * n + 0.25 * (len(equal) / len(both) if both else 0)
            if score >= 0.7 - 1e-9 and (best is None or (-round(score, 6), e["id"]) < (-best[1], best[0])):
                best = (e["id"], round(score, 6), "merge" if score >= 0.85 - 1e-9 and set(equal) & set(strong) else "review")
        decision = best[2] if best else "insert"
        clash = mine and decision != "merge" and any(fold(e["name"]) == mine for e in own)
        out[r["id"]] = (best and best[0], best and pytest.approx(best[1]), decision, mine + ("--" + r["fingerprint"][:12] if clash else ""))
    return out


def test_dedupe_is_that_of_a_loop(spark):
    def rows(seed, start):
        rnd = random.Random(seed)
        pool = words(20, 5)
        return spark.createDataFrame([(start + k, k % 2, rnd.choice(["artist", "artwork", "odd"]), rnd.choice(pool), f"fingerprint-{start + k}", rnd.choice([None, 1980, 1981]), rnd.choice([None, "", "uk", "FR "]), rnd.choice([None, "x.com", "y.com"]), rnd.choice([2000, None]), rnd.choice(["oil", None])) for k in range(120)], STORED)

    stored, incoming = rows(1, 0), rows(2, 500)
    want = plain_dedupe([r.asDict() for r in stored.collect()], [r.asDict() for r in incoming.collect()])
    got = {r["id"]: (r["match_id"], r["score"], r["decision"], r["name"]) for r in names.dedupe_records(stored, incoming).collect()}
    assert got == want and {x[2] for x in want.values()} == {"merge", "review", "insert"}


def test_equal_name_alone_is_review(spark):
    row = lambda *r: spark.createDataFrame([r], STORED)
    got = lambda a, b: names.dedupe_records(row(*a), row(*b)).first()
    alike = got((1, 1, "artist", "Alex Brown", "f" * 20, None, "uk", None, None, None), (2, 1, "artist", "alex  brown", "e" * 20, None, "uk", None, None, None))
    assert (alike["decision"], alike["match_id"], alike["score"], alike["name"]) == ("review", 1, 1.0, "alex brown--eeeeeeeeeeee")
    same = got((1, 1, "artist", "Zoe Gray", "f", None, None, "z.com", None, None), (2, 1, "artist", "Zoe Gray", "e", None, None, "Z.com ", None, None))
    assert (same["decision"], same["match_id"], same["name"]) == ("merge", 1, "zoe gray")
    other = got((1, 1, "artist", "Zoe Gray", "f", None, None, None, None, None), (2, 2, "artist", "Zoe Gray", "e", None, None, None, None, None))
    assert (other["decision"], other["match_id"]) == ("insert", None)


def test_entity_by_name_is_that_of_a_loop(spark):
    mentions, known = spark.createDataFrame(made(5, 1000), ENTITY), spark.createDataFrame(made(6, 0), ENTITY)
    fold = lambda n: (n or "").strip(" ").lower()
    want = {}
    for m in mentions.collect():
        found = [(-ratio(fold(e["name"]), fold(m["name"])), e["id"]) for e in known.collect() if e["entity_type"] == m["entity_type"]]
        best = min((x for x in found if -x[0] >= 0.9), default=None)
        want[m["id"]] = (best and best[1], best and pytest.approx(-best[0]))
    assert {r["r_id"]: (r["l_id"], r["score"]) for r in names.entity_by_name(mentions, known).collect()} == want


def block(n):
    return "".join(c for c in (n or "").lower().strip(" ") if c.isalnum())[:3]


def reach(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_entity_links_join_what_a_loop_joins(spark):
    df = spark.createDataFrame(made(8, 0, 160), ENTITY)
    rows = df.collect()
    fold = lambda x: str(x or "").strip(" ").lower()
    links = []
    for a in rows:
        for b in rows:
            if a["id"] < b["id"] and a["entity_type"] == b["entity_type"] and block(a["name"]) == block(b["name"]):
                x, y = sorted((fold(a["name"]), fold(b["name"])))
                name = SequenceMatcher(None, x, y).ratio()
                both = [f for f in names.OVERLAP if f in a and a[f] not in (None, "") and b[f] not in (None, "")]
                equal = sum(fold(a[f]) == fold(b[f]) for f in both)
                if (0.8 * name + 0.2 * equal / len(both) if both else name) >= 0.94 - 1e-9:
                    links.append((a["id"], b["id"]))
    ids = [r["id"] for r in rows]
    got = names.entity_links(df).collect()
    assert links and {(r["l_id"], r["r_id"]) for r in got} and all(r["l_id"] < r["r_id"] and r["score"] >= 0.94 for r in got)
    assert reach(ids, [(r["l_id"], r["r_id"]) for r in got]) == reach(ids, links)


def test_candidate_pairs_and_members_give_all_pairs_of_a_block(spark):
    df = spark.createDataFrame(made(9, 0, 80), ENTITY)
    rows = df.collect()
    want = {(a["id"], b["id"]) for a in rows for b in rows if a["id"] < b["id"] and a["entity_type"] == b["entity_type"] and block(a["name"]) == block(b["name"])}
    got = names.candidate_pairs(df).collect()
    of = defaultdict(set)
    for r in got:
        if r["role"] == "member":
            of[r["l_id"]].add(r["r_id"])
    every = set()
    for first in {r["id"] for r in rows} - {x for v in of.values() for x in v}:
        own = sorted(of[first] | {first})
        every |= {(a, b) for a in own for b in own if a < b}
    for r in got:
        if r["role"] == "pair":
            every |= {(min(a, b), max(a, b)) for a in of[r["l_id"]] | {r["l_id"]} for b in of[r["r_id"]] | {r["r_id"]}}
    assert every == want and want
