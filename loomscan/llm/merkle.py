"""Merkle manifest of a table: leaves by row, a tree for each group, one tree over the groups' roots.

Rows are numbered within their group by a range sort, whose parts are written, so that no group meets in one task. Each level
joins runs of consecutive nodes to their parent; the levels are stored as node rows that name their parent and their siblings.
A recursive query climbs from the leaves: each step appends the siblings to the proof and folds every leaf's digest, tampered
or not, into that of the next node. The leaves of one run share all their ancestors, so a run climbs as one row that holds a
digest for each of its leaves. Digests are 32 bytes in tables and lower-case hex where they are hashed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomscan.plans.shared import materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the tree over the groups
_PLACE = (1 << 33) - 1  # the low bits of monotonically_increasing_id() count the rows of a partition


def hex_of(c: Column) -> Column:
    return F.lower(F.hex(c))


def digest(c: Column) -> Column:
    """SHA-256 of a string, as bytes."""
    return F.unhex(F.sha2(c, 256))


def leaf_text(fields: list[Column]) -> Column:
    """The fields, each as byte count, colon and value, or - where it is null."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.concat(*parts)


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df, written, with pos (from 0 in each group by order, nulls first) and total (rows of the group)."""
    cut = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = materialize(cut.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(_PLACE).alias("_seq")), name)
    parts = rows.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))  # as many rows as parts and groups together, at most
    before = W.partitionBy("_group").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_group", "_p", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(W.partitionBy("_group")).alias("total"))
    joined = rows.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_seq") - F.col("_first")).alias("pos"), "total")


def _run(of: Column) -> Column:
    """The digest of a run's digests."""
    return digest(F.array_join(F.transform(of, hex_of), ""))


def _levels(nodes: DataFrame, level: int, fanout: int, name: str) -> list[tuple[int, DataFrame]]:
    """From the nodes (tree, pos, total, digest) of a level those of the levels above, each with the run of its children; total is the tree's leaves."""
    out, most = [], nodes.agg(F.max("total").alias("n")).first()["n"] or 0
    while most > fanout**level:
        runs = nodes.where(F.col("total") > fanout**level).groupBy("tree", "total", F.floor(F.col("pos") / fanout).alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run"))  # fanout nodes at most
        level += 1
        nodes = materialize(runs.select("tree", F.col("up").alias("pos"), "total", _run(F.col("run.digest")).alias("digest"), "run"), name)
        out.append((level, nodes))
    return out


def _children(level: int, parents: DataFrame) -> DataFrame:
    """The children of a level's nodes, each with the hex of its siblings before and after it and a link to its parent."""
    text = lambda part: F.array_join(F.transform(part, lambda x: hex_of(x["digest"])), "")
    children = parents.select("tree", "pos", F.posexplode("run").alias("k", "child"), "run")
    return children.select(
        "tree", F.lit(level - 1).cast("long").alias("level"), F.col("child.pos").alias("pos"), F.col("child.digest").alias("digest"),
        text(F.slice("run", F.lit(1), F.col("k"))).alias("before"), text(F.slice("run", F.col("k") + 2, F.size("run"))).alias("after"),
        F.col("tree").alias("up_tree"), F.lit(level).cast("long").alias("up_level"), F.col("pos").alias("up_pos"), F.lit(False).alias("is_subroot"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


_CLIMB = """
with recursive climb(home, start, tree, level, pos, folded, proof, subroot, root) max recursion level 400 as (
    select home, start, tree, level, pos, folded, unhex(''), cast(null as binary), cast(null as binary) from {starts}
    union all
    select c.home, c.start, n.up_tree, n.up_level, n.up_pos,
           case when n.up_tree is null or n.is_subroot then c.folded else transform(c.folded, x -> unhex(sha2(concat(n.before, lower(hex(x)), n.after), 256))) end,
           concat(c.proof, unhex(concat(n.before, n.after))),
           coalesce(c.subroot, case when n.is_subroot then n.digest end), case when n.up_tree is null then n.digest end
    from climb c join {nodes} n on c.tree = n.tree and c.level = n.level and c.pos = n.pos)
select home, start, folded, proof, subroot, root from climb where tree is null"""


def _climb(spark: SparkSession, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of starts at the root. The query runs here, while the session's limit on a recursion's rows is lifted."""
    tag, limit = uuid.uuid4().hex, "spark.sql.cteRecursionRowLimit"
    names = {"starts": f"merkle_starts_{tag}", "nodes": f"merkle_nodes_{tag}"}
    old = spark.conf.get(limit)
    starts.createOrReplaceTempView(names["starts"])
    nodes.createOrReplaceTempView(names["nodes"])
    try:
        spark.conf.set(limit, "-1")
        return materialize(spark.sql(_CLIMB.format(**names)), "climbed")
    finally:
        spark.conf.set(limit, old)
        for n in names.values():
            spark.catalog.dropTempView(n)


def manifest(docs: DataFrame, tampered: Column, changed: dict[str, Column], fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs: doc_id, lang (the group), pos (its place there), leaf, subroot, root, proof_sha256, folded_root, verified.

    A row that is tampered is folded from its fields as changed gives them, any other from its own. Null fields count as -, rows without an id or group come first,
    rows of one id are ordered by their leaves, and equal rows are a leaf each. No rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text, other = leaf_text([F.col(f) for f in fields]), leaf_text([changed.get(f, F.col(f)) for f in fields])
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(group).cast("string").alias("lang"), digest(text).alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)), digest(other)).alias("bad"))
    leaves = numbered(source, "lang", ["doc_id", "leaf", "bad"], "leaves")

    first = leaves.groupBy("lang", "total", F.floor(F.col("pos") / fanout).alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", F.coalesce("bad", "leaf").alias("start")))).alias("run"))  # fanout leaves at most
    groups = numbered(leaves.select(F.col("lang").alias("name")).distinct().withColumn("one", F.lit(1)), "one", ["name"], "groups").select("name", F.col("pos").alias("tree"))
    runs = materialize(first.join(groups, first["lang"].eqNullSafe(groups["name"])).select("tree", F.col("up").alias("pos"), "total", "lang", "run", _run(F.col("run.leaf")).alias("digest")), "runs")
    alone = F.col("total") == 1  # such a leaf is its group's root
    nodes = runs.select("tree", "pos", "total", F.when(alone, F.col("run")[0]["leaf"]).otherwise(F.col("digest")).alias("digest"), F.when(alone, 0).otherwise(1).cast("long").alias("level"))
    upper = _levels(nodes.where(~alone), 1, fanout, "level")

    own = [nodes.where(F.col("total") <= fanout), *(x.where(F.col("total") <= fanout**k).withColumn("level", F.lit(k).cast("long")) for k, x in upper)]
    roots = materialize(_union([x.select("tree", "level", "digest") for x in own]), "subroots")
    tops = _levels(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(roots.count()).cast("long").alias("total"), "digest"), 0, fanout, "top")

    # a group's root is a node of its own tree that links to itself as a leaf of the tree over the groups
    link = roots.select("tree", "level", F.lit(0).cast("long").alias("pos"), "digest", F.lit("").alias("before"), F.lit("").alias("after"), F.lit(TOP).cast("long").alias("up_tree"), F.lit(0).cast("long").alias("up_level"), F.col("tree").alias("up_pos"), F.lit(True).alias("is_subroot"))
    at, top = tops[-1] if tops else (0, roots)
    none = F.lit(None).cast("long")
    last = top.select(F.lit(TOP).cast("long").alias("tree"), F.lit(at).cast("long").alias("level"), F.lit(0).cast("long").alias("pos"), "digest", F.lit("").alias("before"), F.lit("").alias("after"), none.alias("up_tree"), none.alias("up_level"), none.alias("up_pos"), F.lit(False).alias("is_subroot"))
    links = materialize(_union([*(_children(k, x) for k, x in [*upper, *tops]), link, last]), "nodes")

    leaves_hex = F.transform("run", lambda x: hex_of(x["leaf"]))
    others = lambda i, own: F.concat(F.array_join(F.slice("hexes", F.lit(1), i), ""), own, F.array_join(F.slice("hexes", i + 2, F.size("hexes")), ""))
    fold = F.transform("run", lambda x, i: digest(others(i, hex_of(x["start"]))))
    starts = runs.withColumn("hexes", leaves_hex).select(F.col("tree").alias("home"), F.col("pos").alias("start"), "tree", F.when(alone, 0).otherwise(1).cast("long").alias("level"), "pos", F.when(alone, F.transform("run", lambda x: x["start"])).otherwise(fold).alias("folded"))
    climbed = _climb(spark, starts, links)

    told = runs.join(climbed, (F.col("home") == F.col("tree")) & (F.col("start") == F.col("pos"))).withColumn("above", hex_of(F.col("proof"))).withColumn("hexes", leaves_hex)
    rows = F.transform("run", lambda x, i: F.struct(x["doc_id"].alias("doc_id"), x["pos"].alias("pos"), F.get("hexes", i).alias("leaf"), F.sha2(F.concat(others(i, F.lit("")), F.col("above")), 256).alias("proof_sha256"), hex_of(F.get("folded", i)).alias("folded_root")))
    out = told.select("lang", hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"), F.explode(rows).alias("x"))
    return out.select("x.doc_id", "lang", "x.pos", "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified"))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against texts whose A-Z are lower-cased where 3 divides the CRC-32 of the id."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, hit, {"text": F.translate("text", upper, upper.lower())})
