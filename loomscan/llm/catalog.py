"""Queries of the numbered operators and of the pipeline; SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from loomscan.llm import decontamination, embeddings, lexical, licenses, merkle, packing, personal_data, quality, recompression, simhash, token_counts, toxicity, warc


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_benchmark_decontamination(spark, sf_dir):
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    return recompression.remove_repeats(_read(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return personal_data.find(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir, vocabulary=None):
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), vocabulary)


def op5_warc_chunks(spark, sf_dir):
    return warc.round_trip(spark, _read(spark, sf_dir, "pages"))


def op7_license_scan(spark, sf_dir):
    return licenses.scan(_read(spark, sf_dir, "documents"), licenses.template_rows(spark))


def op8_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark, sf_dir):
    return packing.best_fit(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.audit(_read(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    return lexical.top_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_quality(spark, sf_dir):
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def _merkle_sql(levels=9):
    """Levels are written out one by one, for groups of up to 8^levels rows; a tree that has come down to one node stays as it is."""
    part = lambda c: f"coalesce(concat(strlen(cast({c} as varchar)), ':', cast({c} as varchar)), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(part(text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + "))"
    ctes = [
        "crc_table as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from (select unnest(range(256)) as i)))",
        "crc as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda s: ascii(s)::bigint)), lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) as c from (select distinct doc_id from documents where doc_id is not null), crc_table)",
        f"leaves as (select d.doc_id, lang, {leaf('text')} as leaf, case when c % 3 = 0 then {leaf(chr(39).join(['translate(text, ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ', ', 'abcdefghijklmnopqrstuvwxyz', ')']))} end as bad from documents d left join crc using (doc_id))",
        "h0 as (select *, coalesce(bad, leaf) as start, row_number() over (partition by lang order by doc_id nulls first, leaf, bad nulls first) - 1 as pos, dense_rank() over (order by lang nulls first) - 1 as tree from leaves)",
        "a0 as (select tree, pos, leaf as d from h0)",
    ]

    def climb(name, first, n):
        for k in range(n):
            ctes.append(f"{name}r{k} as (select tree, pos // 8 as up, string_agg(d, '' order by pos) as run, nodes from (select *, count(*) over (partition by tree) as nodes from {name}{k}) group by tree, up, nodes)")
            ctes.append(f"{name}{k + 1} as (select tree, up as pos, case when nodes = 1 then run else sha256(run) end as d from {name}r{k})")
            ctes.append(
                f"{name}w{k} as (select o.tree, o.pos, case when nodes = 1 then '' else coalesce(string_agg(s.d, '' order by s.pos) filter (where s.pos < o.pos), '') end as l, case when nodes = 1 then '' else coalesce(string_agg(s.d, '' order by s.pos) filter (where s.pos > o.pos), '') end as r, nodes = 1 as done"
                f" from {name}{k} o join {name}r{k} on {name}r{k}.tree = o.tree and {name}r{k}.up = o.pos // 8 join {name}{k} s on s.tree = o.tree and s.pos // 8 = o.pos // 8 group by o.tree, o.pos, nodes)"
            )

    climb("a", 0, levels)
    ctes.append(f"t0 as (select 0 as tree, tree as pos, d from a{levels})")
    climb("t", 0, 4)
    joins = ""
    step = [(f"{name}w{k}", 8**k) for name, n in (("a", levels), ("t", 4)) for k in range(n)]
    for w, size in step:
        joins += f" join {w} on {w}.tree = " + (f"h0.tree and {w}.pos = h0.pos // {size}" if w[0] == "a" else f"0 and {w}.pos = h0.tree // {size}")
    ctes.append("f0 as (select h0.doc_id, h0.lang, h0.pos, h0.tree, leaf, start as f, '' as p, " + ", ".join(f"{w}.l as {w}_l, {w}.r as {w}_r, {w}.done as {w}_d" for w, _ in step) + f" from h0{joins})")
    for i, (w, _) in enumerate(step):
        ctes.append(f"f{i + 1} as (select * replace (case when {w}_d then f else sha256(concat({w}_l, f, {w}_r)) end as f, concat(p, {w}_l, {w}_r) as p) from f{i})")
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, lang, f.pos, leaf, s.d as subroot, r.d as root, sha256(p) as proof_sha256, f as folded_root, f = r.d as verified from f{len(step)} f join a{levels} s on s.tree = f.tree cross join t4 r"


ORACLE = {
    "op11_merkle_manifest": _merkle_sql(),
    "op12_lexical_search": """
        with words as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t from documents),
        tf as (select doc_id, t, count(*)::bigint as tf from words group by all),
        n as (select doc_id, sum(tf)::bigint as n from tf group by 1),
        corpus as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from n),
        item as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t from benchmark),
        q as (select item_id, t, count(*)::bigint as k from item group by all),
        w as (select t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from (select t, count(*)::bigint as df from tf group by 1), corpus),
        m as (select doc_id, 25 + (75 * n * n_docs) // n_terms as m from n, corpus),
        s as (select item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join tf using (t) join w using (t) join m using (doc_id) group by all),
        r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
        select item_id, rank, doc_id, score from r where rank <= 10""",
    "op5_warc_chunks": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        s as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as payload_digest from p),
        f as (select payload_digest, min(page_id) as first from s where payload_bytes >= 100 group by 1)
        select page_id, payload_bytes, s.payload_digest,
               case when first is not null and page_id <> first then 'revisit' else 'response' end as record_type,
               case when first is not null and page_id <> first then first end as refers_to
        from s left join f using (payload_digest)""",
}


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op")} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return dict(ORACLE)
