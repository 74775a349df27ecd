"""The registered queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstate.llm import (
    decontaminate,
    embedding_dedup,
    language_id,
    merkle,
    near_dedup,
    packing,
    phrases,
    pii,
    sharding,
    token_counts,
    token_store,
    url_filter,
    warc,
)
from tickstate.llm.common import work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; TICKSTATE_TOKENIZERS names another folder."""
    folder = os.environ.get("TICKSTATE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- 1 token counts ---------------------------------------------------------

@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document over a public vocabulary."""
    return piece_counts(table(spark, sf_dir, "documents"))


def piece_counts(docs: DataFrame) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    opening, continuing = token_counts.sentencepiece_pieces(path)
    unknown = token_counts.sentencepiece_unknown(path)
    return token_counts.word_piece_counts(docs, opening, continuing, unknown=unknown)


COMPONENTS = """
reach as (
  select id, id as r from nodes
  union select reach.id, links.y from reach join links on links.x = reach.r)"""


# ---- 2 decontamination ------------------------------------------------------

@query("op2_benchmark_leaks")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents: one row per document, item and place."""
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


# ---- 3 pii ------------------------------------------------------------------

_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_D = "regexp_replace(v, '[^0-9]', '', 'g')"
_SQL_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 90, "mail|contact|correo|courriel"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     f"regexp_full_match(v, '{_OCTET}([.]{_OCTET}){{3}}')", 60, "ip|host|server|address|addr"),
    ("card", r"[0-9]([\x20-]?[0-9])+",
     f"""length({_D}) between 16 and 19 and list_sum(list_transform(string_split(reverse({_D}), ''), lambda c, i:
       case when i % 2 = 1 then cast(c as int) when c >= '5' then cast(c as int) * 2 - 9 else cast(c as int) * 2 end)) % 10 = 0""",
     80, "card|visa|mastercard|karte|carte|tarjeta|payment"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) between 8 and 15", 60, "phone|tel|call|mobile|fax|movil"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
     """list_reduce(list_prepend(0, list_transform(string_split(substr(v, 5) || substr(v, 1, 4), ''), lambda c:
       case when c >= 'A' then 100 + ascii(c) - 55 else ascii(c) - 48 end)), lambda a, c:
       case when c >= 100 then (a * 100 + c - 100) % 97 else (a * 10 + c) % 97 end) = 1""",
     70, "iban|account|bank|konto|compte|cuenta"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
     "v[1] <> '9' and v[1:3] not in ('000', '666') and v[5:6] <> '00' and v[8:11] <> '0000'",
     30, "ssn|social|security|insurance"),
)


@query(
    "op3_pii",
    "with d as (select doc_id, coalesce(text, '') as text from documents), found as ("
    + " union all ".join(f"""
      select doc_id, '{k}' as kind, {i} as nth, stop - length(v) as start, stop, {score}
        + case when regexp_matches(right(gap, 40), '(?i)(^|[^a-z])({words})')
            or regexp_matches(left(after, 40), '(?i)(^|[^a-z])({words})') then 20 else 0 end as score
      from (
        select *, sum(length(gap) + length(v)) over (partition by doc_id order by n) as stop from (
          select doc_id, unnest(m) as v, unnest(g[1:len(m)]) as gap, unnest(g[2:]) as after, unnest(range(1, len(m) + 1)) as n
          from (select doc_id, regexp_extract_all(text, '{p}') as m, string_split_regex(text, '{p}') as g from d)))
      where {valid}"""
      for i, (k, p, valid, score, words) in enumerate(_SQL_KINDS))
    + """),
    kept as (select *, kind || ':' || start || ':' || stop as s from found where kind not in ('iban', 'ssn') or score >= 50)
    select doc_id, """
    + ", ".join(f"count(*) filter (kind = '{k[0]}') as n_{k[0]}" for k in _SQL_KINDS)
    + """, sha256(coalesce(string_agg(s, ',' order by nth, start) filter (kind not in ('iban', 'ssn')), '')) as base_sha256,
      coalesce(string_agg(s, ',' order by nth, start), '') as spans,
      coalesce(string_agg(cast(score as varchar), ',' order by nth, start), '') as scores
    from d left join kept using (doc_id) group by doc_id""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    return pii.span_digest(pii.find_spans(table(spark, sf_dir, "documents")))


# ---- 4 packing --------------------------------------------------------------

@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of all documents packed into bins of four lengths."""
    return packing.pack(lengths(table(spark, sf_dir, "documents")))


def lengths(docs: DataFrame) -> DataFrame:
    """Word-piece counts with one end token."""
    return piece_counts(docs).select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens"))


# ---- 5 embeddings -----------------------------------------------------------

@query(
    "op5_embedding_near_dedup",
    f"""with recursive v as (
      select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
      where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    nodes as (select vec_id as id from embeddings),
    links as (
      select a.vec_id as x, b.vec_id as y from v a join v b
        on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.93),
    {COMPONENTS},
    n as (select x, count(*) as n from links group by x)
    select id as vec_id, coalesce(any_value(n), 0) as n_links, min(r) as component_id, min(r) = id as kept
    from reach left join n on n.x = id group by id""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label with cosine of 0.93 or more."""
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


# ---- 6 sharding -------------------------------------------------------------

@query("op6_sampled_splitter_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return sharding.shards(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# ---- 7 url filter -----------------------------------------------------------

URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


@query(
    "op7_url_filter",
    """with rest as (
      select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
      from pages),
    parts as (
      select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(regexp_replace(coalesce(rest, ''), '^[^/?#]*', ''), '^[^?#]*') as path
      from rest),
    rules(verdict, host, path) as (values """
    + ", ".join(
        "('{}', '{}', '/{}')".format(v, *r.split("/", 1)) for v, r in URL_RULES
    )
    + """),
    fits as (
      select page_id, r.verdict, substr(r.host || r.path, 1) as rule
      from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)),
    best as (select page_id, arg_max(verdict, len(rule)) as verdict, arg_max(rule, len(rule)) as rule from fits group by 1)
    select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (page_id)""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


# ---- 8 token files ----------------------------------------------------------

@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to coded files and read back."""
    path = work_path(spark, "token-files")
    token_store.write_tokens(
        table(spark, sf_dir, "documents"), path, tokenizer=tokenizer_file("byte_bpe_50k.json"), end_id=2
    )
    read = token_store.read_tokens(spark, path, digest=True)
    return token_store.with_start(spark, path, read).select("doc_id", "start", "n_tokens", "ids_crc32")


# ---- 9 near duplicates ------------------------------------------------------

@query(
    "op9_minhash_near_dedup",
    f"""with recursive w as (
      select doc_id as id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
      from documents),
    nodes as (select id from w),
    sh as (
      select distinct id, unnest(case
        when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
      from w),
    size as (select id, count(*) as n from sh group by id),
    pairs as (
      select a.id as x, b.id as y, count(*) as c from sh a join sh b on a.s = b.s and a.id <> b.id group by 1, 2),
    links as (
      select x, y from pairs join size p on p.id = x join size q on q.id = y where 100 * c >= 85 * (p.n + q.n - c)),
    {COMPONENTS}
    select id as doc_id, coalesce(any_value(n), 0) as n_shingles, min(r) as component_id, min(r) = id as kept
    from reach left join size using (id) group by id""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, Jaccard of 0.85."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


# ---- 10 language ID ---------------------------------------------------------

@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    learn = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = language_id.train(learn.select("text", "lang"))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_id.identify(docs, model, keep=("doc_id", "held_out"))


# ---- 11 phrase collocations -------------------------------------------------

@query(
    "op11_phrase_collocations",
    f"""with w as (
      select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from (
        select coalesce(lang, 'und') as lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) as piece from documents)),
    one as (select lang, unnest(w) as p from w),
    n as (select lang, count(*) as n from one group by lang),
    f as (
      select lang, p, 1 as words, count(*) as f from one group by 1, 2
      union all select lang, p, 2, count(*) from (
        select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as p from w) group by 1, 2
      union all select lang, p, 3, count(*) from (
        select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as p
        from w) group by 1, 2),
    c as (select lang, p, words, f as a, string_split(p, ' ') as w from f where words >= 2 and f >= 10),
    cuts as (
      select lang, p, words, a, 1 as k, w[1] as x, array_to_string(w[2:], ' ') as y from c
      union all select lang, p, words, a, 2, array_to_string(w[:2], ' '), w[3] from c where words = 3),
    scored as (
      select cuts.*, fx.f as l, fy.f as r, (1000000::hugeint * a * a) // (fx.f::hugeint * fy.f) as score
      from cuts join f fx on fx.lang = cuts.lang and fx.p = x join f fy on fy.lang = cuts.lang and fy.p = y),
    low as (select * from scored qualify row_number() over (partition by lang, p order by score, k) = 1),
    held as (
      select lang, p, max(a) as longer from (
        select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as p from c where words = 3) group by 1, 2),
    kept as (
      select low.*, row_number() over (partition by low.lang order by score desc, a desc, low.p) as rank
      from low left join held using (lang, p) where words = 3 or longer is null or 100 * longer < 50 * a)
    select kept.lang, rank, p as phrase, a, l, r, n, score::bigint as score from kept join n using (lang) where rank <= 2000""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=10, top=2000)


# ---- 12 merkle manifest -----------------------------------------------------

def _sql_part(name: str) -> str:
    text = f"cast({name} as varchar)"
    return f"case when {name} is null then '-' else octet_length(encode({text})) || ':' || {text} end"


_SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c)::bigint, 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda a, x: case when x < 256 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295)"""


def _sql_walk(name: str, start: str, nodes: str) -> str:
    """From each row of ``start`` to the top of its tree: x by the siblings, sib the siblings."""
    return f"""
    {name} as (
      select g, id, 0 as level, slot, total, x, sib from ({start})
      union all
      select w.g, w.id, w.level + 1, w.slot // 16, (any_value(w.total) + 15) // 16,
        sha256(string_agg(case when n.slot = w.slot then w.x else n.digest end, '' order by n.slot)),
        any_value(w.sib) || coalesce(string_agg(n.digest, '' order by n.slot) filter (n.slot <> w.slot), '')
      from {name} w join {nodes} n on n.level = w.level and n.g = w.g and n.slot // 16 = w.slot // 16
      where w.total > 1 group by w.g, w.id, w.level, w.slot)"""


def _sql_nodes(name: str, leaves: str) -> str:
    return f"""
    {name} as (
      select 0 as level, g, slot, digest, total from {leaves}
      union all
      select level + 1, g, slot // 16, sha256(string_agg(digest, '' order by slot)), (total + 15) // 16
      from {name} where total > 1 group by level, g, slot // 16, total)"""


@query(
    "op12_merkle_manifest",
    f"""with recursive rows as (
      select doc_id, coalesce('=' || source, '') as g,
        sha256({' || '.join(map(_sql_part, merkle.FIELDS))}) as digest,
        case when {_SQL_CRC32} % 5 = 0 then sha256({' || '.join(map(_sql_part, merkle.FIELDS[:-1]))} ||
          {_sql_part('low')}) end as tampered
      from (select *, {_SQL_LOWER} as low from documents)),
    leaves as (
      select *, row_number() over (partition by g order by doc_id nulls first, digest) - 1 as slot,
        count(*) over (partition by g) as total from rows),"""
    + _sql_nodes("nodes", "leaves") + """,
    subs as (
      select '' as g, g as of, digest, row_number() over (order by g) - 1 as slot, count(*) over () as total
      from nodes where total = 1),"""
    + _sql_nodes("above", "subs") + ","
    + _sql_walk("walk", "select g, slot as id, slot, total, coalesce(tampered, digest) as x, '' as sib from leaves", "nodes") + ","
    + _sql_walk(
        "ascent",
        """select '' as g, s.of || chr(1) || w.id as id, s.slot, s.total, w.x, w.sib
        from walk w join subs s on s.of = w.g where w.total = 1""",
        "above",
    ) + """
    select l.doc_id, l.digest as leaf, s.digest as subroot, r.digest as root, sha256(a.sib) as proof_sha256,
      a.x as folded_root, a.x = r.digest as verified
    from leaves l join subs s on s.of = l.g
    join ascent a on a.total = 1 and a.id = l.g || chr(1) || l.slot
    join above r on r.total = 1""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and the root folded from tampered texts."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, merkle.leaf(text=merkle.lower_cased()))
    manifest = merkle.build_manifest(table(spark, sf_dir, "documents"), tampered=tampered)
    return merkle.proofs(manifest, instead="tampered").select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


# ---- 13 web archives --------------------------------------------------------

@query(
    "op13_warc_bundles",
    """with p as (
      select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h,
        sha256(coalesce(html, '')) as k from pages),
    best as (
      select *, max(page_id) over (partition by k) as top, count(*) over (partition by k) as copies,
        row_number() over (partition by k order by page_id desc nulls last) as nth from p)
    select page_id, n as payload_bytes, h as payload_digest,
      case when n >= 1000 and nth > 1 then 'revisit' else 'response' end as record_type,
      case when n >= 1000 and nth > 1 then top end as refers_to from best""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web archive of all pages, written to bundles and read back."""
    path = work_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    records = warc.with_referred_page(warc.read_archive(spark, path, payload=False), spark, path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
