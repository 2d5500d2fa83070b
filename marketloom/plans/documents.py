"""Queries on search hits, source links, pages, passages and planned queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions import text, urls
from marketloom.operators import documents, neighbours
from marketloom.operators.hotkeys import explode_computed
from marketloom.plans.registry import query, r
from marketloom.plans.views import ENTITY_TERMS, KEYWORD_TERMS, STRONG_TERMS
from marketloom.sources import dims, tables

RE_AMOUNT = fixed.AMOUNT_PATTERN.replace("'", "''")


def words(items) -> str:
    return "[" + ", ".join(f"'{w}'" for w in items) + "]"


def _count(terms, column: str) -> str:
    return f"len(list_filter({words(terms)}, w: contains({column}, w)))".replace("w:", "lambda w:")


def _type_case(domain: str) -> str:
    listed = " ".join(f"when {domain} = '{d}' or ends_with({domain}, '.{d}') then '{t}'" for d, t in fixed.SOURCE_TYPE_BY_DOMAIN.items())
    return f"case {listed} when coalesce({domain}, '') = '' then 'unknown' else 'media' end"


@query(
    "F23",
    "",
    """with p as (select page_id, regexp_extract(trim(url), '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#;]*)(?:;[^?#]*)?(?:[?]([^#]*))?(?:#.*)?$',
        ['scheme', 'host', 'path', 'query']) as u from pages),
    q as (select page_id, lower(u.scheme) as scheme, lower(u.host) as host, u.path as path,
      list_sort(list_filter(string_split(u.query, '&'), lambda x: regexp_matches(x, '^[^=]*=.+$') and
        lower(regexp_extract(x, '^([^=]*)=', 1)) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'spm', 'from', 'ref', 'source', 'fr', 'scene'))) as kept from p)
    select page_id, case when scheme = '' then 'https' else scheme end || '://' || host || case when path in ('', '/') then '/' else regexp_replace(path, '/+$', '') end
      || case when len(kept) = 0 then '' else '?' || array_to_string(kept, '&') end as canonical_url, regexp_replace(host, '^www[.]', '') as domain from q""",
)
def canonical_urls(v):
    return v.links().select(F.col("link_id").alias("page_id"), "canonical_url", "domain")


@query("F24", "", "select doc_id, sha256(text) as content_hash, trim(regexp_replace(text, '\\s+', ' ', 'g')) as squeezed from documents")
def content_hashes(v):
    d = v.table("documents")
    return d.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), text.squeeze(F.col("text")).alias("squeezed"))


def _simhash_sql() -> str:
    bits = ", ".join(f"sum(n * (2 * cast((h >> {i}) & 1 as int) - 1)) as b{i}" for i in range(64))
    return f"""with t as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as s from documents),
    u as (select doc_id, unnest(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3))) as gram from t),
    g as (select doc_id, gram, count(*) as n from u group by 1, 2),
    h as (select doc_id, n, cast('0x' || substr(md5(gram), 17, 16) as ubigint) as h from g),
    s as (select doc_id, {bits} from h group by 1)
    """


def _packed() -> str:
    return "cast(" + " + ".join(f"case when b{i} > 0 then {1 << i}::uhugeint else 0::uhugeint end" for i in range(64)) + " as ubigint)"


@query("F25", "", _simhash_sql() + f"select doc_id, lpad(lower(hex({_packed()})), 16, '0') as simhash from s")
def simhash_signatures(v):
    d = v.table("documents")
    return d.select("doc_id", text.signature_hex(text.simhash64(F.col("text"))).alias("simhash"))


@query(
    "J27 F25",
    "",
    _simhash_sql()
    + f""", g2 as (select d.doc_id, source, {_packed()} as sig from s join documents d on d.doc_id = s.doc_id),
    f as (select source, arg_min(sig, doc_id) as first_sig from g2 group by 1)
    select doc_id, source, cast(bit_count(xor(sig, first_sig)) as int) as distance from g2 join f using (source)""",
)
def signature_distance(v):
    """Hamming distance of every document's signature to that of the first document of its source.

    The first documents are one row per source; each source's documents meet them in a join that is split at run time where a source is hot.
    """
    d = v.table("documents")
    signed = d.select("doc_id", "source", text.simhash64(F.col("text")).alias("signature"))
    first = signed.groupBy("source").agg(F.min(F.struct("doc_id", "signature")).alias("_f"))
    first = first.select("source", F.col("_f.signature").alias("_first"))
    joined = signed.join(first, "source")
    return joined.select("doc_id", "source", text.hamming(F.col("signature"), F.col("_first")).alias("distance"))


_CLASSES = _simhash_sql() + f""", g2 as (select doc_id, {_packed()} as sig from s),
    cl as (select sig, min(doc_id) as class_id, count(*) as members from g2 group by 1)"""


def _signed(v):
    return v.table("documents").select("doc_id", text.simhash64(F.col("text")).alias("signature"))


@query(
    "J27",
    "",
    _CLASSES
    + """ select a.class_id as class_a, b.class_id as class_b, cast(bit_count(xor(a.sig, b.sig)) as int) as distance
    from cl a join cl b on a.class_id < b.class_id and bit_count(xor(a.sig, b.sig)) <= 3""",
)
def near_duplicate_pairs(v):
    """Pairs of different signatures within three bits, by the smallest document of each."""
    classes = neighbours.signature_classes(_signed(v), "doc_id", "signature")
    return neighbours.close_pairs(classes, "signature", 3)


@query("J27 F25", "", _CLASSES + " select doc_id, class_id, members from g2 join cl using (sig)")
def signature_members(v):
    """Class of every document: all documents of one signature, named by the smallest."""
    signed = _signed(v)
    members = neighbours.membership(signed, neighbours.signature_classes(signed, "doc_id", "signature"), "signature")
    return members.select("doc_id", "class_id", "members")


@query(
    "J23 S19",
    "",
    f"with h as (select page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www[.]', '') as domain from pages) select page_id, domain, {_type_case('domain')} as source_type from h",
)
def source_types(v):
    return v.links().select(F.col("link_id").alias("page_id"), "domain", urls.source_type(F.col("domain")).alias("source_type"))


@query(
    "J23 S19",
    "v_hits",
    f"""select doc_id, domain, {_type_case("domain")} as source_type from v_hits where {_type_case("domain")} not in ('media', 'unknown')""",
)
def listed_domains(v):
    """The same classification as a join: host suffixes against the listed domains, first list entry wins."""
    hosts = v.hits().select("doc_id", "domain", F.explode(urls.host_suffixes(F.col("domain"))).alias("_suffix"))
    listed = dims.domains(v.spark)
    found = hosts.join(listed.withColumnRenamed("domain", "_suffix"), "_suffix")
    return found.groupBy("doc_id", "domain").agg(F.min_by("source_type", "position").alias("source_type"))


def _dups_sql(order: str, key: str, source: str) -> str:
    return f"select {order}, row_number() over (partition by {key} order by {order}) > 1 as is_duplicate from {source}"


@query(
    "W9",
    "",
    """with c as (select page_id as link_id, regexp_extract(url, '^([^?#]*)', 1) as stem from pages)
    select link_id, row_number() over (partition by stem order by link_id) > 1 as is_duplicate from c""",
)
def duplicate_urls(v):
    links = v.links().withColumn("stem", F.regexp_extract("url", "^([^?#]*)", 1))
    return documents.mark_duplicates(links, "stem", "link_id").select("link_id", "is_duplicate")


@query("W10", "v_hits", _dups_sql("doc_id", "content_hash", "v_hits"))
def duplicate_bodies(v):
    return documents.mark_duplicates(v.hits(), "content_hash", "doc_id").select("doc_id", "is_duplicate")


_TRIAGE = f"""
with d as (select *, row_number() over (partition by content_hash order by doc_id) > 1 as is_duplicate, title || ' ' || snippet as t, {_type_case("domain")} as st from v_hits),
s as (select *, {_count(ENTITY_TERMS, "t")} as ents, {_count(STRONG_TERMS, "t")} as strong, regexp_matches(t, '{RE_AMOUNT}') as amount, st in ('official', 'exchange', 'regulator') as cred,
      {" + ".join(f"case when contains(t, '{w}') then 6 else 0 end" for w in fixed.TRIAGE_KEYWORDS)} as kw from d),
x as (select *, (case when ents > 0 then 30 + 5 * least(ents, 3) else 0 end + case when amount then 20 else 0 end + 6 * least(strong, 4) + kw
      + case when cred then 20 when st = 'company' then 10 else 0 end + greatest(0, 10 - rank) + case when query_family like 'source_pack:%' then 8 else 0 end)
      * case st when 'media' then 0.9::double else 1.0::double end as score from s),
y as (select *, {r("score", 2)} as read_priority, case when is_duplicate then 'link_record_only' when score >= 60 then 'read' when score >= 35 then 'link_record_only' else 'skip_for_now' end as triage_decision,
      concat_ws('|', case when ents > 0 then 'target_entity_match' end, case when amount then 'amount_mentioned' end, case when strong > 0 then 'strong_fact_keyword' end,
        {", ".join(f"case when contains(t, '{w}') then '{s}' end" for w, s in fixed.TRIAGE_KEYWORDS.items())},
        case when cred then 'high_credibility_source' end, case when is_duplicate then 'duplicate_url' end) as signals from x)
"""


def _triaged(v):
    terms = F.array(*[F.lit(t) for t in ENTITY_TERMS])
    # texts are read once: what is left of them is written and met again by hash
    scored = tables.stage(documents.score_hits(v.hits(), terms, STRONG_TERMS, {"media": 0.9}), "scored")
    return documents.decide_hits(documents.mark_duplicates(scored, "content_hash", "doc_id"))


@query(
    "F28",
    "v_hits",
    _TRIAGE + "select doc_id, st as source_type, read_priority, triage_decision, signals, triage_decision = 'read' and score >= 40 as need_model from y",
)
def triaged_hits(v):
    return _triaged(v).select(
        "doc_id", "source_type", "read_priority", "triage_decision", F.array_join("matched_signals", "|").alias("signals"), "need_model"
    )


@query(
    "P24 P33",
    "v_hits",
    _TRIAGE
    + """, c as (select *, triage_decision = 'read' and score >= 40 as need_model from y)
    select coalesce(case when need_model then 'rule_score_between' end, case when amount then 'contains_metric_or_amount' end, case when strong > 0 then 'high_value_keyword_matched' end,
      case when regexp_matches(t, '客户|供应商|订单|中标') then 'contains_relation_signal' end, case when st in ('official', 'exchange', 'regulator', 'company', 'industry') then 'source_type_in' end) as trigger,
      case when st in ('exchange', 'regulator') and read_priority >= 70 then 'high_value_parallel_analysis' else 'bundle_extraction' end as task, count(*) as n from c group by all""",
)
def model_call_triggers(v):
    rows = _triaged(v)
    trigger = documents.call_trigger(F.col("need_model"), F.col("matched_signals"), F.col("source_type"))
    task = documents.task_route(F.col("source_type"), F.col("read_priority"), ["exchange", "regulator"], 70.0)
    return rows.groupBy(trigger.alias("trigger"), task.alias("task")).agg(F.count("*").alias("n"))


@query(
    "K5",
    "v_hits",
    _TRIAGE
    + "select run_id, doc_id, read_priority from (select *, row_number() over (partition by run_id order by read_priority desc, doc_id) as rn from y where triage_decision = 'read') where rn <= 5",
)
def read_queue(v):
    chosen = _triaged(v).where("triage_decision = 'read'").select("run_id", "doc_id", "read_priority")
    return documents.top_per_group(chosen, ["run_id"], [F.desc("read_priority"), F.col("doc_id")], 5)


@query("W11", "v_hits", "select run_id, doc_id from (select *, row_number() over (partition by run_id order by doc_id) as rn from v_hits) where rn <= 20")
def hits_within_budget(v):
    hits = v.hits().select("run_id", "doc_id")
    return documents.within_budget(hits, "run_id", ["doc_id"], F.floor(F.col("doc_id") / 4096), 20).select("run_id", "doc_id")


@query("W11", "v_hits", "select run_id, greatest(0, count(*) - 20) as skipped from v_hits group by 1")
def hits_skipped_by_budget(v):
    return documents.skipped_by_budget(v.hits(), "run_id", 20)


@query(
    "J18",
    "v_hits",
    """with l as (select doc_id as link_id, 'run' || cast(doc_id % 4 as varchar) as run_id, content_hash from v_hits),
    a as (select doc_id as link_id, doc_id * 7 % 1000 as analysed_at from v_hits where lang = 'en'),
    c as (select x.link_id, y.link_id as prior, analysed_at from l x join l y on x.content_hash = y.content_hash and x.link_id <> y.link_id join a on a.link_id = y.link_id)
    select l.link_id, l.run_id, p.prior as reused_link_id from l left join
      (select link_id, prior, row_number() over (partition by link_id order by analysed_at desc, prior desc) as rn from c) p on p.link_id = l.link_id and rn = 1""",
)
def reusable_analyses(v):
    links, analyses = _linked(v)
    return documents.reusable_analysis(links, analyses, "content_hash", "link_id").select("link_id", "run_id", "reused_link_id")


@query(
    "J18",
    "v_hits",
    """with l as (select doc_id as link_id, 'run' || cast(doc_id % 4 as varchar) as run_id, domain || '/' || lang as canonical_url from v_hits where domain <> ''),
    a as (select doc_id as link_id, doc_id * 7 % 1000 as analysed_at from v_hits where lang = 'en'),
    c as (select canonical_url, run_id, max((analysed_at, link_id)) as best from l join a using (link_id) group by 1, 2),
    p as (select o.canonical_url, o.run_id, max(best)[2] as prior from (select distinct canonical_url, run_id from l) o
          join c on c.canonical_url = o.canonical_url and c.run_id <> o.run_id group by 1, 2)
    select l.link_id, l.run_id, p.prior as reused_link_id from l left join p on p.canonical_url = l.canonical_url and p.run_id = l.run_id""",
)
def reusable_analyses_by_url(v):
    links, analyses = _linked(v)
    located = v.hits().where("domain <> ''").select(F.col("doc_id").alias("link_id"), F.concat_ws("/", "domain", "lang").alias("canonical_url"))
    links = links.join(located, "link_id")
    return documents.reusable_analysis(links, analyses, "canonical_url", "run_id").select("link_id", "run_id", "reused_link_id")


def _linked(v):
    h = v.hits()
    links = h.select(
        F.col("doc_id").alias("link_id"), F.concat(F.lit("run"), (F.col("doc_id") % 4).cast("string")).alias("run_id"), "content_hash", F.lit("t").alias("target_id")
    )
    analyses = h.where("lang = 'en'").select(
        F.col("doc_id").alias("link_id"), F.lit("t").alias("target_id"), (F.col("doc_id") * 7 % 1000).alias("analysed_at"), F.col("doc_id").alias("analysis_id")
    )
    return links, analyses


@query(
    "S16 U4",
    "v_hits",
    """with l as (select doc_id as link_id, 'run' || cast(doc_id % 4 as varchar) as run_id, content_hash from v_hits),
    a as (select doc_id as link_id, doc_id * 7 % 1000 as analysed_at from v_hits where lang = 'en'),
    c as (select x.link_id, y.link_id as prior, analysed_at from l x join l y on x.content_hash = y.content_hash and x.link_id <> y.link_id join a on a.link_id = y.link_id),
    p as (select link_id, prior from (select *, row_number() over (partition by link_id order by analysed_at desc, prior desc) as rn from c) where rn = 1)
    select p.link_id, p.prior as analysis_id, i as position, 'cache_reuse' as merge_method from p, (values (0), (1)) x(i)""",
)
def cloned_children(v):
    links, analyses = _linked(v)
    reuse = documents.reusable_analysis(links, analyses, "content_hash", "link_id")
    children = analyses.select("link_id", "analysis_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    return documents.clone_rows(children, analyses, reuse)


# --- pages and passages --------------------------------------------------------------------


@query("F31 F45")
def extracted_pages(v):
    """Title, date hint, body size, tables and images of every whole page."""
    p = v.table("pages").select("page_id", text.extract_page(F.col("html")).alias("x"))
    return p.select(
        "page_id", "x.title", "x.publish_time", F.col("x.body").alias("body"),
        F.size("x.tables").alias("tables"), F.array_join("x.images", ",").alias("images"),
    )


@query(
    "P19",
    "",
    "select doc_id, length(text) <= 600 and regexp_matches('x ' || text, '安全验证|captcha|Access Denied|Just a moment') as junk from documents",
)
def junk_pages(v):
    d = v.table("documents")
    return d.select("doc_id", text.is_anti_bot(F.lit("x"), F.col("text")).alias("junk"))


def _passage_sql() -> str:
    any_of = lambda terms: " or ".join(f"contains(p, '{t}')" for t in terms)
    score = f"""case when i = 0 then 5 else 0 end + case when {any_of(ENTITY_TERMS)} then 8 else 0 end + case when {any_of([*KEYWORD_TERMS, *fixed.PASSAGE_KEYWORDS])} then 4 else 0 end
      + case when regexp_matches(p, '{fixed.PASSAGE_AMOUNT_PATTERN}') then 6 else 0 end + case when regexp_matches(p, '{fixed.PASSAGE_DATE_PATTERN}') then 3 else 0 end
      + case when {any_of(fixed.SUMMARY_WORDS)} then 2 else 0 end"""
    return f"""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as ps from documents),
    e as (select doc_id, unnest(ps) as p, unnest(generate_series(0, len(ps) - 1)) as i from l),
    s as (select *, cast({score} as double) as score from e),
    k as (select *, row_number() over (partition by doc_id order by score desc, i) as rn from s where score > 0),
    c as (select *, sum(length(p)) over (partition by doc_id order by i) - length(p) as used from k where rn <= 7)
    select doc_id, 'p' || cast(i as varchar) as passage_id, score, substr(p, 1, cast(1500 - used as bigint)) as text from c where used < 1500"""


@query("F30 K6 W12", "", _passage_sql())
def selected_passages(v):
    """Best paragraphs of every document within 1500 characters."""
    d = v.table("documents").select("doc_id", F.col("text").alias("body"))
    entities = F.array(*[F.lit(t) for t in ENTITY_TERMS])
    rows = documents.select_passages(d, entities, [*KEYWORD_TERMS, *fixed.PASSAGE_KEYWORDS], fixed.MAX_PASSAGES, 1500)
    return explode_computed(rows, F.col("passages"), "p").select("doc_id", "p.*")


_TABLES = _passage_sql().replace("substr(p, 1, cast(1500 - used as bigint)) as text from c where used < 1500", "substr(p, 1, cast(1500 - used as bigint)) as text, i from c where used < 1500")


@query(
    "K6 W12 F30",
    "",
    f"""with sel as ({_TABLES}),
    b as (select doc_id, count(*) as n, sum(length(text)) as used from sel group by 1),
    d as (select doc_id, split_part(text, chr(10), 1) as title, list_slice(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1, 3) as tables from documents),
    t as (select doc_id, title, unnest(tables) as t, unnest(range(1, len(tables) + 1)) as ti from d),
    v as (select t.*, row_number() over (partition by doc_id order by ti) as rn, coalesce(sum(length(t)) over (partition by doc_id order by ti rows between unbounded preceding and 1 preceding), 0) + coalesce(b.used, 0) as before,
        coalesce(b.n, 0) + case when title <> '' then 1 else 0 end as places
      from t left join b using (doc_id) where regexp_matches(t, '{fixed.PASSAGE_AMOUNT_PATTERN}') or {" or ".join(f"contains(t, '{w}')" for w in [*ENTITY_TERMS, *KEYWORD_TERMS, *fixed.PASSAGE_KEYWORDS])})
    select doc_id, 'title' as passage_id, cast(null as double) as score, title as text from d where title <> ''
    union all select doc_id, passage_id, score, text from sel
    union all select doc_id, 't' || ti, null, substr(t, 1, cast(1500 - before as bigint)) from v where before < 1500 and places + rn <= 8""",
)
def page_passages(v):
    """Title, best paragraphs and relevant tables of every document, eight at most and within 1500 characters; the first three lines stand for tables."""
    lines = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    d = v.table("documents").select("doc_id", F.col("text").alias("body"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.slice(lines, 1, 3).alias("tables"))
    rows = documents.select_passages(d, F.array(*[F.lit(t) for t in ENTITY_TERMS]), [*KEYWORD_TERMS, *fixed.PASSAGE_KEYWORDS], fixed.MAX_PASSAGES, 1500)
    return explode_computed(rows, F.col("passages"), "p").select("doc_id", "p.*")


@query(
    "K6 W12",
    "",
    _passage_sql().split("select doc_id, 'p'")[0] + "select doc_id, count(*) as scoring, count(*) - count(*) filter (where rn <= 7 and coalesce(used, 1500) < 1500) as left_out from k left join (select doc_id, i, used from c) u using (doc_id, i) group by 1",
)
def passages_left_out(v):
    """How many scoring paragraphs of every document its limits leave out whole."""
    d = v.table("documents").select("doc_id", F.col("text").alias("body"))
    entities, words_ = F.array(*[F.lit(t) for t in ENTITY_TERMS]), [*KEYWORD_TERMS, *fixed.PASSAGE_KEYWORDS]
    rows = documents.select_passages(d, entities, words_, fixed.MAX_PASSAGES, 1500)
    counts = rows.select("doc_id", (F.size("passages") + F.col("passages_left_out")).cast("long").alias("scoring"), F.col("passages_left_out").cast("long").alias("left_out"))
    return counts.where("scoring > 0")


@query(
    "W13",
    "",
    """with recursive t as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) as n from documents),
    c(doc_id, n, i, chunk, size) as (select doc_id, n, 1, 1, n[1] from t union all
      select doc_id, n, i + 1, case when size > 0 and size + n[i + 1] > 800 then chunk + 1 else chunk end, case when size > 0 and size + n[i + 1] > 800 then n[i + 1] else size + n[i + 1] end from c where i < len(n))
    select doc_id, chunk, count(*) as passages, cast(sum(n[i]) as bigint) as chars from c where chunk <= 3 group by 1, 2""",
)
def passage_chunks(v):
    chunks = documents.chunk_passages(F.split("text", "\n"), 800, fixed.MAX_CHUNKS)
    rows = explode_computed(v.table("documents"), chunks, "c").select("doc_id", "c.*")
    return rows.groupBy("doc_id", "chunk").agg(F.count("*").alias("passages"), F.sum("size").alias("chars"))


# --- query plan ----------------------------------------------------------------------------

TEMPLATES = [
    ("official_ir", 90.0, "{company} 公告"),
    ("orders_tender", 85.0, "{company} {product} 中标"),
    ("operating", 30.0, "{product} 库存"),
    ("source_pack:policy", 88.0, "site:gov.cn {industry} 政策"),
    ("customers", 40.0, "{customer} 订单"),
    ("alt", 20.0, "行业 招聘"),
]


def _planned(v):
    p, key = v.parts(), F.col("p_partkey")
    none = F.array().cast("array<string>")
    targets = p.select(
        key.alias("target_id"),
        F.create_map(
            F.lit("company"), F.array("p_name"),
            F.lit("product"), F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), lambda i: F.concat(F.col("p_brand"), F.lit("-"), i.cast("string"))),
            F.lit("industry"), F.array("p_type"),
            F.lit("customer"), F.when(key % 2 == 0, F.array(F.lit("客户"))).otherwise(none),
        ).alias("values"),
        F.array("p_name", "p_brand").alias("terms"),
    )
    expanded = documents.expand_templates(targets, TEMPLATES, fixed.QUERY_VALUES_PER_PLACEHOLDER, fixed.QUERY_RESULTS_PER_TEMPLATE)
    scored = documents.score_queries(expanded, F.col("terms"))
    return scored


_PLAN_SQL = """
with p as (select p_partkey, p_name, p_brand, p_type, list_transform(range(0, least(p_partkey % 4, 2) + 1), lambda i: p_brand || '-' || cast(i as varchar)) as prods from part),
q as (select p_partkey, p_name, p_brand, 'official_ir' as f, 90.0::double as b, p_name || ' 公告' as t from p
  union all select p_partkey, p_name, p_brand, 'orders_tender', 85, p_name || ' ' || unnest(prods) || ' 中标' from p
  union all select p_partkey, p_name, p_brand, 'operating', 30, unnest(prods) || ' 库存' from p
  union all select p_partkey, p_name, p_brand, 'source_pack:policy', 88, 'site:gov.cn ' || p_type || ' 政策' from p
  union all select p_partkey, p_name, p_brand, 'customers', 40, '客户 订单' from p where p_partkey % 2 = 0
  union all select p_partkey, p_name, p_brand, 'alt', 20, '行业 招聘' from p),
s as (select *, b + 12 * (case when contains(t, p_name) then 1 else 0 end + case when contains(t, p_brand) then 1 else 0 end)
   + case when regexp_matches(t, '订单|合同|中标|金额|价格|涨价|降价|产能|销量|出货|库存|毛利率|处罚|投产') then 8 else 0 end
   + case when f like 'source_pack:%' then 6 else 0 end + case when regexp_matches(t, '公告|中标|涨价|处罚|投产|业绩') then 5 else 0 end as score from q)
"""


@query("J22 F29 F44", "v_hits", _PLAN_SQL + "select p_partkey as target_id, f as query_family, t as query_text, cast(score as double) as score from s")
def planned_queries(v):
    return _planned(v).select("target_id", "query_family", "query_text", "score")


@query(
    "K4",
    "v_hits",
    _PLAN_SQL
    + "select p_partkey as target_id, t as query_text, cast(score as double) as score from (select *, row_number() over (partition by p_partkey order by score desc, t) as rn from s where score >= 45) where rn <= 3",
)
def executable_queries(v):
    good = _planned(v).where(F.col("score") >= fixed.QUERY_MIN_SCORE)
    return documents.top_per_group(good, ["target_id"], [F.desc("score"), F.col("query_text")], 3).select("target_id", "query_text", "score")


@query(
    "J35 U4",
    "",
    """with f as (select s_suppkey as target_id, n_name as family, s_suppkey % 25 = n_nationkey or (s_suppkey % 7 = n_regionkey and n_nationkey % 2 = 0) as hit from supplier join nation on s_nationkey % 5 = n_regionkey)
    select target_id, family from f x where hit or not exists (select 1 from f y where y.target_id = x.target_id and y.hit)""",
)
def selected_families(v):
    rows = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") % 5 == F.col("n_regionkey"))
    own = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    families = rows.select(
        F.col("s_suppkey").alias("target_id"),
        F.col("n_name").alias("family"),
        own.alias("focus"),
        F.array(F.concat(F.lit("r"), (F.col("s_suppkey") % 7).cast("string"))).alias("requested"),
        F.when(F.col("s_suppkey") % 25 == F.col("n_nationkey"), F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("served"),
    )
    return documents.select_families(families).select("target_id", "family")

