"""One registered query per operator, over whole tables with production parameters, and SQL checks."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import balltree, codes, decontaminate, jaccard, licenses, lm_score, packing, quality, simhash, tokens, topk, toxicity, warc
from marketloom.llm.common import table

#: From this size on equal payloads become revisits.
REVISIT_BYTES = 0


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_counts(table(spark, sf_dir, "documents"))


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from the two labels: 0 junk, 1 sound but toxic, 2 sound and not toxic."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = quality.score(docs, quality.fit(docs, grades(table(spark, sf_dir, "labels"))))
    return rated.withColumn("kept", F.coalesce(F.get("tail_probability", F.lit(0)) >= 0.5, F.lit(True)))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar(table(spark, sf_dir, "documents"), Fraction(9, 10), 3)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(spark)
    warc.write(pages, folder, minimum_bytes=REVISIT_BYTES)
    revisit = F.col("kind") == "revisit"
    return warc.read(spark, folder).select(
        F.col("key").alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, F.col("refers_to_key")).alias("refers_to"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=~toxicity.held_out()))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return lm_score.score(table(spark, sf_dir, "documents"), targets)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality, op3_ngram_jaccard, op4_exact_topk, op5_packing,
        op6_decontamination, op7_warc, op8_toxicity, op9_lm_score, op10_licenses, op11_simhash, op12_vector_codes, op13_ranked_search,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(source: str, key: str, width: int, pattern: str) -> str:
    """SQL of the distinct shingles (key, s) of a table's texts."""
    return f"""
      select distinct {key}, unnest(case when len(w) >= {width}
          then list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' '))
          when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
      from (select {key}, regexp_extract_all({_LOWER}, '{pattern}') as w from {source})"""


def _codebook_sql() -> str:
    """SQL of op12: four rounds of nearest entries and floored means, with a table of parts and one of entries a round."""
    nearest = """
      a{k} as (
        select r, p.part, min(cast(list_inner_product(p.t, p.t) - 2 * list_inner_product(p.t, c.t) + list_inner_product(c.t, c.t) as bigint)
          * 256 + entry) as best
        from p join c{k} c on p.part = c.part group by 1, 2)"""
    moved = """
      m{n} as (
        select part, entry, list(x order by place) as t
        from (
          select part, entry, place, floor(sum(x) / count(*)) as x
          from (select a.part, best % 256 as entry, generate_subscripts(t, 1) as place, unnest(t) as x from a{k} a join p using (r, part))
          group by 1, 2, 3)
        group by 1, 2),
      c{n} as (select part, entry, coalesce(m.t, c.t) as t from c{k} c left join m{n} m using (part, entry))"""
    rounds = ",".join(nearest.format(k=k) + "," + moved.format(k=k, n=k + 1) for k in range(4))
    return f"""
      with v as (
        select row_number() over (order by vec_id, embedding) as r, vec_id, label,
          list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as t
        from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
      p as materialized (select r, part, list_slice(t, part * (len(t) // 4) + 1, (part + 1) * (len(t) // 4)) as t from v, range(4) g(part)),
      c0 as (select part, r - 1 as entry, t from p where r <= 256),{rounds},{nearest.format(k=4)},
      e as (
        select r, string_agg(format('{{:02x}}', best % 256), '' order by part) as code, cast(sum(best // 256) as bigint) as error
        from a4 group by 1)
      select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
        (select sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by part, entry, place))
         from (select part, entry, generate_subscripts(t, 1) as place, unnest(t) as x from c4)) as codebooks_sha256
      from v join e using (r)"""


_TERMS = f"unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"

SQL = {
    "op13_ranked_search": f"""
      with d as (
        select r, doc_id, term, count(*) as tf
        from (select r, doc_id, {_TERMS} as term from (select *, row_number() over () as r from documents)) group by 1, 2, 3),
      n as (select r, sum(tf) as n from d group by 1),
      g as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from n),
      w as (
        select term, cast(floor(1000 * ln(cast(2 * max(n_docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as w
        from d, g group by 1),
      x as (
        select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * cast(n as bigint) * n_docs) // n_terms))) as x
        from d join n using (r) join w using (term), g),
      q as (select distinct i, item_id, term from (select i, item_id, {_TERMS} as term from (select *, row_number() over () as i from benchmark))),
      s as (select i, item_id, doc_id, r, cast(sum(x) as bigint) as score from q join x using (term) group by 1, 2, 3, 4),
      o as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from s where score > 0)
      select item_id, cast(rank as integer) as rank, doc_id, score from o where rank <= 50""",
    "op12_vector_codes": _codebook_sql(),
    "op4_exact_topk": """
      with v as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as t
        from embeddings
        where vec_id is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
      e as (select vec_id, generate_subscripts(t, 1) as d, unnest(t) as x from v),
      s as (
        select q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
        from e q join e c on q.d = c.d and q.vec_id <> c.vec_id where q.vec_id % 20 = 0 group by 1, 2),
      r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
      select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20""",
    "op6_decontamination": f"""
      with d as ({_shingles("documents", "doc_id", 5, "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")}),
      b as ({_shingles("benchmark", "item_id", 5, "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")}),
      n as (select item_id, count(*) as n_item from b group by 1),
      m as (select doc_id, item_id, count(*) as n_shared from d join b using (s) group by 1, 2)
      select doc_id, item_id, n_shared, n_item, cast(n_shared as double) / n_item as containment
      from m join n using (item_id) where 5 * n_shared >= 4 * n_item""",
}
