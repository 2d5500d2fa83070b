"""Queries on extraction bundles, model contributions, relations and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions import text
from marketloom.functions.numbers import round_half_up
from marketloom.operators import extraction
from marketloom.plans.registry import query, r
from marketloom.plans.views import cycle

KINDS = ["facts", "events", "risks"]


@query(
    "S15 W15",
    "v_turns",
    """select link_id, kind, position, seq, statement, passage_id, confidence from v_turns
    where position < case kind when 'facts' then 10 when 'events' then 5 else 5 end""",
)
def bundle_objects(v):
    """Objects of every bundle on their own rows, capped per kind."""
    b = v.bundles()
    parts = None
    for kind in KINDS:
        capped = b.withColumn(kind, extraction.cap_items(F.col(kind), fixed.OBJECT_CAPS[kind]))
        rows = extraction.explode_objects(capped, kind).withColumn("kind", F.lit(kind)).drop("object_id")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.withColumn("position", F.col("position").cast("long"))


@query(
    "S15",
    "v_turns",
    "select kind, count(*) as n, count(distinct link_id) as links from v_turns group by 1",
)
def bundle_json_objects(v):
    """Bundles written as JSON text, parsed back with an explicit schema, and exploded."""
    b = v.bundles()
    item = "array<struct<seq:bigint,statement:string,passage_id:string,confidence:double>>"
    body = b.select("link_id", F.to_json(F.struct(*KINDS)).alias("body"))
    parsed = body.select("link_id", F.from_json("body", ", ".join(f"{k} {item}" for k in KINDS)).alias("p")).select("link_id", "p.*")
    parts = None
    for kind in KINDS:
        rows = extraction.explode_objects(parsed, kind).select("link_id", F.lit(kind).alias("kind"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("link_id").alias("links"))


def _claims_sql() -> str:
    return f"""with passages as (select link_id, 'p' || cast(i as varchar) as passage_id, string_agg(statement, ' ' order by seq, statement) as text
        from v_turns, (values (0), (1), (2), (3), (4)) x(i) where kind = 'events' and passage_id = 'p' || cast(i as varchar) group by 1, 2),
      c as (select f.link_id, f.seq, f.passage_id, f.statement as claimed, f.confidence, p.text, p.passage_id is not null as known,
              f.link_id in (select link_id from passages) as has
            from v_turns f left join passages p on p.link_id = f.link_id and p.passage_id = f.passage_id where f.kind = 'facts')
    select link_id, seq, case when has and not known then null else passage_id end as passage_id, claimed,
      case when has and not known then case when confidence > 0.3::double then {r("confidence * 0.7::double", 3)} else confidence end
           when known and claimed <> '' and not contains(text, claimed) then case when confidence > 0.25::double then {r("confidence * 0.6::double", 3)} else confidence end
           else confidence end as confidence,
      case when has and not known then 'passage_id_cleared' when known and claimed <> '' and not contains(text, claimed) then 'value_not_in_passage' end as evidence_warning
    from c"""


@query("J24", "v_turns", _claims_sql())
def checked_evidence(v):
    """Facts of a conversation against the passages its user turns make up."""
    b = v.bundles()
    user = extraction.explode_objects(b, "events")
    passages = (
        user.groupBy("link_id", "passage_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "statement"))), lambda x: x["statement"]), " ").alias("text"))
    )
    claims = extraction.explode_objects(b, "facts").select(
        "link_id", "seq", "passage_id", F.col("statement").alias("claimed"), "confidence"
    )
    return extraction.check_evidence(claims, passages)


@query(
    "A35 A38",
    "v_turns",
    """with c as (select run_id, count(distinct link_id) as briefs, count(*) filter (where kind = 'facts') as facts, count(*) filter (where kind = 'events') as events,
      count(*) filter (where kind = 'risks') as risks from v_turns group by 1) select *, case when events > 0 and facts = 0 then 'missing_amount' end as gap_type from c""",
)
def run_tallies(v):
    return extraction.run_tally(v.bundles(), KINDS, "run_id")


@query(
    "J19 W15",
    "v_turns",
    """select run_id, 'source_links' as kind, count(distinct link_id) as rows from v_turns group by 1
    union all select run_id, 'merged_analysis', count(distinct link_id) from v_turns where decision <> 'skip' group by 1
    union all select run_id, kind, count(*) from v_turns where kind <> 'risks' group by 1, 2""",
)
def rows_per_run(v):
    b = v.bundles()
    links = b.select("link_id", "run_id")
    children = {k: extraction.explode_objects(b, k) for k in ("facts", "events")}
    return extraction.rows_per_run(links, b.where("decision <> 'skip'"), children)


@query(
    "J29",
    "v_turns",
    """select distinct link_id, 'source' as section, cast(0 as bigint) as position, run_id as text from v_turns
    union all select link_id, kind, position, statement from v_turns where kind <> 'risks'""",
)
def explained_sources(v):
    b = v.bundles()
    sections = {k: extraction.explode_objects(b, k).select("link_id", "position", F.col("statement").alias("text")) for k in ("facts", "events")}
    rows = extraction.explain_links(b.select("link_id", F.col("run_id").alias("text")), sections)
    return rows.withColumn("position", F.col("position").cast("long"))


@query(
    "A36",
    "v_turns",
    """with c as (select link_id, count(*) filter (where kind = 'facts') as f, count(*) filter (where kind = 'events') as e, count(*) filter (where kind = 'risks') as k, max(decision) as d from v_turns group by 1)
    select link_id, cast(f * 10 as bigint) as rows_fetched, cast(e as int) as inline_bars, k > 0 as high_conflict, 0.5::double as data_quality, d <> 'skip' and k = 0 as usable from c""",
)
def response_facts(v):
    b = v.bundles()
    status = F.when(F.col("decision") == "skip", "failed").otherwise("success")
    body = F.to_json(
        F.struct(
            status.alias("status"),
            F.struct(F.lit(True).alias("saved")).alias("persistence"),
            F.transform("facts", lambda _: F.struct(F.lit(10).alias("rows_fetched"))).alias("provider_results"),
            F.struct(
                F.lit(0.5).alias("data_quality_score"), F.transform("risks", lambda _: F.struct(F.lit("critical").alias("severity"))).alias("conflicts")
            ).alias("quality_report"),
            F.struct(F.transform("events", lambda e: e["statement"]).alias("bars")).alias("data"),
        )
    )
    return extraction.response_facts(b.select("link_id", body.alias("body")), "body").drop("body")


@query(
    "F37",
    "",
    """select conv_id, turn, role, case when length(text) % 3 = 2 then null else cast(turn as int) end as turn_back from conversations""",
)
def recovered_json(v):
    c = v.table("conversations")
    plain = F.to_json(F.struct("turn"))
    n = F.length("text") % 3
    output = F.when(n == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here it is: "), plain)).otherwise("no json")
    rows = c.withColumn("_j", text.recovered_json(output))
    return rows.select("conv_id", "turn", "role", F.get_json_object("_j", "$.turn").cast("int").alias("turn_back"))


# --- contributions -------------------------------------------------------------------------


@query("A19", "v_weighted", f"select link_id, event_id, family, {r('effective_weight', 8)} as effective_weight from v_weighted")
def effective_weights(v):
    w = extraction.effective_weights(v.contributions())
    return w.select("link_id", "event_id", "family", round_half_up(F.col("effective_weight"), 8).alias("effective_weight"))


_VOTE = """
vote as (select link_id, cast(sum(cast(effective_weight as decimal(28,12)) * case decision when 'save_structured' then 1.0 when 'link_only' then 0.5 else 0.0 end) as double)
       / nullif(cast(sum(cast(effective_weight as decimal(28,12))) as double), 0) as s, count(*) as contributions, count(distinct decision) as decisions,
       max(confidence) - min(confidence) as spread from v_weighted group by 1)"""


@query(
    "A20 A22",
    "v_weighted",
    f"""with {_VOTE} select link_id, contributions, decisions, {r("s", 6)} as decision_score,
      case when s >= 0.65::double then 'save_structured' when s >= 0.35::double then 'link_only' else 'skip' end as decision,
      case when decisions > 1 and spread > 0.4::double then 'high' when decisions > 1 then 'medium' else 'low' end as disagreement from vote""",
)
def weighted_votes(v):
    votes = extraction.vote(extraction.effective_weights(v.contributions()))
    level = extraction.disagreement(F.col("decisions"), F.lit(0), F.col("confidence_spread"))
    return votes.select("link_id", "contributions", "decisions", "decision_score", "decision", level.alias("disagreement"))


def _median(value: str, digits: int) -> str:
    return f"""select link_id, {r(f"min({value})", digits)} as {value} from (select link_id, {value}, sum(cast(effective_weight as decimal(28,12))) over (partition by link_id order by {value}) as acc,
      sum(cast(effective_weight as decimal(28,12))) over (partition by link_id) as total from v_weighted where effective_weight > 0) where acc >= total / 2 group by 1"""


@query("A21", "v_weighted", f"select * from ({_median('overall_score', 1)}) a full join ({_median('confidence', 3)}) b using (link_id)")
def weighted_medians(v):
    return extraction.merge_scores(extraction.effective_weights(v.contributions()))


@query(
    "P30",
    "v_weighted",
    f"""with {_VOTE}, m as (select * from ({_median("overall_score", 1)}))
    select link_id, overall_score, case when s >= 0.65::double and overall_score < 70 then 'link_only' when s >= 0.65::double then 'save_structured' when s >= 0.35::double then 'link_only' else 'skip' end as decision,
      cast(case when s >= 0.65::double and overall_score >= 70 then 5 when s < 0.35::double then 5 else 0 end as int) as kept_facts from vote join m using (link_id)""",
)
def gated_decisions(v):
    weighted = extraction.effective_weights(v.contributions())
    both = extraction.vote(weighted).select("link_id", F.col("decision").alias("_d")).join(extraction.merge_scores(weighted), "link_id")
    gated = both.withColumn("decision", extraction.decision_gate(F.col("_d"), F.col("overall_score")))
    kept = extraction.kept_items(F.col("decision"), F.sequence(F.lit(1), F.lit(5)), fixed.OBJECT_CAPS["facts"])
    return gated.select("link_id", "overall_score", "decision", F.size(kept).alias("kept_facts"))


@query(
    "W2",
    "v_contrib",
    """select link_id, model_config_id, event_id, confidence from (select *, row_number() over (partition by link_id, model_config_id order by confidence desc, event_id) as rn from v_contrib) where rn = 1""",
)
def most_confident_objects(v):
    rows = v.contributions().select("link_id", "model_config_id", "event_id", "confidence")
    return extraction.keep_most_confident(rows, ["link_id", "model_config_id"], ["event_id"])


@query(
    "W3",
    "v_contrib",
    "select link_id, decision, min(event_id) as event_id from v_contrib group by 1, 2",
)
def earliest_objects(v):
    return extraction.keep_first(v.contributions().select("link_id", "decision", "event_id"), ["link_id", "decision"], ["event_id"])


@query(
    "A23",
    "v_weighted",
    f"""with e as (select w.*, w.model_config_id as event_type, lower(trim(case when w.event_id % 2 = 0 then ' Acme' else 'acme' end)) as counterparty_key, floor(w.overall_score / 50) * 50 as amount,
        ['up', 'up', 'down'][cast(w.event_id % 3 as int) + 1] as direction from v_weighted w),
    c as (select link_id, event_type, counterparty_key, max_by(event_id, (effective_weight, -event_id)) as base_event_id, count(*) as members,
        min(amount) <> max(amount) as ac, min(direction) <> max(direction) as dc, min(direction) as d from e group by 1, 2, 3),
    a as (select link_id, event_type, min(amount) as amount from (select *, sum(cast(effective_weight as decimal(28,12))) over (partition by link_id, event_type order by amount) as acc,
        sum(cast(effective_weight as decimal(28,12))) over (partition by link_id, event_type) as total from e where effective_weight > 0) where acc >= total / 2 group by 1, 2),
    f as (select link_id, event_type, min(confidence) as confidence from (select *, sum(cast(effective_weight as decimal(28,12))) over (partition by link_id, event_type order by confidence) as acc,
        sum(cast(effective_weight as decimal(28,12))) over (partition by link_id, event_type) as total from e where effective_weight > 0) where acc >= total / 2 group by 1, 2)
    select link_id, event_type, counterparty_key, base_event_id, members, amount, confidence, case when dc then 'mixed' else d end as direction,
      cast(ac as int) + cast(dc as int) as conflicts, case when ac then 'conflicting' else 'single_source' end as corroboration
    from c left join a using (link_id, event_type) left join f using (link_id, event_type)""",
)
def clustered_events(v):
    w = extraction.effective_weights(v.contributions())
    rows = w.select(
        "link_id",
        F.col("model_config_id").alias("event_type"),
        F.when(F.col("event_id") % 2 == 0, " Acme").otherwise("acme").alias("counterparty"),
        "event_id",
        (F.floor(F.col("overall_score") / 50) * 50).cast("double").alias("amount"),
        cycle(F.col("event_id"), ["up", "up", "down"]).alias("direction"),
        "confidence",
        "effective_weight",
    )
    return extraction.cluster_events(rows)


# --- relations -----------------------------------------------------------------------------

_KEYS = """k as (select *, case when coalesce(subject_ticker, '') <> '' then 'ticker:' || lower(trim(subject_ticker)) else 'name:' || lower(trim(subject_name)) end as subject_key,
    'name:' || lower(trim(object_name)) as object_key from v_rel where not regexp_matches(object_name, '多家|若干|部分|相关|一批|数家|各大|多个|某|等企业|等公司|等厂商'))"""


def _keyed(v):
    none = F.lit(None).cast("string")
    rel = v.relations()
    clear = rel.where(
        ~extraction.is_vague(F.col("subject_name"), F.col("subject_ticker")) & ~extraction.is_vague(F.col("object_name"), none)
    )
    return clear.withColumn("subject_key", extraction.identity_key(F.col("subject_name"), F.col("subject_ticker"))).withColumn(
        "object_key", extraction.identity_key(F.col("object_name"), none)
    )


@query(
    "P21 P22 A25",
    "v_rel",
    f"""with {_KEYS} select subject_key, relation_type, object_key, max_by(relation_id, (confidence, -relation_id)) as relation_id, max(confidence) as confidence, count(distinct link_id) as source_links
    from k group by 1, 2, 3""",
)
def corroborated_relations(v):
    return extraction.corroborated_relations(_keyed(v))


@query(
    "A24",
    "v_rel",
    f"""with {_KEYS} select subject_key, object_key, product, string_agg(distinct relation_type, ',' order by relation_type) as relation_types from k group by 1, 2, 3
    having bool_or(relation_type = 'customer_of') and bool_or(relation_type = 'supplier_of')""",
)
def relation_conflicts(v):
    found = extraction.relation_conflicts(_keyed(v))
    return found.select("subject_key", "object_key", "product", F.array_join("relation_types", ",").alias("relation_types"))


@query(
    "A24 W2",
    "v_rel",
    f"""with {_KEYS}, best as (select subject_key, relation_type, object_key, product, max_by(relation_id, (confidence, -relation_id)) as relation_id from k group by 1, 2, 3, 4),
    bad as (select subject_key, object_key, product from k group by 1, 2, 3 having bool_or(relation_type = 'customer_of') and bool_or(relation_type = 'supplier_of'))
    select relation_type, case when relation_type in ('customer_of', 'supplier_of') and (subject_key, object_key, product) in (select (subject_key, object_key, product) from bad) then 'needs_arbitration' end as resolution_status,
      count(*) as n from best group by 1, 2""",
)
def merged_relations(v):
    keyed = _keyed(v).select("subject_key", "relation_type", "object_key", "product", "relation_id", "confidence")
    best = extraction.keep_most_confident(keyed, ["subject_key", "relation_type", "object_key", "product"], ["relation_id"])
    flagged = extraction.flag_conflicting_relations(best, extraction.relation_conflicts(keyed))
    return flagged.groupBy("relation_type", "resolution_status").agg(F.count("*").alias("n"))


@query(
    "P20",
    "",
    """with p as (select l_orderkey, ['A 向 B 供货', '采购', ' partner_of ', 'friend', '从B买'][cast(l_linenumber % 5 as int) + 1] as t from lineitem),
    n as (select case when contains(t, '向') and contains(t, '供货') then 'supplier_of' when contains(t, '采购') or contains(t, '从') then 'customer_of' else trim(t) end as relation_type from p)
    select relation_type, case when relation_type = 'friend' then 'relation_type_not_in_enum' end as error, count(*) as n from n group by 1""",
)
def normalised_relation_types(v):
    phrase = cycle(F.col("l_linenumber"), ["A 向 B 供货", "采购", " partner_of ", "friend", "从B买"])
    rows = v.table("lineitem").select(extraction.relation_type(phrase).alias("relation_type"))
    error = extraction.relation_type_error(F.col("relation_type"))
    return rows.groupBy("relation_type", error.alias("error")).agg(F.count("*").alias("n"))


def _feedback_sql(key: str) -> str:
    return f"""select {key}, count(*) as rows, count(*) filter (where quality = 1 or (toxic = 0 and quality = 1)) as good,
     {r("0.5::double + 0.7::double * (count(*) filter (where quality = 1 or (toxic = 0 and quality = 1)) / cast(count(*) as double))", 3)} as multiplier
     from labels join documents using (doc_id) group by 1"""


def _feedback(v):
    return (
        v.table("labels")
        .join(v.table("documents").select("doc_id", "source", "lang"), "doc_id")
        .select("source", "lang", (F.col("quality") == 1).alias("correct"), ((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("useful"))
    )


@query("A18", "", _feedback_sql("source"))
def feedback_by_source(v):
    return extraction.feedback_multiplier(_feedback(v), "source")


@query("A18", "", _feedback_sql("lang"))
def feedback_by_language(v):
    return extraction.feedback_multiplier(_feedback(v), "lang")


