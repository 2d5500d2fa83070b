"""Search hits, source links, pages and passages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions import urls
from marketloom.functions.numbers import any_contains, contained, lookup, round_half_up
from marketloom.operators.hotkeys import explode_computed, first_by_key, latest_by_key, mark_first, running_total


def score_hits(
    hits: DataFrame, terms: Column, strong: Sequence[str] = fixed.STRONG_KEYWORDS, feedback: dict[str, float] | None = None
) -> DataFrame:
    """Source type, score and signals of search hits, without their texts.

    ``hits`` has title, snippet, domain, rank and query_family; ``terms`` is an array column of the
    target's entity terms. All of it is row-local, so texts end here and are never shuffled.
    """
    text = F.col("_text")
    entities = F.size(F.filter(terms, lambda t: (t != "") & F.contains(text, t)))
    strong_hits = F.size(contained(text, strong))
    amount = text.rlike(fixed.AMOUNT_PATTERN)
    found = {w: F.contains(text, F.lit(w)) for w in fixed.TRIAGE_KEYWORDS}
    kind = F.col("source_type")
    credible = kind.isin(fixed.HIGH_CREDIBILITY)
    base = (
        F.when(F.col("_entities") > 0, 30.0 + 5.0 * F.least(F.col("_entities"), F.lit(3))).otherwise(0.0)
        + F.when(F.col("_amount"), 20.0).otherwise(0.0)
        + 6.0 * F.least(F.col("_strong"), F.lit(4))
        + 6.0 * F.size("_keywords")
        + F.when(credible, 20.0).when(kind == "company", 10.0).otherwise(0.0)
        + F.greatest(F.lit(0), 10 - F.col("rank"))
        + F.when(F.coalesce("query_family", F.lit("")).startswith("source_pack:"), 8.0).otherwise(0.0)
    )
    weight = lookup(kind, feedback, F.lit(1.0)) if feedback else F.lit(1.0)
    keywords = F.filter(F.array(*[F.when(found[w], s) for w, s in fixed.TRIAGE_KEYWORDS.items()]), lambda s: s.isNotNull())
    signals = F.concat(
        F.filter(
            F.array(
                F.when(F.col("_entities") > 0, "target_entity_match"),
                F.when(F.col("_amount"), "amount_mentioned"),
                F.when(F.col("_strong") > 0, "strong_fact_keyword"),
            ),
            lambda s: s.isNotNull(),
        ),
        F.col("_keywords"),
        F.when(credible, F.array(F.lit("high_credibility_source"))).otherwise(F.array().cast("array<string>")),
    )
    kept = [c for c in hits.columns if c not in ("title", "snippet")]
    return (
        hits.withColumn("_text", F.concat_ws(" ", "title", "snippet"))
        .select(
            *kept,
            urls.source_type(F.col("domain")).alias("source_type"),
            entities.alias("_entities"),
            strong_hits.alias("_strong"),
            amount.alias("_amount"),
            keywords.alias("_keywords"),
        )
        .select(*kept, "source_type", (base * weight).alias("score"), signals.alias("matched_signals"))
    )


def decide_hits(scored: DataFrame) -> DataFrame:
    """Read priority, decision and model need of scored hits that know whether they are duplicates."""
    score = F.col("score")
    signal = F.when(F.col("is_duplicate"), F.array(F.lit("duplicate_url"))).otherwise(F.array().cast("array<string>"))
    return (
        scored.withColumn("matched_signals", F.concat("matched_signals", signal))
        .withColumn("read_priority", round_half_up(score, 2))
        .withColumn(
            "triage_decision",
            F.when(F.col("is_duplicate"), "link_record_only")
            .when(score >= fixed.TRIAGE_READ, "read")
            .when(score >= fixed.TRIAGE_RECORD, "link_record_only")
            .otherwise("skip_for_now"),
        )
        .withColumn("need_model", (F.col("triage_decision") == "read") & (score >= fixed.TRIAGE_MODEL))
        .drop("score")
    )


def triage(
    hits: DataFrame, terms: Column, strong: Sequence[str] = fixed.STRONG_KEYWORDS, feedback: dict[str, float] | None = None
) -> DataFrame:
    """Score, signals and decision of hits that carry an ``is_duplicate`` flag."""
    return decide_hits(score_hits(hits, terms, strong, feedback))


def call_trigger(need_model: Column, signals: Column, source_type: Column) -> Column:
    """First reason for which a model is called on a link, null when none applies."""
    relation = F.arrays_overlap(signals, F.array(*[F.lit(s) for s in fixed.RELATION_SIGNALS]))
    return F.coalesce(
        F.when(need_model, "rule_score_between"),
        F.when(F.array_contains(signals, "amount_mentioned"), "contains_metric_or_amount"),
        F.when(F.array_contains(signals, "strong_fact_keyword"), "high_value_keyword_matched"),
        F.when(relation, "contains_relation_signal"),
        F.when(source_type.isin(fixed.MODEL_SOURCE_TYPES), "source_type_in"),
    )


def task_route(source_type: Column, materiality: Column, types: Sequence[str], threshold: float) -> Column:
    parallel = source_type.isin(list(types)) & (materiality >= threshold)
    return F.when(parallel, "high_value_parallel_analysis").otherwise("bundle_extraction")


def mark_duplicates(links: DataFrame, key: str, order: str) -> DataFrame:
    """Flag rows whose key was already seen earlier in arrival order."""
    flagged = mark_first(links, [key], order, "_first")
    return flagged.withColumn("is_duplicate", ~F.col("_first")).drop("_first")


def within_budget(hits: DataFrame, run: str, order: Sequence[str], block: Column, budget: int) -> DataFrame:
    """Keep the running prefix of every run that fits the budget."""
    counted = running_total(hits, [run], order, F.lit(1), block, "hit_number")
    return counted.where(F.col("hit_number") <= budget)


def skipped_by_budget(hits: DataFrame, run: str, budget: int) -> DataFrame:
    return hits.groupBy(run).agg(F.greatest(F.lit(0), F.count("*") - budget).cast("long").alias("skipped"))


def reusable_analysis(links: DataFrame, analyses: DataFrame, key: str, exclude: str = "run_id") -> DataFrame:
    """For each link the latest analysed link with the same key and target.

    ``exclude`` names what may not be reused: the link's own run (``run_id``, the rule for canonical URLs)
    or only the link itself (``link_id``, the rule for content hashes). A (key, target) may hold any
    number of analysed links. The latest of each run or link, and of these the two latest, are enough:
    the answer is one of the two.
    """
    analysed = (
        analyses.join(links.select("link_id", "run_id", key), "link_id")
        .select(key, "target_id", F.col(exclude).alias("_own"), F.struct("analysed_at", "link_id").alias("_a"))
        .where(F.coalesce(F.col(key), F.lit("")) != "")
    )
    group = [key, "target_id"]
    per_own = analysed.groupBy(*group, "_own").agg(F.max("_a").alias("_a"))
    newest = per_own.groupBy(*group).agg(F.max(F.struct("_a", "_own")).alias("_top"))
    runner_up = per_own.join(newest, group).where(F.col("_own") != F.col("_top._own")).groupBy(*group).agg(F.max("_a").alias("_second"))
    choices = newest.join(runner_up, group, "left")
    prior = F.when(F.col("_top._own") != F.col(exclude), F.col("_top._a")).otherwise(F.col("_second"))
    return links.join(choices, group, "left").withColumn("reused_link_id", prior["link_id"]).drop("_top", "_second")


def clone_rows(children: DataFrame, latest: DataFrame, reuse: DataFrame) -> DataFrame:
    """Child rows of each reused link's latest analysis, copied under the new link."""
    current = latest_by_key(latest.select("link_id", "analysed_at", "analysis_id"), ["link_id"], ["analysed_at"])
    pairs = reuse.where("reused_link_id is not null").select(
        F.col("link_id").alias("new_link_id"), F.col("reused_link_id").alias("link_id")
    )
    source = children.join(current.select("link_id", "analysis_id"), ["link_id", "analysis_id"], "left_semi")
    copied = pairs.join(source, ["link_id"])  # a hot earlier link is split at run time
    return copied.drop("link_id").withColumnRenamed("new_link_id", "link_id").withColumn("merge_method", F.lit("cache_reuse"))


def passage_score(paragraph: Column, index: Column, entities: Column, keywords: Sequence[str]) -> Column:
    """Points of one paragraph; ``entities`` is an array of the target's own terms."""

    def points(test: Column, value: float) -> Column:
        return F.when(test, value).otherwise(0.0)

    return (
        points(index == 0, 5.0)
        + points(F.exists(entities, lambda t: (t != "") & F.contains(paragraph, t)), 8.0)
        + points(any_contains(paragraph, keywords), 4.0)
        + points(paragraph.rlike(fixed.PASSAGE_AMOUNT_PATTERN), 6.0)
        + points(paragraph.rlike(fixed.PASSAGE_DATE_TEST), 3.0)
        + points(any_contains(paragraph, fixed.SUMMARY_WORDS), 2.0)
    )


_PASSAGE = "struct<passage_id:string,score:double,text:string>"


def _fit(found: Column, start: Column, budget: int | None) -> Column:
    """Passages of an array cut to what is left of a budget: the passages, and how much of it is used."""
    none = F.array().cast(f"array<{_PASSAGE}>")

    def add(acc: Column, s: Column) -> Column:
        room = F.length(s["text"]) if budget is None else F.lit(budget) - acc["used"]
        text = s["text"] if budget is None else F.substring(s["text"], F.lit(1), room)
        kept = F.concat(acc["kept"], F.array(F.struct(s["passage_id"].alias("passage_id"), s["score"].alias("score"), text.alias("text"))))
        used = acc["used"] + F.length(s["text"]) if budget is None else F.least(F.lit(budget), acc["used"] + F.length(s["text"]))
        grown = F.struct(kept.alias("kept"), used.alias("used"))
        return grown if budget is None else F.when(acc["used"] >= budget, acc).otherwise(grown)

    return F.aggregate(found, F.struct(none.alias("kept"), start.alias("used")), add)


def select_passages(pages: DataFrame, entities: Column, keywords: Sequence[str], limit: int | None = None, budget: int | None = None) -> DataFrame:
    """Title, best paragraphs in document order and relevant tables of every page, as one array ``passages`` per page.

    ``pages`` has ``body`` and may have ``title`` and ``tables`` (an array of texts). Of the paragraphs that score, the
    best ``limit`` less one stay, as one place is the title's; tables fill what places are left. Paragraphs and tables
    are cut to ``budget`` characters together. Without a limit or budget everything that scores stays.
    ``passages_left_out`` counts scoring paragraphs and relevant tables that the limit or the budget leaves out whole.
    Scoring, ranking and budgeting are array expressions inside the row, so pages never move.
    """
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda p: F.trim(p) != "")
    scored = F.transform(
        lines,
        lambda p, i: F.struct(
            (-passage_score(p, i, F.col("_entities"), keywords)).alias("neg_score"),
            i.alias("position"),
            p.alias("text"),
        ),
    )
    hits = F.array_sort(F.filter(F.col("_scored"), lambda s: s["neg_score"] < 0))
    best = F.col("_hits") if limit is None else F.slice("_hits", 1, limit - 1)
    ordered = F.array_sort(F.transform(best, lambda s: F.struct(s["position"], s["neg_score"], s["text"])))
    named = F.transform(
        ordered,
        lambda s: F.struct(
            F.concat(F.lit("p"), s["position"].cast("string")).alias("passage_id"), (-s["neg_score"]).cast("double").alias("score"), s["text"].alias("text")
        ),
    )
    rows = pages.withColumn("_entities", entities).withColumn("_scored", scored).withColumn("_hits", hits)
    rows = rows.withColumn("_fitted", _fit(named, F.lit(0), budget))
    passages, left_out = F.col("_fitted.kept"), F.size("_hits") - F.size("_fitted.kept")
    if "title" in pages.columns:
        title = F.struct(F.lit("title").alias("passage_id"), F.lit(None).cast("double").alias("score"), F.col("title").alias("text"))
        passages = F.concat(F.when(F.coalesce("title", F.lit("")) != "", F.array(title)).otherwise(F.array().cast(f"array<{_PASSAGE}>")), passages)
    rows = rows.withColumn("passages", passages)
    if "tables" in pages.columns:
        numbered = F.transform(
            F.coalesce("tables", F.array().cast("array<string>")),
            lambda t, i: F.struct(F.concat(F.lit("t"), (i + 1).cast("string")).alias("passage_id"), F.lit(None).cast("double").alias("score"), t.alias("text")),
        )
        rows = rows.withColumn("_tables", F.filter(numbered, lambda t: _relevant(t["text"], F.col("_entities"), keywords)))
        places = F.col("_tables") if limit is None else F.slice("_tables", 1, F.greatest(F.lit(limit) - F.size("passages"), F.lit(0)))
        rows = rows.withColumn("_more", _fit(places, F.col("_fitted.used"), budget)["kept"])
        left_out = left_out + F.size("_tables") - F.size("_more")
        rows = rows.withColumn("_out", left_out).withColumn("passages", F.concat("passages", "_more")).drop("_tables", "_more")
    else:
        rows = rows.withColumn("_out", left_out)
    return rows.withColumnRenamed("_out", "passages_left_out").drop("_entities", "_scored", "_hits", "_fitted")


def _relevant(table: Column, entities: Column, keywords: Sequence[str]) -> Column:
    named = F.exists(entities, lambda t: (t != "") & F.contains(table, t))
    return F.coalesce(table.rlike(fixed.PASSAGE_AMOUNT_PATTERN) | named | any_contains(table, keywords), F.lit(False))


def chunk_passages(passages: Column, limit: int = fixed.MAX_PASSAGE_CHARS, chunks: int | None = None) -> Column:
    """Chunk number of every passage text, filled greedily up to a size; with ``chunks``, only those of the first so many."""
    numbered = F.aggregate(
        passages,
        F.struct(
            F.array().cast("array<struct<chunk:int,size:int>>").alias("out"), F.lit(1).alias("chunk"), F.lit(0).alias("size")
        ),
        lambda acc, p: _next_chunk(acc, F.length(p), limit),
    )["out"]
    return numbered if chunks is None else F.filter(numbered, lambda c: c["chunk"] <= chunks)


def _next_chunk(acc: Column, size: Column, limit: int) -> Column:
    turn = (acc["size"] > 0) & (acc["size"] + size > limit)
    chunk = F.when(turn, acc["chunk"] + 1).otherwise(acc["chunk"])
    return F.struct(
        F.concat(acc["out"], F.array(F.struct(chunk.alias("chunk"), size.alias("size")))).alias("out"),
        chunk.alias("chunk"),
        F.when(turn, size).otherwise(acc["size"] + size).alias("size"),
    )


# --- query plan ----------------------------------------------------------------------------


def expand_templates(
    targets: DataFrame,
    templates: Sequence[tuple[str, float, str]],
    each: int | None = fixed.QUERY_VALUES_PER_PLACEHOLDER,
    most: int | None = fixed.QUERY_RESULTS_PER_TEMPLATE,
) -> DataFrame:
    """Queries from (family, base priority, text with ``{placeholder}`` marks) and each target's values.

    ``targets`` has target_id and ``values``, a map of placeholder to terms. The templates are a
    fixed configuration list, so targets meet them by exploding one literal array. A template takes
    the first ``each`` values per mark and yields the first ``most`` queries, all if these are None; a mark without values
    drops it.
    """
    listed = F.array(
        *[
            F.struct(
                F.lit(family).alias("query_family"), F.lit(float(base)).alias("base_priority"), F.lit(text).alias("template")
            )
            for family, base, text in templates
        ]
    )
    marks = max((len(re.findall(r"\{\w+\}", text)) for _, _, text in templates), default=0)
    none = F.array().cast("array<string>")
    out = targets.withColumn("_t", F.explode(listed)).select("*", "_t.*").drop("_t").withColumn("_q", F.array("template"))
    for _ in range(marks):
        name = F.regexp_extract(F.coalesce(F.try_element_at("_q", F.lit(1)), F.lit("")), r"\{(\w+)\}", 1)
        out = (
            out.withColumn("_m", F.concat(F.lit("{"), name, F.lit("}")))
            .withColumn("_v", _first(F.coalesce(F.try_element_at("values", name), none), each))
            .withColumn("_q", F.when(F.col("_m") == "{}", F.col("_q")).otherwise(_filled()))
        )
    return explode_computed(out, _first(F.col("_q"), most), "query_text").drop("_q", "_m", "_v", "values")


def _first(items: Column, count: int | None) -> Column:
    return items if count is None else F.slice(items, 1, count)


def _filled() -> Column:
    """All texts of ``_q`` with the first mark ``_m`` replaced by each value of ``_v``."""

    def replaced(text: Column, value: Column) -> Column:
        before = F.substring_index(text, "{", 1)
        return F.concat(before, value, F.substring(text, F.length(before) + F.length("_m") + 1, F.length(text)))

    return F.flatten(F.transform("_q", lambda q: F.transform("_v", lambda v: replaced(q, v))))


def score_queries(queries: DataFrame, terms: Column) -> DataFrame:
    """Score of planned queries; queries equal after normalisation collapse to the best one."""
    weight = fixed.QUERY_WEIGHTS
    text = F.col("query_text")
    entities = F.size(F.filter(terms, lambda t: (t != "") & F.contains(text, t)))
    pack = F.col("query_family").startswith("source_pack:")
    score = (
        F.col("base_priority") * weight["topic"]
        + weight["entity"] * F.least(entities, F.lit(3))
        + F.when(any_contains(text, fixed.QUERY_FACT_KEYWORDS), weight["fact"]).otherwise(0.0)
        + F.when(pack, weight["source_pack"]).otherwise(0.0)
        + F.when(any_contains(text, fixed.QUERY_TIME_KEYWORDS), weight["time"]).otherwise(0.0)
    )
    normalized = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    rows = queries.withColumn("score", score).withColumn("query_norm", normalized).withColumn("_neg", -F.col("score"))
    keep = ["target_id", "query_norm", "_neg", "query_family", "query_text", "score"]
    return first_by_key(rows.select(*keep), ["target_id", "query_norm"], ["_neg", "query_family", "query_text"]).drop("_neg")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """First ``limit`` rows per group with a bounded partial result per task."""
    # Spark prunes below the shuffle too (WindowGroupLimit), so a hot group ships at most limit rows per task.
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")


def select_families(families: DataFrame) -> DataFrame:
    """Query families that serve a target's focus; all of its families when none does.

    ``families`` has target_id, family, its own ``focus`` areas, the ``requested`` focus and the
    ``served`` families that the taxonomy lists for that request, each an array.
    """
    hit = F.array_contains("served", F.col("family")) | F.arrays_overlap("focus", "requested")
    marked = families.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    fallback = marked.groupBy("target_id").agg((~F.bool_or("_hit")).alias("_all"))
    return marked.join(fallback, "target_id").where("_hit or _all").drop("_hit", "_all")
