"""Extraction bundles: JSON texts split into child tables, copied to other links, and gathered per link.

A bundle is one JSON text per analysed link. Its objects become rows of one long table of (kind, object), written once with
the kind as partition, so that every child table is a partition read with the typed columns of its kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.operators.hotkeys import explode_computed, latest_by_key

#: The table of child rows: what identifies an object, and the object itself as JSON text.
KEYS = ["link_id", "analysis_id", "target_id", "run_id"]
KINDS = list(fixed.CHILD_FIELDS)


def _items(parsed: Column, kind: str) -> Column:
    """All objects of a kind; the brief is a single object under its own name."""
    if kind == "briefs":
        brief = F.try_variant_get(parsed, "$.brief", "variant")
        return F.when(brief.isNotNull(), F.array(brief))
    return F.try_variant_get(parsed, f"$.{kind}", "array<variant>")


def object_id(kind: Column, link: Column, position: Column, payload: Column) -> Column:
    """Id of a child row from its link, place and content, so that splitting again gives the same ids."""
    return F.concat_ws("_", kind, F.sha2(F.concat_ws("|", link.cast("string"), position.cast("string"), payload), 256))


def child_rows(bundles: DataFrame, kinds: Sequence[str] = KINDS, caps: dict[str, int] | None = None) -> DataFrame:
    """One row per object of all kinds, from one pass over the bundles.

    ``bundles`` has link_id, analysis_id, target_id, run_id and ``body``. Returns these ids, kind, position (from 0 within the
    kind), payload (JSON text) and object_id. Every object is kept; ``caps`` keeps the first of a kind only, and
    ``capped_objects`` tells how many that leaves out. Texts that are no JSON have no rows; see ``unreadable``.
    """
    parsed = bundles.select(*KEYS, F.try_parse_json("body").alias("_b"))
    lists = F.array(*[F.struct(F.lit(kind).alias("kind"), _items(F.col("_b"), kind).alias("items")) for kind in kinds])
    listed = explode_computed(parsed.withColumn("_l", lists), F.col("_l"), "_k").select(*KEYS, "_k.kind", "_k.items")
    rows = listed.where("items is not null").select(*KEYS, "kind", F.posexplode("items").alias("position", "_v"))
    if caps:
        rows = rows.where(F.coalesce(_cap(F.col("kind"), caps) > F.col("position"), F.lit(True)))
    rows = rows.withColumn("payload", F.to_json("_v")).drop("_v")
    return rows.withColumn("object_id", object_id(F.col("kind"), F.col("link_id"), F.col("position"), F.col("payload")))


def _cap(kind: Column, caps: dict[str, int]) -> Column:
    limits = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return F.try_element_at(limits, kind)


def capped_objects(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Per link and kind, how many of all objects lie beyond the caps."""
    beyond = rows.where(F.col("position") >= _cap(F.col("kind"), caps))
    return beyond.groupBy("link_id", "kind").agg(F.count("*").alias("left_out"))


def unreadable(bundles: DataFrame) -> DataFrame:
    """Ids of the bundles whose text is no JSON object."""
    kind = F.schema_of_variant(F.try_parse_json("body"))
    return bundles.where(F.coalesce(~kind.startswith("OBJECT"), F.lit(True))).select(*KEYS)


def typed(rows: DataFrame, kind: str) -> DataFrame:
    """The child table of one kind: ids, position and the kind's fields in their types.

    A field that is absent or of another type is null; nested fields are JSON texts.
    """
    payload = F.col("_p")

    def field(name: str, type_: str) -> Column:
        if type_ == "json":
            return F.to_json(F.try_variant_get(payload, f"$.{name}", "variant"))
        if type_ == "date":
            return F.try_variant_get(payload, f"$.{name}", "string").try_cast("date")
        return F.try_variant_get(payload, f"$.{name}", type_)

    own = rows.where(F.col("kind") == kind).withColumn("_p", F.parse_json("payload"))
    fields = {name: field(name, type_) for name, type_ in fixed.CHILD_FIELDS[kind].items()}
    return own.select("object_id", *KEYS, "position", *[c.alias(n) for n, c in fields.items()])


def write_children(rows: DataFrame, folder: str) -> None:
    """Add child rows to the tables of a folder, one partition per kind.

    Ids come from the content, so rows of a batch that is written again carry the ids they had.
    """
    rows.write.mode("append").partitionBy("kind").parquet(folder)


def read_children(spark, folder: str, kind: str) -> DataFrame:
    """One child table of a folder; only its partition is read."""
    return typed(spark.read.parquet(folder), kind)


def clone(rows: DataFrame, analyses: DataFrame, pairs: DataFrame, skipped: Sequence[str] = ("coverage_gaps",)) -> tuple[DataFrame, DataFrame]:
    """Copies of the analyses and child rows of earlier links under new ones.

    ``analyses`` has link_id, analysis_id, analysed_at, merge_method; ``pairs`` has link_id, target_id, run_id and reused_link_id.
    The newest analysis of the earlier link is copied, with all child rows of the link but the ``skipped``
    kinds, which belong to runs, and of the briefs the first. Returns the new analyses and the new child rows. A
    link that very many others reuse is split at run time.
    """
    newest = latest_by_key(analyses.select("link_id", "analysed_at", "analysis_id", "merge_method"), ["link_id"], ["analysed_at"])
    wanted = pairs.where("reused_link_id is not null")
    wanted = wanted.select(F.col("link_id").alias("_new"), F.col("target_id").alias("_target"), F.col("run_id").alias("_run"), F.col("reused_link_id").alias("link_id"))
    found = wanted.join(newest, "link_id").withColumn("_analysis", F.concat_ws("_", F.lit("clone"), F.col("_new").cast("string"), F.col("analysis_id").cast("string")))
    method = F.concat(F.lit("cache_reuse:"), F.coalesce("merge_method", F.lit("unknown")))
    copied = found.select(
        F.col("_new").alias("link_id"), F.col("_analysis").alias("analysis_id"), F.col("_target").alias("target_id"), F.col("_run").alias("run_id"),
        F.col("link_id").alias("reused_link_id"), method.alias("merge_method"),
    )
    source = rows.where(~F.col("kind").isin(list(skipped))).drop("target_id", "run_id", "analysis_id", "object_id")
    briefs = latest_by_key(source.where("kind = 'briefs'").withColumn("_first", -F.col("position")), ["link_id"], ["_first"]).drop("_first")
    source = source.where("kind <> 'briefs'").unionByName(briefs)
    children = found.select("link_id", "_new", "_target", "_run", "_analysis").join(source, "link_id")
    children = children.select(
        F.col("_new").alias("link_id"), F.col("_analysis").alias("analysis_id"), F.col("_target").alias("target_id"), F.col("_run").alias("run_id"),
        "kind", "position", "payload",
    )
    return copied, children.withColumn("object_id", object_id(F.col("kind"), F.col("link_id"), F.col("position"), F.col("payload")))


def counts(rows: DataFrame) -> DataFrame:
    """Child rows per link and kind, a column a kind."""
    return rows.groupBy("link_id").agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in KINDS])


def explain(links: DataFrame, analyses: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per link: its source, decision, models and the texts of its objects, in order, an array a kind.

    All kinds meet in one grouping of the child rows by link, which are as many as its bundles have. ``links`` has link_id and the
    columns to show, ``analyses`` link_id and decision, ``runs`` link_id and model_config_id.
    """
    payload = F.parse_json("payload")
    texts = F.coalesce(*[F.when(F.col("kind") == kind, F.try_variant_get(payload, f"$.{name}", "string")) for kind, name in fixed.EXPLAINED_FIELDS.items()])
    said = rows.where(F.col("kind").isin(list(fixed.EXPLAINED_FIELDS))).select("link_id", "kind", "position", "object_id", texts.alias("text"))

    def of(kind: str) -> Column:
        place = F.struct("position", "object_id", "text")
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, place))), lambda p: p["text"]).alias(kind)

    gathered = said.groupBy("link_id").agg(*[of(kind) for kind in fixed.EXPLAINED_FIELDS])
    models = runs.groupBy("link_id").agg(F.array_sort(F.collect_set("model_config_id")).alias("models_used"))
    decided = analyses.groupBy("link_id").agg(F.min("decision").alias("merged_decision"))
    none = F.array().cast("array<string>")
    out = links.join(decided, "link_id", "left").join(models, "link_id", "left").join(gathered, "link_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ["models_used", *fixed.EXPLAINED_FIELDS]})
