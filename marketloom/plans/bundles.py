"""Queries on the child tables of extraction bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.operators import bundles
from marketloom.plans.registry import query
from marketloom.plans.views import TURNS_PER_BUNDLE, cycle, cycle_sql
from marketloom.session import scratch_root

LISTS = [k for k in bundles.KINDS if k != "briefs"]
CAPS = {"facts": 1, "metrics": 1, "events": 1}


def _value(name: str, kind: str, n: str) -> str:
    """Value of a field of the object of turn ``n`` as an expression both engines read; every eleventh is absent."""
    made = {
        "string": f"case when {n} % 3 = 0 then text else concat('{name}', '-', cast({n} % 7 as string)) end",
        "double": f"cast({n} as double) / 4.0e0",
        "date": f"concat('2024-01-', lpad(cast(1 + {n} % 28 as string), 2, '0'))",
    }[kind]
    return f"case when ({n} + {len(name)}) % 11 <> 0 then {made} end"


def _object(kind: str) -> str:
    """Spark SQL of one object of a kind as a struct."""
    parts = []
    for name, type_ in fixed.CHILD_FIELDS[kind].items():
        if type_ == "json":
            made = f"case when (turn + {len(name)}) % 11 <> 0 then named_struct('name', concat('x', cast(turn % 5 as string)), 'n', turn) end"
        elif type_ == "array<string>":
            made = f"case when (turn + {len(name)}) % 11 <> 0 then transform(sequence(0, cast(turn % 3 as int)), i -> concat('{name}', '-', cast(i as string))) end"
        else:
            made = _value(name, type_, "turn")
        parts.append(f"'{name}', {made}")
    return f"named_struct({', '.join(parts)})"


def texts(v):
    """Conversations as bundle texts, one per sixteen turns; every turn is an object, the first also the brief, and some texts are cut off."""
    chunk = F.floor(F.col("turn") / TURNS_PER_BUNDLE)
    rows = v.table("conversations").withColumn("link_id", F.concat_ws("-", F.col("conv_id").cast("string"), chunk.cast("string")))
    rows = rows.withColumn("kind", cycle(F.col("conv_id") + F.floor(F.col("turn") / 2), LISTS))
    gathered = []
    for kind in LISTS:
        own = F.when(F.col("kind") == kind, F.struct("turn", F.expr(_object(kind)).alias("o")))
        gathered.append(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["o"]).alias(kind))
    brief = F.min_by(F.expr(_object("briefs")), "turn").alias("brief")
    grouped = rows.groupBy("conv_id", "link_id").agg(brief, *gathered)
    body = F.to_json(F.struct("brief", *LISTS))
    return grouped.select(
        "link_id",
        F.concat(F.lit("a"), "link_id").alias("analysis_id"),
        F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")).alias("target_id"),
        F.concat(F.lit("run"), (F.col("conv_id") % 4).cast("string")).alias("run_id"),
        cycle(F.col("conv_id"), ["save_structured", "link_only", "skip"]).alias("decision"),
        F.col("conv_id").alias("conv_id"),
        F.when(F.col("conv_id") % 13 == 0, F.substring(body, 1, 20)).otherwise(body).alias("body"),
    )


_TURNS = f"""t as (
  select *, cast(conv_id as varchar) || '-' || cast(turn // {TURNS_PER_BUNDLE} as varchar) as link_id,
    {cycle_sql("(conv_id + turn // 2)", LISTS)} as kind from conversations),
o as (
  select *, row_number() over (partition by link_id, kind order by turn, text) - 1 as position, 'a' || link_id as analysis_id,
    't' || (conv_id % 3) as target_id, 'run' || (conv_id % 4) as run_id
  from t where conv_id % 13 <> 0
  union all
  select conv_id, turn, role, text, link_id, 'briefs', 0, 'a' || link_id, 't' || (conv_id % 3), 'run' || (conv_id % 4)
  from (select *, row_number() over (partition by link_id order by turn, text) as rn from t) where rn = 1 and conv_id % 13 <> 0)"""


def _columns_sql(kind: str) -> str:
    out = []
    for name, type_ in fixed.CHILD_FIELDS[kind].items():
        there = f"(turn + {len(name)}) % 11 <> 0"
        if type_ == "json":
            made = f"""case when {there} then '{{"n":' || turn || ',"name":"x' || (turn % 5) || '"}}' end"""
        elif type_ == "array<string>":
            made = f"case when {there} then array_to_string(list_transform(range(0, turn % 3 + 1), lambda i: '{name}-' || i), ',') end"
        else:
            made = _value(name, type_, "turn")
        out.append(f'{made} as "{name}"')
    return ", ".join(out)


def _flat(rows, kind):
    """Arrays and dates as texts, so that both engines return the same types."""
    shown = []
    for name, type_ in fixed.CHILD_FIELDS[kind].items():
        shown.append(F.array_join(name, ",").alias(name) if type_ == "array<string>" else F.col(name).cast("string").alias(name) if type_ == "date" else F.col(name))
    return rows.select("link_id", "analysis_id", "target_id", "run_id", F.col("position").cast("long").alias("position"), *shown)


def _child_query(kind: str):
    def build(v):
        folder = f"{scratch_root(v.spark)}/children-{uuid.uuid4().hex}"
        bundles.write_children(bundles.child_rows(texts(v)), folder)
        return _flat(bundles.read_children(v.spark, folder, kind), kind)

    build.__name__ = f"child_{kind}"
    build.__doc__ = f"The {kind} of all bundles, split from their texts, written with all other kinds and read back from their partition."
    ids = "link_id, analysis_id, target_id, run_id, position"
    query("S15", "", f"with {_TURNS} select {ids}, {_columns_sql(kind)} from o where kind = '{kind}'")(build)


for _kind in bundles.KINDS:
    _child_query(_kind)


@query(
    "S15 W15", "",
    f"with {_TURNS} select link_id, kind, count(*) as left_out from o where position >= case kind {' '.join(f'''when '{k}' then {n}''' for k, n in CAPS.items())} end group by 1, 2",
)
def capped_children(v):
    """What caps of one object a kind would leave out."""
    return bundles.capped_objects(bundles.child_rows(texts(v)), CAPS)


@query(
    "S15", "",
    f"with {_TURNS} select distinct link_id, 'a' || link_id as analysis_id, 't' || (conv_id % 3) as target_id, 'run' || (conv_id % 4) as run_id from t where conv_id % 13 = 0",
)
def unreadable_bundles(v):
    """Bundles whose text is cut off."""
    return bundles.unreadable(texts(v))


def _pairs(v):
    """Every third conversation's links reuse the link of the conversation before, at the same place."""
    chunk = F.split_part("link_id", F.lit("-"), F.lit(2))
    reused = F.when(F.col("conv_id") % 3 == 1, F.concat_ws("-", (F.col("conv_id") - 1).cast("string"), chunk))
    return texts(v).select(F.concat(F.lit("n"), "link_id").alias("link_id"), "target_id", F.lit("run9").alias("run_id"), reused.alias("reused_link_id"))


def _cloned(v):
    bodies = texts(v)
    rows = bundles.child_rows(bodies)
    older = [bodies.select("link_id", F.concat(F.lit(p), "analysis_id").alias("analysis_id"), F.lit(at).alias("analysed_at"), F.lit(method).alias("merge_method")) for p, at, method in (("", 2, None), ("old", 1, "vote"))]
    return bundles.clone(rows, older[0].unionByName(older[1]), _pairs(v))


_REUSED = f"""{_TURNS},
l as (select distinct link_id, conv_id, turn // {TURNS_PER_BUNDLE} as chunk from t),
p as (select 'n' || a.link_id as new_link, b.link_id as old_link, a.conv_id from l a join l b on b.conv_id = a.conv_id - 1 and a.chunk = b.chunk where a.conv_id % 3 = 1)"""


@query(
    "S16", "",
    f"""with {_REUSED} select new_link as link_id, 'clone_' || new_link || '_a' || old_link as analysis_id, 't' || (conv_id % 3) as target_id, 'run9' as run_id,
      old_link as reused_link_id, 'cache_reuse:unknown' as merge_method from p""",
)
def cloned_analyses(v):
    """Newest analyses copied to the links that reuse them."""
    return _cloned(v)[0]


@query(
    "S16", "",
    f"""with {_REUSED} select new_link as link_id, 'clone_' || new_link || '_a' || old_link as analysis_id, 't' || (p.conv_id % 3) as target_id, 'run9' as run_id,
      kind, position, count(*) as copies from p join o on o.link_id = old_link where kind <> 'coverage_gaps' group by all""",
)
def cloned_child_rows(v):
    """Child rows of all kinds copied to the links that reuse them."""
    rows = _cloned(v)[1].groupBy("link_id", "analysis_id", "target_id", "run_id", "kind", "position").agg(F.count("*").alias("copies"))
    return rows.withColumn("position", F.col("position").cast("long"))


@query(
    "S16 J19", "",
    f"""with {_REUSED} select new_link as link_id, {", ".join(f"count(*) filter (where kind = '{k}' and kind <> 'coverage_gaps') as {k}" for k in bundles.KINDS)}
    from p join o on o.link_id = old_link where kind <> 'coverage_gaps' group by 1""",
)
def cloned_counts(v):
    """Copied child rows per link and kind."""
    return bundles.counts(_cloned(v)[1])


def _said_sql(kind: str, field: str) -> str:
    return f"coalesce(list({_value(field, 'string', 'turn')} order by position) filter (where kind = '{kind}'), [])"


@query(
    "J29", "",
    f"""with {_TURNS},
    l as (select distinct link_id, conv_id from t),
    s as (select link_id, {", ".join(f"{_said_sql(k, f)} as {k}" for k, f in fixed.EXPLAINED_FIELDS.items())} from o group by 1)
    select link_id, 'run' || (conv_id % 4) as run_id, {cycle_sql("conv_id", ["save_structured", "link_only", "skip"])} as merged_decision, 'm0|m' || (conv_id % 2 + 1) as models_used,
      {", ".join(f"coalesce(array_to_string({k}, '|'), '') as {k}, coalesce(len({k}), 0) as n_{k}" for k in fixed.EXPLAINED_FIELDS)}
    from l left join s using (link_id)""",
)
def explained_links(v):
    """Everything known about each link in one row."""
    bodies = texts(v)
    models = F.array(F.lit("m0"), F.concat(F.lit("m"), (F.col("conv_id") % 2 + 1).cast("string")), F.lit("m0"))
    runs = bodies.select("link_id", F.explode(models).alias("model_config_id"))
    found = bundles.explain(bodies.select("link_id", "run_id"), bodies.select("link_id", "decision"), bundles.child_rows(bodies), runs)
    shown = [c for k in fixed.EXPLAINED_FIELDS for c in (F.array_join(k, "|").alias(k), F.size(k).cast("long").alias(f"n_{k}"))]
    return found.select("link_id", "run_id", "merged_decision", F.array_join("models_used", "|").alias("models_used"), *shown)
