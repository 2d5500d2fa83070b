"""Child tables of extraction bundles: splitting, caps, copies and explanations."""

import json

import pytest

from marketloom import fixed
from marketloom.operators import bundles

BUNDLES = "link_id string, analysis_id string, target_id string, run_id string, body string"
FULL = {
    "brief": {"one_sentence": "s", "impact_channels": ["a", "b"]},
    "facts": [{"fact_statement": "f0", "entities": {"b": 1, "a": "x"}, "confidence": 0.5}, {"fact_statement": "f1", "confidence": "bad"}, {}],
    "events": [{"summary": "e0", "event_date": "2024-02-30"}, {"summary": "e1", "event_date": "2024-02-03"}],
    "analyst_questions": [{"question": "why"}],
    "coverage_gaps": [{"gap_type": "missing"}],
    "unknown_kind": [{"x": 1}],
}


@pytest.fixture(scope="module")
def rows(spark):
    texts = [("l1", "a1", "t", "r", json.dumps(FULL)), ("l2", "a2", "t", "r", "{}"), ("l3", "a3", "t", "r", "{broken"), ("l4", None, None, None, None),
             ("l5", "a5", "t", "r", "[1, 2]"), ("l6", "a6", "t", "r", json.dumps({"facts": "no list", "risks": [{"risk_summary": "ü 中"}]}))]
    return spark.createDataFrame(texts, BUNDLES)


def test_every_object_becomes_a_row_of_its_kind(spark, rows):
    found = bundles.child_rows(rows)
    assert sorted((r["link_id"], r["kind"], r["position"]) for r in found.collect()) == [
        ("l1", "analyst_questions", 0), ("l1", "briefs", 0), ("l1", "coverage_gaps", 0), ("l1", "events", 0), ("l1", "events", 1),
        ("l1", "facts", 0), ("l1", "facts", 1), ("l1", "facts", 2), ("l6", "risks", 0),
    ]
    facts = bundles.typed(found, "facts").orderBy("position").collect()
    assert [(f["fact_statement"], f["entities"], f["confidence"], f["period"]) for f in facts] == [("f0", '{"a":"x","b":1}', 0.5, None), ("f1", None, None, None), (None, None, None, None)]
    assert [str(e["event_date"]) for e in bundles.typed(found, "events").orderBy("position").collect()] == ["None", "2024-02-03"]
    assert bundles.typed(found, "briefs").first()["impact_channels"] == ["a", "b"]
    assert bundles.typed(found, "risks").first()["risk_summary"] == "ü 中"
    assert {r["link_id"] for r in bundles.unreadable(rows).collect()} == {"l3", "l4", "l5"}
    assert bundles.child_rows(rows.limit(0)).count() == 0


def test_caps_are_off_unless_given_and_report_what_they_leave_out(rows):
    whole, caps = bundles.child_rows(rows), {"facts": 1, "events": 2}
    capped = bundles.child_rows(rows, caps=caps)
    left_out = {(r["link_id"], r["kind"]): r["left_out"] for r in bundles.capped_objects(whole, caps).collect()}
    assert left_out == {("l1", "facts"): 2} and whole.count() - capped.count() == 2


def test_tables_are_read_by_partition_and_ids_stay(spark, rows, tmp_path):
    found = bundles.child_rows(rows)
    bundles.write_children(found, str(tmp_path))
    assert {p.name for p in tmp_path.iterdir() if p.is_dir()} == {f"kind={k}" for k in ("analyst_questions", "briefs", "coverage_gaps", "events", "facts", "risks")}
    read = bundles.read_children(spark, str(tmp_path), "facts")
    assert "PartitionFilters: [isnotnull(kind" in read._jdf.queryExecution().toString()
    again = {r["object_id"] for r in bundles.child_rows(rows.repartition(5)).collect()}
    assert again == {r["object_id"] for r in found.collect()} and len(again) == 9
    assert {r["object_id"] for r in read.collect()} <= again


def test_copies_take_the_newest_analysis_and_leave_gaps_with_their_run(spark, rows):
    found = bundles.child_rows(rows).unionByName(bundles.child_rows(rows).where("kind = 'briefs'").withColumn("position", bundles.F.col("position") + 1))
    analyses = spark.createDataFrame([("l1", "a1", 1, "vote"), ("l1", "a1b", 2, None), ("l6", "a6", 1, "vote")], "link_id string, analysis_id string, analysed_at int, merge_method string")
    pairs = spark.createDataFrame([("n1", "t9", "r9", "l1"), ("n2", "t9", "r9", "l1"), ("n3", "t9", "r9", None), ("n4", "t9", "r9", "l3")], "link_id string, target_id string, run_id string, reused_link_id string")
    copied, children = bundles.clone(found, analyses, pairs)
    assert {(r["link_id"], r["analysis_id"], r["merge_method"]) for r in copied.collect()} == {(n, f"clone_{n}_a1b", "cache_reuse:unknown") for n in ("n1", "n2")}
    counts = {r["link_id"]: r for r in bundles.counts(children).collect()}
    assert set(counts) == {"n1", "n2"}
    assert [counts["n1"][k] for k in ("briefs", "facts", "events", "analyst_questions", "coverage_gaps")] == [1, 3, 2, 1, 0]
    ids = [r["object_id"] for r in children.collect()]
    assert len(ids) == len(set(ids)) and not set(ids) & {r["object_id"] for r in found.collect()}
    assert {(r["target_id"], r["run_id"]) for r in children.collect()} == {("t9", "r9")}


def test_explanations_list_texts_in_order(spark, rows):
    links = rows.select("link_id", "run_id")
    decided = spark.createDataFrame([("l1", "save")], "link_id string, decision string")
    runs = spark.createDataFrame([("l1", "m2"), ("l1", "m1"), ("l1", "m2")], "link_id string, model_config_id string")
    found = {r["link_id"]: r for r in bundles.explain(links, decided, bundles.child_rows(rows), runs).collect()}
    assert len(found) == 6
    assert (found["l1"]["facts"], found["l1"]["events"], found["l1"]["questions"] if "questions" in found["l1"] else found["l1"]["analyst_questions"]) == (["f0", "f1", None], ["e0", "e1"], ["why"])
    assert (found["l1"]["models_used"], found["l1"]["merged_decision"], found["l2"]["facts"], found["l3"]["models_used"]) == (["m1", "m2"], "save", [], [])


def test_every_explained_field_is_a_field_of_its_kind():
    assert all(name in fixed.CHILD_FIELDS[kind] for kind, name in fixed.EXPLAINED_FIELDS.items())
