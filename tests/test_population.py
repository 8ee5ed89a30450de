"""Native queries take all native documents, predicted or not."""

import datetime

import pytest

from tessella.plans import metrics, native

AT = datetime.datetime(2024, 1, 1)
GOLD = {
    1: ["T1\tMaterial 0 4\tiron", "T2\tElement 5 9\tzinc", "R1\tTarget Arg1:T1 Arg2:T2"],
    2: ["T1\tMaterial 0 4\tiron", "T2\tDoping 5 9\tzinc", "R1\tCondition Arg1:T1 Arg2:T2", "E1\tDoping:T2 Dopant:E2", "E2\tDoping:T2 Dopant:E1"],
}
FOUND = {1: ["T1\tMaterial 0 4", "T2\tDoping 5 9", "R1\tCondition Arg1:T1 Arg2:T2"]}


def folder(spark, path, found):
    spark.createDataFrame([(i, "iron zinc") for i in (1, 2, 3)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    for name, row_id, raw, stamp, docs in (("native_records", "record_id", "raw", "received_at", GOLD), ("emissions", "emission_id", "payload", "emitted_at", found)):
        lines = [(10 * k + i, k, i, None, bytearray(x.encode()), AT) for k, xs in docs.items() for i, x in enumerate(xs)]
        spark.createDataFrame(lines, f"{row_id} long, doc_id long, occurrence int, family string, {raw} binary, {stamp} timestamp").write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture
def tables(spark, tmp_path):
    return folder(spark, tmp_path, FOUND)


def counts(df, *key):
    return {tuple(r[k] for k in key): (r["tp"], r["fp"], r["fn"]) for r in df.collect()}


def test_documents_without_predictions_are_scored(spark, tables):
    scores = metrics.document_scores(spark, tables)
    assert {r["documents"] for r in scores.collect()} == {2}
    got = counts(scores, "metric")
    assert got[("text_bound_all_native",)] == (1, 1, 3)
    assert got[("events_full_graph",)] == (0, 0, 2)
    assert got[("relations_full_graph",)] == got[("relations_trigger_projected",)] == (0, 1, 2)
    assert counts(native.native_mention_scores(spark, tables), "category") == {("Material",): (1, 0, 1), ("Element",): (0, 0, 1), ("Doping",): (0, 1, 1)}
    assert counts(native.projected_relation_key(spark, tables), "label") == {("Target",): (0, 0, 1), ("Condition",): (0, 1, 1)}
    assert counts(native.graph_match_global(spark, tables), "doc") == {(1,): (0, 0, 0), (2,): (0, 0, 2)}
    assert counts(native.relation_match_global(spark, tables), "doc") == {(1,): (0, 1, 1), (2,): (0, 0, 1)}


def test_signatures_of_documents_without_predictions_are_known(spark, tables):
    assert native.signature_warnings(spark, tables).count() == 0


def test_prediction_of_a_document_outside_the_population_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="outside the population"):
        metrics.document_scores(spark, folder(spark, tmp_path, FOUND | {3: ["T1\tMaterial 0 4"]})).collect()


def test_cycles_of_documents_without_predictions_are_found(spark, tables):
    assert {(r["doc"], r["node"], r["cycle"]) for r in metrics.nested_cycles(spark, tables).collect()} == {(2, "E1", "E1"), (2, "E2", "E1")}
