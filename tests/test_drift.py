import json

from lodestrata.operators.drift import field_changes, ingest, renamed_to, renames, replay

TARGET = {"id": "string", "bits": "double", "on": "boolean", "row_id": "bigint"}


def rows(spark, files, series=1):
    data = [(i, series, f, p) for f, ps in enumerate(files) for i, p in enumerate(ps)]
    return spark.createDataFrame(data, "row_id long, series_id long, file_seq int, payload string")


def changes(spark, *files):
    """The changes; a target schema, whatever it takes from the payloads, must not alter them."""
    found = [sorted((r["file_seq"], r["change_kind"], r["field_name"]) for r in field_changes(rows(spark, files), target=t).collect()) for t in (None, {"id": "string", "bits": "double", "x": "int", "gone": "boolean", "score": "double"})]
    assert found[0] == found[1]
    return found[0]


def many(**fields):
    return [json.dumps({k: (v[i % len(v)] if isinstance(v, list) else v) for k, v in fields.items()}) for i in range(12)]


def test_all_kinds(spark):
    a = many(id="a", bits=[2, 4, 8], model=["x-1", "y-2"], gone=True)
    b = many(id="a", kbits=[4, 2, 8], model=[1, 2], fresh="new text")
    assert changes(spark, a, b) == [(1, "added", "fresh"), (1, "removed", "gone"), (1, "renamed", "bits"), (1, "type_changed", "model")]


def test_numbers_nulls_and_broken_payloads_change_nothing(spark):
    a = ['{"x": 4, "y": null}', '{"x": 4', "", None, "[1]"]
    b = ['{"x": 4.0, "y": null}', '{"z": 1} rest']
    assert changes(spark, a, b) == []


def test_file_without_complete_payload_has_no_fields(spark):
    assert changes(spark, ['{"x": 1}'], ["{"], ['{"x": 1}']) == [(1, "removed", "x"), (2, "added", "x")]


def test_first_file_and_gaps_compare_with_the_file_before(spark):
    df = rows(spark, [['{"x": 1}'], ['{"x": "1"}']]).replace({1: 5}, subset=["file_seq"])
    assert [(r["file_seq"], r["change_kind"]) for r in field_changes(df).collect()] == [(5, "type_changed")]
    assert field_changes(rows(spark, [])).count() == 0


def test_renames_need_alike_values():
    bits, scores = {1: 5, 2: 5}, {8: 9, 9: 1}
    assert renames({"key_bits": bits}, {"score": scores}) == []
    assert renames({"a": bits, "b": scores}, {"c": scores, "d": bits}) == [("a", "d"), ("b", "c")]
    assert renames({"finalScore": {}}, {"final_score": {}}) == [("finalScore", "final_score")]


def test_renames_in_large_files(spark):
    def file(**fields):
        return [json.dumps({k: make(i) for k, make in fields.items()}) for i in range(1500)]

    a = file(owner=lambda i: f"user-{i}", weight=lambda i: i / 1500, bits=lambda i: 2 << i % 3, score=lambda i: i * 7919 % 1500 / 1499, title=lambda i: f"u{i}")
    b = file(place=lambda i: f"site-{i}", height=lambda i: 500 + i / 7, kbits=lambda i: str(2 << i % 3), final_score=lambda i: (i * 104729 + 1) % 1500 / 1501, label=lambda i: f"v{i}")
    gone, new = ("owner", "weight", "title"), ("place", "height", "label")
    assert changes(spark, a, b) == sorted([*((1, "removed", f) for f in gone), *((1, "added", f) for f in new), (1, "renamed", "bits"), (1, "renamed", "score"), (1, "type_changed", "bits")])


def test_rescue_and_replay(spark):
    payloads = ['{"id": "a", "bits": "4", "on": "x", "more": {"k": [1]}}', '{"id": 7, "bits": [1], "old_bits": 8.5, "row_id": 5}', "{broken", None, '{"id": null}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "row_id long, payload string")
    out = ingest(df, "payload", TARGET, {})
    got = {r["row_id"]: r for r in out.collect()}
    assert out.columns == ["row_id", "id", "bits", "on", "row_id_1", "rescued", "payload_state"]
    assert (got[0]["id"], got[0]["bits"], got[0]["on"]) == ("a", 4.0, None)
    assert json.loads(got[0]["rescued"]) == {"on": "x", "more": {"k": [1]}}
    assert json.loads(got[1]["rescued"]) == {"bits": [1], "old_bits": 8.5} and got[1]["row_id_1"] == 5 and got[1]["id"] == "7"
    assert json.loads(got[2]["rescued"]) == {"_payload": "{broken"} and got[2]["payload_state"] == "broken"
    assert got[3]["rescued"] is None and got[3]["payload_state"] == "missing" and got[4]["rescued"] is None
    again = {r["row_id"]: r for r in replay(out, {"bits": "double", "more_text": "string"}, {"old_bits": "bits", "on": "more_text"}).collect()}
    assert again[1]["bits"] == 8.5 and json.loads(again[1]["rescued"]) == {"bits": [1]}
    assert again[0]["more_text"] == "x" and again[0]["bits"] == 4.0 and json.loads(again[0]["rescued"]) == {"more": {"k": [1]}}


def test_strict_ingestion_rescues_other_kinds_and_replay_casts_them(spark):
    df = spark.createDataFrame([(1, '{"id": 7, "bits": "4", "on": true, "none": null}'), (2, '{"id": "a", "bits": 4, "on": "true"}')], "row_id long, payload string")
    out = ingest(df, "payload", TARGET, strict=True, keep_nulls=True)
    a, b = out.orderBy("row_id").collect()
    assert (a["id"], a["bits"], a["on"], a["null_fields"]) == (None, None, True, ["none"]) and json.loads(a["rescued"]) == {"id": 7, "bits": "4"}
    assert (b["id"], b["bits"], b["on"], b["null_fields"]) == ("a", 4.0, None, []) and json.loads(b["rescued"]) == {"on": "true"}
    a, b = replay(out, {"id": "string", "bits": "double", "on": "boolean"}, {}).orderBy("row_id").collect()
    assert (a["id"], a["bits"], b["on"], a["rescued"], b["rescued"]) == ("7", 4.0, True, None, None)


def test_names_tied_by_renames(spark):
    c = spark.createDataFrame([("renamed", "a", "b"), ("renamed", "b", "bits"), ("added", "z", "bits"), ("renamed", "q", "id"), ("renamed", "q", "on")], "change_kind string, field_name string, detail string")
    assert renamed_to(c, TARGET, {"k": "bits"}) == {"a": "bits", "b": "bits", "k": "bits"}


def test_values_that_are_not_taken_stay_rescued(spark):
    df = spark.createDataFrame([(1, '{"bits": 4, "kbits": 8, "old_bits": 16}')], "row_id long, payload string")
    out = ingest(df, "payload", {"bits": "double"}, {"kbits": "bits"})
    r = out.first()
    assert r["bits"] == 4.0 and json.loads(r["rescued"]) == {"kbits": 8, "old_bits": 16}
    r = replay(out, {"bits": "double"}, {"kbits": "bits", "old_bits": "bits"}).first()
    assert r["bits"] == 4.0 and json.loads(r["rescued"]) == {"kbits": 8, "old_bits": 16}
