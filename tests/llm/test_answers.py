import pytest

from lodestrata.llm.answer_structure import read_answer, requested, visible
from lodestrata.llm.answers import PROFILE, answer_defects, is_copy, profile, truncated_answers, truncation_by_source
from lodestrata.llm.languages import asked_for, leading, votes

QUERY = "Describe 2 ferry records in {}. Use exactly these fields: code, level, remark.\nReturn only the code."
REMARK = "Please ring twice before opening the gate."
BODY = {
    "JSON": '{"ferrys": [{"code": "AB123", "level": 5, "remark": "%s"}, {"code": "CD456", "level": 71, "remark": "%s"}]}' % (REMARK, REMARK),
    "XML": "<ferrys>\n  <item>\n    <code>AB123</code>\n    <level>5</level>\n    <remark>%s</remark>\n  </item>\n  <item>\n    <code>CD456</code>\n    <level>71</level>\n    <remark>%s</remark>\n  </item>\n</ferrys>" % (REMARK, REMARK),
    "YAML": 'ferrys:\n  - code: AB123\n    level: 5\n    remark: "%s"\n  - code: CD456\n    level: 71\n    remark: "%s"' % (REMARK, REMARK),
    "TOML": '[[ferrys]]\n"code" = "AB123"\n"level" = 5\n"remark" = "%s"\n[[ferrys]]\n"code" = "CD456"\n"level" = 71\n"remark" = "%s"' % (REMARK, REMARK),
    "CSV": 'code,level,remark\nAB123,5,"%s"\nCD456,71,"%s"' % (REMARK, REMARK),
}
WRAPS = ["{}", "<|BEGIN_CODE|>\n{}\n<|END_CODE|>", "<|BEGIN_CODE|>\n{}", "```\n{}\n```", "```\n{}", "Here is the document:\n{}", "Sure.\n<|BEGIN_CODE|>\n{}\n<|END_CODE|>\nAll required fields are present.", "{}\nAll required fields are present."]


@pytest.mark.parametrize("wrap", WRAPS)
@pytest.mark.parametrize("kind", BODY)
def test_complete_in_any_wrapping(kind, wrap):
    a = read_answer(wrap.format(BODY[kind]), kind)
    assert (a.complete, a.records) == (True, 2), (a.reason, a.payload)
    assert {"code", "level", "remark"} <= set(a.keys)


@pytest.mark.parametrize("kind", BODY)
def test_every_cut_inside_the_last_record_is_seen(kind):
    text = "<|BEGIN_CODE|>\n" + BODY[kind]
    start = text.index("CD456") + 2
    missed = [n for n in range(start, len(text) - 1) if read_answer(text[:n], kind).complete is not False]
    # an unquoted value that could be whole cannot be told from the text alone
    assert all(kind in ("YAML", "TOML", "CSV") for _ in missed) and len(missed) <= 1, [text[:n][-20:] for n in missed]


def test_cut_signs_and_broken_characters():
    assert read_answer(BODY["YAML"].replace("71", "7…").split("…")[0] + "…", "YAML").complete is False
    assert read_answer(BODY["TOML"] + "\n[[fer...", "TOML").complete is False
    assert read_answer('{"a": "\\u00', "JSON").reason in ("unclosed_quote", "broken_character")
    assert read_answer('{"a": "caf�', "JSON").complete is False


def test_requested():
    assert requested(QUERY.format("JSON"), "Text") == (2, {"code", "level", "remark"})
    assert requested("Turn it into CSV. Keep code, level.\n\n" + BODY["YAML"], "YAML")[0] == 2
    assert requested("3件の台帳をJSONで表してください。", "Text")[0] == 3 and requested(None, None) == (0, set())


def test_visible():
    assert visible("<|BEGIN_CODE|>\n\n<|END_CODE|>") == visible("```json\n```") == visible("​﻿ \xa0") == visible(None) == ""
    assert visible("`x`") != ""


def test_languages():
    assert leading(votes("Las cajas no deben mojarse nunca.")) == "es"
    assert leading(votes("Seul Olha possède encore la clé.")) == "fr"
    assert leading(votes("予約なしでは見学できません。")) == "ja"
    assert leading(votes("Bator Vinnor 12 AB123")) is None
    assert asked_for("Write the remarks in French. Schreibe auf Deutsch.") == {"fr", "de"}


def test_copies():
    q = QUERY.format("JSON") + "\n\n" + BODY["YAML"]
    assert is_copy(q, q) and is_copy(q, "> " + q.upper().replace("\n", "\n> ")) and is_copy(q, '{"answer": "%s"}' % q.replace("\n", "\\n").replace('"', "'"))
    assert is_copy(q, q + "\n" + q) and is_copy(q, "Sure, here it is:\n" + q)
    assert not is_copy(q, BODY["JSON"]) and not is_copy(q, q.split("\n")[0] + "\n" + BODY["JSON"] + BODY["JSON"].replace("ring", "knock")) and not is_copy(None, q) and not is_copy(q, "")


SCHEMA = "eval_id long, query string, text string, output_type string, input_type string, stop_reason string, generated_tokens int, export_source string, reason string"


def frame(spark, rows):
    return spark.createDataFrame([(i, q, t, o, "Text", s, g, src, "own") for i, (q, t, o, s, g, src) in enumerate(rows)], SCHEMA)


ROWS = [
    (QUERY.format("JSON"), BODY["JSON"], "JSON", "eos", 60, "a"),
    (QUERY.format("JSON"), BODY["JSON"][:-40], "JSON", None, None, "a"),
    (QUERY.format("JSON"), None, "JSON", None, None, None),
    (QUERY.format("JSON"), "<|BEGIN_CODE|>\n<|END_CODE|>", "JSON", "eos", 1, "b"),
    (QUERY.format("XML"), "I'm sorry, but I cannot help with that.", "XML", "eos", 9, "b"),
    (QUERY.format("JSON"), '{"error": "Leider kann ich das nicht erstellen."}', "JSON", "eos", 9, "b"),
    (QUERY.format("JSON"), QUERY.format("JSON"), "JSON", "eos", 9, "b"),
    (QUERY.format("YAML"), BODY["YAML"].replace(REMARK, "Las cajas no deben mojarse nunca.").replace("code", "código").replace("remark", "observación").replace("level", "nivel"), "YAML", "eos", 50, "b"),
    (QUERY.format("YAML"), BODY["YAML"] + "\nI could not verify the dates.", "YAML", "max_new_tokens", 50, "b"),
    (None, BODY["CSV"], "CSV", None, None, "b"),
    (None, "x" * 300_000, None, None, None, "b"),
    (QUERY.format("CSV"), BODY["CSV"].rsplit("\n", 1)[0], "CSV", "eos", 20, "b"),
]


def test_defects(spark):
    got = sorted((r["eval_id"], r["defect"]) for r in answer_defects(frame(spark, ROWS + ROWS[:2]), "eval_id").collect())
    assert got == [(1, "truncated"), (2, "empty"), (3, "empty"), (4, "refusal"), (5, "refusal"), (6, "copies_query"), (7, "other_language"), (11, "truncated"), (13, "truncated")]


def test_truncated_and_shares(spark):
    v = truncated_answers(frame(spark, ROWS), "eval_id")
    assert {r["eval_id"]: r["reason"] for r in v.filter("truncated").collect()} == {1: "unclosed_quote", 11: "missing_records"}
    shares = {r["answer_source"]: (r["answers"], r["cut_answers"]) for r in truncation_by_source(v).collect()}
    assert shares == {"a": (2, 1), "b": (9, 1), None: (1, 0)}


def test_empty_table(spark):
    assert answer_defects(frame(spark, []), "eval_id").count() == 0 and truncated_answers(frame(spark, []), "eval_id").count() == 0


def test_source_baseline_decides_an_open_last_value(spark):
    cut = "<|BEGIN_CODE|>\nferrys:\n  - code: AB123\n    level: 5\n  - code: CD456\n    level: 7"
    base = [(None, "<|BEGIN_CODE|>\n" + BODY["JSON"] + "\n<|END_CODE|>", "JSON", "eos", 60, "sure")] * 250
    rows = [*base, (None, cut, "YAML", None, None, "sure"), (None, cut, "YAML", None, None, "loose"), (None, "<|BEGIN_CODE|>\n" + BODY["JSON"], "JSON", "eos", 60, "loose")]
    got = [r["eval_id"] for r in truncated_answers(frame(spark, rows), "eval_id").filter("truncated").collect()]
    assert got == [250]
    rows[-2] = (None, cut, "YAML", "eos", 200, "loose")
    assert sorted(r["eval_id"] for r in truncated_answers(frame(spark, rows), "eval_id").filter("truncated").collect()) == [250, 251]


def test_token_counts_decide_in_every_script(spark):
    latin = "<|BEGIN_CODE|>\nferrys:\n  - code: AB123\n    name: Zoë\n  - code: CD456\n    name: Fenfi"
    other = latin.replace("Zoë", "港の船").replace("Fenfi", "北の倉庫")
    closed = [(None, BODY["JSON"], "JSON", "eos", len(BODY["JSON"]) // 4, "a"), (None, '{"name": "港の船と北の倉庫", "place": "南の港の近く"}', "JSON", "eos", 24, "a")] * 5
    cut, whole = [[(None, t, "YAML", None, len(t.encode()) // per, "a") for t in (latin, other)] for per in (1, 3)]
    whole = [(q, t, o, s, n * 3 // 4, src) for q, t, o, s, n, src in whole]
    got = [r["eval_id"] for r in truncated_answers(frame(spark, [*closed, *cut, *whole]), "eval_id").filter("truncated").collect()]
    assert sorted(got) == [10, 11]


def test_a_message_inside_cut_data_is_no_refusal():
    cut = 'Here:\n{"shops": [{"code": "A1", "remark": "Sorry, we cannot accept the crates on Fri'
    assert profile("Write JSON for 3 shops with code, remark.", cut, "JSON", "Text", None, None)[0] is False
    whole = '{"note": "Sorry, I cannot write this."}'
    names = [c.split()[0] for c in PROFILE.split(", ")]
    assert dict(zip(names, profile("Write JSON for 3 shops with code, remark.", whole, "JSON", "Text", None, None)))["refusal"]


def test_languages_of_texts_with_other_subjects():
    """Texts about subjects that no word list knows, by their function words alone."""
    said = {
        "en": "the comet was so bright that nobody could see any of those stars until it had gone below the horizon",
        "de": "der komet war so hell dass man keinen von diesen sternen sehen konnte bis er unter dem horizont war",
        "fr": "la comète était si brillante que personne ne voyait plus aucune de ces étoiles avant son départ",
        "es": "el cometa era tan brillante que nadie podía ver ninguna de estas estrellas hasta que se fue",
        "pt": "o cometa era tão brilhante que ninguém via nenhuma dessas estrelas até ele se pôr",
        "it": "la cometa era così luminosa che nessuno vedeva più quelle stelle prima che essa fosse sotto l'orizzonte",
        "nl": "de komeet was zo helder dat niemand nog een van die sterren kon zien voordat hij onder was",
        "sv": "kometen var så ljus att ingen kunde se några av de andra stjärnorna innan den hade gått ned",
        "pl": "kometa była tak jasna że nikt nie widział już tych gwiazd przed jej zachodem",
        "ja": "彗星はとても明るかったので星は見えませんでした",
    }
    for lang, text in said.items():
        assert leading(votes(text)) == lang, (lang, votes(text).most_common(3))
