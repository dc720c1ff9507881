import pytest

from lodestrata.llm.residue import find_residue, host_boilerplate, line_hash, normal_line, residue_kinds

GOOD = "The renderer answered with status 500 twice, so job 874 was queued again and passed."
FOUND = {
    "placeholder": ["Dear {{ name }}, the run has finished.", "See [INSERT AUTHOR HERE] for the table.", "The <model_name> of the run was steady.", "Report on ${date} by ${author}", "After 9 %(format)s the value rose.", "The [Your metric] was low.", "The __SCORE__ was high.", "Report on <%= run_id %>.", "Dear <first name>, the run has ended.", "Dear ((name)), the run has ended.", "{{#if name}} Hello"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "xxxx xxx xxxxx xx xxxx", "Results: TBD\nSetup: TODO", "Data: ???", "Dummy text for the layout. Dummy text for the layout.", "foo bar test asdf blah qwer", "Please replace this paragraph before the release.", "Your text goes here.", "Hier steht später der Text der Notiz.", "Texte à remplacer par le résumé.", "Texto de relleno para la sección.", "Testo segnaposto.", "Insira aqui o resumo.", "Vul hier de samenvatting in.", "ここに本文を入力してください。"],
    "error": ["404 Not Found", "Access denied. You do not have the rights to open this report.", "Une erreur 502 est survenue. Réessayez plus tard.", "Seite nicht gefunden (Fehler 503).", "ページが見つかりません（エラー502）。", "Traceback: TemplateNotFound: report_9.html", "Your session has expired. Sign in again to see this page.", "We can't find that page. It may have been moved or deleted.", "The site is down for maintenance until 6:00.", "Pagina non trovata (errore 404).", "Si è verificato un errore. Riprova più tardi.", "Página não encontrada.", "Ocorreu um erro. Tente novamente mais tarde.", "Pagina niet gevonden.", "Er is een fout opgetreden. Probeer het later opnieuw.", "We are sorry, but the page that you have requested, which may have been there only a short while ago, could not be found on this server today."],
    "script_required": ["Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um den Bericht zu sehen.", "このページを表示するにはJavaScriptを有効にしてください。", "Abilita JavaScript per vedere questa pagina.", "Ative o JavaScript para ver esta página.", "Schakel JavaScript in om deze pagina te zien.", "<noscript>Your browser does not run scripts; the report cannot be shown.</noscript>"],
}
CLEAN = [
    GOOD,
    "Our prompt template has the slots {query} and {output_type}, and both were filled for all 921 tasks.",
    "An earlier draft by Ramar used placeholders such as TBD for the render score; they are gone now.",
    'Users of the depot demo saw "Please enable JavaScript" until Elgal fixed the yarn route in build 71.',
    'Task 082286 asks for an error page in HTML, and the answer contains the heading "404" as required, along with 7 links.',
    "Keep scripts enabled in the preview of report 88, since the charts of Norfir are drawn by them.",
    "The layout test used 5 lorem ipsum blocks, but the scored pages hold only real inlet data.",
    '```html\n<li v-for="x in moss">{{ x.code }}</li>\n```',
    "```bash\ncp out/${RUN_ID}/moss.json /data/\n```",
    "```\n{{ open }}",
    "[0.1, 0.2] and x[i] < y, with {3, 4}",
    "",
    " ",
    "a",
    None,
]


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in FOUND.items() for t in ts])
def test_found(kind, text):
    assert residue_kinds(f"{GOOD}\n\n{text}\n\n{GOOD}") == [kind]


@pytest.mark.parametrize("kind", ["error", "script_required"])
@pytest.mark.parametrize("size", [650, 950, 20_000])
def test_found_in_long_blocks(kind, size):
    block = "\n".join(FOUND[kind][:1] * (size // len(FOUND[kind][0]) + 1))
    assert len(block) > size and residue_kinds(f"{GOOD}\n\n{block}\n\n{GOOD}") == [kind]
    assert residue_kinds(f"{block}\n" + f"{GOOD}\n" * (2 * block.count("\n") + 4)) == []


def test_every_dummy_sentence_has_a_piece():
    """The pieces that gate the pattern of dummy sentences leave none of the examples out."""
    from lodestrata.llm.residue import _DUMMY, _DUMMY_PIECES

    for said in ("TBD", "to be done", "a placeholder heading for the top", "this is sample text", "text here", "delete these lines", "type it below", "wird noch ergänzt", "hier bitte eintragen", "à venir", "écrivez ici", "por definir", "sustituya este texto", "da completare", "sostituire questo", "a preencher", "digite seu nome", "nog in te vullen", "vervang deze zin", "準備中", "この文章は後で差し替え", "本文が入ります"):
        assert _DUMMY.fullmatch(said), said
        assert any(p in f" {said.lower()} " for p in _DUMMY_PIECES), said


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert residue_kinds(text) == []


def test_operator(spark):
    rows = [(i, f"{GOOD} {i}", "h") for i in range(30)] + [(50, FOUND["filler"][0], "h"), (50, FOUND["filler"][0], None), (51, None, "h"), (52, "", None), (53, FOUND["error"][0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "id").selectExpr("id", "text", "source", "1 AS t", "2 AS lines")
    assert sorted(r["id"] for r in find_residue(df, "id").collect()) == [50, 50, 53]
    assert find_residue(df.limit(0), "id").count() == 0


def test_boilerplate_of_a_host_is_subtracted(spark):
    notice = "Please enable JavaScript to view this page."
    rows = [(i, f"{notice}\n{GOOD} Number {i} of Names{'x' * i}", "site") for i in range(40)] + [(99, f"{notice}", "other")] + [(100 + i, f"{notice}\nText", "site") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    b = {r["host_key"]: r["lines"] for r in host_boilerplate(df).collect()}
    assert list(b) == ["site"] and line_hash(notice) in b["site"]
    assert [r["doc_id"] for r in find_residue(df, "doc_id").collect()] == [99]


def test_normal_line_is_the_same_on_both_sides(spark):
    from lodestrata.llm.residue import _normal
    from pyspark.sql import functions as F

    lines = ["  Run 12 of   Ramar-7 Ended ", "Ähm 4　X Yz", "tab\tEnd 1.5"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    assert [r[0] for r in df.select(_normal(F.col("x"))).collect()] == [normal_line(x) for x in lines]
