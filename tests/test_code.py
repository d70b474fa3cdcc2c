"""Source text and class facts on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import evaluate, one
from riskscope.functions import code, facts, templates
from riskscope.functions.commits import is_bugfix
from riskscope.operators import code_facts
from riskscope.sources.files import read_class_facts


@pytest.mark.parametrize(
    "text",
    [
        "{ if ($x) { return $x; } }",
        "{ // commentaire { ouvert\n $x = 1; }",
        "{ /* { non compté } */ return 1; }",
        '{ $s = "a{b}c"; }',
        "{ // l'input est 'final'\n return 1; }",
        "{ int $x = 1; if ($x) { return $x; } return 0; }",
        "{ $s = 'it\\'s }'; # }\n }",
    ],
)
def test_balanced_block_whole(spark, text):
    assert evaluate(spark, code.balanced_block, text + " tail }") == text


@pytest.mark.parametrize("text", ["{ open", "no brace", "{ 'unclosed }", "{ /* unclosed }"])
def test_balanced_block_none(spark, text):
    assert evaluate(spark, code.balanced_block, text) is None


def test_balanced_block_long_literal(spark):
    text = "{ $s = '" + "x" * 300_000 + "{'; }"
    assert evaluate(spark, code.balanced_block, text) == text


SOURCE = """<?php
class Foo extends Bar
{
    private int $x;
    private ?Baz $y;
    public function bar(): int {
        if ($this->x > 0) { return $this->x; }
        return 0;
    }
    public function empty() {}
}
"""


def test_class_and_method_blocks(spark):
    df = spark.createDataFrame([(SOURCE,)], "t string")
    row = df.select(
        code.class_block(F.col("t"), F.lit("Foo")).alias("c"),
        code.method_block(F.col("t"), F.lit("bar")).alias("m"),
        code.method_body(F.col("t"), F.lit("bar")).alias("b"),
        code.method_body(F.col("t"), F.lit("nothing")).alias("n"),
        code.properties(F.col("t")).alias("p"),
    ).head()
    assert row.c == SOURCE[SOURCE.index("class") :].rstrip("\n")
    assert row.m.startswith("public function bar(): int {") and row.m.endswith("return 0;\n    }")
    assert row.b.startswith("\n        if") and row.n == ""
    assert [(p["type"], p["name"]) for p in row.p] == [("int", "x"), ("Baz", "y")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("if ($a && $b) { x(); } elseif ($c) { y(); } else if ($d ?? 1) {}", 7),
        ("return $x?->y;", 2),
        ("foreach ($a as $b) { switch ($b) { case 1: case 2: break; } }", 4),
        ("", 1),
        (None, 1),
        ("éif ifé if", 2),
    ],
)
def test_cyclomatic(spark, text, expected):
    assert evaluate(spark, code.cyclomatic, text) == expected


def test_line_counts(spark):
    assert evaluate(spark, code.file_loc, "") == 1
    assert evaluate(spark, code.body_loc, "") == 0
    assert evaluate(spark, code.body_loc, "a\nb") == 2


def test_strip_comments(spark):
    text = "a(); // x\n$u = 'http://h'; /* b\nc */ d(); # e\n"
    assert evaluate(spark, code.strip_comments, text) == "a();  \n$u = 'http://h';   d();  \n"
    kept = evaluate(spark, lambda t: code.strip_comments(t, keep_lines=True), text)
    assert kept.count("\n") == text.count("\n")


@pytest.mark.parametrize(
    "body, types, form",
    [
        ("return $this->render('foo/index.html.twig', []);", ["render (200)"], False),
        ("return $this->redirectToRoute('foo_index');", ["redirect (302)"], False),
        ("return $this->json([]);", ["json (200)"], False),
        ("return new JsonResponse([]);", ["json (200)"], False),
        ("echo file_get_contents($p); header('Content-Disposition: attachment');", ["file_download (200)"], False),
        ("return new ExportResponse($data);", ["export (200)"], False),
        ("return new BinaryFileResponse($path);", ["binary (200)"], False),
        (
            "if ($f->isSubmitted()) { return $this->redirect('/'); } return $this->render('a.twig');",
            ["render (200)", "redirect (302)"],
            True,
        ),
        ("set_time_limit(0); return $result;", [], False),
    ],
)
def test_body_signals(spark, body, types, form):
    s = evaluate(spark, code.body_signals, body)
    assert list(s["response_types"]) == types and s["has_form"] == form


def test_body_details(spark):
    s = evaluate(
        spark,
        code.body_signals,
        "if (!$request->isXmlHttpRequest()) {} $this->createForm(App\\Form\\CommentType::class);"
        " $this->denyAccessUnlessGranted('view', $invoice, 'x'); $this->denyAccessUnlessGranted('edit');"
        " $request->request->get('a'); $request->query->get('b'); $request->files->get('c');",
    )
    assert s["is_ajax_only"] and s["form_type"] == "CommentType" and s["body_inferred_verb"] == "POST"
    assert [(v["attribute"], v["subject"]) for v in s["voter_checks"]] == [("view", "invoice"), ("edit", None)]
    assert list(s["body_reads"]) == ["POST data", "query string", "uploaded files"]
    checked = evaluate(spark, code.body_signals, "$request->isMethod('DELETE'); $request->request->get('a');")
    assert checked["body_inferred_verb"] == "DELETE" and list(checked["body_reads"]) == []


@pytest.mark.parametrize(
    "subject, expected",
    [
        ("fix: total", True),
        ("Fixture loader", True),
        ("[Hotfix] login", True),
        ("feat: bugfix table", True),
        ("Corrige le calcul", True),
        ("refactor #12 fix typo", True),
        ("feat [FIX] x", True),
        ("prefix change", False),
        ("add fix", False),
        ("debugfix x", False),
    ],
)
def test_bugfix_subjects(spark, subject, expected):
    assert evaluate(spark, is_bugfix, subject) is expected


def test_test_blocks(spark):
    text = (
        "```php class X { public function testA(): void { $x = '{'; }\n function helper() {}\n"
        " public function testB($a) {\n  if(1){ }\n }\n public function testC() { oops"
    )
    blocks = evaluate(spark, code.test_blocks, text)
    assert blocks == [
        "    public function testA(): void { $x = '{'; }",
        "    public function testB($a) {\n      if(1){ }\n     }",
    ]


def _facts(spark, tmp_path, record):
    path = tmp_path / "facts.json"
    path.write_text(json.dumps(record) + "\n")
    return code_facts.class_facts(read_class_facts(spark, str(path)))


def _attribute(kind, *positional, **named):
    args = [{"name": None, "value": v} for v in positional] + [{"name": k, "value": v} for k, v in named.items()]
    return {"name": kind, "args": args}


def _method(name, attributes=(), docblock=None, body="", params=()):
    return {
        "name": name,
        "attributes": list(attributes),
        "params": list(params),
        "return_type": None,
        "docblock": docblock,
        "body": body,
    }


def test_class_facts(spark, tmp_path):
    param = lambda name, kind: {"name": name, "type": kind, "has_default": False}
    record = {
        "file": "Controller/ProductController.php",
        "content": SOURCE,
        "class_name": "ProductController",
        "class_attributes": [_attribute("Route", "/product"), _attribute("IsGranted", "ROLE_COURSE")],
        "class_docblock": None,
        "methods": [
            _method("__construct", params=[param("repo", "ProductRepository"), param("em", "?\\EntityManagerInterface")]),
            _method("index", [_attribute("Route", "/", name="product_index")], "/** Liste. */", "$this->render('a.twig');"),
            _method("new", [_attribute("Route", "/new", methods=["get", "POST"]), _attribute("IsGranted", "ROLE_ADMIN")]),
            _method(
                "weird",
                [_attribute("Route", name="weird_order", methods=["GET"], path="/weird", requirements={"id": ["a", 1]})],
            ),
            _method("edit", [_attribute("Route", "/{id}/edit")], "/** @IsGranted('ROLE_EDITOR') */"),
            _method("old", docblock='/** @Route("/foo", methods={"DELETE"}) */'),
            _method("listAction"),
            _method("broken", [_attribute("Route", 5)]),
        ],
    }
    row = _facts(spark, tmp_path, record).head()
    by_name = {m["name"]: m for m in row.method_facts}
    paths = {n: [(r["path"], list(r["http_methods"])) for r in m["routes"]] for n, m in by_name.items()}
    assert paths == {
        "__construct": [],
        "index": [("/product/", [])],
        "new": [("/product/new", ["GET", "POST"])],
        "weird": [("/product/weird", ["GET"])],
        "edit": [("/product/{id}/edit", [])],
        "old": [("/product/foo", ["DELETE"])],
        "listAction": [("/product", [])],
        "broken": [],
    }
    assert by_name["index"]["description"] == "Liste."
    assert by_name["index"]["routes"][0]["name"] == "product_index"
    assert [g["role"] for g in row.class_grants] == ["ROLE_COURSE"]
    assert [g["role"] for g in by_name["new"]["method_grants"]] == ["ROLE_ADMIN"]
    assert [g["role"] for g in by_name["edit"]["method_grants"]] == ["ROLE_EDITOR"]
    assert [(p["type"], p["name"]) for p in row.constructor_params] == [
        ("ProductRepository", "repo"),
        ("EntityManagerInterface", "em"),
    ]
    counted = code_facts.method_rows(_facts(spark, tmp_path, record)).select("nb_methods_in_class").distinct().collect()
    assert [r[0] for r in counted] == [8]


@pytest.mark.parametrize(
    "types, expected",
    [
        (["json", "json", "json"], "api"),
        (["render", "render"], "web_crud"),
        ([], "internal"),
        (["render", "json", "render", "json"], "mixed"),
        (["json"] * 7 + ["x"] * 3, "web_crud"),
    ],
)
def test_class_profile(spark, types, expected):
    data = [("C", True, [t]) for t in types] or [("C", False, ["json"])]
    df = spark.createDataFrame(data, "c string, is_routed boolean, response_types array<string>")
    assert code_facts.profile_by_class(df, ["c"]).head()["profile"] == expected


def test_doc_summary(spark):
    assert evaluate(spark, facts.doc_summary, "/**\n * Première ligne.\n * Suite.\n */") == "Première ligne."
    assert evaluate(spark, facts.doc_summary, "/** Une ligne. */") == "Une ligne."
    assert evaluate(spark, facts.doc_summary, "/* rien */") is None


HTML = (
    "{% set page_title = 'Liste' %}<h1>Mes <b>items</b> {{ n }}</h1><h4>no</h4>"
    '<a class="nav-link active" href="#">Général</a><button>Ajouter</button><button>{{ x }}</button>'
    '<input type="hidden" id="hid1"><input name="nom"><table id="t1"></table>'
    "<a href=\"{{ path('foo_new') }}\">Nouveau</a>{{ include('part.html.twig') }}"
)


def test_template_facts(spark):
    t = evaluate(spark, templates.template_facts, HTML).asDict()
    assert t == {
        "page_titles": ["Liste"],
        "headings": ["Mes items"],
        "nav_tabs": ["Général"],
        "links": ["foo_new"],
        "buttons": ["Ajouter", "Nouveau"],
        "inputs": ["nom"],
        "hidden_ids": ["hid1"],
        "table_ids": ["t1"],
        "includes": ["part.html.twig"],
    }
    text = one(spark, templates.index_text(F.lit("a.twig"), templates.template_facts(F.col("t"))), t=HTML)
    assert text.startswith("Le template a.twig. Titres H1 : Liste, Mes items. Boutons/Liens : Ajouter, Nouveau.")
