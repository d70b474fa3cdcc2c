"""Chunk grammar, scenarios, files, attempts and coverage on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from helpers import evaluate, rows
from riskscope.functions import routes
from riskscope.operators import chunks as chunk_ops, prompts
from riskscope.plans import rendering, route_plan, scenarios
from riskscope.plans.pipeline import batch_requests, plan_batch, plan_tests

KEYS = ["class_name"]
CLASS = (
    "La classe PHP LedgerController (type: controllers) dans Controller/LedgerController.php."
    " → Profil: web_crud → Rôles classe: ADMIN"
)
RENDER = (
    "Méthode 'overview' (LedgerController) — Route: /ledger/ — Template: ledger/overview.html.twig\n"
    "  → Type de réponse: render (200)\n  → H1: Open ledgers"
)
AJAX = (
    "Méthode 'rowsOf' (LedgerController) — Route: /ledger/rows\n  → Type de réponse: json (200)\n"
    "  → AJAX uniquement\n  → Verbes HTTP: GET"
)
FORM = (
    "Méthode 'amend' (LedgerController) — Route: /ledger/{id}/amend — Template: ledger/amend.html.twig\n"
    "  → Type de réponse: render (200), redirect (302)\n  → Formulaire: LedgerType\n"
    "  → Verbes HTTP: GET, POST\n  → H1: Amend ledger"
)
DELETE = (
    "Méthode 'discard' (LedgerController) — Route: /ledger/{id}/discard\n  → Type de réponse: redirect (302)\n"
    "  → Rôle requis (méthode): OWNER\n  → Verbes HTTP: DELETE"
)
MULTI_A = "Méthode 'browse' (LedgerController) — Route: /ledger/browse\n  → Type de réponse: render (200)"
MULTI_B = "Méthode 'browse' (LedgerController) — Route: /ledger/browse/page/{page}\n  → Type de réponse: render (200)"
PRIVATE = "Méthode 'prepareTotals' (LedgerController) — méthode interne sans route"
INTERNAL = "Méthode 'settle' (DocketController)\n  → Pas de route HTTP (méthode interne)"


def chunk_frame(spark, *contents):
    data = [("LedgerController", i, c) for i, c in enumerate(contents)]
    return spark.createDataFrame(data, "class_name string, pos long, content string")


def planned(chunks):
    settings = chunk_ops.class_settings(chunks, KEYS)
    first = scenarios.first_routes(chunk_ops.method_references(chunks), KEYS)
    return chunk_ops.chunk_metadata(scenarios.rank_routes(first, KEYS).join(settings, KEYS), F.col("class_role"))


def names(spark, *contents):
    found = scenarios.expand(planned(chunk_frame(spark, CLASS, *contents)), KEYS)
    return [r["func_name"] for r in found.orderBy("pos", "scenario_no").collect()]


def whole_file(spark, *contents):
    return plan_tests(chunk_frame(spark, *contents)).segments


def test_render_route(spark):
    assert names(spark, RENDER) == [
        "testOverviewRedirectsWhenNotAuthenticated",
        "testOverviewIsReachedWithAdminRole",
        "testOverviewIsReachedWithConsultRole",
    ]


def test_ajax_route(spark):
    assert names(spark, AJAX) == [
        "testRowsOfRedirectsWhenNotAuthenticated",
        "testRowsOfReturnsJsonWithAdminRole",
        "testRowsOfWithoutXhrReturns404",
    ]


def test_form_route(spark):
    assert names(spark, FORM) == [
        "testAmendRedirectsWhenNotAuthenticated",
        "testAmendDisplaysFormWithAdminRole",
        "testAmendSubmitWithAdminRole",
        "testAmendNotFoundWithAdminRole",
    ]


def test_higher_role(spark):
    assert names(spark, DELETE) == [
        "testDiscardRedirectsWhenNotAuthenticated",
        "testDiscardRedirectsWithOwnerRole",
        "testDiscardForbiddenWithAdminRole",
        "testDiscardNotFoundWithOwnerRole",
    ]


def test_routes_of_one_method(spark):
    found = names(spark, MULTI_A, MULTI_B, MULTI_A, MULTI_B)
    assert len(found) == len(set(found)) == 7
    assert sum("BrowseRoute2" in n for n in found) == 4


def test_contract_row(spark):
    content = (
        "Méthode 'amend' (DocketController) — Template: docket/amend.html.twig — Changes a docket. — Params: (int $id)"
        " — Route: /docket/{id}/amend (name: docket_amend)\n  → Verbes HTTP: GET, POST\n"
        "  → Rôle requis (méthode): ROLE_OWNER\n  → Type de réponse: render (200)\n"
        "  → Type de réponse: redirect (302)\n  → AJAX uniquement (isXmlHttpRequest)\n  → Formulaire: DocketType\n"
        "  → Verbe HTTP inféré (body): POST\n  → Lit: POST data\n"
        "  → Voter: denyAccessUnlessGranted('edit', $docket)"
    )
    m = planned(chunk_frame(spark, content)).head()
    assert (m.method_name, m.http_verb, m.method_role, m.route) == ("amend", "POST", "ROLE_OWNER", "/docket/1/amend")
    assert m.has_form and m.is_ajax and m.has_voter and m.has_render and m.has_redirect and not m.has_json


def test_whole_file(spark):
    files = rendering.join_segments(whole_file(spark, CLASS, RENDER, PRIVATE, FORM)).collect()
    assert len(files) == 1
    text = files[0].text
    assert text.startswith("<?php\n\nnamespace App\\Tests\\Functional\\Controller;\n")
    assert "final class LedgerControllerTest extends WebTestCase" in text
    assert "    }\n\n    // Méthodes sans route HTTP (non testées ici) : prepareTotals\n\n    /** /ledger/ — non authentifié" in text
    assert "assertResponseStatusCodeSame(307)" in text and "testPrepareTotals" not in text
    assert "$this->assertSelectorTextContains('h1', 'Open ledgers');\n    }\n\n    /** " in text
    assert text.endswith("    }\n}\n") and text.count("{") == text.count("}")


def test_small_slots_give_the_same_file(spark):
    segments = whole_file(spark, CLASS, RENDER, PRIVATE, FORM, MULTI_A, MULTI_B, DELETE)
    whole = rendering.join_segments(segments).head().text
    assert rendering.join_segments(segments, slot=1).head().text == whole


def test_a_large_class_is_one_file(spark):
    methods = [f"Méthode 'm{i}' (LedgerController) — Route: /ledger/m{i}\n  → Type de réponse: render (200)" for i in range(3200)]
    chunks = chunk_frame(spark, CLASS, *methods).withColumn("pos", F.col("pos") * chunk_ops.METHOD_STRIDE)
    files = plan_tests(chunks).files().collect()
    assert len(files) == 1
    text = files[0].text
    assert text.count("RedirectsWhenNotAuthenticated()") == 3200 and text.index("testM9Redirects") < text.index("testM10Redirects")


def test_internal_class(spark):
    settings = chunk_ops.class_settings(chunk_frame(spark, INTERNAL), KEYS)
    functional, unit = chunk_ops.split_internal(settings)
    assert functional.count() == 0 and unit.head().profile == "internal"


@pytest.mark.parametrize(
    "name, path, content, verb",
    [
        ("show", "/a", "→ Verbes HTTP: GET, PUT", "PUT"),
        ("show", "/a", "→ Verbes HTTP: HEAD", "HEAD"),
        ("show", "/a", "→ Formulaire: X", "POST"),
        ("show", "/a", "→ Verbe HTTP inféré (body): DELETE\n→ Formulaire: X", "DELETE"),
        ("deleteAll", "/a", "", "DELETE"),
        ("newsletter", "/a", "", "POST"),
        ("show", "/address", "", "POST"),
        ("editor", "/a", "", "PUT"),
        ("show", "/a", "", "GET"),
    ],
)
def test_http_verb(spark, name, path, content, verb):
    row = spark.createDataFrame([(content, name, path)], "c string, n string, p string")
    assert row.select(routes.http_verb(F.col("c"), F.col("n"), F.col("p"))).head()[0] == verb


def test_route_values(spark):
    assert evaluate(spark, routes.resolve_route, "/a/{id}/{Slug}/{x}/{tab}.{") == "/a/1/exemple/test/general.{"
    assert evaluate(spark, routes.role_label, "ROLE_SUPER_ADMIN") == "Super_Admin"
    assert routes.parse_role_map("ROLE_A:KEY, ROLE_B : B,x") == {"ROLE_A": "KEY", "ROLE_B": "B"}


@pytest.mark.parametrize(
    "attempts, kept, ok",
    [
        ([(0, "length")] * 3, None, False),
        ([(1, "length"), (0, "length"), (0, "length")], 1, True),
        ([(1, "length"), (2, "stop")], 2, True),
        ([(2, "length"), (2, "length")], 1, True),
        ([(1, None), (5, "stop")], 1, True),
    ],
)
def test_best_attempt(spark, attempts, kept, ok):
    data = [("r", i + 1, n, reason, 10, 1.0) for i, (n, reason) in enumerate(attempts)]
    df = spark.createDataFrame(
        data, "route string, attempt int, n_blocks int, done_reason string, tokens int, elapsed double"
    )
    row = route_plan.best_attempt(df, ["route"]).head()
    assert (row.kept, row.ok) == (kept, ok)
    if attempts[0][1] is None:
        assert (row.attempts, row.tokens) == (1, 10)


@pytest.mark.parametrize(
    "given, want",
    [
        ("a a a2 b a", "a a2 a22 b a3"),
        ("a2 a a", "a2 a a3"),
        ("a2 a a a22 a222 a2222", "a2 a a3 a22 a222 a2222"),
        ("x1 x1 x1 x12", "x1 x12 x13 x122"),
        ("b c d", "b c d"),
    ],
)
def test_unique_names(spark, given, want):
    df = spark.createDataFrame([("f", i, n) for i, n in enumerate(given.split())], "file string, pos long, name string")
    named = route_plan.unique_names(df, ["file"], "name", "pos").orderBy("pos").collect()
    assert [r["name"] for r in named] == want.split()


def test_attempts_beyond_three(spark):
    data = [("r", i, 0, "length", 5, 1.0) for i in (1, 2, 3)] + [("r", 4, 2, "stop", 7, 1.5), (None, 1, 1, "stop", 3, 0.5)]
    df = spark.createDataFrame(
        data, "route string, attempt int, n_blocks int, done_reason string, tokens int, elapsed double"
    )
    found = {r.route: r for r in route_plan.best_attempt(df, ["route"]).collect()}
    assert (found["r"].kept, found["r"].attempts, found["r"].tokens, found["r"].ok) == (4, 4, 22, True)
    assert found[None].kept == 1


def test_route_files_rename_inside_blocks(spark):
    block = "    public function testX(): void {\n        // testX(\n    }"
    data = [("C", 0, 0, block), ("C", 1, 0, block), ("C", 1, 1, "    // note")]
    df = spark.createDataFrame(data, "class_name string, pos long, part int, block string")
    text = route_plan.route_files(df, KEYS).head().text
    assert "function testX(): void {\n        // testX(" in text and "function testX2(): void {\n        // testX(" in text
    assert text.endswith("    // note\n}\n")


def test_uncovered_routes(spark):
    wanted = spark.createDataFrame(
        [("C", "/ledger/{id}"), ("C", "/docket"), ("C", "/a.b"), ("D", "/x")], "class_name string, raw_route string"
    )
    texts = spark.createDataFrame([("C", "get('/ledger/1'); get('/docketber'); get('/aXb');")], "class_name string, text string")
    missing = route_plan.uncovered_routes(wanted, texts, KEYS)
    assert rows(missing) == [("C", "/a.b"), ("D", "/x")]
    assert rows(route_plan.coverage_retry(missing, KEYS)) == [("C", 1), ("D", 1)]


def test_patterns_run_on_hits_only(spark):
    routes = [(i, "C", f"/admin/part{i}/{{id}}/edit") for i in range(40)] + [(40, "C", "/{id}"), (41, "C", "/docket"), (42, None, "/a/b/")]
    texts = [(i, "C", f"get('/admin/part{i}/7/edit'); get('/x')") for i in range(0, 40, 2)] + [(90, "D", "/admin/part1/7/edit"), (91, None, "/a/b/")]
    asked = spark.createDataFrame(routes, "route_id long, class_name string, route string")
    given = spark.createDataFrame(texts, "text_id long, class_name string, text string")
    hits = route_plan.route_hits(asked, given, KEYS)
    assert hits.count() == 20 + 2 * 20 < len(routes) * len(texts) / 10
    left = route_plan.uncovered_routes(asked.withColumnRenamed("route", "raw_route"), given, KEYS)
    assert sorted(r.route_id for r in left.collect()) == [*range(1, 40, 2), 41, 42]
    assert left.columns == ["route_id", "class_name", "raw_route"]


def test_generation_outcome(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", True)], "k string, ok boolean")
    found = route_plan.generation_outcome(df, ["k"]).select("k", "status")
    assert rows(found) == [("a", "partial"), ("b", "failed"), ("c", "success")]


def test_entity_types_and_fixtures(spark):
    content = "Params: (Invoice $a, ?Invoice $b, Request $r, int $i, LedgerType $f, BarService $s, \\Voucher $d, x)"
    chunks = chunk_frame(spark, content)
    counts = rendering.entity_type_counts(chunks, KEYS)
    assert rows(counts, "entity_type", "n") == [("Invoice", 2), ("Voucher", 1)]
    files = rendering.fixture_files(rendering.fixture_segments(counts)).collect()
    assert len(files) == 1
    text = files[0].text
    assert text.index("use App\\Entity\\Invoice;") < text.index("use App\\Entity\\Voucher;")
    assert "// $invoice = new Invoice();" in text and "final class LedgerControllerTestFixtures" in text


def test_prompts(spark):
    long = "{" * 10 + "x" * 4000
    cut = evaluate(spark, lambda t: prompts.truncate_example(t, 3500), long)
    assert cut.endswith("\n// [tronqué]\n" + "}" * 10) and len(cut) == 3500 + 14 + 10
    lines = [
        (0, '{"response": "```php\\n<?php ", "done": false}'),
        (1, "not json"),
        (2, '{"response": "echo;", "done": true, "done_reason": "stop", "eval_count": 7}'),
        (3, '{"response": "late", "done": true}'),
    ]
    df = spark.createDataFrame([("q", s, line) for s, line in lines], "id string, seq long, line string")
    row = prompts.assemble_responses(df, ["id"]).head()
    assert (row.text, row.done_reason, row.eval_count) == ("<?php echo;", "stop", 7)
    missing = prompts.with_context(
        spark.createDataFrame([("q",)], "id string"), spark.createDataFrame([], "id string, context string"), ["id"]
    )
    assert missing.head().context == prompts.NO_CONTEXT


def test_batch(spark):
    chunks = chunk_frame(spark, CLASS, RENDER).unionByName(
        spark.createDataFrame([("DocketController", 0, INTERNAL)], "class_name string, pos long, content string")
    )
    requests = batch_requests(spark, ["LedgerController", "Docket-Controller"])
    assert rows(requests, "test_name") == [("DocketControllerTest",), ("LedgerControllerTest",)]
    plan = plan_batch(chunks, requests)
    assert rows(plan.files().select("class_name")) == [("LedgerController",)]
    assert rows(plan_tests(chunks).internal, "class_name") == [("DocketController",)]
    with pytest.raises(ValueError):
        batch_requests(spark, [])
