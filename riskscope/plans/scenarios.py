"""Rule expansion: each route of a class yields its test scenarios.

A rule is a function from settings to a Column holding an array of scenarios, computed
from the chunk metadata columns. New rules are added to `RULES`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskscope.functions import routes
from riskscope.plans.settings import AppSettings
from riskscope.scaling import bucketed_position, position_bucket

SCENARIO = "array<struct<rule: string, comment: string, func_name: string, body: array<string>>>"
MAX_ASSERTED_IDS = 1
MAX_SECONDARY_ROLES = 1

Rule = Callable[[AppSettings], Column]


def _text(*parts: Column | str) -> Column:
    """Concatenation where plain strings are literals and `@name` is a column."""
    return F.concat(
        *[p if isinstance(p, Column) else F.col(p[1:]) if p.startswith("@") else F.lit(p) for p in parts]
    )


def _lines(*lines: Column) -> Column:
    """The lines that are not null, as an array."""
    return F.filter(F.array(*lines), lambda line: line.isNotNull())


def _when(condition: Column, *parts: Column | str) -> Column:
    return F.when(condition, _text(*parts))


def _scenario(rule: str, comment: Column, func_name: Column, body: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), comment.alias("comment"), func_name.alias("func_name"), body.alias("body")
    )


def _if(condition: Column, *scenarios: Column) -> Column:
    return F.when(condition, F.array(*scenarios)).otherwise(F.array().cast(SCENARIO))


def _login(key: str, s: AppSettings) -> Column:
    return _text("$this->client->loginUser($this->getTestUser('", key, f"'), '{s.firewall}');")


def _request(verb: Column | str = "@http_verb", route: str = "@route") -> Column:
    return _text("$this->client->request('", verb, "', '", route, "');")


_SUCCESS = "self::assertResponseIsSuccessful();"
_REDIRECTS = "self::assertResponseRedirects();"
_IS_JSON = "$this->assertJson($this->client->getResponse()->getContent());"
_STATUS_OPEN = "self::assertContains("
_STATUS_CODE = "    $this->client->getResponse()->getStatusCode(),"


def _heading_line() -> Column:
    return _when(F.col("h1") != "", "$this->assertSelectorTextContains('h1', '", "@h1", "');")


def no_auth(s: AppSettings) -> Column:
    """Anonymous request: sent to the login page."""
    return F.array(
        _scenario(
            "no_auth",
            _text("@raw_route", " — non authentifié → WebSSO"),
            _text("test", "@cap", "RedirectsWhenNotAuthenticated"),
            _lines(
                _request(),
                F.lit(f"self::assertResponseStatusCodeSame({s.redirect_status});"),
                F.lit(f"self::assertResponseRedirects('{s.redirect_path}');"),
            ),
        )
    )


def form(s: AppSettings) -> Column:
    """Display and submission of a form."""
    display = _scenario(
        "form_display",
        _text("@raw_route", " — ", "@factory_key", " — affichage formulaire ", F.coalesce("form_type", F.lit(""))),
        _text("test", "@cap", "DisplaysFormWith", "@role_label", "Role"),
        _lines(_login("@factory_key", s), _request("GET"), F.lit(_SUCCESS), _heading_line()),
    )
    submit = _scenario(
        "form_submit",
        _text("@raw_route", " — ", "@factory_key", " — soumission formulaire"),
        _text("test", "@cap", "SubmitWith", "@role_label", "Role"),
        _lines(
            _login("@factory_key", s),
            _request("POST"),
            F.when(F.col("has_redirect"), _REDIRECTS).otherwise(_SUCCESS),
        ),
    )
    return _if(F.col("has_form"), display, submit)


def simple(s: AppSettings) -> Column:
    """Authenticated request without a form, asserted by the kind of answer."""
    first_type = F.coalesce(F.get("response_types", F.lit(0)), F.lit(""))
    both = F.col("has_render") & F.col("has_redirect")
    redirect = first_type.contains("redirect (302)")
    json = first_type.contains("json (200)")
    kind = (
        F.when(both, "either")
        .when(redirect, "redirect")
        .when(json, "json")
        .when(F.col("has_file"), "file")
        .when(F.col("has_export"), "export")
        .otherwise("page")
    )
    outcome = routes.literal_map(
        {
            "either": "IsReachedWith",
            "redirect": "RedirectsWith",
            "json": "ReturnsJsonWith",
            "file": "ReturnsFileWith",
            "export": "ReturnsExportWith",
            "page": "IsReachedWith",
        }
    )
    request = F.when(
        F.col("is_ajax"),
        _text(
            "$this->client->request('", "@http_verb", "', '", "@route",
            "', [], [], ['HTTP_X-Requested-With' => 'XMLHttpRequest']);",
        ),
    ).otherwise(_request())
    hidden = F.transform(
        F.slice("hidden_ids", 1, MAX_ASSERTED_IDS), lambda i: _text("$this->assertSelectorExists('#", i, "');")
    )
    checks = (
        F.when(
            kind == "either",
            _lines(
                F.lit("$statusCode = $this->client->getResponse()->getStatusCode();"),
                F.lit("self::assertContains($statusCode, [200, 302],"),
                F.lit("    sprintf('Expected 200 or 302, got %d', $statusCode));"),
            ),
        )
        .when(kind == "redirect", _lines(F.lit(_REDIRECTS)))
        .when(kind == "json", _lines(F.lit(_SUCCESS), F.lit(_IS_JSON)))
        .when(kind.isin("file", "export"), _lines(F.lit(_SUCCESS)))
        .otherwise(F.concat(_lines(F.lit(_SUCCESS), _heading_line()), hidden))
    )
    return _if(
        ~F.col("has_form"),
        _scenario(
            "simple",
            _text("@raw_route", " — authentifié ", "@factory_key"),
            _text("test", "@cap", F.element_at(outcome, kind), "@role_label", "Role"),
            F.concat(_lines(_login("@factory_key", s), request), checks),
        ),
    )


def ajax_without_header(s: AppSettings) -> Column:
    """Ajax route called without its header."""
    return _if(
        F.col("is_ajax"),
        _scenario(
            "ajax_without_header",
            _text("@raw_route", " — ", "@factory_key", " — sans header XHR → 404"),
            _text("test", "@cap", "WithoutXhrReturns404"),
            _lines(_login("@factory_key", s), _request(), F.lit("self::assertResponseStatusCodeSame(404);")),
        ),
    )


def insufficient_role(s: AppSettings) -> Column:
    """Class role where the method asks for another one."""
    return _if(
        F.col("method_role") != F.col("class_role"),
        _scenario(
            "insufficient_role",
            _text("@raw_route", " — ", "@class_factory_key", " (rôle insuffisant) → 403"),
            _text("test", "@cap", "ForbiddenWith", "@class_role_label", "Role"),
            _lines(_login("@class_factory_key", s), _request(), F.lit("self::assertResponseStatusCodeSame(403);")),
        ),
    )


def voter(s: AppSettings) -> Column:
    """Access check: a missing entity where the route has a parameter, else plain access."""
    raw = F.col("raw_route")
    refused = _scenario(
        "voter",
        _text("@raw_route", " — voter '", "@voter_attr", "' avec entité inexistante"),
        _text("test", "@cap", "VoterDeniesAccessWith", "@role_label", "Role"),
        _lines(
            _login("@factory_key", s),
            _text("// Voter '", "@voter_attr", f"' attendu sur cette route — entité {routes.BOGUS_ID} inexistante."),
            _text("$this->client->request('", "@http_verb", "', '", routes.bogus_route(raw), "');"),
            F.lit(_STATUS_OPEN),
            F.lit(_STATUS_CODE),
            F.lit("    [403, 404, 500],"),
            _text("    \"Le voter '", "@voter_attr", "' devrait refuser ou l'entité ne devrait pas exister\""),
            F.lit(");"),
        ),
    )
    current = _scenario(
        "voter",
        _text("@raw_route", " — voter '", "@voter_attr", "' — accès courant"),
        _text("test", "@cap", "VoterCheckWith", "@role_label", "Role"),
        _lines(
            _login("@factory_key", s),
            _text("// Voter '", "@voter_attr", "' attendu — adapter selon les fixtures"),
            _request(),
            F.lit(_STATUS_OPEN),
            F.lit(_STATUS_CODE),
            F.lit("    [200, 302, 403],"),
            _text("    \"Voter '", "@voter_attr", "' à valider\""),
            F.lit(");"),
        ),
    )
    return _if(F.col("has_voter"), F.when(routes.has_param(raw), refused).otherwise(current))


def not_found(s: AppSettings) -> Column:
    """Missing resource on a route with a parameter, unless a voter covers it."""
    raw = F.col("raw_route")
    return _if(
        routes.has_param(raw) & ~F.col("has_voter"),
        _scenario(
            "not_found",
            _text("@raw_route", " — ressource inexistante → 404"),
            _text("test", "@cap", "NotFoundWith", "@role_label", "Role"),
            _lines(
                _login("@factory_key", s),
                _text("$this->client->request('", "@http_verb", "', '", routes.bogus_route(raw), "');"),
                F.lit(_STATUS_OPEN),
                F.lit(_STATUS_CODE),
                F.lit("    [404, 302, 500],"),
                F.lit("    'Une ressource inexistante doit produire 404 (ou redirect/erreur applicative)'"),
                F.lit(");"),
            ),
        ),
    )


def secondary_role(s: AppSettings) -> Column:
    """Another role on an ordinary page, with the assertions of the main one."""
    others = F.slice(
        F.filter(F.array(*map(F.lit, s.roles)), lambda r: r != F.col("class_factory_key")), 1, MAX_SECONDARY_ROLES
    )
    plain = ~(F.col("is_ajax") | F.col("has_form") | F.col("has_voter"))

    def scenario(role: Column) -> Column:
        key = routes.role_key(role, s.role_map)
        return _scenario(
            "secondary_role",
            _text("@raw_route", " — ", key, " (rôle secondaire)"),
            _text("test", "@cap", "IsReachedWith", routes.role_label(key), "Role"),
            _lines(
                _text("$this->client->loginUser($this->getTestUser('", key, f"'), '{s.firewall}');"),
                _request(),
                F.lit(_SUCCESS),
                F.when(F.col("has_json"), F.lit(_IS_JSON)),
                _heading_line(),
            ),
        )

    return F.when(
        plain & (F.col("method_role") == F.col("class_role")), F.transform(others, scenario)
    ).otherwise(F.array().cast(SCENARIO))


RULES: list[Rule] = [
    no_auth,
    form,
    simple,
    ajax_without_header,
    insufficient_role,
    voter,
    not_found,
    secondary_role,
]


def first_routes(references: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """The first chunk of each (method, route) of a class.

    Spark limits each pair to one row per task before the shuffle, so repeats never pile up.
    """
    pair = Window.partitionBy(*keys, "method_name", "raw_route").orderBy(pos)
    routed = references.where(F.col("raw_route").isNotNull())
    return routed.withColumn("__n", F.row_number().over(pair)).where(F.col("__n") == 1).drop("__n")


def rank_routes(first: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Number the routes of a method in chunk order; later ones get names of their own.

    Ranking comes before anything else is read from the chunk, so the pass that counts the
    buckets only reads names and routes.
    """
    return bucketed_position(
        first, [*keys, "method_name"], position_bucket(F.col(pos)), [F.col(pos)], "route_rank"
    )


def expand(
    metadata: DataFrame,
    keys: Sequence[str],
    settings: AppSettings = AppSettings(),
    rules: list[Rule] = RULES,
    pos: str = "pos",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per scenario, numbered inside its route; no shuffle.

    The outer form keeps Spark from testing the scenarios for emptiness, which would build
    them twice; every route has at least one.
    """
    every = F.flatten(F.array(*[rule(settings) for rule in rules]))
    kept = [*keys, pos, "method_name", "raw_route", *keep]
    return metadata.select(*kept, F.posexplode_outer(every).alias("scenario_no", "sc")).select(
        *kept, "scenario_no", "sc.*"
    )


def unrouted_methods(references: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Distinct methods without a route and the place each is first seen."""
    return (
        references.where(F.col("raw_route").isNull())
        .groupBy(*keys, "method_name")
        .agg(F.min(pos).alias(pos))
    )
