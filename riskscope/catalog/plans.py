"""Test planning on the chunk texts of the part classes, attempts on events, coverage on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscope.catalog import code_tables as ct
from riskscope.catalog import code as code_queries
from riskscope.catalog.code import METADATA_SQL
from riskscope.catalog.registry import register
from riskscope.catalog.tables import table
from riskscope.operators import chunks as chunk_ops, prompts
from riskscope.plans import rendering, route_plan, scenarios
from riskscope.plans.pipeline import plan_tests

KEYS = ["class_name"]


def chunk_rows(spark, sf_dir):
    """The chunks of all classes; every fifth class repeats its routes further down."""
    chunks = code_queries.chunk_rows(spark, sf_dir)
    repeated = chunks.where("p_partkey % 5 = 0 AND pos > 0").where(F.col("content").contains("Route: "))
    return chunks.unionByName(repeated.withColumn("pos", F.col("pos") + 50000))


def with_settings(rows, chunks):
    """Rows joined with the settings of their class; Spark broadcasts the settings if they are small."""
    return rows.join(chunk_ops.class_settings(chunks, KEYS), KEYS)


def ranked(chunks, role_map=None):
    """Metadata of the first chunk of each route, the routes of a method numbered."""
    first = scenarios.first_routes(chunk_ops.method_references(chunks), KEYS)
    rows = with_settings(scenarios.rank_routes(first, KEYS), chunks)
    return chunk_ops.chunk_metadata(rows, F.col("class_role"), role_map)


_RANKED = f"""{METADATA_SQL},
ranked AS (
  SELECT * REPLACE (cap || CASE WHEN pos = 8589934594 THEN 'Route2' ELSE '' END AS cap),
         CASE WHEN pos = 8589934594 THEN 2 ELSE 1 END::BIGINT AS route_rank,
         CASE method_role WHEN 'ROLE_PART' THEN 'Part' WHEN 'ADMIN' THEN 'Admin' ELSE 'Super_Admin' END AS rl,
         regexp_replace(raw_route, '\\{{[^}}]+\\}}', '99999999', 'g') AS bogus,
         '$this->client->loginUser($this->getTestUser(''' || method_role || '''), ''secured_area'');' AS login,
         '$this->client->request(''' || http_verb || ''', ''' || route || ''');' AS request
  FROM metadata WHERE raw_route IS NOT NULL)"""


@register(
    "route_rank",
    f"WITH {_RANKED} SELECT class_name, method_name, raw_route, route_rank, cap FROM ranked",
)
def route_rank(spark, sf_dir):
    return ranked(chunk_rows(spark, sf_dir)).select("class_name", "method_name", "raw_route", "route_rank", "cap")


_OK = "'self::assertResponseIsSuccessful();'"
_H1 = "'$this->assertSelectorTextContains(''h1'', ''Page ' || (p_partkey % 50) || ''');'"
_SCENARIOS = f"""{_RANKED},
expanded AS (
  SELECT *, 0 AS k, 'no_auth' AS rule, raw_route || ' — non authentifié → WebSSO' AS comment,
    'test' || cap || 'RedirectsWhenNotAuthenticated' AS func_name,
    [request, 'self::assertResponseStatusCodeSame(307);', 'self::assertResponseRedirects(''/connect/web-sso'');'] AS body FROM ranked
  UNION ALL SELECT *, 1, 'form_display', raw_route || ' — ' || method_role || ' — affichage formulaire PartType',
    'test' || cap || 'DisplaysFormWith' || rl || 'Role',
    list_filter([login, '$this->client->request(''GET'', ''' || route || ''');', {_OK}, CASE WHEN has_render THEN {_H1} END], lambda x: x IS NOT NULL)
    FROM ranked WHERE has_form
  UNION ALL SELECT *, 2, 'form_submit', raw_route || ' — ' || method_role || ' — soumission formulaire', 'test' || cap || 'SubmitWith' || rl || 'Role',
    [login, '$this->client->request(''POST'', ''' || route || ''');', 'self::assertResponseRedirects();'] FROM ranked WHERE has_form
  UNION ALL SELECT *, 3, 'simple', raw_route || ' — authentifié ' || method_role,
    'test' || cap || CASE WHEN has_json THEN 'ReturnsJsonWith' ELSE 'IsReachedWith' END || rl || 'Role',
    CASE WHEN has_json THEN [login, '$this->client->request(''' || http_verb || ''', ''' || route || ''', [], [], [''HTTP_X-Requested-With'' => ''XMLHttpRequest'']);',
                             {_OK}, '$this->assertJson($this->client->getResponse()->getContent());']
         WHEN has_render THEN [login, request, {_OK}, {_H1}, '$this->assertSelectorExists(''#token' || (p_partkey % 50) || ''');']
         ELSE [login, request, {_OK}] END FROM ranked WHERE NOT has_form
  UNION ALL SELECT *, 4, 'ajax_without_header', raw_route || ' — ' || method_role || ' — sans header XHR → 404', 'test' || cap || 'WithoutXhrReturns404',
    [login, request, 'self::assertResponseStatusCodeSame(404);'] FROM ranked WHERE has_json
  UNION ALL SELECT *, 5, 'insufficient_role', raw_route || ' — ' || class_role || ' (rôle insuffisant) → 403',
    'test' || cap || 'ForbiddenWith' || CASE class_role WHEN 'ROLE_PART' THEN 'Part' ELSE 'Admin' END || 'Role',
    ['$this->client->loginUser($this->getTestUser(''' || class_role || '''), ''secured_area'');', request, 'self::assertResponseStatusCodeSame(403);']
    FROM ranked WHERE method_role <> class_role
  UNION ALL SELECT *, 6, 'voter', raw_route || ' — voter ''edit'' avec entité inexistante', 'test' || cap || 'VoterDeniesAccessWith' || rl || 'Role',
    [login, '// Voter ''edit'' attendu sur cette route — entité 99999999 inexistante.',
     '$this->client->request(''POST'', ''' || bogus || ''');', 'self::assertContains(', '    $this->client->getResponse()->getStatusCode(),',
     '    [403, 404, 500],', '    "Le voter ''edit'' devrait refuser ou l''entité ne devrait pas exister"', ');'] FROM ranked WHERE has_voter
  UNION ALL SELECT *, 7, 'not_found', raw_route || ' — ressource inexistante → 404', 'test' || cap || 'NotFoundWith' || rl || 'Role',
    [login, '$this->client->request(''POST'', ''' || bogus || ''');', 'self::assertContains(', '    $this->client->getResponse()->getStatusCode(),',
     '    [404, 302, 500],', '    ''Une ressource inexistante doit produire 404 (ou redirect/erreur applicative)''', ');']
    FROM ranked WHERE contains(raw_route, '{{') AND NOT has_voter
  UNION ALL SELECT *, 8, 'secondary_role', raw_route || ' — ' || CASE class_role WHEN 'ADMIN' THEN 'CONSULT' ELSE 'ADMIN' END || ' (rôle secondaire)',
    'test' || cap || 'IsReachedWith' || CASE class_role WHEN 'ADMIN' THEN 'Consult' ELSE 'Admin' END || 'Role',
    list_filter(['$this->client->loginUser($this->getTestUser(''' || CASE class_role WHEN 'ADMIN' THEN 'CONSULT' ELSE 'ADMIN' END || '''), ''secured_area'');',
     request, {_OK}, CASE WHEN has_render THEN {_H1} END], lambda x: x IS NOT NULL) FROM ranked WHERE method_name IN ('index', 'helperAction')),
sc AS (SELECT *, (row_number() OVER (PARTITION BY class_name, pos ORDER BY k) - 1)::INT AS scenario_no FROM expanded)"""


@register(
    "scenarios",
    f"""WITH {_SCENARIOS} SELECT class_name, pos, method_name, raw_route, scenario_no, rule, comment, func_name,
        array_to_string(body, chr(10)) AS body FROM sc""",
)
def scenario_rows(spark, sf_dir):
    rows = scenarios.expand(ranked(chunk_rows(spark, sf_dir)), KEYS)
    return rows.withColumn("body", F.array_join("body", "\n"))


@register(
    "unrouted_methods",
    f"WITH {ct.METHOD_TEXT_SQL} SELECT class_name, 'data' AS method_name, pos FROM unrouted",
)
def unrouted_methods(spark, sf_dir):
    return scenarios.unrouted_methods(chunk_ops.method_references(chunk_rows(spark, sf_dir)), KEYS)


_FILE_HEAD = """'<?php' || repeat(chr(10), 2) || 'namespace App\\Tests\\Functional\\Controller;' || repeat(chr(10), 2)
 || 'use App\\Tests\\Security\\TestUserFactory;' || chr(10) || 'use App\\Security\\SsoUser;' || chr(10)
 || 'use Symfony\\Bundle\\FrameworkBundle\\KernelBrowser;' || chr(10) || 'use Symfony\\Bundle\\FrameworkBundle\\Test\\WebTestCase;' || chr(10)
 || 'use Symfony\\Component\\HttpFoundation\\Response;' || repeat(chr(10), 2) || 'final class ' || class_name || 'Test extends WebTestCase' || chr(10)
 || '{' || chr(10) || '    protected KernelBrowser $client;' || chr(10) || '    private TestUserFactory $testUserFactory;' || repeat(chr(10), 2)
 || '    protected function setUp(): void' || chr(10) || '    {' || chr(10) || '        $this->client = self::createClient();' || chr(10)
 || '        $this->testUserFactory = $this->client->getContainer()->get(TestUserFactory::class);' || chr(10) || '    }' || repeat(chr(10), 2)
 || '    private function getTestUser(string $key): SsoUser' || chr(10) || '    {' || chr(10)
 || '        return $this->testUserFactory->create($key);' || chr(10) || '    }' || chr(10)"""


@register(
    "render_files",
    f"""WITH {_SCENARIOS},
    methods AS (SELECT class_name, pos, scenario_no, '    /** ' || comment || ' */' || chr(10) || '    public function ' || func_name || '(): void'
        || chr(10) || '    {{' || chr(10) || '        ' || array_to_string(body, chr(10) || '        ') || chr(10) || '    }}' AS m FROM sc),
    files AS (SELECT class_name, string_agg(m, repeat(chr(10), 2) ORDER BY pos, scenario_no) AS all_methods FROM methods GROUP BY class_name)
    SELECT class_name, {_FILE_HEAD.replace("{", "{").replace("}", "}")}
      || CASE WHEN class_name IN (SELECT class_name FROM unrouted)
         THEN chr(10) || '    // Méthodes sans route HTTP (non testées ici) : data' || chr(10) ELSE '' END
      || chr(10) || all_methods || chr(10) || '}}' || chr(10) AS text FROM files""",
)
def render_files(spark, sf_dir):
    """Whole test files of all classes."""
    return plan_tests(chunk_rows(spark, sf_dir)).files()


@register(
    "entity_types",
    f"""WITH {ct.METHOD_TEXT_SQL}
    SELECT class_name, 'Part' AS entity_type, sum(CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS n
    FROM routed WHERE pos // 4294967296 = 2 GROUP BY class_name
    UNION ALL SELECT 'x', 'x', 0 WHERE false""",
)
def entity_types(spark, sf_dir):
    return rendering.entity_type_counts(chunk_rows(spark, sf_dir), KEYS)


@register(
    "fixture_files",
    """SELECT 'Part' || p_partkey || 'Controller' AS class_name, '<?php' || repeat(chr(10), 2) || 'namespace App\\Tests\\Functional\\Fixtures;' || repeat(chr(10), 2)
      || '// use App\\Entity\\Part;' || chr(10) || 'use Doctrine\\Bundle\\FixturesBundle\\Fixture;' || chr(10)
      || 'use Doctrine\\Persistence\\ObjectManager;' || repeat(chr(10), 2) || '/**' || chr(10)
      || ' * Fixtures squelette auto-générées pour Part' || p_partkey || 'ControllerTest.' || chr(10) || ' *' || chr(10)
      || ' * À COMPLÉTER : décommente les stubs ci-dessous et ajuste les setters' || chr(10)
      || ' * aux contraintes de ton domaine. Les tests utilisent par défaut id=1' || chr(10) || ' * pour les paramètres de route.' || chr(10)
      || ' *' || chr(10) || ' * Activation dans config/packages/test/doctrine.yaml :' || chr(10) || ' *   doctrine:' || chr(10)
      || ' *     dbal:' || chr(10) || ' *       url: ''sqlite:///:memory:''' || chr(10) || ' *' || chr(10) || ' * Chargement avant chaque test :' || chr(10)
      || ' *   php bin/console doctrine:fixtures:load --env=test --no-interaction' || chr(10) || ' */' || chr(10)
      || 'final class Part' || p_partkey || 'ControllerTestFixtures extends Fixture' || chr(10) || '{' || chr(10)
      || '    public function load(ObjectManager $manager): void' || chr(10) || '    {' || chr(10)
      || '        // TODO: créer une instance de Part pour les tests' || chr(10) || '        // $part = new Part();' || chr(10)
      || '        // $manager->persist($part);' || chr(10) || '        // $this->addReference(''part_test_1'', $part);' || repeat(chr(10), 2)
      || '        $manager->flush();' || chr(10) || '    }' || chr(10) || '}' || chr(10) AS text FROM part""",
)
def fixture_files(spark, sf_dir):
    counts = rendering.entity_type_counts(chunk_rows(spark, sf_dir), KEYS)
    return rendering.fixture_files(rendering.fixture_segments(counts))


@register(
    "redirect_internal",
    f"""SELECT {ct.CLASS} AS class_name, 'internal' AS profile FROM part WHERE p_partkey % 11 = 0 AND NOT ({ct.DATA_ROUTED})""",
)
def redirect_internal(spark, sf_dir):
    """Classes sent to unit tests; every eleventh class is cut down to its data method."""
    rows = chunk_rows(spark, sf_dir).where(
        (F.col("p_partkey") % 11 != 0) | (F.col("pos") == 12884901889)
    )
    _, internal = chunk_ops.split_internal(chunk_ops.class_settings(rows, KEYS))
    return internal.select("class_name", "profile")


@register(
    "role_keys",
    f"""WITH {METADATA_SQL} SELECT class_name, pos, CASE method_role WHEN 'ROLE_PART' THEN 'PART' ELSE method_role END AS factory_key,
        CASE method_role WHEN 'ROLE_PART' THEN 'Part' WHEN 'ADMIN' THEN 'Admin' ELSE 'Super_Admin' END AS role_label,
        CASE class_role WHEN 'ROLE_PART' THEN 'PART' ELSE class_role END AS class_factory_key FROM metadata""",
)
def role_keys(spark, sf_dir):
    chunks = code_queries.chunk_rows(spark, sf_dir)
    rows = with_settings(chunk_ops.method_references(chunks), chunks)
    return chunk_ops.chunk_metadata(rows, F.col("class_role"), {"ROLE_PART": "PART"}).select("class_name", "pos", "factory_key", "role_label", "class_factory_key")


_PLAN = f"""{_RANKED},
plan AS (
  SELECT *, 0 AS plan_no, 'test' || cap || 'RedirectsWhenNotAuthenticated' AS name,
    'NON authentifié (pas de loginUser) : $this->client->request(''' || http_verb || ''', ''' || route
    || ''') puis assertResponseStatusCodeSame(307) et assertResponseRedirects(''/connect/web-sso'').' AS spec FROM ranked
  UNION ALL SELECT *, 1, 'test' || cap || 'AuthenticatedWith' || rl || 'Role',
    'AUTHENTIFIÉ : $this->client->loginUser($this->getTestUser(''' || method_role || '''), ''secured_area'') puis $this->client->request('''
    || http_verb || ''', ''' || route || ''') puis '
    || CASE WHEN has_json THEN 'assertResponseIsSuccessful() puis assertJson sur le contenu de la réponse'
            WHEN has_form AND NOT has_render THEN 'assertResponseRedirects() SANS argument'
            ELSE 'assertResponseIsSuccessful()' || CASE WHEN has_render THEN ' ; puis assertSelectorTextContains(''h1'', ''Page ' || (p_partkey % 50) || ''')' ELSE '' END END
    || '.' FROM ranked
  UNION ALL SELECT *, 2, 'test' || cap || 'WithoutXhrReturns404', 'Route AJAX appelée SANS header XHR : loginUser(''' || method_role
    || ''') puis $this->client->request(''' || http_verb || ''', ''' || route || ''') (sans HTTP_X-Requested-With) puis assertResponseStatusCodeSame(404).'
    FROM ranked WHERE has_json
  UNION ALL SELECT *, 2, 'test' || cap || 'FormSubmit', 'Soumission du formulaire : loginUser(''' || method_role
    || ''') puis $this->client->request(''POST'', ''' || route || ''') puis assertResponseRedirects().' FROM ranked WHERE has_form)"""


@register(
    "route_plan",
    f"WITH {_PLAN} SELECT class_name, raw_route, http_verb, plan_no, name, spec FROM plan",
)
def planned(spark, sf_dir):
    plan = route_plan.route_plan(ranked(chunk_rows(spark, sf_dir)), KEYS)
    return plan.select("class_name", "raw_route", "http_verb", "plan_no", "name", "spec")


@register(
    "stub_methods",
    f"""WITH {_PLAN}
    SELECT class_name, raw_route, name, '    public function ' || name || '(): void' || chr(10) || '    {{' || chr(10)
      || '        // TODO: génération échouée pour la route ' || http_verb || ' ' || raw_route || ' (done_reason=' || CASE WHEN p_partkey % 6 = 0 THEN 'None' ELSE 'length' END || ').'
      || chr(10) || '        $this->markTestIncomplete(''Génération automatique échouée — à écrire à la main.'');' || chr(10) || '    }}' AS stub
    FROM plan WHERE p_partkey % 3 = 0""",
)
def stub_methods(spark, sf_dir):
    plan = route_plan.route_plan(ranked(chunk_rows(spark, sf_dir)), KEYS)
    outcomes = table(spark, sf_dir, "part").selectExpr(
        f"{ct.CLASS} AS class_name", "p_partkey % 3 <> 0 AS ok", "CASE WHEN p_partkey % 6 <> 0 THEN 'length' END AS done_reason"
    )
    return route_plan.stub_methods(plan, outcomes, KEYS).select("class_name", "raw_route", "name", "stub")


@register(
    "unique_names",
    """SELECT conv_id, turn, 'test_' || role || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END AS name
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)""",
)
def unique_names(spark, sf_dir):
    names = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("test_"), "role").alias("name")
    )
    return route_plan.unique_names(names, ["conv_id"], "name", "turn")


_ATTEMPTS = """event_id // 3 AS route_id, (event_id % 3 + 1)::INT AS attempt, (json_extract(props, '$.k')::INT % 4)::INT AS n_blocks,
  CASE event_type WHEN 'error' THEN 'length' WHEN 'click' THEN NULL WHEN 'view' THEN 'length' ELSE 'stop' END AS done_reason,
  json_extract(props, '$.k')::BIGINT AS tokens, floor(value) AS elapsed"""
_BEST = f"""a AS (SELECT {_ATTEMPTS} FROM events),
s AS (SELECT *, n_blocks > 0 AND coalesce(done_reason, '') <> 'length' AS success FROM a),
f AS (SELECT route_id, min(attempt) FILTER (success) AS first_ok, max(attempt) AS last FROM s GROUP BY route_id),
made AS (SELECT s.*, coalesce(first_ok, last) AS n_made FROM s JOIN f USING (route_id) WHERE attempt <= coalesce(first_ok, last)),
k AS (SELECT route_id, attempt AS kept, row_number() OVER (PARTITION BY route_id ORDER BY success DESC, n_blocks DESC, attempt) AS n
      FROM made WHERE n_blocks > 0),
best AS (SELECT route_id, any_value(kept) AS kept, max(n_made) AS attempts, max(done_reason) FILTER (attempt = n_made) AS done_reason,
                sum(tokens)::BIGINT AS tokens, round(sum(elapsed), 1) AS elapsed, any_value(kept) IS NOT NULL AS ok
         FROM made LEFT JOIN (SELECT * FROM k WHERE n = 1) USING (route_id) GROUP BY route_id)"""


def _attempts(spark, sf_dir, per_route: int = 3):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / per_route).alias("route_id"),
        (F.col("event_id") % per_route + 1).cast("int").alias("attempt"),
        (k % 4).alias("n_blocks"),
        F.when(F.col("event_type").isin("error", "view"), "length")
        .when(F.col("event_type") != "click", "stop")
        .alias("done_reason"),
        k.cast("long").alias("tokens"),
        F.floor("value").cast("double").alias("elapsed"),
    )


@register("best_attempt", f"WITH {_BEST} SELECT * FROM best")
def best_attempt(spark, sf_dir):
    return route_plan.best_attempt(_attempts(spark, sf_dir), ["route_id"])


_BEST_OF_SEVEN = _BEST.replace("event_id // 3 AS", "event_id // 7 AS").replace("event_id % 3 + 1", "event_id % 7 + 1")


@register("best_attempt_of_seven", f"WITH {_BEST_OF_SEVEN} SELECT * FROM best")
def best_attempt_of_seven(spark, sf_dir):
    return route_plan.best_attempt(_attempts(spark, sf_dir, 7), ["route_id"])


_BASE = "'a' || CASE turn % 4 WHEN 1 THEN '2' WHEN 3 THEN '22' ELSE '' END"
_FREE = "CASE WHEN NOT list_contains(taken, o.base) THEN o.base ELSE o.base || list_filter(range(2, 60), lambda i: NOT list_contains(taken, o.base || i))[1] END"


@register(
    "unique_names_colliding",
    f"""WITH RECURSIVE o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {_BASE} AS base FROM conversations),
    f AS (SELECT conv_id, k, turn, base AS name, [base] AS taken FROM o WHERE k = 1
          UNION ALL SELECT o.conv_id, o.k, o.turn, {_FREE}, list_append(taken, {_FREE}) FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1)
    SELECT conv_id, turn, name FROM f""",
)
def unique_names_colliding(spark, sf_dir):
    """Names that end in numbers and run into each other."""
    names = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_BASE).alias("name"))
    return route_plan.unique_names(names, ["conv_id"], "name", "turn")


_CONV_CLASS = "'Conv' || conv_id"


@register(
    "route_files",
    f"""WITH b AS (SELECT {_CONV_CLASS} AS class_name, turn, 'test' || role AS base, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations),
    m AS (SELECT class_name, string_agg('    public function ' || base || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END || '(): void' || chr(10) || '    {{' || chr(10)
        || '        // test' || turn || '(' || chr(10) || '    }}', repeat(chr(10), 2) ORDER BY turn) AS body FROM b GROUP BY class_name)
    SELECT class_name, {_FILE_HEAD} || chr(10) || body || chr(10) || '}}' || chr(10) AS text FROM m""",
)
def route_files(spark, sf_dir):
    """One method per turn, named by its role, assembled into one file per conversation."""
    blocks = table(spark, sf_dir, "conversations").select(
        F.expr(_CONV_CLASS).alias("class_name"), F.col("turn").alias("pos"), F.lit(0).alias("part"),
        F.concat(
            F.lit("    public function test"), "role", F.lit("(): void\n    {\n        // test"), F.col("turn").cast("string"), F.lit("(\n    }")
        ).alias("block"),
    )
    return route_plan.route_files(blocks, KEYS)


@register(
    "generation_outcome",
    f"""WITH {_BEST}, g AS (SELECT route_id % 997 AS class_no, count(*) AS routes_total, count(*) FILTER (ok) AS routes_generated,
        count(*) FILTER (NOT ok) AS routes_failed, 0::BIGINT AS routes_skipped FROM best GROUP BY 1)
    SELECT *, CASE WHEN routes_generated = 0 AND routes_total > 0 THEN 'failed' WHEN routes_failed > 0 THEN 'partial' ELSE 'success' END AS status FROM g""",
)
def generation_outcome(spark, sf_dir):
    best = route_plan.best_attempt(_attempts(spark, sf_dir), ["route_id"])
    return route_plan.generation_outcome(best.withColumn("class_no", F.col("route_id") % 997), ["class_no"])


_TURNS = """q AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> ''))) AS word
      FROM conversations WHERE role = 'user'),
r AS (SELECT DISTINCT conv_id, '/' || word || '/{id}' AS raw_route, word FROM q),
t AS (SELECT conv_id, string_agg('/' || replace(replace(text, chr(10), '/'), ' ', '/'), '' ORDER BY turn) AS body
      FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
u AS (SELECT r.conv_id, raw_route FROM r LEFT JOIN t USING (conv_id)
      WHERE body IS NULL OR NOT regexp_matches(body, '/' || regexp_escape(word) || '/[^''"\\s]+'))"""


def _uncovered(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    words = F.filter(F.split(F.translate("text", "\n", " "), " "), lambda w: w != "")
    asked = (
        turns.where("role = 'user'")
        .select("conv_id", F.explode(words).alias("word"))
        .distinct()
        .select("conv_id", F.concat(F.lit("/"), "word", F.lit("/{id}")).alias("raw_route"))
    )
    return route_plan.uncovered_routes(asked, _answers(spark, sf_dir), ["conv_id"])


def _answers(spark, sf_dir):
    answered = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("/"), F.translate("text", "\n ", "//")).alias("text")
    )
    return prompts.join_pieces(answered, ["conv_id"], ["turn"], "text")


@register("uncovered_routes", f"WITH {_TURNS} SELECT * FROM u")
def uncovered_routes(spark, sf_dir):
    """Words of the user turns as routes, looked for in the answers of the same conversation."""
    return _uncovered(spark, sf_dir)


@register(
    "coverage_retry",
    f"WITH {_TURNS} SELECT conv_id, count(*) AS n_missing FROM u GROUP BY conv_id HAVING count(*) <= 6",
)
def coverage_retry(spark, sf_dir):
    return route_plan.coverage_retry(_uncovered(spark, sf_dir), ["conv_id"])


_SAFE = "replace(replace(replace(replace(text, chr(92), ' '), chr(39), ' '), chr(34), ' '), chr(10), ' ')"
_ANSWER = f"""'<?php class Extra {{ ' || chr(10) || 'public function testTurn' || turn || '(): void {{' || chr(10) || '  $x = ''' || {_SAFE} || ' }}'';' || chr(10) || '}}'
  || chr(10) || 'function helper() {{}} public function testLast($a) {{ if ($a) {{ b(); }} }} public function testCut() {{ $y = ''' || {_SAFE} || '''; '"""


@register(
    "generated_blocks",
    f"""SELECT conv_id, turn, 0 AS block_no, 'testTurn' || turn AS test_name,
        '    public function testTurn' || turn || '(): void {{' || chr(10) || '      $x = ''' || {_SAFE} || ' }}'';' || chr(10) || '    }}' AS block FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'testLast', '    public function testLast($a) {{ if ($a) {{ b(); }} }}' FROM conversations""",
)
def generated_blocks(spark, sf_dir):
    """Complete test methods of answers that end in a cut-off one."""
    answers = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_ANSWER} AS answer")
    return route_plan.generated_blocks(answers, ["conv_id", "turn"], "answer")


@register(
    "missing_routes",
    f"WITH {_TURNS} SELECT conv_id, count(*) AS n_missing, string_agg(raw_route, ' ' ORDER BY raw_route) AS missing FROM u GROUP BY conv_id HAVING count(*) <= 6",
)
def missing_routes(spark, sf_dir):
    found = route_plan.missing_routes(_uncovered(spark, sf_dir), ["conv_id"])
    return found.withColumn("missing", F.array_join("missing", " "))


@register(
    "retry_prompts",
    f"""WITH {_TURNS}, m AS (SELECT conv_id, string_agg(raw_route, ''', ''' ORDER BY raw_route) AS missing FROM u GROUP BY conv_id HAVING count(*) <= 40)
    SELECT conv_id, '<|im_start|>system' || chr(10) || 'Règles' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Scénario: '
      || 'Routes manquantes : [''' || missing || ''']' || repeat(chr(10), 2)
      || 'Complète le fichier suivant en ajoutant les tests manquants. Retourne TOUT le fichier corrigé commençant par <?php, sans markdown.'
      || repeat(chr(10), 2) || 'Code actuel :' || chr(10) || body || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt
    FROM m JOIN t USING (conv_id)""",
)
def retry_prompts(spark, sf_dir):
    """The request to complete the answers of a conversation with the routes they miss."""
    missing = route_plan.missing_routes(_uncovered(spark, sf_dir), ["conv_id"], 40)
    return route_plan.retry_prompts(missing, _answers(spark, sf_dir), ["conv_id"], F.lit("Règles"), "phi3")
