"""Class facts, source files and chunks that Spark derives from the part table.

Each part is one class with a handful of methods, which methods and attributes it has
following from its columns. The pieces are SQL expressions valid in Spark and in DuckDB,
so the same input can be written on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskscope.catalog.tables import table
from riskscope.scaling import SPREAD_ROWS, spread

CLASS = "'Part' || p_partkey || 'Controller'"
FILE = "'src/Controller/Part' || p_partkey || 'Controller.php'"
PREFIX = "(CASE WHEN p_partkey % 3 < 2 THEN '/part/' || p_partkey ELSE '/doc/' || p_partkey END)"
TEMPLATE = "'page' || (p_partkey % 50) || '.html.twig'"

HAS_DEPS = "p_size % 3 = 0"
HAS_CLASS_GRANT = "p_size % 2 = 0"
HAS_SECOND_ROUTE = "p_size % 4 = 0"
HAS_VOTER = "p_size % 5 = 0"
EDIT_RENDERS = "p_size % 3 = 0"
HAS_METHOD_GRANT = "p_size % 7 = 0"
DATA_ROUTED = "p_size % 2 = 1"
HAS_HELPER = "p_size % 6 = 0"

NL = "chr(10)"
BODY_INDEX = f"'return $this->render(''' || {TEMPLATE} || ''', [''n'' => 1]);'"
BODY_EDIT = (
    f"'$form = $this->createForm(App' || chr(92) || 'Form' || chr(92) || 'PartType::class);' || {NL} || "
    "'if ($form->isSubmitted() && $form->isValid()) { return $this->redirectToRoute(''part''); }' || "
    f"(CASE WHEN {HAS_VOTER} THEN {NL} || '$this->denyAccessUnlessGranted(''edit'', $part);' ELSE '' END) || "
    f"(CASE WHEN {EDIT_RENDERS} THEN {NL} || 'return $this->render(''' || {TEMPLATE} || ''');' ELSE '' END)"
)
BODY_DATA = (
    "'if (!$request->isXmlHttpRequest()) { throw $e; }' || "
    f"{NL} || 'return $this->json([''id'' => ' || p_partkey || ']);'"
)
BODY_HELPER = "'$q = $request->query->get(''q'');' || chr(10) || 'foreach ($q ?? [] as $x) { /* if { */ }'"


def _method_source(name: str, params: str, body: str) -> str:
    return (
        f"'    public function {name}({params})' || {NL} || '    {{' || {NL} || {body} || {NL} || '    }}' || {NL}"
    )


CONTENT = (
    f"'<?php' || {NL} || '// class Note {{ /' || {NL} || 'class ' || {CLASS} || ' extends Base' || {NL} || '{{' || {NL} || "
    f"'    private PartRepository $repo; // it''s {{' || {NL} || "
    + _method_source("index", "", BODY_INDEX)
    + " || "
    + _method_source("edit", "int $id, Part $part", BODY_EDIT)
    + " || "
    + _method_source("data", "Request $request", BODY_DATA)
    + f" || (CASE WHEN {HAS_HELPER} THEN "
    + _method_source("helperAction", "", BODY_HELPER)
    + f" ELSE '' END) || '}}' || {NL}"
)


def part_keys(spark, sf_dir, rows: int = SPREAD_ROWS) -> DataFrame:
    """What the classes follow from; a small file holds millions of them, so they are dealt over tasks."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), rows)


def parts(spark, sf_dir) -> DataFrame:
    return part_keys(spark, sf_dir).selectExpr(
        "p_partkey",
        "p_size",
        f"{CLASS} AS class_name",
        f"{FILE} AS file",
        f"{PREFIX} AS prefix",
        f"{CONTENT} AS content",
        f"{BODY_INDEX} AS body_index",
        f"{BODY_EDIT} AS body_edit",
        f"{BODY_DATA} AS body_data",
        f"{BODY_HELPER} AS body_helper",
    )


def raw_facts(spark, sf_dir) -> DataFrame:
    """The parts as class facts in their input layout, attribute values as variants."""
    text = lambda c: F.variant_get(F.parse_json(F.to_json(F.array(c))), "$[0]", "variant")
    arg = lambda value, name=None: F.struct(F.lit(name).cast("string").alias("name"), value.alias("value"))
    attribute = lambda name, *args: F.struct(F.lit(name).alias("name"), F.array(*args).alias("args"))
    attribute_type = "array<struct<name: string, args: array<struct<name: string, value: variant>>>>"
    none = F.array().cast(attribute_type)
    param = lambda name, kind: F.struct(
        F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(False).alias("has_default")
    )
    no_params = F.array().cast("array<struct<name: string, type: string, has_default: boolean>>")

    def method(name, attributes, params, docblock, body):
        return F.struct(
            F.lit(name).alias("name"),
            attributes.alias("attributes"),
            params.alias("params"),
            F.lit("Response").alias("return_type"),
            docblock.alias("docblock"),
            body.alias("body"),
        )

    no_doc = F.lit(None).cast("string")
    key = F.col("p_partkey").cast("string")
    verbs = F.parse_json(F.lit('["get", "POST"]'))
    first = attribute("Route", arg(text(F.lit("/{id}/edit"))), arg(verbs, "methods"))
    second = attribute("Route", arg(text(F.lit("{slug}/modifier"))))
    edit_attributes = F.when(F.expr(HAS_SECOND_ROUTE), F.array(first, second)).otherwise(F.array(first))
    methods = F.array(
        method(
            "__construct",
            none,
            F.when(
                F.expr(HAS_DEPS), F.array(param("repo", "PartRepository"), param("em", "?\\EntityManagerInterface"))
            ).otherwise(no_params),
            no_doc,
            F.lit(""),
        ),
        method(
            "index",
            F.array(
                attribute(
                    "Route", arg(text(F.concat(F.lit("part_"), key)), "name"), arg(text(F.lit("/")), "path")
                )
            ),
            no_params,
            F.lit("/** Liste. */"),
            F.col("body_index"),
        ),
        method(
            "edit",
            edit_attributes,
            F.array(param("id", "int"), param("request", "Request"), param("part", "?Part")),
            F.lit("/**\n * Modifie une pièce.\n * @return Response\n */"),
            F.col("body_edit"),
        ),
        method(
            "data",
            F.when(
                F.expr(HAS_METHOD_GRANT),
                F.array(attribute("IsGranted", arg(text(F.lit("ROLE_SUPER_ADMIN"))), arg(F.parse_json(F.lit("5")), "message"))),
            ).otherwise(none),
            F.array(param("request", "Request")),
            F.when(F.expr(DATA_ROUTED), F.lit('/** @Route("/data", methods={"DELETE"}) */')),
            F.col("body_data"),
        ),
        F.when(F.expr(HAS_HELPER), method("helperAction", none, no_params, no_doc, F.col("body_helper"))),
    )
    route = attribute("Route", arg(text(F.col("prefix"))))
    grant = attribute("IsGranted", arg(text(F.lit("ROLE_PART"))))
    class_attributes = F.filter(
        F.array(F.when(F.expr("p_partkey % 3 < 2"), route), F.when(F.expr(HAS_CLASS_GRANT), grant)),
        lambda a: a.isNotNull(),
    )
    return parts(spark, sf_dir).select(
        "file",
        "content",
        "class_name",
        class_attributes.alias("class_attributes"),
        F.when(
            F.expr("p_partkey % 3 = 2"), F.concat(F.lit("/** @Route('"), F.col("prefix"), F.lit("') */"))
        ).alias("class_docblock"),
        F.filter(methods, lambda m: m.isNotNull()).alias("methods"),
    )


# One row per (class, method, route) with the fields that the input implies.
ROUTES_SQL = f"""
p AS (SELECT *, {CLASS} AS class_name, {FILE} AS file, {PREFIX} AS prefix FROM part),
routes AS (
  SELECT p.*, 'index' AS method, 1 AS method_pos, 0 AS route_pos, prefix || '/' AS path,
         'part_' || p_partkey AS name, '' AS verbs FROM p
  UNION ALL SELECT p.*, 'edit', 2, 0, prefix || '/{{id}}/edit', '', 'GET, POST' FROM p
  UNION ALL SELECT p.*, 'edit', 2, 1, prefix || '/{{slug}}/modifier', '', '' FROM p WHERE {HAS_SECOND_ROUTE}
  UNION ALL SELECT p.*, 'data', 3, 0, prefix || '/data', '', 'DELETE' FROM p WHERE {DATA_ROUTED}
  UNION ALL SELECT p.*, 'helperAction', 4, 0, prefix, '', '' FROM p WHERE {HAS_HELPER})"""

PROFILE_SQL = f"""
profiles AS (
  SELECT *, CASE WHEN json / routed > 0.7 THEN 'api' WHEN render / routed > 0.7 THEN 'web_crud'
                 WHEN json > 0 AND render > 0 THEN 'mixed' ELSE 'web_crud' END AS profile
  FROM (SELECT p_partkey, class_name,
               2 + ({DATA_ROUTED})::INT + ({HAS_HELPER})::INT AS routed, ({DATA_ROUTED})::INT AS json,
               1 + ({EDIT_RENDERS})::INT AS render FROM p))"""

# Chunk texts written out from the same rows; h1 and inputs come from the templates below.
TEMPLATE_H1 = "'Page ' || k"
METHOD_TEXT_SQL = f"""
{ROUTES_SQL}, {PROFILE_SQL},
class_text AS (
  SELECT p.p_partkey, p.class_name, p.file, 0::BIGINT AS pos, 'controllers_class' AS chunk_type,
         'La classe PHP ' || p.class_name || ' (type: controllers) dans ' || p.file || '.'
         || CASE WHEN {HAS_DEPS} THEN ' Son constructeur injecte : (PartRepository $repo, EntityManagerInterface $em).' ELSE '' END
         || chr(10) || '  → Profil: ' || profile
         || CASE WHEN {HAS_CLASS_GRANT} THEN chr(10) || '  → Rôles classe: ROLE_PART' ELSE '' END AS content
  FROM p JOIN profiles USING (p_partkey)),
unrouted AS (
  SELECT p_partkey, class_name, file, 1 + 3 * 4294967296::BIGINT AS pos, 'controllers_method' AS chunk_type,
         'Méthode ''data'' (' || class_name || ') — Params: (Request $request)' || chr(10)
         || '  → Pas de route HTTP (méthode interne)' AS content
  FROM p WHERE NOT ({DATA_ROUTED})),
base AS (
  SELECT *, 'Méthode ''' || method || ''' (' || class_name || ')'
    || CASE WHEN method = 'index' OR (method = 'edit' AND {EDIT_RENDERS}) THEN ' — Template: ' || {TEMPLATE} ELSE '' END
    || CASE method WHEN 'index' THEN ' — Liste.'
                   WHEN 'edit' THEN ' — Modifie une pièce. — Params: (int $id, Request $request, Part $part)'
                   WHEN 'data' THEN ' — @Route("/data", methods={{"DELETE"}}) — Params: (Request $request)' ELSE '' END
    || ' — Route: ' || path || CASE WHEN name <> '' THEN ' (name: ' || name || ')' ELSE '' END
    || CASE WHEN verbs <> '' THEN chr(10) || '  → Verbes HTTP: ' || verbs ELSE '' END AS opening,
    method = 'index' OR (method = 'edit' AND {EDIT_RENDERS}) AS renders
  FROM routes),
routed AS (
  SELECT p_partkey, class_name, file, 1 + method_pos * 4294967296::BIGINT + route_pos AS pos, 'controllers_method' AS chunk_type,
    opening
    || CASE WHEN method = 'data' AND {HAS_METHOD_GRANT} THEN chr(10) || '  → Rôle requis (méthode): ROLE_SUPER_ADMIN' ELSE '' END
    || CASE WHEN renders THEN chr(10) || '  → H1: Page ' || (p_partkey % 50) || chr(10) || '  → Champs formulaire: nom, qty'
                              || chr(10) || '  → IDs cachés: token' || (p_partkey % 50) ELSE '' END
    || CASE WHEN renders THEN chr(10) || '  → Type de réponse: render (200)' ELSE '' END
    || CASE WHEN method = 'edit' THEN chr(10) || '  → Type de réponse: redirect (302)' ELSE '' END
    || CASE WHEN method = 'data' THEN chr(10) || '  → Type de réponse: json (200)' || chr(10)
                                      || '  → AJAX uniquement (isXmlHttpRequest)' ELSE '' END
    || CASE WHEN method = 'edit' THEN chr(10) || '  → Formulaire: PartType' || chr(10) || '  → Verbe HTTP inféré (body): POST' ELSE '' END
    || CASE WHEN method = 'helperAction' THEN chr(10) || '  → Lit: query string' ELSE '' END
    || CASE WHEN method = 'edit' AND {HAS_VOTER} THEN chr(10) || '  → Voter: denyAccessUnlessGranted(''edit'', $part)' ELSE '' END AS content
  FROM base),
chunks AS (SELECT * FROM class_text UNION ALL SELECT * FROM unrouted UNION ALL SELECT * FROM routed)"""


def page_templates(spark, sf_dir) -> DataFrame:
    """Fifty templates, built from the distinct residues of the part keys."""
    residue = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("k")).distinct()
    text = lambda *parts: F.concat(*[F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p) for p in parts])
    return residue.select(
        F.lit("shop").alias("project_id"),
        text("page", "@k", ".html.twig").alias("file"),
        text(
            "<h1>Page <b>", "@k", "</b>{{ n }}</h1><h4>no</h4><form><input name=\"nom\"><input name=\"qty\">"
            "<input type=\"hidden\" id=\"token", "@k", "\"></form><a href=\"{{ path('part_", "@k", "') }}\">Voir</a>"
        ).alias("html"),
    )
