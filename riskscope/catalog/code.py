"""Source text, class facts, templates and chunk texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscope.catalog import code_tables as ct
from riskscope.catalog.code_tables import page_templates, parts, raw_facts
from riskscope.catalog.registry import register
from riskscope.catalog.tables import METRICS_SQL, NOW, table, touches
from riskscope.functions import code, safety
from riskscope.operators import changes, chunks as chunk_ops, code_facts, safety_scan
from riskscope.session import materialise
from riskscope.sources.files import category_counts, decode_text, select_controllers

_WORDS = "list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: w IN ('if', 'elseif', 'while', 'for', 'foreach', 'case', 'catch'))"
_COMPLEXITY = f"""1 + len({_WORDS}) + (length(text) - length(replace(text, '&&', ''))) // 2
  + (length(text) - length(replace(text, '||', ''))) // 2 + length(text) - length(replace(text, '?', ''))"""


@register(
    "text_size",
    f"""SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS file_loc,
        CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS body_loc,
        {_COMPLEXITY} AS complexity FROM documents""",
)
def text_size(spark, sf_dir):
    """Line counts and complexity of whole document texts."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        code.file_loc(text).alias("file_loc"),
        code.body_loc(text).alias("body_loc"),
        code.cyclomatic(text).alias("complexity"),
    )


# Source text around a document: the document sits in a string, a comment and a block comment.
_CLEAN = "replace(replace(replace(replace(replace(text, chr(92), ' '), chr(39), ' '), chr(34), ' '), '*/', ' '), chr(10) || chr(10), chr(10))"
_INSIDE = f"'{{ // ' || split_part({_CLEAN}, chr(10), 1) || ' {{' || chr(10) || ' $a = ''' || {_CLEAN} || ' }}''; /* }} ' || {_CLEAN} || ' */ if ($x) {{ return 1; }} }}'"
_SOURCE = f"'<?php' || chr(10) || 'class Doc' || doc_id || ' extends Base ' || {_INSIDE} || ' // tail }}'"


@register(
    "block_extract",
    f"""SELECT doc_id, 'class Doc' || doc_id || ' extends Base ' || {_INSIDE} AS block FROM documents""",
)
def block_extract(spark, sf_dir):
    """Class blocks of sources whose strings and comments hold whole documents and stray braces."""
    source = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_SOURCE} AS source")
    name = F.concat(F.lit("Doc"), F.col("doc_id").cast("string"))
    return source.select("doc_id", code.class_block(F.col("source"), name).alias("block"))


@register(
    "comment_strip",
    f"""SELECT doc_id, '<?php' || chr(10) || 'class Doc' || doc_id || ' extends Base {{  ' || chr(10) || ' $a = ''' || {_CLEAN}
        || ' }}'';   if ($x) {{ return 1; }} }}  ' AS stripped FROM documents""",
)
def comment_strip(spark, sf_dir):
    source = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_SOURCE} AS source")
    return source.select("doc_id", code.strip_comments(F.col("source")).alias("stripped"))


# Generated code from conversations: each turn in a comment and a string, calls by turn and id.
_TURN = "replace(replace(replace(replace(replace(replace(text, chr(92), ' '), chr(39), ' '), chr(34), ' '), '*/', ' '), '`', ' '), '(', ' ')"
_CALLS = """CASE WHEN (conv_id + turn) % 6 = 0 THEN 'shell_exec(''ls''); eval(''$x = 1;'');'
                 WHEN (conv_id + turn) % 6 = 1 THEN '$fs->system($a); exec ($b);'
                 WHEN (conv_id + turn) % 6 = 2 THEN 'file_get_contents(''http://x/''); // curl_exec($h)'
                 WHEN (conv_id + turn) % 6 = 3 THEN 'ini_set(1); unlink(''/a''); UNLINK(''/b'');'
                 ELSE '$this->client->request(''GET'', ''/x'');' END"""
_GENERATED = f"'/* ' || {_TURN} || ' unlink(1) */' || chr(10) || '$s = ''' || {_TURN} || ''';' || chr(10) || {_CALLS}"


@register(
    "rule_scan",
    f"""WITH g AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS kind,
          1 + 2 * (length(text) - length(replace(text, chr(10), ''))) + 2 AS line FROM conversations)
    SELECT conv_id, turn, unnest(['exec_commande', 'eval_dynamique']) AS rule, true AS is_blocking, line::INT AS line,
           'shell_exec(''ls''); eval(''$x = 1;'');' AS excerpt FROM g WHERE kind = 0
    UNION ALL SELECT conv_id, turn, 'exec_system', true, line::INT, '$fs->system($a); exec ($b);' FROM g WHERE kind = 1
    UNION ALL SELECT conv_id, turn, 'url_distante', true, line::INT, 'file_get_contents(''http://x/'');' FROM g WHERE kind = 2
    UNION ALL SELECT conv_id, turn, unnest(['suppression_fichier', 'suppression_fichier', 'modif_env']),
                     unnest([true, true, false]), line::INT, 'ini_set(1); unlink(''/a''); UNLINK(''/b'');' FROM g WHERE kind = 3""",
)
def rule_scan(spark, sf_dir):
    generated = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_GENERATED} AS code")
    found = safety_scan.finding_rows(safety_scan.scan(generated, "code"), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "rule", "is_blocking", "line", "excerpt")


_CUSTOM = safety.Rule("custom", r"e\D\De", "own rule")


@register(
    "custom_rule_scan",
    r"SELECT doc_id, len(regexp_extract_all(text, '(?i)e\D\De'))::INT AS n FROM documents",
)
def custom_rule_scan(spark, sf_dir):
    """A rule of the caller's own, with a negated class, over whole texts."""
    found = safety.findings(F.col("text"), [_CUSTOM])
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"))


_REASONS = """CASE (conv_id + turn) % 6 WHEN 0 THEN 'exécution de commande système' WHEN 1 THEN 'exécution de commande système'
  WHEN 2 THEN 'lecture d''une URL distante ou d''un flux php://' WHEN 3 THEN 'suppression ou déplacement de fichier' ELSE '' END"""


@register(
    "scan_verdict",
    f"SELECT conv_id, turn, (conv_id + turn) % 6 > 3 AS is_safe, {_REASONS} AS first_reason FROM conversations",
)
def scan_verdict(spark, sf_dir):
    generated = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_GENERATED} AS code")
    return safety_scan.scan(generated, "code").select(
        "conv_id", "turn", "is_safe", F.coalesce(F.get("findings", F.lit(0))["reason"], F.lit("")).alias("first_reason")
    )


@register(
    "format_findings",
    f"""WITH g AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS kind, {_REASONS} AS reason,
          'ligne ' || (3 + 2 * (length(text) - length(replace(text, chr(10), '')))) || ' : ' AS line FROM conversations)
    SELECT conv_id, turn, CASE kind
      WHEN 0 THEN line || reason || ' (`shell_exec(''ls''); eval(''$x = 1;'');`) ; ' || line
                  || 'évaluation de code dynamique (`shell_exec(''ls''); eval(''$x = 1;'');`)'
      WHEN 1 THEN line || reason || ' (`$fs->system($a); exec ($b);`)'
      WHEN 2 THEN line || reason || ' (`file_get_contents(''http://x/'');`)'
      WHEN 3 THEN line || reason || ' (`ini_set(1); unlink(''/a''); UNLINK(''/b'');`) ; ' || line || reason
                  || ' (`ini_set(1); unlink(''/a''); UNLINK(''/b'');`) ; ' || line
                  || 'modification de l''environnement d''exécution (`ini_set(1); unlink(''/a''); UNLINK(''/b'');`)'
      ELSE '' END AS sentence FROM g""",
)
def format_findings(spark, sf_dir):
    generated = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_GENERATED} AS code")
    return safety_scan.scan(generated, "code").select(
        "conv_id", "turn", safety.format_findings(F.col("findings")).alias("sentence")
    )


_WITH_TOKENS = "CASE WHEN turn % 2 = 0 THEN '<|im_start|>' || text || '<|im_end|>[INST]</s>' ELSE text || ' a | b <c> [d]' END"


@register(
    "neutralise_tokens",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '‹｜im_start｜›' || text || '‹｜im_end｜›［INST］‹／s›'
        ELSE text || ' a | b <c> [d]' END AS text FROM conversations""",
)
def neutralise_tokens(spark, sf_dir):
    tagged = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_WITH_TOKENS} AS text")
    return tagged.withColumn("text", safety.neutralise(F.col("text")))


@register("decode_text", "SELECT doc_id, text FROM documents")
def decode_texts(spark, sf_dir):
    """Texts stored as bytes, in Latin-1 where it can hold them, read back without loss."""
    latin = F.col("text").rlike(r"^[\x00-\xff]*$") & (F.col("doc_id") % 2 == 0)
    stored = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("content"),
    )
    return stored.select("doc_id", decode_text(F.col("content")).alias("text"))


_PATHS = """CASE p_partkey % 8 WHEN 0 THEN 'app/src/Controller/' || p_brand || '/Show.php'
  WHEN 1 THEN 'app/src/Entity/' || p_name || '.php' WHEN 2 THEN 'app/src/Services/X' || p_size || 'Controller.php'
  WHEN 3 THEN 'app/vendor/src/Controller/Y' || p_size || '.php' WHEN 4 THEN 'app/src/Form/' || p_type || 'Type.php'
  WHEN 5 THEN 'app/src/Command/Run' || p_size || 'Action.php' WHEN 6 THEN 'app/src/Other/Z.php'
  ELSE 'app/src/Controller/readme.md' END"""


@register(
    "select_controllers",
    f"""SELECT DISTINCT {_PATHS} AS path FROM part WHERE p_partkey % 8 IN (0, 2, 5)""",
)
def controllers(spark, sf_dir):
    return select_controllers(table(spark, sf_dir, "part").selectExpr(f"{_PATHS} AS path"))


@register(
    "category_counts",
    f"""WITH f AS (SELECT {_PATHS} AS path FROM part),
    k AS (SELECT CASE regexp_extract(path, '(?:^|/)src/([^/]+)/', 1) WHEN 'Controller' THEN 'controllers' WHEN 'Entity' THEN 'entitys'
             WHEN 'Service' THEN 'services' WHEN 'Services' THEN 'services' WHEN 'Repository' THEN 'repositorys'
             WHEN 'Command' THEN 'commands' WHEN 'Form' THEN 'forms' WHEN 'Security' THEN 'securitys' END AS category FROM f),
    names AS (SELECT unnest(['controllers', 'entitys', 'services', 'repositorys', 'commands', 'forms', 'securitys']) AS category)
    SELECT category, count(k.category) AS n_files, count(k.category) = 0 AS is_empty
    FROM names LEFT JOIN k USING (category) GROUP BY category""",
)
def categories(spark, sf_dir):
    return category_counts(table(spark, sf_dir, "part").selectExpr(f"{_PATHS} AS path"))


@register(
    "body_signals",
    f"""WITH b AS (SELECT p_partkey, {ct.BODY_EDIT} AS e, p_size FROM part)
    SELECT p_partkey, CASE WHEN {ct.EDIT_RENDERS} THEN 'page' || (p_partkey % 50) || '.html.twig' END AS rendered_template,
           CASE WHEN {ct.EDIT_RENDERS} THEN 'render (200), redirect (302)' ELSE 'redirect (302)' END AS response_types,
           false AS is_ajax_only, true AS has_form, 'PartType' AS form_type,
           CASE WHEN {ct.HAS_VOTER} THEN 'edit:part' ELSE '' END AS checks, 'POST' AS verb, '' AS reads
    FROM b""",
)
def body_signals(spark, sf_dir):
    signals = parts(spark, sf_dir).select("p_partkey", code.body_signals(F.col("body_edit")).alias("s"))
    return signals.select(
        "p_partkey",
        "s.rendered_template",
        F.array_join("s.response_types", ", ").alias("response_types"),
        "s.is_ajax_only",
        "s.has_form",
        "s.form_type",
        F.array_join(
            F.transform("s.voter_checks", lambda v: F.concat_ws(":", v["attribute"], v["subject"])), ","
        ).alias("checks"),
        F.col("s.body_inferred_verb").alias("verb"),
        F.array_join("s.body_reads", ", ").alias("reads"),
    )


def classes(spark, sf_dir):
    return code_facts.class_facts(raw_facts(spark, sf_dir))


@register(
    "route_facts",
    f"WITH {ct.ROUTES_SQL} SELECT class_name, method, route_pos, path, name, verbs FROM routes",
)
def route_facts(spark, sf_dir):
    rows = code_facts.method_rows(classes(spark, sf_dir))
    return rows.select(
        "class_name", F.col("m.name").alias("method"), F.posexplode("m.routes").alias("route_pos", "r")
    ).select(
        "class_name",
        "method",
        "route_pos",
        "r.path",
        F.coalesce("r.name", F.lit("")).alias("name"),
        F.array_join("r.http_methods", ", ").alias("verbs"),
    )


@register(
    "method_facts",
    f"""WITH {ct.ROUTES_SQL}, {ct.PROFILE_SQL}, m AS (
      SELECT p.*, 'index' AS method, 'Liste.' AS description, '' AS params, '' AS grants, 'render (200)' AS response_types FROM p
      UNION ALL SELECT p.*, 'edit', 'Modifie une pièce.', 'int id, Request request, Part part', '',
        CASE WHEN {ct.EDIT_RENDERS} THEN 'render (200), redirect (302)' ELSE 'redirect (302)' END FROM p
      UNION ALL SELECT p.*, 'data', CASE WHEN {ct.DATA_ROUTED} THEN '@Route("/data", methods={{"DELETE"}})' ELSE '' END,
        'Request request', CASE WHEN {ct.HAS_METHOD_GRANT} THEN 'ROLE_SUPER_ADMIN' ELSE '' END, 'json (200)' FROM p
      UNION ALL SELECT p.*, 'helperAction', '', '', '', '' FROM p WHERE {ct.HAS_HELPER})
    SELECT m.class_name, method, description, params, grants, response_types, profile,
           CASE WHEN {ct.HAS_CLASS_GRANT} THEN 'ROLE_PART' ELSE '' END AS class_grants,
           4::BIGINT + ({ct.HAS_HELPER})::BIGINT AS nb_methods_in_class
    FROM m JOIN profiles USING (p_partkey)""",
)
def method_facts(spark, sf_dir):
    rows = code_facts.method_rows(classes(spark, sf_dir))
    listed = lambda items, shown: F.array_join(F.transform(items, shown), ", ")
    return rows.select(
        "class_name",
        F.col("m.name").alias("method"),
        F.coalesce("m.description", F.lit("")).alias("description"),
        listed("m.params", lambda p: F.concat_ws(" ", p["type"], p["name"])).alias("params"),
        listed("m.method_grants", lambda g: g["role"]).alias("grants"),
        F.array_join("m.response_types", ", ").alias("response_types"),
        F.col("controller_profile").alias("profile"),
        listed("class_grants", lambda g: g["role"]).alias("class_grants"),
        "nb_methods_in_class",
    )


@register(
    "profile_by_class",
    f"WITH {ct.ROUTES_SQL}, {ct.PROFILE_SQL} SELECT class_name, routed::BIGINT AS routed, json::BIGINT AS json, render::BIGINT AS render, profile FROM profiles",
)
def profile_by_class(spark, sf_dir):
    rows = code_facts.method_rows(classes(spark, sf_dir)).select(
        "class_name", (F.size("m.routes") > 0).alias("is_routed"), "m.response_types"
    )
    return code_facts.profile_by_class(rows, ["class_name"])


_BODIES = f"""bodies AS (
  SELECT p.*, 'index' AS method, chr(10) || {ct.BODY_INDEX} || chr(10) || '    ' AS text FROM p
  UNION ALL SELECT p.*, 'edit', chr(10) || {ct.BODY_EDIT} || chr(10) || '    ' FROM p
  UNION ALL SELECT p.*, 'data', chr(10) || {ct.BODY_DATA} || chr(10) || '    ' FROM p
  UNION ALL SELECT p.*, 'helperAction', chr(10) || {ct.BODY_HELPER} || chr(10) || '    ' FROM p WHERE {ct.HAS_HELPER})"""


@register(
    "feature_rows",
    f"""WITH {ct.ROUTES_SQL}, {METRICS_SQL}, {_BODIES},
    n AS (SELECT p_partkey, method, count(*) AS n_routes FROM routes GROUP BY ALL),
    k AS (SELECT p_partkey, {ct.CONTENT} AS content FROM part)
    SELECT file, class_name AS class, method, coalesce(n_routes, 0) AS nb_routes_method,
           length(content) - length(replace(content, chr(10), '')) + 1 AS file_loc,
           length(text) - length(replace(text, chr(10), '')) + 1 AS method_loc,
           {_COMPLEXITY} AS cyclomatic_complexity,
           (method = 'edit')::BIGINT AS has_form, (method = 'data')::BIGINT AS is_ajax_only,
           CASE WHEN {ct.HAS_DEPS} THEN 2 ELSE 0 END::BIGINT AS nb_constructor_deps,
           coalesce(bugfix_count, 0) AS git_bugfix_count, coalesce(total_commits, 0) AS git_total_commits,
           coalesce(nb_authors, 0) AS git_nb_authors, coalesce(days_since_change, -1.0) AS git_days_since_change,
           (coalesce(bugfix_count, 0) >= 5)::INT AS label_risk
    FROM bodies JOIN k USING (p_partkey) LEFT JOIN n USING (p_partkey, method)
         LEFT JOIN (SELECT file AS pk, * EXCLUDE (file) FROM metrics) ON p_partkey = pk""",
)
def feature_rows(spark, sf_dir):
    """The feature dataset: code facts joined with the change history of each file."""
    metrics = changes.change_metrics(touches(spark, sf_dir), NOW).withColumn(
        "file", F.concat(F.lit("src/Controller/Part"), F.col("file").cast("string"), F.lit("Controller.php"))
    )
    return code_facts.feature_rows(classes(spark, sf_dir), metrics).select(
        "file", "class", "method", "nb_routes_method", "file_loc", "method_loc", "cyclomatic_complexity", "has_form",
        "is_ajax_only", "nb_constructor_deps", "git_bugfix_count", "git_total_commits", "git_nb_authors",
        "git_days_since_change", "label_risk",
    )


@register(
    "properties",
    f"SELECT {ct.CLASS} AS class_name, 'PartRepository repo' AS properties FROM part",
)
def class_properties(spark, sf_dir):
    return parts(spark, sf_dir).select(
        "class_name",
        F.array_join(
            F.transform(code.properties(F.col("content")), lambda p: F.concat_ws(" ", p["type"], p["name"])), ", "
        ).alias("properties"),
    )


_H = "list_transform(regexp_extract_all(html, '(?is)<h[123][^>]*>(.*?)</h[123]>', 1), lambda h: trim(regexp_replace(h, '\\{%.*?%\\}|\\{\\{.*?\\}\\}|<.*?>', '', 'g')))"
_B = "list_transform(regexp_extract_all(html, '(?is)<(?:button|a)[^>]*>(.*?)</(?:button|a)>', 1), lambda b: trim(regexp_replace(b, '<.*?>', '', 'g')))"
# DuckDB keeps no order in list_distinct, so the oracle compares the sorted list.
_PAGES_SQL = f"""
facts AS (SELECT page_id, url, list_filter({_H}, lambda h: h <> '') AS headings,
  list_filter({_B}, lambda b: len(b) > 1 AND NOT starts_with(b, '{{')) AS buttons FROM pages)"""


@register(
    "template_facts",
    f"""WITH {_PAGES_SQL}
    SELECT page_id, array_to_string(headings, ' / ') AS headings, array_to_string(list_sort(list_distinct(buttons)), ' / ') AS buttons
    FROM facts""",
)
def template_facts(spark, sf_dir):
    """Headings and anchor texts of whole pages."""
    page = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file"), "html")
    return chunk_ops.template_rows(page).select(
        "page_id",
        F.array_join("headings", " / ").alias("headings"),
        F.array_join(F.array_sort("buttons"), " / ").alias("buttons"),
    )


@register(
    "template_index_text",
    f"""WITH {_PAGES_SQL},
    b AS (SELECT page_id, unnest(buttons) AS t, generate_subscripts(buttons, 1) AS i FROM facts),
    d AS (SELECT page_id, t, min(i) AS i FROM b GROUP BY ALL),
    s AS (SELECT page_id, string_agg(t, ', ' ORDER BY i) AS listed FROM d GROUP BY page_id)
    SELECT page_id, 'Le template ' || url || '.'
           || CASE WHEN len(headings) > 0 THEN ' Titres H1 : ' || array_to_string(headings, ', ') || '.' ELSE '' END
           || coalesce(' Boutons/Liens : ' || listed || '.', '') AS content
    FROM facts LEFT JOIN s USING (page_id)""",
)
def template_index_text(spark, sf_dir):
    page = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file"), "html")
    return chunk_ops.template_rows(page).select("page_id", "content")


@register(
    "template_description",
    f"""WITH {_PAGES_SQL},
    b AS (SELECT page_id, unnest(buttons) AS t, generate_subscripts(buttons, 1) AS i FROM facts),
    d AS (SELECT page_id, t, min(i) AS i FROM b GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM d),
    s AS (SELECT page_id, string_agg(t, ', ' ORDER BY i) AS listed FROM r WHERE n <= 10 GROUP BY page_id)
    SELECT page_id, 'Le template ' || url || '.'
           || CASE WHEN len(headings) > 0 THEN ' Sections : ' || array_to_string(headings, ', ') || '.' ELSE '' END
           || coalesce(' Boutons : ' || listed || '.', '') AS description
    FROM facts LEFT JOIN s USING (page_id)""",
)
def template_description(spark, sf_dir):
    page = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file"), "html")
    return chunk_ops.template_rows(page).select("page_id", "description")


@register(
    "template_form_facts",
    """SELECT DISTINCT 'page' || (p_partkey % 50) || '.html.twig' AS file, 'Page ' || (p_partkey % 50) AS h1, 'nom, qty' AS inputs,
        'token' || (p_partkey % 50) AS hidden_ids, 'part_' || (p_partkey % 50) AS links, 'Voir' AS buttons FROM part""",
)
def template_form_facts(spark, sf_dir):
    shown = lambda c: F.array_join(c, ", ").alias(c)
    return chunk_ops.template_rows(page_templates(spark, sf_dir)).select(
        "file", *[shown(c) for c in ("h1", "inputs", "hidden_ids", "links", "buttons")]
    )


def all_chunks(spark, sf_dir):
    """Class and method chunks of all parts, template items joined in."""
    facts_rows = classes(spark, sf_dir).withColumn("project_id", F.lit("shop"))
    tpl = chunk_ops.template_rows(page_templates(spark, sf_dir))
    methods = code_facts.method_rows(facts_rows).withColumn("renders", F.col("m.renders"))
    enriched = chunk_ops.enrich_with_template(methods, tpl, "renders")
    category = F.lit("controllers")
    return chunk_ops.class_chunks(facts_rows, category).unionByName(chunk_ops.method_chunks(enriched, category))


@register(
    "chunk_texts",
    f"WITH {ct.METHOD_TEXT_SQL} SELECT class_name, file AS file_path, pos, chunk_type, content FROM chunks",
)
def chunk_texts(spark, sf_dir):
    return all_chunks(spark, sf_dir).drop("project_id")


@register(
    "template_join",
    f"""WITH {ct.ROUTES_SQL} SELECT DISTINCT class_name, method, 'Page ' || (p_partkey % 50) AS h1 FROM routes
        WHERE method = 'index' OR (method = 'edit' AND {ct.EDIT_RENDERS})""",
)
def template_join(spark, sf_dir):
    methods = code_facts.method_rows(classes(spark, sf_dir)).withColumn("renders", F.col("m.renders"))
    tpl = chunk_ops.template_rows(page_templates(spark, sf_dir))
    joined = chunk_ops.enrich_with_template(methods, tpl, "renders")
    return joined.where(F.col("tpl_h1").isNotNull()).select(
        "class_name", F.col("m.name").alias("method"), F.array_join("tpl_h1", ", ").alias("h1")
    )


_FACTS = f"""facts AS (
  SELECT c.class_name, c.pos, p.p_size, p.prefix, p.p_partkey,
         CASE c.pos // 4294967296 WHEN 1 THEN 'index' WHEN 2 THEN 'edit' WHEN 3 THEN 'data' ELSE 'helperAction' END AS method_name,
         CASE WHEN c.pos // 4294967296 = 1 THEN prefix || '/' WHEN c.pos = 8589934593 THEN prefix || '/{{id}}/edit'
              WHEN c.pos = 8589934594 THEN prefix || '/{{slug}}/modifier'
              WHEN c.pos // 4294967296 = 3 THEN CASE WHEN {ct.DATA_ROUTED} THEN prefix || '/data' END ELSE prefix END AS raw_route,
         CASE WHEN {ct.HAS_CLASS_GRANT} THEN 'ROLE_PART' ELSE 'ADMIN' END AS class_role
  FROM chunks c JOIN p USING (p_partkey) WHERE c.chunk_type = 'controllers_method')"""

# Fields of method chunks as the input implies them.
METADATA_SQL = f"""{ct.METHOD_TEXT_SQL}, {_FACTS},
metadata AS (
  SELECT *, upper(method_name[1:1]) || method_name[2:] AS cap,
         replace(replace(raw_route, '{{id}}', '1'), '{{slug}}', 'exemple') AS route,
         CASE WHEN raw_route IS NULL THEN 'GET'
              WHEN method_name = 'edit' THEN 'POST' WHEN method_name = 'data' THEN 'DELETE' ELSE 'GET' END AS http_verb,
         CASE WHEN raw_route IS NOT NULL AND method_name = 'data' AND {ct.HAS_METHOD_GRANT} THEN 'ROLE_SUPER_ADMIN' ELSE class_role END AS method_role,
         raw_route IS NOT NULL AND (method_name = 'index' OR (method_name = 'edit' AND {ct.EDIT_RENDERS})) AS has_render,
         raw_route IS NOT NULL AND method_name = 'edit' AS has_form,
         raw_route IS NOT NULL AND method_name = 'data' AS has_json,
         method_name = 'edit' AND {ct.HAS_VOTER} AS has_voter
  FROM facts)"""


# Parts whose texts one task writes, so that no file holds very many of them.
CHUNK_PARTS = 1 << 16


def chunk_rows(spark, sf_dir):
    """A chunk table with the texts written straight from the part table."""
    ct.part_keys(spark, sf_dir, CHUNK_PARTS).createOrReplaceTempView("riskscope_part")
    sql = ct.METHOD_TEXT_SQL.replace("FROM part)", "FROM riskscope_part)")
    return materialise(
        spark.sql(f"WITH {sql} SELECT p_partkey, class_name, file AS file_path, pos, chunk_type, content FROM chunks")
    )


def metadata(spark, sf_dir):
    """Method chunks read back, each with the main role of its class."""
    chunks = chunk_rows(spark, sf_dir)
    settings = chunk_ops.class_settings(chunks, ["class_name"])
    joined = chunk_ops.method_references(chunks).join(settings, "class_name")
    return chunk_ops.chunk_metadata(joined, F.col("class_role"))


@register(
    "chunk_metadata",
    f"""WITH {METADATA_SQL}
    SELECT class_name, pos, method_name, coalesce(raw_route, '') AS raw_route, cap, coalesce(route, '') AS route, http_verb, method_role,
           CASE method_role WHEN 'ROLE_PART' THEN 'Part' WHEN 'ADMIN' THEN 'Admin' ELSE 'Super_Admin' END AS role_label,
           has_render, has_form AS has_redirect, has_json, has_json AS is_ajax, has_form, coalesce(CASE WHEN has_form THEN 'PartType' END, '') AS form_type,
           has_voter, CASE WHEN has_render THEN 'Page ' || (p_partkey % 50) ELSE '' END AS h1,
           CASE WHEN has_render THEN 'token' || (p_partkey % 50) ELSE '' END AS hidden_ids
    FROM metadata""",
)
def chunk_metadata(spark, sf_dir):
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return metadata(spark, sf_dir).select(
        "class_name", "pos", "method_name", empty("raw_route"), "cap", empty("route"), "http_verb", "method_role",
        "role_label", "has_render", "has_redirect", "has_json", "is_ajax", "has_form", empty("form_type"), "has_voter",
        "h1", F.array_join("hidden_ids", ",").alias("hidden_ids"),
    )


@register(
    "class_settings",
    f"""WITH {ct.ROUTES_SQL}, {ct.PROFILE_SQL}
    SELECT p.class_name, profile, CASE WHEN {ct.HAS_CLASS_GRANT} THEN 'ROLE_PART' ELSE 'ADMIN' END AS class_role
    FROM profiles JOIN p USING (p_partkey)""",
)
def class_settings(spark, sf_dir):
    settings = chunk_ops.class_settings(chunk_rows(spark, sf_dir), ["class_name"])
    return settings.select("class_name", "profile", "class_role")
