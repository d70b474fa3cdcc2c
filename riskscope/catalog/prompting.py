"""Prompts and responses on documents, conversations, benchmark items and part classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscope.catalog import code_tables as ct, plans
from riskscope.catalog.plans import KEYS, _PLAN
from riskscope.catalog.registry import register
from riskscope.catalog.tables import table
from riskscope.functions import safety
from riskscope.operators import prompts
from riskscope.plans import route_plan

_BRACED = "replace(text, 'e', CASE WHEN doc_id % 2 = 0 THEN '{' ELSE '}' END)"
_BALANCE = "(length(c) - length(replace(c, '{', '')) - (length(c) - length(replace(c, '}', ''))))"


@register(
    "truncate_example",
    f"""WITH d AS (SELECT doc_id, {_BRACED} AS t, substr({_BRACED}, 1, 3500) AS c FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 3500 THEN c || chr(10) || '// [tronqué]' || chr(10) || repeat('}}', greatest(0, {_BALANCE})::INT) ELSE t END AS text FROM d""".replace(
        "'}}'", "'}'"
    ),
)
def truncate_example(spark, sf_dir):
    braced = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_BRACED} AS text")
    return braced.withColumn("text", prompts.truncate_example(F.col("text"), prompts.MAX_EXAMPLE_CHARS))


@register(
    "fit_budget",
    """SELECT doc_id, substr(text, 1, 12000) AS prompt, length(text) > 12000 AS is_truncated,
        (length(substr(text, 1, 12000)) // 3)::BIGINT AS estimated_tokens, length(substr(text, 1, 12000)) // 3 > 6500 AS is_over_budget FROM documents""",
)
def fit_budget(spark, sf_dir):
    return prompts.fit_budget(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt")), "prompt", prompts.MAX_PROMPT_CHARS)


@register(
    "fit_budget_unlimited",
    """SELECT doc_id, text AS prompt, false AS is_truncated, (length(text) // 4)::BIGINT AS estimated_tokens, length(text) // 4 > 900 AS is_over_budget FROM documents""",
)
def fit_budget_unlimited(spark, sf_dir):
    """Without a limit nothing is cut; the estimate and the warning are parameters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return prompts.fit_budget(docs, "prompt", chars_per_token=4, warn_tokens=900)


_DEMAND = "CASE item_id % 6 WHEN 3 THEN 'Test CRUD ' WHEN 4 THEN 'Profil mixte ' WHEN 5 THEN 'Via XHR ' ELSE 'Cas ' END || item_id"
_SHOTS = f"""examples AS (SELECT item_id, {_DEMAND} AS request, text AS ideal FROM benchmark),
firsts AS (SELECT 'api' AS profile, min(item_id) FILTER (regexp_matches(lower(request), 'xhr|api|ajax')) AS k FROM examples
  UNION ALL SELECT 'mixed', min(item_id) FILTER (regexp_matches(lower(request), 'mixte|mixed')) FROM examples
  UNION ALL SELECT 'web_crud', min(item_id) FILTER (regexp_matches(lower(request), 'crud|formulaire|form|redirect')) FROM examples
  UNION ALL SELECT '', min(item_id) FROM examples),
shots AS (SELECT profile, item_id, request, ideal FROM firsts JOIN examples ON item_id = coalesce(k, (SELECT min(item_id) FROM examples)))"""


def _shots(spark, sf_dir):
    examples = table(spark, sf_dir, "benchmark").selectExpr("item_id", f"{_DEMAND} AS request", "text AS ideal")
    return prompts.select_shots(examples, "request", "item_id")


@register("select_shots", f"WITH {_SHOTS} SELECT * FROM shots")
def select_shots(spark, sf_dir):
    return _shots(spark, sf_dir).select("profile", "example.*")


_PROFILE = "CASE conv_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'mixed' WHEN 2 THEN 'web_crud' ELSE 'other' END"


@register(
    "build_prompt",
    f"""WITH {_SHOTS}, t AS (SELECT *, {_PROFILE} AS profile FROM conversations)
    SELECT conv_id, turn, '<|im_start|>system' || chr(10) || role || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Scénario: ' || request || chr(10)
      || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || ideal || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Scénario: ' || text
      || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS chat,
      '### Instructions' || chr(10) || role || chr(10) || chr(10) || '### Exemple' || chr(10) || 'Scénario: ' || request || chr(10) || 'Réponse:' || chr(10) || ideal || chr(10)
      || chr(10) || '### Tâche' || chr(10) || 'Scénario: ' || text || chr(10) || 'Réponse:' || chr(10) AS plain
    FROM t JOIN shots ON shots.profile = CASE WHEN t.profile = 'other' THEN '' ELSE t.profile END""",
)
def build_prompt(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("profile", F.expr(_PROFILE))
    requests = prompts.attach_shot(turns, _shots(spark, sf_dir))
    shots = F.array(F.struct(F.col("example.request").alias("request"), F.col("example.ideal").alias("ideal")))
    prompt = lambda model: prompts.build_prompt(F.col("role"), shots, F.col("text"), model)
    return requests.select(
        "conv_id", "turn", prompt("Qwen2.5-coder:3b").alias("chat"), prompt("gemma").alias("plain")
    )


_NOTICE = safety.CONTEXT_NOTICE.replace("'", "''")


@register(
    "context_blocks",
    f"""SELECT conv_id, '{_NOTICE}' || chr(10) || '<<<DEBUT_CONTEXTE_PROJET>>>' || chr(10) || 'CONTEXTE RÉEL DU PROJET (NE PAS INVENTER) :' || chr(10)
      || string_agg('- ‹s›' || text || ' (Fichier: ' || role || ')', chr(10) ORDER BY turn) || chr(10) || '<<<FIN_CONTEXTE_PROJET>>>' || chr(10) AS context
    FROM conversations GROUP BY conv_id""",
)
def context_blocks(spark, sf_dir):
    """The turns of a conversation as the chunks of one request."""
    chunks = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("<s>"), "text").alias("content"), F.col("role").alias("file_path")
    )
    return prompts.context_blocks(chunks, ["conv_id"], ["turn"])


@register(
    "routes_summary",
    f"""WITH {ct.METHOD_TEXT_SQL},
    lines AS (SELECT r.class_name, r.pos, '  - ' || CASE r.pos // 4294967296 WHEN 1 THEN 'index: ' || prefix || '/' WHEN 2 THEN 'edit: ' || prefix
        || CASE r.pos WHEN 8589934593 THEN '/{{id}}/edit' ELSE '/{{slug}}/modifier' END WHEN 3 THEN 'data: ' || prefix || '/data' ELSE 'helperAction: ' || prefix END
        || ' → ' || CASE r.pos // 4294967296 WHEN 1 THEN 'render (200)' WHEN 2 THEN CASE WHEN {ct.EDIT_RENDERS} THEN 'render (200)' ELSE 'redirect (302)' END
                      WHEN 3 THEN 'json (200)' ELSE '(type non détecté)' END
        || CASE WHEN r.pos = 8589934593 THEN ' [GET, POST]' WHEN r.pos // 4294967296 = 3 THEN ' [DELETE] [AJAX]' ELSE '' END
        || CASE WHEN r.pos // 4294967296 = 2 THEN ' [Form: PartType]' ELSE '' END
        || CASE WHEN r.pos // 4294967296 = 3 AND {ct.HAS_METHOD_GRANT} THEN ' [Rôle: ROLE_SUPER_ADMIN]' ELSE '' END
        || CASE WHEN r.pos // 4294967296 = 2 AND {ct.HAS_VOTER} THEN ' [Voter: edit]' ELSE '' END AS line
      FROM routed r JOIN p USING (p_partkey))
    SELECT class_name, 'ROUTES À TESTER (exhaustif, ne pas en oublier) :' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS summary FROM lines GROUP BY class_name""",
)
def routes_summary(spark, sf_dir):
    chunks = plans.code_queries.chunk_rows(spark, sf_dir).where(F.col("chunk_type") == "controllers_method")
    return prompts.routes_summary(chunks, KEYS, ["pos"])


@register(
    "route_prompt",
    f"""WITH {_PLAN}, listed AS (SELECT class_name, raw_route, http_verb, route,
        string_agg((plan_no + 1) || '. public function ' || name || '(): void — ' || spec, chr(10) ORDER BY plan_no) AS items FROM plan GROUP BY ALL)
    SELECT class_name, raw_route, strpos(items, 'Authenticated') > 0 AS lists_methods, length(items) > 100 AS is_long,
           'Route : ' || http_verb || ' ' || route || repeat(chr(10), 2) || 'Génère EXACTEMENT ces méthodes (utilise ces noms précis, rien d''autre) :' || chr(10) || items
           || repeat(chr(10), 2) || 'Retourne uniquement les corps de méthodes, sans texte autour.' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS request
    FROM listed""",
)
def route_prompt(spark, sf_dir):
    rows = plans.ranked(plans.chunk_rows(spark, sf_dir))
    plan = route_plan.route_plan(rows, KEYS)
    contexts = rows.select("class_name", "raw_route", F.col("content").alias("route_context"))
    prompt = prompts.route_prompt(plan, contexts, ["class_name", "raw_route"], "qwen2.5-coder:3b")
    request = F.concat(F.lit("Route : "), F.substring_index("prompt", "Scénario: Route : ", -1))
    return prompt.select(
        "class_name",
        "raw_route",
        request.contains("Authenticated").alias("lists_methods"),
        (F.length(request) > 100).alias("is_long"),
        request.alias("request"),
    )


def _stream(spark, sf_dir):
    """Turns as streamed lines: odd turns are no JSON, turn 6 ends the answer early."""
    final = F.when(F.col("turn") == 6, True).otherwise(False)
    body = F.struct(
        F.concat(F.lit("```php"), "text", F.lit("```")).alias("response"),
        final.alias("done"),
        F.when(final, "stop").alias("done_reason"),
        F.when(final, F.col("conv_id") + 10).alias("eval_count"),
    )
    line = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("log: "), "text")).otherwise(F.to_json(body))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), line.alias("line"))


@register(
    "assemble_responses",
    """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS piece, max((turn = 6)::INT) OVER (PARTITION BY conv_id) AS ended FROM conversations)
    SELECT conv_id, regexp_replace(string_agg(piece, '' ORDER BY turn), '^\\s+|\\s+$', '', 'g') AS text,
           CASE WHEN max(ended) = 1 THEN 'stop' END AS done_reason, CASE WHEN max(ended) = 1 THEN conv_id + 10 ELSE 0 END AS eval_count
    FROM t WHERE ended = 0 OR turn <= 6 GROUP BY conv_id""",
)
def assemble_responses(spark, sf_dir):
    return prompts.assemble_responses(_stream(spark, sf_dir), ["conv_id"])
