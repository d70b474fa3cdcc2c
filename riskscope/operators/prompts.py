"""Prompt texts and model responses as DataFrame columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskscope.functions import chunk_text, safety
from riskscope.functions.code import strip_space
from riskscope.plans.settings import AppSettings
from riskscope.schemas import STREAM_LINE_SCHEMA

# The size limits of examples and prompts that a caller may pass.
MAX_EXAMPLE_CHARS = 3500
MAX_PROMPT_CHARS = 12_000
CHARS_PER_TOKEN = 3
TOKEN_WARNING = 6_500

# Model families that use the chat format, and words that select an example.
CHAT_MODELS = ["qwen", "mistral", "phi"]
PROFILE_KEYWORDS = {
    "api": ["xhr", "api", "ajax"],
    "mixed": ["mixte", "mixed"],
    "web_crud": ["crud", "formulaire", "form", "redirect"],
}

NO_CONTEXT = "CONTEXTE : Aucun contexte trouvé pour ce projet.\n"
CONTEXT_TITLE = "CONTEXTE RÉEL DU PROJET (NE PAS INVENTER) :"
ROUTES_TITLE = "ROUTES À TESTER (exhaustif, ne pas en oublier) :"
# Pieces joined by one task when a long text is put together.
PIECES_PER_STEP = 4_096


def truncate_example(text: Column, limit: int | None = None) -> Column:
    """Cut an example longer than `limit` and close the braces it leaves open; no limit, no cut."""
    if limit is None:
        return text
    cut = F.substring(text, 1, limit)
    braces = lambda c: F.length(cut) - F.length(F.replace(cut, F.lit(c), F.lit("")))
    missing = F.greatest(F.lit(0), braces("{") - braces("}"))
    closed = F.concat(cut, F.lit("\n// [tronqué]\n"), F.repeat(F.lit("}"), missing))
    return F.when(F.length(text) > limit, closed).otherwise(text)


def select_shots(examples: DataFrame, request: str, order: str) -> DataFrame:
    """(profile, example): first example that mentions a keyword of the profile, else the first one.

    One aggregation over the examples; the result has one row per profile, plus one for any
    other profile under the empty name.
    """
    first = lambda condition: F.min_by(F.struct(*examples.columns), F.when(condition, F.col(order)))
    mentions = lambda words: F.lower(request).rlike("|".join(words))
    row = examples.agg(
        first(F.lit(True)).alias("other"),
        *[first(mentions(words)).alias(profile) for profile, words in PROFILE_KEYWORDS.items()],
    )
    entries = [F.struct(F.lit("").alias("profile"), F.col("other").alias("example"))] + [
        F.struct(F.lit(p).alias("profile"), F.coalesce(p, "other").alias("example")) for p in PROFILE_KEYWORDS
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def attach_shot(requests: DataFrame, shots: DataFrame, profile: str = "profile") -> DataFrame:
    """Each request with the example of its profile. `shots` has one row per known profile."""
    known = F.when(F.col(profile).isin(*PROFILE_KEYWORDS), F.col(profile)).otherwise("")
    small = shots.withColumnRenamed("profile", "__profile")
    return requests.withColumn("__profile", known).join(F.broadcast(small), "__profile", "left").drop("__profile")


def build_prompt(system: Column, shots: Column, user: Column, model: str) -> Column:
    """Prompt of a model: chat format or plain sections. `shots` is array<struct<request, ideal>>."""
    joined = lambda wrap: F.array_join(F.transform(shots, wrap), "")
    if any(family in model.lower() for family in CHAT_MODELS):
        turn = lambda s: F.concat(
            F.lit("<|im_end|>\n<|im_start|>user\nScénario: "), s["request"],
            F.lit("\n<|im_end|>\n<|im_start|>assistant\n"), s["ideal"], F.lit("\n"),
        )
        return F.concat(
            F.lit("<|im_start|>system\n"), system, F.lit("\n"), joined(turn),
            F.lit("<|im_end|>\n<|im_start|>user\nScénario: "), user, F.lit("\n<|im_end|>\n<|im_start|>assistant\n"),
        )
    section = lambda s: F.concat(
        F.lit("\n### Exemple\nScénario: "), s["request"], F.lit("\nRéponse:\n"), s["ideal"], F.lit("\n")
    )
    return F.concat(
        F.lit("### Instructions\n"), system, F.lit("\n"), joined(section),
        F.lit("\n### Tâche\nScénario: "), user, F.lit("\nRéponse:\n"),
    )


def fit_budget(
    df: DataFrame, prompt: str, limit: int | None = None, chars_per_token: int = CHARS_PER_TOKEN, warn_tokens: int = TOKEN_WARNING
) -> DataFrame:
    """Add the estimated tokens of a prompt and a warning; cut it at `limit` characters if one is given."""
    text = F.col(prompt)
    return (
        df.withColumn("is_truncated", F.length(text) > limit if limit is not None else text.isNull() & F.lit(None))
        .withColumn(prompt, text if limit is None else F.substring(text, 1, limit))
        .withColumn("is_truncated", F.coalesce("is_truncated", F.when(text.isNotNull(), F.lit(False))))
        .withColumn("estimated_tokens", F.floor(F.length(prompt) / chars_per_token))
        .withColumn("is_over_budget", F.col("estimated_tokens") > warn_tokens)
    )


def context_line(content: Column, file_path: Column) -> Column:
    return F.concat(F.lit("- "), content, F.lit(" (Fichier: "), file_path, F.lit(")"))


def join_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str = "") -> DataFrame:
    """(keys…, text): the pieces of a key joined in order.

    `order` starts with an integer column. Pieces are first joined in slices of that column,
    so no task sorts all the pieces of one key; the slices are then joined.
    """
    sliced = df.withColumn("__slice", F.floor(F.col(order[0]) / F.lit(PIECES_PER_STEP)))
    by = ", ".join(order)
    quoted = separator.replace("\n", "\\n")
    parts = sliced.groupBy(*keys, "__slice").agg(
        F.expr(f"listagg({text}, '{quoted}') WITHIN GROUP (ORDER BY {by})").alias(text)
    )
    return parts.groupBy(*keys).agg(
        F.expr(f"listagg({text}, '{quoted}') WITHIN GROUP (ORDER BY __slice)").alias(text)
    )


def context_blocks(chunks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys…, context): the chunks of a key as one delimited block of data."""
    lines = chunks.select(*keys, *order, context_line(F.col("content"), F.col("file_path")).alias("context"))
    joined = join_pieces(lines, keys, order, "context", "\n")
    return joined.withColumn(
        "context", F.concat(safety.wrap_context(F.concat(F.lit(CONTEXT_TITLE + "\n"), F.col("context"))), F.lit("\n"))
    )


def with_context(requests: DataFrame, contexts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests with their context block, or the fixed text where nothing was found."""
    return requests.join(contexts, list(keys), "left").na.fill({"context": NO_CONTEXT})


def route_line(content: Column) -> Column:
    """Summary line of a route chunk, or null for any other chunk."""
    get = lambda pattern: chunk_text.extract(content, pattern)
    tag = lambda label, pattern: F.when(
        content.rlike(pattern), F.concat(F.lit(f" [{label}"), get(pattern), F.lit("]"))
    ).otherwise("")
    line = F.concat(
        F.lit("  - "), get(chunk_text.METHOD_NAME), F.lit(": "), get(chunk_text.ROUTE), F.lit(" → "),
        F.coalesce(get(chunk_text.RESPONSE_TYPE), F.lit("(type non détecté)")),
        tag("", chunk_text.HTTP_VERBS),
        F.when(content.contains(chunk_text.AJAX_ONLY), " [AJAX]").otherwise(""),
        tag("Form: ", chunk_text.FORM_TYPE),
        tag("Rôle: ", chunk_text.METHOD_ROLE),
        tag("Voter: ", chunk_text.VOTER),
    )
    return F.when(content.contains("Route:"), line)


def routes_summary(chunks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys…, summary): all route lines of a key under their title."""
    lines = chunks.select(*keys, *order, route_line(F.col("content")).alias("summary")).where(
        F.col("summary").isNotNull()
    )
    joined = join_pieces(lines, keys, order, "summary", "\n")
    return joined.withColumn("summary", F.concat(F.lit(ROUTES_TITLE + "\n"), F.col("summary")))


def route_prompt(
    plan: DataFrame, contexts: DataFrame, route_keys: Sequence[str], model: str, settings: AppSettings = AppSettings()
) -> DataFrame:
    """Prompt of one route that imposes the exact method names.

    `plan` holds at most three rows per route; `contexts` one row per route with `route_context`.
    """
    item = F.concat(
        (F.col("plan_no") + 1).cast("string"), F.lit(". public function "), F.col("name"), F.lit("(): void — "), F.col("spec")
    )
    listed = plan.withColumn("__item", item).groupBy(*route_keys, "http_verb", "route").agg(
        F.expr("listagg(__item, '\n') WITHIN GROUP (ORDER BY plan_no)").alias("items")
    )
    system = F.concat(
        F.lit(
            "Tu es un expert Symfony spécialisé dans les tests fonctionnels PHPUnit / WebTestCase.\n"
            "Tu génères UNIQUEMENT des méthodes de test (corps PHP complets) — "
            "PAS de <?php, PAS de namespace, PAS de use, PAS de déclaration de classe, "
            "PAS de setUp ni getTestUser (ils existent déjà). Commence DIRECTEMENT par "
            "'public function'.\n"
            "Le client est $this->client (KernelBrowser). "
            f"Authentification : $this->client->loginUser($this->getTestUser('ROLE_XXX'), '{settings.firewall}').\n"
            "N'invente aucune URL, aucun texte de page, aucun sélecteur CSS non fourni.\n\n"
            "CONTEXTE RÉEL DE LA ROUTE (ne pas inventer au-delà) :\n"
        ),
        safety.wrap_context(F.col("route_context")),
    )
    user = F.concat(
        F.lit("Route : "), F.col("http_verb"), F.lit(" "), F.col("route"),
        F.lit("\n\nGénère EXACTEMENT ces méthodes (utilise ces noms précis, rien d'autre) :\n"), F.col("items"),
        F.lit("\n\nRetourne uniquement les corps de méthodes, sans texte autour."),
    )
    no_shots = F.array().cast("array<struct<request: string, ideal: string>>")
    return listed.join(contexts, list(route_keys)).select(
        *route_keys, build_prompt(system, no_shots, user, model).alias("prompt")
    )


def assemble_responses(lines: DataFrame, keys: Sequence[str], seq: str = "seq", line: str = "line") -> DataFrame:
    """(keys…, text, done_reason, eval_count): streamed pieces up to the first final one.

    Lines that are not JSON objects are ignored. Fences around the code are removed.
    """
    parsed = lines.select(*keys, F.col(seq).alias("__seq"), F.from_json(line, STREAM_LINE_SCHEMA).alias("j")).select(
        *keys, "__seq", F.coalesce("j.response", F.lit("")).alias("text"), F.coalesce("j.done", F.lit(False)).alias("done"),
        "j.done_reason", "j.eval_count",
    )
    ends = parsed.groupBy(*keys).agg(
        F.min(F.when(F.col("done"), F.struct("__seq", "done_reason", "eval_count"))).alias("end")
    )
    kept = parsed.join(ends, list(keys)).where(
        F.col("end").isNull() | (F.col("__seq") <= F.col("end.__seq"))
    )
    texts = join_pieces(kept.select(*keys, "__seq", "text"), keys, ["__seq"], "text")
    clean = strip_space(
        F.replace(F.replace(strip_space(F.col("text")), F.lit("```php"), F.lit("")), F.lit("```"), F.lit(""))
    )
    return texts.join(ends, list(keys)).select(
        *keys, clean.alias("text"), F.col("end.done_reason").alias("done_reason"),
        F.coalesce("end.eval_count", F.lit(0)).cast("long").alias("eval_count"),
    )
