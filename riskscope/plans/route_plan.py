"""Per-route generation: planned methods, attempts, fallbacks and outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskscope.functions import code
from riskscope.functions.routes import anchor_segment, coverage_pattern
from riskscope.operators.prompts import build_prompt, join_pieces
from riskscope.plans.rendering import FILE_FOOTER, file_header, test_class_name
from riskscope.plans.scenarios import _text
from riskscope.plans.settings import AppSettings
from riskscope.scaling import join_on, spread
from riskscope.session import materialise

# Fixed value: output budget of the first attempt.
OUTPUT_BUDGET = 1024
# Rows that one task sorts by family of names.
NAMED_ROWS = 1 << 18


def output_budget(attempt: Column) -> Column:
    return attempt * F.lit(OUTPUT_BUDGET)


def expected_assertion() -> Column:
    """What an authenticated answer must satisfy, in words."""
    success = "assertResponseIsSuccessful()"
    heading = F.when(
        F.col("h1") != "", _text(" ; puis assertSelectorTextContains('h1', '", "@h1", "')")
    ).otherwise("")
    return (
        F.when(F.col("has_json"), f"{success} puis assertJson sur le contenu de la réponse")
        .when(F.col("has_redirect") & ~F.col("has_render"), "assertResponseRedirects() SANS argument")
        .when(F.col("has_file") | F.col("has_export"), success)
        .otherwise(F.concat(F.lit(success), heading))
    )


def planned_methods(s: AppSettings = AppSettings()) -> Column:
    """array<struct<name, spec>>: two base methods and at most one for ajax, form or voter."""
    method = lambda name, spec: F.struct(name.alias("name"), spec.alias("spec"))
    call = "$this->client->request('"
    anonymous = method(
        _text("test", "@cap", "RedirectsWhenNotAuthenticated"),
        _text(
            "NON authentifié (pas de loginUser) : ", call, "@http_verb", "', '", "@route",
            f"') puis assertResponseStatusCodeSame({s.redirect_status}) et assertResponseRedirects('{s.redirect_path}').",
        ),
    )
    logged_in = method(
        _text("test", "@cap", "AuthenticatedWith", "@role_label", "Role"),
        _text(
            "AUTHENTIFIÉ : $this->client->loginUser($this->getTestUser('", "@factory_key", f"'), '{s.firewall}') puis ",
            call, "@http_verb", "', '", "@route", "') puis ", expected_assertion(), ".",
        ),
    )
    extra = (
        F.when(
            F.col("is_ajax"),
            method(
                _text("test", "@cap", "WithoutXhrReturns404"),
                _text(
                    "Route AJAX appelée SANS header XHR : loginUser('", "@factory_key", "') puis ", call, "@http_verb",
                    "', '", "@route", "') (sans HTTP_X-Requested-With) puis assertResponseStatusCodeSame(404).",
                ),
            ),
        )
        .when(
            F.col("has_form"),
            method(
                _text("test", "@cap", "FormSubmit"),
                _text(
                    "Soumission du formulaire : loginUser('", "@factory_key", "') puis ", call, "POST', '", "@route",
                    "') puis ",
                    F.when(F.col("has_redirect"), "assertResponseRedirects()").otherwise("assertResponseIsSuccessful()"),
                    ".",
                ),
            ),
        )
        .when(
            F.col("has_voter"),
            method(
                _text("test", "@cap", "VoterDeniesAccess"),
                _text(
                    "Contrôle d'accès par voter '", F.coalesce("voter_attr", F.lit("?")), "' : loginUser('", "@factory_key",
                    "') puis requête sur la route avec une entité inexistante, et assertContains du status dans [403, 404, 500].",
                ),
            ),
        )
    )
    return F.filter(F.array(anonymous, logged_in, extra), lambda m: m.isNotNull())


def route_plan(metadata: DataFrame, keys: Sequence[str], settings: AppSettings = AppSettings(), pos: str = "pos") -> DataFrame:
    """One row per planned method; repeated names inside a class get the first free number.

    Names start from a method and its route number, so repeats are rare; they are numbered by
    their place in the file.
    """
    plan = metadata.select(
        *keys, pos, "method_name", "raw_route", "http_verb", "route",
        F.posexplode_outer(planned_methods(settings)).alias("plan_no", "p"),
    ).select(*keys, pos, "method_name", "raw_route", "http_verb", "route", "plan_no", "p.*")
    return unique_names(plan, keys, "name", pos, "plan_no")


def unique_names(df: DataFrame, keys: Sequence[str], name: str, pos: str, part: str | None = None) -> DataFrame:
    """Rename repeats of a name inside a file: a repeat gets the smallest free number from 2 on.

    Names are settled in file order, as each choice takes a name from the later ones. Only
    names that are equal but for a number at their end can meet, and only families of several
    names with a repeat are folded one by one.
    """
    order = [pos] + ([part] if part else [])
    family = [*keys, "__family"]
    # Both results read the rows, which are stored, so that they are computed once and counted by the file.
    stored = materialise(df.withColumn("__family", F.regexp_replace(name, "[0-9]+$", "")))
    rows = spread(stored, NAMED_ROWS, *family)
    group = Window.partitionBy(*family)
    found = (
        rows.withColumn("__copy", F.row_number().over(Window.partitionBy(*family, name).orderBy(*order)))
        .withColumn("__repeats", F.max("__copy").over(group) > 1)
        .withColumn("__one", F.min(name).over(group) == F.max(name).over(group))
    )
    # In a family of one name the n-th copy gets the number n.
    numbered = F.when(F.col("__copy") > 1, F.concat(name, F.col("__copy").cast("string"))).otherwise(F.col(name))
    schema, columns = df.schema, df.columns

    def settle(pdf):
        taken, following, out = set(), {}, []
        pdf = pdf.sort_values(order, kind="stable")
        for base in pdf[name]:
            free = base
            if base in taken:
                i = following.get(base, 2)
                while f"{base}{i}" in taken:
                    i += 1
                free, following[base] = f"{base}{i}", i + 1
            taken.add(free)
            out.append(free)
        return pdf.assign(**{name: out})[columns]

    meeting = F.col("__repeats") & ~F.coalesce("__one", F.lit(True))
    settled = found.where(meeting).groupBy(*family).applyInPandas(settle, schema)
    return found.where(~meeting).withColumn(name, numbered).select(*columns).unionByName(settled)


def best_attempt(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per route: the attempt to keep, and the diagnostic of the attempts made.

    An attempt succeeds with at least one block and a reason other than `length`; nothing
    after the first success is looked at. Without success the attempt with most blocks is
    kept, the earliest on ties, or none if all are empty. Any number of attempts will do.
    """
    ok = (F.col("n_blocks") > 0) & (F.coalesce("done_reason", F.lit("")) != "length")
    fullest = F.when(F.col("n_blocks") > 0, F.struct("n_blocks", -F.col("attempt")))
    ends = attempts.groupBy(*keys).agg(
        F.min(F.when(ok, F.col("attempt"))).alias("__first_ok"),
        F.max_by("attempt", fullest).alias("__fullest"),
        F.max("attempt").alias("__last"),
    )
    made = ends.select(
        *keys,
        F.coalesce("__first_ok", F.when(F.col("__fullest").isNotNull(), F.col("__fullest"))).alias("kept"),
        F.coalesce("__first_ok", "__last").alias("attempts"),
    )
    counted = join_on(attempts, made, keys).where(F.col("attempt") <= F.col("attempts"))
    return counted.groupBy(*keys).agg(
        F.max("kept").alias("kept"),
        F.max("attempts").alias("attempts"),
        F.max(F.when(F.col("attempt") == F.col("attempts"), F.col("done_reason"))).alias("done_reason"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.round(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 1).alias("elapsed"),
        F.max("kept").isNotNull().alias("ok"),
    )


def stub_methods(plan: DataFrame, outcomes: DataFrame, route_keys: Sequence[str]) -> DataFrame:
    """Placeholder methods for the routes whose generation failed."""
    failed = outcomes.where(~F.col("ok")).select(*route_keys, "done_reason")
    text = _text(
        "    public function ", "@name", "(): void\n    {\n        // TODO: génération échouée pour la route ", "@http_verb", " ",
        "@raw_route", " (done_reason=", F.coalesce("done_reason", F.lit("None")),
        ").\n        $this->markTestIncomplete('Génération automatique échouée — à écrire à la main.');\n    }",
    )
    return plan.join(failed, list(route_keys)).withColumn("stub", text)


def generation_outcome(diagnostics: DataFrame, keys: Sequence[str], ok: str = "ok", skipped: str | None = None) -> DataFrame:
    """Status of each class: failed, partial or success."""
    skip = F.count_if(F.col(skipped)) if skipped else F.lit(0)
    counts = diagnostics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("routes_total"),
        F.count_if(F.col(ok)).alias("routes_generated"),
        F.count_if(~F.col(ok)).alias("routes_failed"),
        skip.cast("long").alias("routes_skipped"),
    )
    return counts.withColumn(
        "status",
        F.when((F.col("routes_generated") == 0) & (F.col("routes_total") > 0), "failed")
        .when((F.col("routes_failed") > 0) | (F.col("routes_skipped") > 0), "partial")
        .otherwise("success"),
    )


def generated_blocks(responses: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per complete test method of a response, in order."""
    blocks = F.posexplode_outer(code.test_blocks(F.col(text))).alias("block_no", "block")
    return (
        responses.select(*keys, blocks)
        .where(F.col("block").isNotNull())
        .withColumn("test_name", code.test_name(F.col("block")))
    )


def route_hits(routes: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(route_id, pattern, text_id) pairs that may match: a whole literal segment of the route occurs in a text of its class.

    `routes` has keys, route_id and raw route `route`; `texts` has keys, text_id and `text`. Segments
    are looked up by hash, so a class with many texts is spread over its segments. Routes without a whole
    literal segment are paired with every text of their class.
    """
    pieces = F.array_distinct(F.transform(F.split("text", "/"), lambda x: F.xxhash64(x)))
    found = texts.select(*[F.col(k).alias(f"__{k}") for k in keys], "text_id", F.explode(pieces).alias("piece"))
    asked = routes.select(*keys, "route_id", coverage_pattern(F.col("route")).alias("pattern"), F.xxhash64(anchor_segment(F.col("route"))).alias("anchor"), anchor_segment(F.col("route")).isNull().alias("open"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    pairs = ("route_id", "pattern", "text_id")
    hits = asked.where(~F.col("open")).join(found, [*same, F.col("anchor") == F.col("piece")]).select(*pairs)
    whole = texts.select(*[F.col(k).alias(f"__{k}") for k in keys], "text_id")
    return hits.unionByName(asked.where("open").join(whole, same).select(*pairs))


def uncovered_routes(routes: DataFrame, code_texts: DataFrame, keys: Sequence[str], route: str = "raw_route", text: str = "text") -> DataFrame:
    """Routes whose pattern is found in no generated text of their own class.

    Patterns run only on the texts that `route_hits` finds. A class without any text has all its
    routes uncovered. Both sides are written once, so that their numbers hold.
    """
    asked = materialise(routes.withColumn("__route", F.monotonically_increasing_id()))
    texts = materialise(code_texts.select(*keys, F.col(text).alias("text"), F.monotonically_increasing_id().alias("text_id")))
    numbered = asked.select(*keys, F.col("__route").alias("route_id"), F.col(route).alias("route"))
    hits = route_hits(numbered, texts, keys).join(texts.select("text_id", "text"), "text_id")
    covered = hits.where(F.call_function("regexp_like", F.col("text"), F.col("pattern"))).select(F.col("route_id").alias("__route"))
    return asked.join(covered.distinct(), "__route", "left_anti").select(*routes.columns)


def coverage_retry(uncovered: DataFrame, keys: Sequence[str], most: int = 6) -> DataFrame:
    """Classes worth another generation: between one and `most` missing routes."""
    return uncovered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_missing")).where(F.col("n_missing") <= most)


def missing_routes(uncovered: DataFrame, keys: Sequence[str], most: int = 6, route: str = "raw_route") -> DataFrame:
    """(keys…, n_missing, missing): the sorted missing routes of each class worth another generation."""
    few = coverage_retry(uncovered, keys, most)
    listed = join_on(uncovered, few, keys, "left_semi")
    return listed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_missing"), F.array_sort(F.collect_list(route)).alias("missing")
    )


def retry_prompts(
    missing: DataFrame, codes: DataFrame, keys: Sequence[str], system: Column, model: str, code_text: str = "text"
) -> DataFrame:
    """(keys…, prompt): the request that completes a file with its missing routes."""
    quoted = F.concat(F.lit("['"), F.array_join("missing", "', '"), F.lit("']"))
    user = F.concat(
        F.lit("Routes manquantes : "), quoted,
        F.lit(
            "\n\nComplète le fichier suivant en ajoutant les tests manquants. "
            "Retourne TOUT le fichier corrigé commençant par <?php, sans markdown.\n\nCode actuel :\n"
        ),
        F.col(code_text),
    )
    no_shots = F.array().cast("array<struct<request: string, ideal: string>>")
    return join_on(missing, codes, keys).select(*keys, build_prompt(system, no_shots, user, model).alias("prompt"))


def route_files(
    blocks: DataFrame, keys: Sequence[str], pos: str = "pos", part: str = "part", block: str = "block",
    settings: AppSettings = AppSettings(), class_key: str = "class_name",
) -> DataFrame:
    """(keys…, text): kept blocks and stubs in route order as one test file per class.

    `blocks` holds one method per row, generated or a stub. A name that repeats in the file
    is renamed inside the text of its block.
    """
    header = r"(?is)^(.*?public\s+function\s+)(test\w+)(\s*\()"
    named = blocks.select(
        *keys, F.col(pos).cast("long").alias("__pos"), F.col(part).alias("__part"), F.col(block).alias("__block"),
        F.regexp_extract(block, header, 2).alias("__name"),
    )
    # A block without a method name takes part in no renaming.
    plain = named.where("__name = ''").withColumn("__new", F.lit(""))
    titled = named.where("__name <> ''").withColumn("__new", F.col("__name"))
    renamed = unique_names(titled, keys, "__new", "__pos", "__part")
    at = F.length(F.regexp_extract("__block", header, 1))
    text = F.when(F.col("__new") == F.col("__name"), F.col("__block")).otherwise(
        F.concat(
            F.substring(F.col("__block"), F.lit(1), at), F.col("__new"),
            F.substring(F.col("__block"), at + F.length("__name") + 1, F.length("__block")),
        )
    )
    rows = renamed.unionByName(plain).select(*keys, "__pos", "__part", text.alias("__text"))
    body = join_pieces(rows, keys, ["__pos", "__part"], "__text", "\n\n")
    whole = F.concat(
        file_header(test_class_name(F.col(class_key)), settings), F.lit("\n"), F.col("__text"), F.lit(FILE_FOOTER)
    )
    return body.select(*keys, whole.alias("text"))
