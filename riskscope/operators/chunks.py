"""Class facts and templates to chunks, and chunks to metadata."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from riskscope.functions import chunk_text, routes, templates
from riskscope.functions.code import none_if_empty

# Positions reserved for the routes of one method: more than an array can hold.
METHOD_STRIDE = 1 << 32
CHUNK_COLUMNS = ["project_id", "file_path", "class_name", "pos", "chunk_type", "content"]


def template_rows(raw: DataFrame, file: str = "file", html: str = "html") -> DataFrame:
    """Facts of each template as columns, with its two texts."""
    facts = F.col("__f")
    read = raw.select("*", templates.template_facts(F.col(html)).alias("__f"))
    return read.select(
        *[c for c in raw.columns if c != html],
        templates.description(F.col(file), facts).alias("description"),
        templates.index_text(F.col(file), facts).alias("content"),
        templates.heading_list(facts).alias("h1"),
        "__f.*",
    )


def enrich_with_template(methods: DataFrame, template_facts: DataFrame, renders: str, file: str = "file") -> DataFrame:
    """Left join of headings, inputs and hidden ids of the rendered template, each capped.

    Methods that render nothing skip the join, so their null key is no hot spot. The size of
    the template side decides at run time whether it is broadcast.
    """
    right = template_facts.select(
        F.col(file).alias("__file"),
        F.slice("h1", 1, chunk_text.MAX_HEADINGS).alias("tpl_h1"),
        F.slice("inputs", 1, chunk_text.MAX_FIELDS).alias("tpl_inputs"),
        F.slice("hidden_ids", 1, chunk_text.MAX_FIELDS).alias("tpl_hidden_ids"),
    )
    rendering = methods.where(F.col(renders).isNotNull()).join(
        right, F.col(renders) == F.col("__file"), "left"
    )
    none = F.lit(None).cast("array<string>")
    others = methods.where(F.col(renders).isNull()).select(
        "*", none.alias("tpl_h1"), none.alias("tpl_inputs"), none.alias("tpl_hidden_ids")
    )
    return rendering.drop("__file").unionByName(others)


def class_chunks(classes: DataFrame, category: Column) -> DataFrame:
    """One chunk per class; `pos` 0 puts it before its methods."""
    return classes.select(
        "project_id",
        F.col("file").alias("file_path"),
        "class_name",
        F.lit(0).cast("long").alias("pos"),
        F.concat(category, F.lit("_class")).alias("chunk_type"),
        chunk_text.class_text(
            F.col("class_name"), category, F.col("file"), F.col("constructor_params"),
            F.col("controller_profile"), F.col("class_grants"),
        ).alias("content"),
    )


def method_chunks(methods: DataFrame, category: Column) -> DataFrame:
    """One chunk per route of a method, or one for a method without a route.

    `methods` holds `m` (method facts), `method_pos` and the `tpl_*` lists.
    """
    m = F.col("m")
    routed = methods.select("*", F.posexplode_outer("m.routes").alias("route_pos", "route"))
    text = F.when(F.col("route").isNull(), chunk_text.unrouted_text(m, F.col("class_name"))).otherwise(
        chunk_text.route_text(
            m, F.col("class_name"), F.col("route"), F.col("tpl_h1"), F.col("tpl_inputs"), F.col("tpl_hidden_ids")
        )
    )
    return routed.select(
        "project_id",
        F.col("file").alias("file_path"),
        "class_name",
        (1 + F.col("method_pos").cast("long") * METHOD_STRIDE + F.coalesce("route_pos", F.lit(0))).cast("long").alias("pos"),
        F.concat(category, F.lit("_method")).alias("chunk_type"),
        text.alias("content"),
    )


def template_chunks(template_table: DataFrame) -> DataFrame:
    return template_table.select(
        "project_id",
        F.col("file").alias("file_path"),
        F.lit("N/A").alias("class_name"),
        F.lit(0).cast("long").alias("pos"),
        F.lit("template_info").alias("chunk_type"),
        "content",
    )


def method_references(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Method chunks with `method_name` and `raw_route` (null without a route) read from the text."""
    c = F.col(content)
    read = chunks.where(c.startswith("Méthode '")).select(
        "*",
        F.regexp_extract(c, chunk_text.METHOD_NAME, 1).alias("method_name"),
        none_if_empty(F.regexp_extract(c, chunk_text.ROUTE, 1)).alias("raw_route"),
    )
    return read.where(~F.col("method_name").isin("", "__construct"))


def chunk_metadata(
    references: DataFrame, class_role: Column, role_map: Mapping[str, str] | None = None, content: str = "content"
) -> DataFrame:
    """`method_references` rows with all fields read back from the text.

    `cap` is the capitalised method name; a `route_rank` column above one adds its suffix.
    """
    c = F.col(content)
    mapping = role_map or {}
    name, route = F.col("method_name"), F.col("raw_route")
    mentions = lambda *words: F.exists("response_types", lambda t: _any(t, words))
    cap = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20))
    if "route_rank" in references.columns:
        rank = F.col("route_rank")
        cap = F.when(rank > 1, F.concat(cap, F.lit("Route"), rank.cast("string"))).otherwise(cap)
    first = references.select(
        *[x for x in references.columns if x != "class_role"],
        class_role.alias("class_role"),
        routes.method_role(c, class_role).alias("method_role"),
        chunk_text.response_types(c).alias("response_types"),
        chunk_text.extract(c, chunk_text.FORM_TYPE).alias("form_type"),
        none_if_empty(F.regexp_extract(c, chunk_text.VOTER, 1)).alias("voter_attr"),
        chunk_text.first_heading(c).alias("h1"),
        chunk_text.hidden_ids(c).alias("hidden_ids"),
        c.contains(chunk_text.AJAX_ONLY).alias("is_ajax"),
        cap.alias("cap"),
        routes.resolve_route(route).alias("route"),
        routes.http_verb(c, name, F.coalesce(route, F.lit(""))).alias("http_verb"),
    )
    second = first.select(
        *first.columns,
        routes.role_key(F.col("method_role"), mapping).alias("factory_key"),
        routes.role_key(F.col("class_role"), mapping).alias("class_factory_key"),
        mentions("render").alias("has_render"),
        mentions("redirect").alias("has_redirect"),
        mentions("json").alias("has_json"),
        mentions("file_download", "binary").alias("has_file"),
        mentions("export").alias("has_export"),
        F.col("form_type").isNotNull().alias("has_form"),
        F.col("voter_attr").isNotNull().alias("has_voter"),
    )
    return second.select(
        *second.columns,
        routes.role_label(F.col("factory_key")).alias("role_label"),
        routes.role_label(F.col("class_factory_key")).alias("class_role_label"),
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def class_settings(chunks: DataFrame, keys: list[str], pos: str = "pos", content: str = "content") -> DataFrame:
    """Profile and main role of each class: the first chunk, in order, that states them.

    Without any statement the role is the default one, and the profile is internal only if
    the class has methods without routes and none with a route. All are plain aggregates
    that combine before the shuffle. `first_route`, `first_unrouted` and `last_pos` are the
    places that the layout of a test file needs.
    """
    c, p = F.col(content), F.col(pos)
    first = lambda value: F.min_by(value, F.when(value.isNotNull(), p))
    is_method = c.startswith("Méthode '") & ~c.startswith("Méthode '__construct'")
    read = chunks.select(
        *keys,
        p,
        chunk_text.extract(c, chunk_text.PROFILE).alias("__profile"),
        routes.first_class_role(c).alias("__role"),
        is_method.alias("__method"),
        c.rlike(chunk_text.ROUTE).alias("__routed"),
        c.contains(chunk_text.NO_ROUTE).alias("__internal"),
    )
    found = read.groupBy(*keys).agg(
        first(F.col("__profile")).alias("profile"),
        first(F.col("__role")).alias("class_role"),
        F.bool_or("__routed").alias("__routed"),
        F.bool_or("__internal").alias("__internal"),
        F.min(F.when(F.col("__method") & F.col("__routed"), p)).alias("first_route"),
        F.min(F.when(F.col("__method") & ~F.col("__routed"), p)).alias("first_unrouted"),
        F.max(p).alias("last_pos"),
    )
    fallback = F.when(~F.col("__routed") & F.col("__internal"), "internal").otherwise("web_crud")
    return found.select(
        *keys,
        F.coalesce("profile", fallback).alias("profile"),
        F.coalesce("class_role", F.lit(routes.DEFAULT_ROLE)).alias("class_role"),
        "first_route",
        "first_unrouted",
        "last_pos",
    )


def split_internal(settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes for functional tests, internal classes for unit tests)."""
    internal = F.col("profile") == "internal"
    return settings.where(~internal), settings.where(internal)
