"""Expressions over class facts: routes, grants, parameters, doc comments, profile."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskscope.functions import code
from riskscope.functions.binding import let
from riskscope.functions.code import none_if_empty, strip_space

# Patterns over doc comments.
DOC_ROUTE = r"Route\(\s*(?:path\s*:\s*)?['\"]([^'\"]+)['\"]"
DOC_CLASS_ROUTE = r"@Route\(\s*['\"]([^'\"]+)['\"]"
DOC_METHODS = r"(?i)methods\s*[:=]\s*[\[{]\s*(['\"][A-Z]+['\"](?:\s*,\s*['\"][A-Z]+['\"])*)\s*[\]}]"
DOC_GRANT = r"(?i)@IsGranted\(\s*['\"]([^'\"]+)['\"]"
DOC_SUMMARY = r"(?s)/\*\*(?:\s*\n\s*\*\s*(.*?)\n|\s+(.*?)\s*\*/)"

# Fixed value: share of routed methods above which one response kind names the profile.
DOMINANT_SHARE = 0.7

ROUTE_TYPE = "struct<path: string, name: string, http_methods: array<string>>"
GRANT_TYPE = "struct<role: string, message: string>"


def _is_type(value: Column, prefix: str) -> Column:
    return F.schema_of_variant(value).startswith(prefix)


def text_value(value: Column) -> Column:
    """The variant as text when it holds a string, else null."""
    return let(value, lambda v: F.when(_is_type(v, "STRING"), F.try_variant_get(v, "$", "string")))


def text_list(value: Column) -> Column:
    """The variant as a list of texts when it holds a list, else an empty list."""
    empty = F.array().cast("array<string>")
    items = let(
        value, lambda v: F.when(_is_type(v, "ARRAY"), F.try_variant_get(v, "$", "array<string>"))
    )
    return F.coalesce(items, empty)


def named_argument(args: Column, name: str) -> Column:
    return F.try_element_at(F.filter(args, lambda a: a["name"] == name), F.lit(-1))["value"]


def first_positional(args: Column) -> Column:
    return F.try_element_at(F.filter(args, lambda a: a["name"].isNull()), F.lit(1))["value"]


def join_path(prefix: Column, path: Column) -> Column:
    """Class prefix and method path with one slash between them."""
    joined = lambda p: F.concat(
        F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(p, "^/+", "")
    )
    return let(
        path, lambda p: F.when(prefix == "", p).otherwise(F.replace(joined(p), F.lit("//"), F.lit("/")))
    )


def attribute_path(attribute: Column) -> Column:
    """Literal path of a route attribute: the `path` argument, else the first positional one."""
    args = attribute["args"]
    value = let(
        named_argument(args, "path"),
        lambda named: F.when(named.isNotNull() & ~F.is_variant_null(named), named).otherwise(first_positional(args)),
    )
    return text_value(value)


def attribute_routes(attributes: Column, prefix: Column) -> Column:
    """Routes of the attributes named Route; those without a literal path are skipped."""
    routes = F.transform(
        F.filter(attributes, lambda a: a["name"] == "Route"),
        lambda a: F.struct(
            join_path(prefix, attribute_path(a)).alias("path"),
            text_value(named_argument(a["args"], "name")).alias("name"),
            F.transform(text_list(named_argument(a["args"], "methods")), F.upper).alias("http_methods"),
        ),
    )
    return F.filter(routes, lambda r: r["path"].isNotNull())


def class_prefix(attributes: Column, docblock: Column) -> Column:
    """Route prefix of a class from its attributes, else from its doc comment, else empty."""
    from_attributes = F.try_element_at(attribute_routes(attributes, F.lit("")), F.lit(1))["path"]
    from_doc = F.regexp_extract(F.coalesce(docblock, F.lit("")), DOC_CLASS_ROUTE, 1)
    return F.coalesce(none_if_empty(from_attributes), from_doc)


def doc_verbs(docblock: Column) -> Column:
    listed = F.regexp_extract(docblock, DOC_METHODS, 1)
    verbs = lambda text: F.transform(
        F.split(text, ","), lambda v: F.upper(F.btrim(strip_space(v), F.lit("'\"")))
    )
    return let(listed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(verbs(t)))


def _one_route(path: Column, verbs: Column) -> Column:
    route = F.struct(
        path.alias("path"), F.lit(None).cast("string").alias("name"), verbs.alias("http_methods")
    )
    return F.array(route)


def method_routes(attributes: Column, docblock: Column, method_name: Column, prefix: Column) -> Column:
    """Routes of a method: attributes, else doc comment, else the naming convention."""
    doc = F.coalesce(docblock, F.lit(""))
    conventional = (
        (prefix != "")
        & (method_name != "__construct")
        & (method_name.endswith("Action") | (method_name == "index"))
    )
    by_name = F.when(conventional, _one_route(prefix, F.array().cast("array<string>"))).otherwise(
        F.array().cast(f"array<{ROUTE_TYPE}>")
    )
    fallback = let(
        F.regexp_extract(doc, DOC_ROUTE, 1),
        lambda path: F.when(path != "", _one_route(join_path(prefix, path), doc_verbs(doc))).otherwise(by_name),
    )
    return let(
        attribute_routes(attributes, prefix),
        lambda found: F.when(F.size(found) > 0, found).otherwise(fallback),
    )


def grants(attributes: Column, docblock: Column) -> Column:
    """Required roles: attributes named IsGranted, then doc comments."""
    from_attributes = F.transform(
        F.filter(attributes, lambda a: a["name"] == "IsGranted"),
        lambda a: F.struct(
            text_value(
                F.when(
                    F.exists(a["args"], lambda x: x["name"].isNull()), first_positional(a["args"])
                ).otherwise(named_argument(a["args"], "attribute"))
            ).alias("role"),
            text_value(named_argument(a["args"], "message")).alias("message"),
        ),
    )
    from_doc = F.transform(
        F.regexp_extract_all(F.coalesce(docblock, F.lit("")), F.lit(DOC_GRANT), 1),
        lambda role: F.struct(role.alias("role"), F.lit(None).cast("string").alias("message")),
    )
    empty = F.array().cast(f"array<{GRANT_TYPE}>")
    return F.concat(F.coalesce(from_attributes, empty), from_doc)


def doc_summary(docblock: Column) -> Column:
    """First summary line of a doc comment, or null."""
    first = F.regexp_extract(docblock, DOC_SUMMARY, 1)
    second = F.regexp_extract(docblock, DOC_SUMMARY, 2)
    raw = F.when(first != "", first).otherwise(second)
    return none_if_empty(strip_space(F.btrim(raw, F.lit("* "))))


def clean_params(params: Column) -> Column:
    """Named parameters, types without leading `?` or `\\`."""
    named = F.filter(params, lambda p: p["name"].isNotNull() & (p["name"] != ""))
    return F.transform(
        named,
        lambda p: F.struct(
            F.regexp_replace(p["type"], r"^[?\\]+", "").alias("type"), p["name"].alias("name")
        ),
    )


def method_facts(methods: Column, prefix: Column) -> Column:
    """Facts of every method of a class, in order."""

    def facts(m: Column) -> Column:
        body = F.coalesce(m["body"], F.lit(""))
        return F.struct(
            m["name"].alias("name"),
            method_routes(m["attributes"], m["docblock"], m["name"], prefix).alias("routes"),
            code.rendered_template(body).alias("renders"),
            code.response_types(body).alias("response_types"),
            grants(m["attributes"], m["docblock"]).alias("method_grants"),
            body.rlike(code.AJAX_CHECK).alias("is_ajax_only"),
            code.has_form(body).alias("has_form"),
            code.form_type(body).alias("form_type"),
            code.voter_checks(body).alias("voter_checks"),
            code.body_verb(body).alias("body_inferred_verb"),
            code.body_reads(body).alias("body_reads"),
            doc_summary(m["docblock"]).alias("description"),
            clean_params(m["params"]).alias("params"),
            m["return_type"].alias("return_type"),
        )

    return F.transform(methods, facts)


def mentions(types: Column, word: str) -> Column:
    return F.exists(types, lambda t: t.contains(word))


def profile_from_counts(routed: Column, json: Column, render: Column) -> Column:
    """Profile of a class from its routed methods and those answering JSON or a page."""
    share = lambda part: F.try_divide(part, routed)
    return (
        F.when(routed == 0, "internal")
        .when(share(json) > DOMINANT_SHARE, "api")
        .when(share(render) > DOMINANT_SHARE, "web_crud")
        .when((json > 0) & (render > 0), "mixed")
        .otherwise("web_crud")
    )


def class_profile(facts: Column) -> Column:
    """Profile of a class from its method facts."""

    def name(routed: Column) -> Column:
        having = lambda word: F.size(F.filter(routed, lambda m: mentions(m["response_types"], word)))
        counts = F.struct(
            F.size(routed).alias("all"), having("json").alias("json"), having("render").alias("render")
        )
        return let(counts, lambda c: profile_from_counts(c["all"], c["json"], c["render"]))

    return let(F.filter(facts, lambda m: F.size(m["routes"]) > 0), name)
