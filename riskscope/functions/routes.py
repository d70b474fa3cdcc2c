"""Expressions over routes: parameter values, verbs, roles, coverage patterns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from riskscope.functions import chunk_text
from riskscope.functions.binding import let
from riskscope.functions.code import none_if_empty, strip_space

# Values put in place of route parameters.
PARAM_DEFAULTS = {
    "id": "1",
    "nom": "dupont",
    "name": "dupont",
    "slug": "exemple",
    "page": "1",
    "type": "test",
    "code": "001",
    "tab": "general",
    "filename": "export.csv",
}
OTHER_PARAM = "test"
# Fixed value: an identifier no entity carries.
BOGUS_ID = "99999999"
# Fixed value: class role when no chunk names one.
DEFAULT_ROLE = "ADMIN"

# Verbs by order of preference, and name or path hints by order of trial.
VERB_PREFERENCE = ["POST", "PUT", "DELETE", "PATCH", "GET"]
VERB_HINTS = {
    "DELETE": ["delete", "remove", "destroy", "trash", "erase", "unlink"],
    "PUT": ["update", "edit", "modify", "replace", "put"],
    "PATCH": ["patch", "toggle", "enable", "disable", "activate", "deactivate"],
    "POST": [
        "create",
        "add",
        "new",
        "save",
        "store",
        "submit",
        "send",
        "post",
        "register",
        "ajout",
        "ajouter",
        "creer",
        "creation",
        "valider",
        "soumettre",
        "publier",
        "envoyer",
    ],
}


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def resolve_route(route: Column) -> Column:
    """Each `{param}` replaced by a realistic value.

    The route is read as runs of plain text and parameters, in order.
    """
    pieces = F.regexp_extract_all(route, F.lit(r"(?U)(\{\w+\}|[^{]+|\{)"), 1)
    name = lambda p: F.lower(F.regexp_extract(p, r"(?U)^\{(\w+)\}$", 1))
    value = lambda n: F.coalesce(F.try_element_at(literal_map(PARAM_DEFAULTS), n), F.lit(OTHER_PARAM))
    resolved = F.transform(pieces, lambda p: let(name(p), lambda n: F.when(n == "", p).otherwise(value(n))))
    return F.array_join(resolved, "")


def bogus_route(route: Column) -> Column:
    """Each `{param}` replaced by an identifier that does not exist."""
    return F.regexp_replace(route, r"\{[^}]+\}", BOGUS_ID)


def has_param(route: Column) -> Column:
    return route.contains("{")


def role_key(role: Column, mapping: Mapping[str, str]) -> Column:
    """Factory key of a role; unmapped roles pass through."""
    if not mapping:
        return role
    return F.coalesce(F.try_element_at(literal_map(mapping), role), role)


def parse_role_map(text: str) -> dict[str, str]:
    """`ROLE_A:KEY_A,ROLE_B:KEY_B` as a mapping."""
    pairs = [pair.split(":", 1) for pair in text.split(",") if ":" in pair]
    return {source.strip(): target.strip() for source, target in pairs}


def role_label(key: Column) -> Column:
    """Key without `ROLE_`, each run of letters capitalised."""
    runs = F.regexp_extract_all(F.replace(key, F.lit("ROLE_"), F.lit("")), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 20)))), "")


def declared_verb(content: Column) -> Column:
    """Preferred verb of the declared list, else its first entry, else null."""
    listed = chunk_text.extract(content, chunk_text.HTTP_VERBS)
    verbs = F.filter(F.transform(F.split(listed, ","), strip_space), lambda v: v != "")
    preferred = lambda given: F.array_intersect(F.array(*map(F.lit, VERB_PREFERENCE)), given)
    return let(verbs, lambda given: F.coalesce(F.get(preferred(given), F.lit(0)), F.get(given, F.lit(0))))


def marker_verb(content: Column) -> Column:
    """Verb noted from the body, else POST where a form is noted."""
    noted = chunk_text.extract(content, chunk_text.BODY_VERB)
    return F.coalesce(
        noted, F.when(content.contains("Formulaire:") | content.contains("→ Formulaire"), "POST")
    )


def hinted_verb(method_name: Column, route: Column) -> Column:
    """Verb hinted by the start of the method name or by the route, in order of trial."""
    name, path = F.lower(method_name), F.lower(route)
    verb = F.lit(None).cast("string")
    for candidate, hints in reversed(VERB_HINTS.items()):
        words = "|".join(hints)
        verb = F.when(name.rlike(f"^(?:{words})") | path.rlike(f"/(?:{words})|(?:{words})$"), candidate).otherwise(verb)
    return verb


def http_verb(content: Column, method_name: Column, route: Column) -> Column:
    """Verb to test a route with: declared, noted, hinted, else GET."""
    return F.coalesce(
        declared_verb(content), marker_verb(content), hinted_verb(method_name, route), F.lit("GET")
    )


def method_role(content: Column, class_role: Column) -> Column:
    return F.coalesce(none_if_empty(chunk_text.extract(content, chunk_text.METHOD_ROLE)), class_role)


def first_class_role(content: Column) -> Column:
    """First role of a class-roles line, or null."""
    return strip_space(F.get(F.split(chunk_text.extract(content, chunk_text.CLASS_ROLES), ","), F.lit(0)))


def anchor_segment(route: Column) -> Column:
    """The longest path segment that every text with the route has between two slashes; null if there is none."""
    whole = lambda part: F.slice(F.split(part, "/"), F.lit(2), F.greatest(F.size(F.split(part, "/")) - 2, F.lit(0)))
    segments = F.flatten(F.transform(F.split(route, r"\{[^}]+\}"), whole))
    named = F.filter(segments, lambda x: x != "")
    return F.array_max(F.transform(named, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]


def coverage_pattern(route: Column) -> Column:
    """Pattern that finds a route in code, any value standing for a parameter."""
    parts = F.split(route, r"\{[^}]+\}")
    quoted = F.transform(
        parts, lambda p: F.when(p == "", p).otherwise(F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))
    )
    return F.array_join(quoted, r"[^'\"\s]+")
