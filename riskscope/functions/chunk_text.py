"""The chunk text grammar: writing chunks from facts and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskscope.functions.code import none_if_empty, strip_space

# How many template items a method chunk repeats.
MAX_HEADINGS = 3
MAX_FIELDS = 8

# Patterns that read a chunk back.
METHOD_NAME = r"Méthode '([^']+)'"
ROUTE = r"(?U)Route:\s*([^\s—\n]+)"
RESPONSE_TYPE = r"(?dU)→ Type de réponse:\s*(.+)"
H1 = r"(?dU)→ H1:\s*(.+)"
HIDDEN_IDS = r"(?dU)→ IDs cachés:\s*(.+)"
CONSTRUCTOR = r"(?U)constructeur injecte\s*:\s*\(([^)]+)\)"
HTTP_VERBS = r"(?dU)→ Verbes HTTP:\s*(.+)"
AJAX_ONLY = "→ AJAX uniquement"
FORM_TYPE = r"(?dU)→ Formulaire:\s*(.+)"
VOTER = r"(?U)→ Voter:\s*denyAccessUnlessGranted\('([^']+)'"
CLASS_ROLES = r"(?dU)→ Rôles classe:\s*(.+)"
METHOD_ROLE = r"(?dU)→ Rôle requis \(méthode\):\s*(.+)"
PROFILE = r"(?U)→ Profil:\s*(\w+)"
NO_ROUTE = "→ Pas de route HTTP"
BODY_VERB = r"(?U)→ Verbe HTTP inféré \(body\):\s*([A-Z]+)"
PARAMS_LINE = r"(?U)Params:\s*\(([^)]*)\)"


def extract(content: Column, pattern: str) -> Column:
    """First capture of a pattern, trimmed; null when the pattern is absent.

    Patterns capture at least one character, so an empty capture means no match.
    """
    return strip_space(none_if_empty(F.regexp_extract(content, pattern, 1)))


def _typed(params: Column, missing: str) -> Column:
    items = F.transform(
        params,
        lambda p: F.concat(
            F.coalesce(none_if_empty(p["type"]), F.lit(missing)), F.lit(" $"), F.coalesce(none_if_empty(p["name"]), F.lit("?"))
        ),
    )
    return F.array_join(items, ", ")


def _optional(condition: Column, *parts: Column) -> Column:
    return F.when(condition, F.concat(*parts)).otherwise("")


def class_text(
    class_name: Column, category: Column, file: Column, constructor_params: Column, profile: Column, class_grants: Column
) -> Column:
    """Text of a class chunk."""
    roles = F.array_join(
        F.transform(class_grants, lambda g: F.coalesce(none_if_empty(g["role"]), F.lit("?"))), ", "
    )
    return F.concat(
        F.lit("La classe PHP "), class_name, F.lit(" (type: "), category, F.lit(") dans "), file, F.lit("."),
        _optional(
            F.size(constructor_params) > 0,
            F.lit(" Son constructeur injecte : ("), _typed(constructor_params, "mixed"), F.lit(")."),
        ),
        _optional(F.coalesce(profile, F.lit("")) != "", F.lit("\n  → Profil: "), profile),
        _optional(F.size(class_grants) > 0, F.lit("\n  → Rôles classe: "), roles),
    )


def _voter_lines(checks: Column) -> Column:
    lines = F.transform(
        checks,
        lambda v: F.concat(
            F.lit("\n  → Voter: denyAccessUnlessGranted('"), v["attribute"], F.lit("'"),
            F.when(v["subject"].isNotNull(), F.concat(F.lit(", $"), v["subject"])).otherwise(""),
            F.lit(")"),
        ),
    )
    return F.array_join(lines, "")


def _lines(label: str, items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit(f"\n  → {label}: "), i)), "")


def _listed(label: str, items: Column, cap: int | None = None) -> Column:
    shown = F.slice(items, 1, cap) if cap else items
    return _optional(F.coalesce(F.size(items), F.lit(0)) > 0, F.lit(f"\n  → {label}: "), F.array_join(shown, ", "))


def method_base(m: Column, class_name: Column) -> Column:
    """Opening line of a method chunk."""
    return F.concat(
        F.lit("Méthode '"), m["name"], F.lit("' ("), class_name, F.lit(")"),
        _optional(m["renders"].isNotNull(), F.lit(" — Template: "), m["renders"]),
        _optional(m["description"].isNotNull(), F.lit(" — "), m["description"]),
        _optional(F.size(m["params"]) > 0, F.lit(" — Params: ("), _typed(m["params"], "?"), F.lit(")")),
    )


def unrouted_text(m: Column, class_name: Column) -> Column:
    """Text of a method without a route."""
    return F.concat(
        method_base(m, class_name),
        F.lit("\n  → Pas de route HTTP (méthode interne)"),
        _voter_lines(m["voter_checks"]),
    )


def route_text(m: Column, class_name: Column, route: Column, headings: Column, inputs: Column, hidden_ids: Column) -> Column:
    """Text of one route of a method; template lists are null without a template."""
    return F.concat(
        method_base(m, class_name),
        F.lit(" — Route: "), route["path"],
        _optional(none_if_empty(route["name"]).isNotNull(), F.lit(" (name: "), route["name"], F.lit(")")),
        _listed("Verbes HTTP", route["http_methods"]),
        _lines(
            "Rôle requis (méthode)",
            F.transform(m["method_grants"], lambda g: F.coalesce(g["role"], F.lit("None"))),
        ),
        _listed("H1", headings, MAX_HEADINGS),
        _listed("Champs formulaire", inputs, MAX_FIELDS),
        _listed("IDs cachés", hidden_ids, MAX_FIELDS),
        _lines("Type de réponse", m["response_types"]),
        _optional(m["is_ajax_only"], F.lit("\n  → AJAX uniquement (isXmlHttpRequest)")),
        _optional(m["has_form"], F.lit("\n  → Formulaire: "), F.coalesce(m["form_type"], F.lit("?"))),
        _optional(
            m["body_inferred_verb"].isNotNull(), F.lit("\n  → Verbe HTTP inféré (body): "), m["body_inferred_verb"]
        ),
        _listed("Lit", m["body_reads"]),
        _voter_lines(m["voter_checks"]),
    )


def response_types(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(RESPONSE_TYPE), 1), strip_space)


def hidden_ids(content: Column) -> Column:
    listed = F.transform(F.split(extract(content, HIDDEN_IDS), ","), strip_space)
    return F.coalesce(listed, F.array().cast("array<string>"))


def first_heading(content: Column) -> Column:
    listed = extract(content, H1)
    return F.coalesce(strip_space(F.get(F.split(listed, ","), F.lit(0))), F.lit(""))
