"""Expressions over page templates: titles, headings, tabs, links, buttons, fields, ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskscope.functions.code import strip_space

# Patterns over template text.
PAGE_TITLE = r"(?i)\{%[-\s]*set\s+page_title\s*=\s*['\"]([^'\"]+)['\"]"
HEADING = r"(?is)<h[123][^>]*>(.*?)</h[123]>"
BUTTON = r"(?is)<(?:button|a)[^>]*>(.*?)</(?:button|a)>"
NAV_LINK = (
    r"(?iU)class=\"[^\"]*nav-link[^\"]*\"[^>]*>\s*"
    r"([\w\s\-/()'.àâäéèêëîïôöùûüçÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ]+)"
)
LINK = r"path\(['\"]([^'\"]+)['\"]"
INPUT_NAME = r"(?i)<(?:input|select|textarea)\b[^>]*\bname=['\"]([^'\"]+)['\"]"
HIDDEN_ID = (
    r"(?i)<input\b[^>]*\btype=['\"]hidden['\"][^>]*\bid=['\"]([^'\"]+)['\"]"
    r"|<input\b[^>]*\bid=['\"]([^'\"]+)['\"][^>]*\btype=['\"]hidden['\"]"
)
TABLE_ID = r"(?i)<table\b[^>]*\bid=['\"]([^'\"]+)['\"]"
INCLUDE = r"include\(['\"]([^'\"]+)['\"]"
MARKUP = r"(?d)\{%.*?%\}|\{\{.*?\}\}|<.*?>"
TAGS = r"(?d)<.*?>"

# How many items of each family a description keeps.
MAX_ITEMS = 10
MAX_SECONDARY = 5


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), group)


def page_titles(html: Column) -> Column:
    return _all(html, PAGE_TITLE)


def headings(html: Column) -> Column:
    """Text of h1 to h3 without template markup and tags; empty ones dropped."""
    texts = F.transform(_all(html, HEADING), lambda h: strip_space(F.regexp_replace(h, MARKUP, "")))
    return F.filter(texts, lambda h: h != "")


def nav_tabs(html: Column) -> Column:
    return F.filter(F.transform(_all(html, NAV_LINK), strip_space), lambda t: F.length(t) > 2)


def links(html: Column) -> Column:
    """Distinct route names, sorted."""
    return F.array_sort(F.array_distinct(_all(html, LINK)))


def buttons(html: Column) -> Column:
    """Distinct button and anchor texts in order of appearance; tabs, markup and one-letter texts left out."""
    tabs = nav_tabs(html)
    texts = F.transform(_all(html, BUTTON), lambda b: strip_space(F.regexp_replace(b, TAGS, "")))
    kept = F.filter(
        texts, lambda b: ~b.startswith("{") & (F.length(b) > 1) & ~F.array_contains(tabs, b)
    )
    return F.array_distinct(kept)


def hidden_ids(html: Column) -> Column:
    either = F.arrays_zip(_all(html, HIDDEN_ID, 1), _all(html, HIDDEN_ID, 2))
    return F.transform(either, lambda p: F.when(p["0"] != "", p["0"]).otherwise(p["1"]))


def template_facts(html: Column) -> Column:
    """All facts of a template as one struct."""
    return F.struct(
        page_titles(html).alias("page_titles"),
        headings(html).alias("headings"),
        nav_tabs(html).alias("nav_tabs"),
        links(html).alias("links"),
        buttons(html).alias("buttons"),
        _all(html, INPUT_NAME).alias("inputs"),
        hidden_ids(html).alias("hidden_ids"),
        _all(html, TABLE_ID).alias("table_ids"),
        _all(html, INCLUDE).alias("includes"),
    )


def heading_list(facts: Column) -> Column:
    """Page titles, then headings."""
    return F.concat(facts["page_titles"], facts["headings"])


def _sentence(label: str, items: Column, cap: int | None = None) -> Column:
    shown = F.slice(items, 1, cap) if cap else items
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{label} : "), F.array_join(shown, ", "), F.lit(".")))


def description(file: Column, facts: Column) -> Column:
    """Description of a template with capped lists."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("Le template "), file, F.lit(".")),
        _sentence("Titre de page", facts["page_titles"]),
        _sentence("Sections", facts["headings"]),
        _sentence("Onglets", facts["nav_tabs"], MAX_ITEMS),
        _sentence("Boutons", facts["buttons"], MAX_ITEMS),
        _sentence("IDs cachés", facts["hidden_ids"], MAX_ITEMS),
        _sentence("IDs tables", facts["table_ids"], MAX_SECONDARY),
        _sentence("Routes Twig", facts["links"], MAX_ITEMS),
        _sentence("Champs formulaire", facts["inputs"], MAX_ITEMS),
        _sentence("Inclut", facts["includes"], MAX_SECONDARY),
    )


def index_text(file: Column, facts: Column) -> Column:
    """The text of a template that is indexed; lists are whole."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("Le template "), file, F.lit(".")),
        _sentence("Titres H1", heading_list(facts)),
        _sentence("Boutons/Liens", facts["buttons"]),
        _sentence("IDs éléments cachés", facts["hidden_ids"]),
        _sentence("Routes liées", facts["links"]),
        _sentence("Champs de formulaire (name)", facts["inputs"]),
    )
