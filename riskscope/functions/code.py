"""Expressions over source text: size, complexity, balanced blocks, comments, body signals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskscope.functions.binding import let

# Words and signs that add one to the cyclomatic complexity.
COMPLEXITY_WORDS = ["if", "elseif", r"else\s+if", "while", "for", "foreach", "case", "catch"]
COMPLEXITY_SIGNS = ["&&", r"\|\|", r"\?"]
# One word boundary test for all words, so most positions fail at once.
COMPLEXITY = r"(?U)\b(?:" + "|".join(COMPLEXITY_WORDS) + r")\b|" + "|".join(COMPLEXITY_SIGNS)

# Patterns looked for in a method body.
RENDER = r"->render\(['\"]([^'\"]+)['\"]"
REDIRECT = r"(?i)\$this->redirect\(|RedirectResponse|->redirectToRoute\("
JSON_RESPONSE = r"(?i)JsonResponse|->json\("
EXPORT_RESPONSE = r"(?i)ExportResponse|CsvResponse|XlsResponse"
FILE_DOWNLOAD = r"(?id)Content-Disposition.*attachment|file_get_contents|readfile\("
BINARY_RESPONSE = r"(?i)BinaryFileResponse|StreamedResponse"
AJAX_CHECK = r"(?i)\bisXmlHttpRequest\(\)"
FORM_CREATE = r"(?i)\$this->createForm\(\s*([A-Za-z0-9_\\]+)::class"
FORM_HANDLE = r"(?i)->handleRequest\(|->isSubmitted\(\)"
DENY_ACCESS = (
    r"(?i)\$this->denyAccessUnlessGranted\(\s*['\"]([^'\"]+)['\"](?:\s*,\s*\$([a-zA-Z_]+))?"
)
IS_METHOD = r"(?i)\$request->isMethod\(\s*['\"]{verb}['\"]\s*\)"
READS_BODY = r"\$request->request->(?:get|all|has)\("
READS_QUERY = r"\$request->query->(?:get|all|has)\("
READS_FILES = r"\$request->files->(?:get|all|has)\("

# Response types in reporting order.
RESPONSE_TYPES = [
    ("render (200)", RENDER),
    ("redirect (302)", REDIRECT),
    ("json (200)", JSON_RESPONSE),
    ("export (200)", EXPORT_RESPONSE),
    ("file_download (200)", FILE_DOWNLOAD),
    ("binary (200)", BINARY_RESPONSE),
]

# One token per string, comment, brace or run of other text; every character is in a token.
# Loops are possessive so that long literals do not recurse; an unclosed string or comment
# runs to the end of the text.
TOKEN = (
    r"(?s)('(?:[^'\\]++|\\(?:.|\z))*+(?:'|\z)"
    r'|"(?:[^"\\]++|\\(?:.|\z))*+(?:"|\z)'
    r"|//[^\n]*+|#[^\n]*+|/\*.*?(?:\*/|\z)|[{}]|[^{}'\"/#]++|.)"
)

CLASS_HEADER = (
    r"(?i:(?:abstract\s+)?(?:class|interface|trait)\s+{name}(?:\s+(?:extends|implements)\s+[^{{]+)?\s*)"
)
METHOD_HEADER = (
    r"(?s:(?:public|protected|private|final|static|abstract)?\s*function\s+{name}\s*\(.*?\)\s*(?::\s*\S+\s*)?)"
)
DATASET_METHOD_HEADER = r"(?:function\s+{name}\s*\([^)]*\)[^{{]*)"
TEST_METHOD = r"(?i:public\s+function\s+(?:test\w+)\s*\()"

PROPERTY = r"(?:private|protected|public)\s+\??([a-zA-Z0-9\\]+)\s+\$([a-zA-Z_\x7f-\xff][a-zA-Z0-9_\x7f-\xff]*)"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def file_loc(text: Column) -> Column:
    """Newlines plus one, also for an empty file."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def body_loc(body: Column) -> Column:
    """Newlines plus one; zero for an empty body."""
    return F.when(body == "", F.lit(0).cast("long")).otherwise(file_loc(body))


def cyclomatic(text: Column) -> Column:
    """One plus the number of branching constructs, on raw text."""
    matches = F.regexp_count(text, F.lit(COMPLEXITY))
    return F.coalesce(matches, F.lit(0)).cast("long") + 1


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("#") | token.startswith("/*")


def strip_comments(code: Column, keep_lines: bool = False) -> Column:
    """Comments outside strings become one space each.

    `keep_lines` also keeps the newlines of block comments, so line numbers stay those of
    the original text.
    """
    kept = F.lit(" ")
    blank = (lambda t: F.concat(kept, F.regexp_replace(t, r"[^\n]+", ""))) if keep_lines else (lambda t: kept)
    return F.array_join(F.transform(tokens(code), lambda t: F.when(is_comment(t), blank(t)).otherwise(t)), "")


def balanced_block(text: Column) -> Column:
    """The balanced `{…}` at the start of `text`, braces in strings and comments not counted.

    One pass over the tokens with the running depth as state; null when never closed.
    """
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("closed_at")
    )

    def step(state: Column, token: Column) -> Column:
        depth = (
            F.when(token == "{", state["depth"] + 1)
            .when(token == "}", state["depth"] - 1)
            .otherwise(state["depth"])
        )
        closes = (token == "}") & (state["depth"] == 1) & (state["closed_at"] == 0)
        return F.struct(
            depth.alias("depth"),
            (state["seen"] + 1).alias("seen"),
            F.when(closes, state["seen"] + 1).otherwise(state["closed_at"]).alias("closed_at"),
        )

    def cut(parts: Column) -> Column:
        closed_at = F.aggregate(parts, start, step)["closed_at"]
        return let(closed_at, lambda n: F.when(n > 0, F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "")))

    return F.when(text.startswith("{"), let(tokens(text), cut))


def header_pattern(template: str, name: Column) -> Column:
    """A header pattern with the symbol name quoted in."""
    before, after = template.format(name="\x00").split("\x00")
    return F.concat(F.lit(before + r"\Q"), name, F.lit(r"\E" + after))


def _extract(text: Column, pattern: Column, group: int) -> Column:
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def block_after(text: Column, header: Column) -> Column:
    """The balanced block opened by the first match of `header` followed by `{`."""
    opened = _extract(text, F.concat(F.lit(r"(?s)\A.*?"), header, F.lit(r"(\{.*)\z")), 1)
    return let(opened, balanced_block)


def symbol_block(text: Column, header: Column) -> Column:
    """Header and balanced block of a symbol, or null."""
    head = _extract(text, F.concat(F.lit("("), header, F.lit(r")\{")), 1)
    return F.concat(head, block_after(text, header))


def class_block(text: Column, class_name: Column) -> Column:
    return symbol_block(text, header_pattern(CLASS_HEADER, class_name))


def method_block(class_text: Column, method_name: Column) -> Column:
    return symbol_block(class_text, header_pattern(METHOD_HEADER, method_name))


def method_body(text: Column, method_name: Column) -> Column:
    """Text between the braces of a method; empty when not found."""
    block = block_after(text, header_pattern(DATASET_METHOD_HEADER, method_name))
    inner = let(block, lambda b: F.substring(b, F.lit(2), F.length(b) - 2))
    return F.coalesce(inner, F.lit(""))


def indent_block(block: Column) -> Column:
    """Each non-blank line moved four spaces to the right."""
    lines = F.transform(
        F.split(block, "\n"),
        lambda line: F.when(strip_space(line) != "", F.concat(F.lit("    "), line)).otherwise(line),
    )
    return F.array_join(lines, "\n")


def test_blocks(text: Column) -> Column:
    """Complete `public function test…(…) {…}` methods of a text, re-indented.

    The text is cut before each test header; within a cut, the block starts at the first
    brace after the header. A brace missing from its cut is looked for in what follows.
    """
    cut = "\ue000"
    marked = F.regexp_replace(F.translate(text, cut, ""), f"({TEST_METHOD})", cut + "$1")

    def block(pieces: Column, i: Column) -> Column:
        def complete(rest: Column) -> Column:
            head = F.regexp_extract(rest, f"(?s)\\A({TEST_METHOD}[^{{]*)\\{{", 1)
            return let(
                head,
                lambda h: F.when(
                    h != "",
                    F.concat(h, balanced_block(F.substring(rest, F.length(h) + 1, F.length(rest)))),
                ),
            )

        # Most blocks close inside their own cut; only others look at what follows.
        own = let(F.get(pieces, i), complete)
        rest = let(F.array_join(F.slice(pieces, i + 1, F.size(pieces)), ""), complete)
        return F.when(i > 0, indent_block(strip_space(F.coalesce(own, rest))))

    blocks = let(F.split(marked, cut), lambda pieces: F.transform(pieces, lambda _, i: block(pieces, i)))
    return F.filter(blocks, lambda b: b.isNotNull())


def test_name(block: Column) -> Column:
    return F.regexp_extract(block, r"(?i)public\s+function\s+(test\w+)\s*\(", 1)


def properties(text: Column) -> Column:
    """array<struct<type, name>> of typed property declarations."""
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(PROPERTY), 1).alias("type"),
        F.regexp_extract_all(text, F.lit(PROPERTY), 2).alias("name"),
    )


def rendered_template(body: Column) -> Column:
    return none_if_empty(F.regexp_extract(body, RENDER, 1))


def response_types(body: Column) -> Column:
    """Response types found in a method body, in reporting order."""
    found = [F.when(body.rlike(pattern), F.lit(name)) for name, pattern in RESPONSE_TYPES]
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def has_form(body: Column) -> Column:
    return body.rlike(FORM_CREATE) | body.rlike(FORM_HANDLE)


def form_type(body: Column) -> Column:
    """Short class name given to `createForm`."""
    return none_if_empty(F.regexp_extract(body, FORM_CREATE.replace(r"([A-Za-z0-9_\\]+)", r"(?:[A-Za-z0-9_\\]*\\)?([A-Za-z0-9_]+)"), 1))


def voter_checks(body: Column) -> Column:
    """array<struct<attribute, subject>> of access checks; subject may be null."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(DENY_ACCESS), 1),
        F.regexp_extract_all(body, F.lit(DENY_ACCESS), 2),
    )
    return F.transform(
        pairs,
        lambda p: F.struct(p["0"].alias("attribute"), none_if_empty(p["1"]).alias("subject")),
    )


def _asks_method(body: Column, verb: str) -> Column:
    return body.rlike(IS_METHOD.replace("{verb}", verb))


def body_verb(body: Column) -> Column:
    """HTTP verb suggested by a body: explicit checks, then body reads, form, uploads."""
    return (
        F.when(_asks_method(body, "POST"), "POST")
        .when(_asks_method(body, "DELETE"), "DELETE")
        .when(_asks_method(body, "PUT"), "PUT")
        .when(body.rlike(READS_BODY) | has_form(body) | body.rlike(READS_FILES), "POST")
    )


def body_reads(body: Column) -> Column:
    """Request parts a body reads."""
    explicit = _asks_method(body, "POST") | _asks_method(body, "DELETE") | _asks_method(body, "PUT")
    found = [
        F.when(~explicit & body.rlike(READS_BODY), "POST data"),
        F.when(body.rlike(READS_QUERY), "query string"),
        F.when(body.rlike(READS_FILES), "uploaded files"),
    ]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def body_signals(body: Column) -> Column:
    """All signals of a method body as one struct."""
    return F.struct(
        rendered_template(body).alias("rendered_template"),
        response_types(body).alias("response_types"),
        body.rlike(AJAX_CHECK).alias("is_ajax_only"),
        has_form(body).alias("has_form"),
        form_type(body).alias("form_type"),
        voter_checks(body).alias("voter_checks"),
        body_verb(body).alias("body_inferred_verb"),
        body_reads(body).alias("body_reads"),
    )
