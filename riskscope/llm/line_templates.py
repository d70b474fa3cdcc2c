"""Line dedup with a log-template tree.

Every line goes down a tree of fixed depth: the number of its tokens, then its leading
tokens, with tokens that hold a digit generalised at once. The leaf is a hash of that path.
Inside a leaf a token is constant at its position if the lines of `min_docs` documents have
it there, and a variable field otherwise; the line with its fields masked is its template.
A template is recurring if `min_docs` documents hold it and at least 80 percent of its tokens
are constant. Recurring lines go, except in the document of smallest id that holds the
template, so nothing disappears from the corpus.

With `whole_fields`, as the query and the pipeline call it, tokens that hold a digit match at
their place like constants, so the share limits only the fields found by counting, and a
masked line that `min_docs` documents hold is recurring however many fields it has. A line of
nothing but such tokens has no template and is compared as it stands, or all rows of figures
would be one. Without it, these tokens count against the share.

All of it is counting: documents fold their own repeats first, leaves that too few lines
reach are dropped before any token is looked at, and counts are combined before the shuffle.
No leaf or template is gathered in a task. Lines are masked once. A hash of the line as it
stands names it afterwards: one line of each masked form is looked up for its tokens, and the
lines to drop are found in the texts by their hashes.

Defined cases: a null text has no lines; blank lines are kept and never counted; lines that
differ in white space or fields only are one; texts of any length are read whole, and a long line
is one row like any other; repeated rows of one id count as one document
and are filtered alike; a null id takes part in the counts of documents as one document and
keeps no first copy; further columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskscope.scaling import join_on
from riskscope.session import materialise, release

MIN_DOCS = 10
LEADING = 3
MIN_SHARE = 80
FIELD = "<*>"
# Leaf hashes that may be shipped to every task: 8 bytes each, 16 MB.
SHIPPED_LEAVES = 2_000_000
#: A whole token with a digit; the look-behind keeps the search linear in the token.
_WITH_DIGIT = r"(?<!\S)[^\s\d]*+\d\S*"
#: The same, after a line (group 1) of nothing but such tokens.
_FIELDS_ONLY = r"^([^\s\d]*+\d\S*+(?: [^\s\d]*+\d\S*+)*+)$|" + _WITH_DIGIT
_WORDED_LINE = r"(?md)^[ \t\x0B\f\r]*+\S"


def masked(line: Column, whole_fields: bool = False) -> Column:
    """The line with single spaces and tokens that hold a digit replaced by the field mark."""
    plain = F.trim(F.regexp_replace(line, r"\s+", " "))
    if whole_fields:
        # A line of fields only stays, with the mark at its end; elsewhere group 1 is empty.
        return F.regexp_replace(plain, _FIELDS_ONLY, "$1" + FIELD)
    return F.regexp_replace(plain, _WITH_DIGIT, FIELD)


def masked_lines(text: Column, whole_fields: bool = False) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda line: masked(line, whole_fields))


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), *[F.get(tokens, F.lit(i)) for i in range(LEADING)])


def recurring_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, whole_fields: bool = False
) -> DataFrame:
    """(doc_id, raw_hash, line_hash, template_hash) of the lines to drop, by document."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.explode(F.array_distinct(F.split(body, "\n", -1))).alias("raw"))
    own = F.struct(F.col("raw"), masked(F.col("raw"), whole_fields).alias("line"))
    # The pair is bound by an array of one, so that the line is masked once.
    hashed = lines.select("doc_id", F.explode(F.array(own)).alias("e")).where("e.line <> ''").select(
        "doc_id", F.xxhash64("e.raw").alias("raw_hash"), F.xxhash64("e.line").alias("line_hash"), _leaf(F.split("e.line", " ")).alias("leaf")
    )
    narrow = materialise(hashed)
    # Lines that differ in fields only count more than once here, which lets no recurring line go.
    reached = narrow.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_lines"))
    live = materialise(reached.where(F.col("n_lines") >= min_docs).select("leaf"))
    # Few leaves are reached often. Their hashes are shipped while they are few, and shuffled beyond that.
    shipped = F.broadcast(live) if live.count() <= SHIPPED_LEAVES else live
    written = materialise(narrow.join(shipped, "leaf", "left_semi").distinct())
    placed = written.select("doc_id", "line_hash", "leaf").distinct()
    counted = placed.groupBy("leaf", "line_hash").agg(F.count(F.lit(1)).alias("n_docs"))
    # One line of each masked form of a live leaf, found by its hash and masked again.
    chosen = materialise(written.groupBy("line_hash").agg(F.min("raw_hash").alias("raw_hash")))
    few = F.broadcast(chosen) if chosen.count() <= SHIPPED_LEAVES else chosen
    found = lines.select("raw", F.xxhash64("raw").alias("raw_hash")).join(few, "raw_hash").dropDuplicates(["raw_hash"])
    known = counted.join(found.select("line_hash", masked(F.col("raw"), whole_fields).alias("line")), "line_hash")
    slots = known.select("leaf", "line_hash", "n_docs", F.posexplode(F.split("line", " ")).alias("slot", "token"))
    slots = materialise(slots.withColumn("token", F.when(F.col("token") != FIELD, F.xxhash64("token"))))
    constant = (
        slots.where(F.col("token").isNotNull())
        .groupBy("leaf", "slot", "token")
        .agg(F.sum("n_docs").alias("__docs"))
        .where(F.col("__docs") >= min_docs)
        .select("leaf", "slot", "token", F.lit(True).alias("constant"))
    )
    # A template is the set of its constants; an order-free sum of mixed slots stands for it.
    part = F.when(F.col("constant"), F.xxhash64("slot", "token").cast("decimal(38,0)"))
    matching = F.coalesce("constant", F.col("token").isNull()) if whole_fields else F.col("constant")
    matching = F.when(matching, True)
    templates = (
        slots.join(constant, ["leaf", "slot", "token"], "left")
        .groupBy("leaf", "line_hash")
        .agg(F.sum(part).alias("__sum"), F.count(matching).alias("n_constant"), F.count(F.lit(1)).alias("n_tokens"))
        .where(F.lit(100) * F.col("n_constant") >= F.lit(MIN_SHARE) * F.col("n_tokens"))
        .select("line_hash", F.xxhash64("leaf", F.col("__sum").cast("string")).alias("template_hash"))
    )
    templates = materialise(templates)
    held = materialise(placed.join(templates, "line_hash").select("doc_id", "line_hash", "template_hash"))
    recurring = materialise(
        held.select("doc_id", "template_hash")
        .distinct()
        .groupBy("template_hash")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
        .where(F.col("n_docs") >= min_docs)
    )
    # Common templates are few; shipped, their copies do not meet in one task.
    common = F.broadcast(recurring) if recurring.count() <= SHIPPED_LEAVES else recurring
    gone = held.join(common, "template_hash").where(
        F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_doc")) | F.col("first_doc").isNull()
    ).select("doc_id", "line_hash", "template_hash")
    dropped = join_on(written.select("doc_id", "line_hash", "raw_hash"), gone, ["doc_id", "line_hash"])
    dropped = materialise(dropped.select("doc_id", "raw_hash", "line_hash", "template_hash"))
    release(narrow, live, written, chosen, slots, templates, held, recurring)
    return dropped


def drop_recurring_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, whole_fields: bool = False
) -> DataFrame:
    """The rows of `docs` with recurring lines taken out of the text, and `__n_lines`, `__n_dropped`."""
    gone = recurring_lines(docs, id_column, text, min_docs, whole_fields).groupBy(F.col("doc_id").alias("__id")).agg(
        F.collect_set("raw_hash").alias("__gone")
    ).hint("shuffle_hash")
    body = F.col(f"`{text}`").cast("string")
    joined = docs.join(gone, F.col(f"`{id_column}`").eqNullSafe(F.col("__id")), "left")
    lines = F.split(body, "\n", -1)
    stays = F.filter(lines, lambda line: ~F.array_contains("__gone", F.xxhash64(line)))
    kept = F.when(F.col("__gone").isNull() | body.isNull(), F.array(body)).otherwise(stays)
    marked = joined.withColumn("__kept", kept)
    out = F.array_join("__kept", "\n")
    n_lines = F.when(body.isNull(), 0).otherwise(F.regexp_count(body, F.lit(_WORDED_LINE))).cast("long")
    columns = [
        (F.when(body.isNull(), body).otherwise(out) if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns
    ]
    dropped = F.when(F.col("__gone").isNull() | body.isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long")
    return marked.select(*columns, n_lines.alias("__n_lines"), dropped.alias("__n_dropped"))


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, whole_fields: bool = False
) -> DataFrame:
    """The documents with recurring lines taken out of the text, with their own columns."""
    found = drop_recurring_lines(docs, id_column, text, min_docs, whole_fields)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
