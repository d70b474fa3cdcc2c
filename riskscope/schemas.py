"""Table layouts and feature sets."""

from __future__ import annotations

from pyspark.sql import types as T

IDENTITY_COLUMNS = ["file", "class", "method", "profile"]
LABEL_COLUMN = "label_risk"

# The feature columns of the dataset, in order.
FEATURE_COLUMNS = [
    "nb_routes_method",
    "has_route_attr",
    "nb_params",
    "has_form",
    "is_ajax_only",
    "nb_voter_checks",
    "nb_response_types",
    "has_render",
    "has_redirect",
    "has_json",
    "has_file_download",
    "nb_method_grants",
    "nb_class_grants",
    "nb_constructor_deps",
    "nb_methods_in_class",
    "is_invoke",
    "file_loc",
    "method_loc",
    "cyclomatic_complexity",
    "git_bugfix_count",
    "git_total_commits",
    "git_nb_authors",
    "git_days_since_change",
]

# Columns computed from the window that also defines the label.
LABEL_SOURCE = "git_bugfix_count"
TOTAL_COMMITS = "git_total_commits"
WINDOW_FEATURES = ["git_nb_authors", "git_days_since_change"]
LEAKY_COLUMNS = [LABEL_SOURCE, TOTAL_COMMITS, *WINDOW_FEATURES]

# Columns that profiling showed to be constant or redundant.
REDUNDANT_FEATURES = [
    "is_invoke",
    "nb_voter_checks",
    "has_file_download",
    "has_route_attr",
    "file_loc",
    "cyclomatic_complexity",
]

# Grouping of the features by kind.
BINARY_FEATURES = [
    "has_route_attr",
    "has_form",
    "is_ajax_only",
    "has_render",
    "has_redirect",
    "has_json",
    "has_file_download",
    "is_invoke",
]
CONTINUOUS_FEATURES = [
    "file_loc",
    "method_loc",
    "cyclomatic_complexity",
    "nb_params",
    "nb_constructor_deps",
    "nb_methods_in_class",
    "nb_routes_method",
    "nb_voter_checks",
    "nb_response_types",
    "nb_method_grants",
    "nb_class_grants",
    "git_nb_authors",
    "git_days_since_change",
]

FEATURES_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in IDENTITY_COLUMNS]
    + [T.StructField(c, T.LongType()) for c in FEATURE_COLUMNS[:-1]]
    + [T.StructField(FEATURE_COLUMNS[-1], T.DoubleType()), T.StructField(LABEL_COLUMN, T.IntegerType())]
)

CLASS_FACTS_SCHEMA = """
    file string,
    content string,
    class_name string,
    class_attributes array<struct<name: string, args: array<struct<name: string, value: variant>>>>,
    class_docblock string,
    methods array<struct<
        name: string,
        attributes: array<struct<name: string, args: array<struct<name: string, value: variant>>>>,
        params: array<struct<name: string, type: string, has_default: boolean>>,
        return_type: string,
        docblock: string,
        body: string>>
"""

CHUNKS_SCHEMA = """
    chunk_id string, chunk_type string, file_path string, class_name string,
    content string, embedding array<float>, project_id string
"""

EXAMPLES_SCHEMA = "demande_utilisateur string, contexte_pertinent array<string>, test_ideal string"

STREAM_LINE_SCHEMA = "response string, done boolean, done_reason string, eval_count long"
