"""Scenarios to test files.

A file is an ordered list of segments, one row each, sorted and joined in bounded slots; the
file of a class is its slots in order, one value of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskscope.functions import chunk_text
from riskscope.functions.code import strip_space
from riskscope.functions.commits import safe_name
from riskscope.plans.settings import AppSettings
from riskscope.scaling import checked_position

# Positions that are sorted together.
SLOT = 1 << 16

# Types that are not business entities.
NON_ENTITY_TYPES = [
    "Request",
    "Response",
    "Session",
    "ContainerInterface",
    "EntityManagerInterface",
    "EntityManager",
    "ManagerRegistry",
    "FormFactoryInterface",
    "RouterInterface",
    "TranslatorInterface",
    "LoggerInterface",
    "EventDispatcherInterface",
    "ParameterBagInterface",
    "DataTableQuery",
    "Security",
    "TokenStorageInterface",
    "AuthorizationCheckerInterface",
    "FormView",
    "FormBuilderInterface",
    "string",
    "int",
    "float",
    "bool",
    "array",
    "object",
    "mixed",
    "Yaml",
    "AbstractController",
]


def test_class_name(class_name: Column) -> Column:
    return safe_name(F.concat(class_name, F.lit("Test")))


def file_header(name: Column, s: AppSettings = AppSettings()) -> Column:
    """Opening of a test class up to its first method. The lines of the generated file."""
    before, after = f"""<?php

namespace App\\Tests\\Functional\\Controller;

use {s.test_class};
use {s.user_class};
use Symfony\\Bundle\\FrameworkBundle\\KernelBrowser;
use Symfony\\Bundle\\FrameworkBundle\\Test\\WebTestCase;
use Symfony\\Component\\HttpFoundation\\Response;

final class % extends WebTestCase
{{
    protected KernelBrowser $client;
    private {s.factory} $testUserFactory;

    protected function setUp(): void
    {{
        $this->client = self::createClient();
        $this->testUserFactory = $this->client->getContainer()->get({s.factory}::class);
    }}

    private function getTestUser(string $key): {s.user}
    {{
        return $this->testUserFactory->create($key);
    }}
""".split("%")
    return F.concat(F.lit(before), name, F.lit(after))


FILE_FOOTER = "\n}\n"


def scenario_method(comment: Column, func_name: Column, body: Column) -> Column:
    """A scenario as a test method."""
    lines = F.array_join(F.transform(body, lambda line: F.concat(F.lit("        "), line)), "\n")
    return F.concat(
        F.when(F.coalesce(comment, F.lit("")) != "", F.concat(F.lit("    /** "), comment, F.lit(" */\n"))).otherwise(""),
        F.lit("    public function "), func_name, F.lit("(): void\n    {\n"), lines, F.lit("\n    }"),
    )


def file_segments(
    classes: DataFrame, scenarios: DataFrame, unrouted: DataFrame, key: str = "class_name", settings: AppSettings = AppSettings()
) -> DataFrame:
    """(key, last_pos, section, pos, part, text): everything a file is made of, in order.

    Sections: 0 header, 1 names of unrouted methods, 2 end of header, 3 methods, 4 footer.
    `classes` are class settings; `scenarios` and `unrouted` carry `last_pos` and the place
    of the first of their kind, which alone has no separator before it.
    """
    text_row = lambda section, text: F.struct(
        F.lit(section).alias("section"), F.lit(0).cast("long").alias("pos"), text.alias("text")
    )
    mention = F.col("first_unrouted").isNotNull()
    frame = F.array(
        text_row(
            0,
            F.concat(
                file_header(test_class_name(F.col(key)), settings),
                F.when(mention, "\n    // Méthodes sans route HTTP (non testées ici) : ").otherwise(""),
            ),
        ),
        text_row(2, F.when(mention, F.lit("\n\n")).otherwise("\n")),
        text_row(4, F.lit(FILE_FOOTER)),
    )
    around = classes.select(key, "last_pos", F.explode(frame).alias("s")).select(
        key, "last_pos", "s.section", "s.pos", F.lit(0).alias("part"), "s.text"
    )
    separated = lambda first, separator, text: F.concat(F.when(first, "").otherwise(separator), text)
    names = unrouted.select(
        key,
        "last_pos",
        F.lit(1).alias("section"),
        F.col("pos").cast("long").alias("pos"),
        F.lit(0).alias("part"),
        separated(F.col("pos") == F.col("first_unrouted"), ", ", F.col("method_name")).alias("text"),
    )
    is_first = (F.col("pos") == F.col("first_route")) & (F.col("scenario_no") == 0)
    methods = scenarios.select(
        key,
        "last_pos",
        F.lit(3).alias("section"),
        F.col("pos").cast("long").alias("pos"),
        F.col("scenario_no").alias("part"),
        separated(
            is_first, "\n\n", scenario_method(F.col("comment"), F.col("func_name"), F.col("body"))
        ).alias("text"),
    )
    return around.unionByName(names).unionByName(methods)


def join_segments(segments: DataFrame, key: str = "class_name", slot: int = SLOT) -> DataFrame:
    """(key, text): the segments of a file joined in order, one row per file.

    Positions are unique in a class, so a slot of them holds a bounded number of segments:
    slots are sorted and joined first, and the file is the slots in order.
    """
    sliced = segments.withColumn("slot", F.struct("section", F.floor(F.col("pos") / F.lit(slot)).alias("at")))
    slots = sliced.groupBy(key, "slot").agg(
        F.expr("listagg(text, '') WITHIN GROUP (ORDER BY pos, part)").alias("text")
    )
    return slots.groupBy(key).agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY slot)").alias("text"))


def entity_type_counts(chunks: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """(keys…, entity_type, n): entity types in parameter lists, technical types left out."""
    blobs = F.regexp_extract_all(content, F.lit(chunk_text.PARAMS_LINE), 1)
    parts = F.flatten(F.transform(blobs, lambda b: F.split(b, ",")))
    words = F.transform(parts, lambda p: F.split(strip_space(p), r"(?U)\s+"))
    typed = F.filter(words, lambda w: F.size(w) >= 2)
    types = F.transform(typed, lambda w: F.regexp_replace(F.get(w, F.lit(0)), r"^[?\\]+", ""))
    kept = F.filter(
        types,
        lambda t: t.rlike(r"^\p{Lu}")
        & ~F.array_contains(F.array(*map(F.lit, NON_ENTITY_TYPES)), t)
        & ~t.rlike(r"(?:Service|Manager|Repository|Type)$"),
    )
    return (
        chunks.select(*keys, F.explode_outer(kept).alias("entity_type"))
        .where(F.col("entity_type").isNotNull())
        .groupBy(*keys, "entity_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fixture_segments(counts: DataFrame, key: str = "class_name") -> DataFrame:
    """(key, entity_type, place, use_line, stub): the parts of a fixture file, by falling frequency."""
    t = F.col("entity_type")
    var = F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 20))
    stub = F.concat(
        F.lit("        // TODO: créer une instance de "), t, F.lit(" pour les tests\n        // $"), var, F.lit(" = new "), t,
        F.lit("();\n        // $manager->persist($"), var, F.lit(");\n        // $this->addReference('"), F.lower(t),
        F.lit("_test_1', $"), var, F.lit(");"),
    )
    ranked = checked_position(counts.withColumn("__rank", -F.col("n")), [key], ["__rank", "entity_type"], "place")
    return ranked.select(
        key, "entity_type", "place", F.concat(F.lit("// use App\\Entity\\"), t, F.lit(";")).alias("use_line"), stub.alias("stub")
    )


def fixture_files(segments: DataFrame, key: str = "class_name") -> DataFrame:
    """(key, text): the fixture skeleton of each class."""
    name = test_class_name(F.col(key))
    lists = segments.groupBy(key).agg(
        F.expr("listagg(use_line, '\n') WITHIN GROUP (ORDER BY place)").alias("uses"),
        F.expr("listagg(stub, '\n\n') WITHIN GROUP (ORDER BY place)").alias("stubs"),
    )
    text = F.concat(
        F.lit("<?php\n\nnamespace App\\Tests\\Functional\\Fixtures;\n\n"), F.col("uses"),
        F.lit(
            "\nuse Doctrine\\Bundle\\FixturesBundle\\Fixture;\nuse Doctrine\\Persistence\\ObjectManager;\n\n"
            "/**\n * Fixtures squelette auto-générées pour "
        ), name,
        F.lit(
            ".\n *\n * À COMPLÉTER : décommente les stubs ci-dessous et ajuste les setters\n"
            " * aux contraintes de ton domaine. Les tests utilisent par défaut id=1\n"
            " * pour les paramètres de route.\n *\n"
            " * Activation dans config/packages/test/doctrine.yaml :\n *   doctrine:\n *     dbal:\n"
            " *       url: 'sqlite:///:memory:'\n *\n * Chargement avant chaque test :\n"
            " *   php bin/console doctrine:fixtures:load --env=test --no-interaction\n */\nfinal class "
        ), name,
        F.lit("Fixtures extends Fixture\n{\n    public function load(ObjectManager $manager): void\n    {\n"), F.col("stubs"),
        F.lit("\n\n        $manager->flush();\n    }\n}\n"),
    )
    return lists.select(key, text.alias("text"))
