"""Control tokens and scan rules."""

import pytest
from pyspark.sql import functions as F

from helpers import evaluate
from riskscope.functions import safety
from riskscope.operators.safety_scan import finding_rows, scan


def scan_one(spark, body, **options):
    text = f"<?php\nclass T {{\n    public function testX(): void\n    {{\n        {body}\n    }}\n}}\n"
    return scan(spark.createDataFrame([(text,)], "code string"), "code", **options).head()


@pytest.mark.parametrize(
    "body",
    [
        "shell_exec('curl http://x');",
        "system('rm -rf /');",
        "passthru($cmd);",
        "eval('$x = 1;');",
        "unserialize($payload);",
        "curl_exec($ch);",
        "file_get_contents('http://evil/');",
        "unlink('/etc/passwd');",
        "file_put_contents('/tmp/x', $data);",
        "$x = `id -a`;",
        "include $file;",
    ],
)
def test_blocking(spark, body):
    row = scan_one(spark, body)
    assert not row.is_safe and row.findings[0]["line"] == 5 and row.findings[0]["excerpt"] == body


@pytest.mark.parametrize(
    "body",
    [
        "// shell_exec('x')",
        "/* eval('x') unlink(1) */ $a = 1;",
        "$this->client->request('GET', '/foo');",
        "$this->markTestIncomplete('à écrire');",
        "$this->system($x);",
        "// TODO: génération échouée",
    ],
)
def test_safe(spark, body):
    assert scan_one(spark, body).is_safe


def test_warning_does_not_block(spark):
    row = scan_one(spark, "ini_set('a', 1); exit(1);")
    assert row.is_safe and [f["rule"] for f in row.findings] == ["modif_env", "sortie_directe"]


def test_line_numbers(spark):
    body = "/* a\nb */ unlink(1);"
    assert scan_one(spark, body).findings[0]["line"] == 6
    assert scan_one(spark, body, keep_lines=False).findings[0]["line"] == 5


def test_rows_and_sentence(spark):
    df = spark.createDataFrame([(1, "exec('a'); unlink('b');")], "id int, code string")
    found = scan(df, "code")
    assert finding_rows(found, ["id"]).count() == 2
    sentence = found.select(safety.format_findings(F.col("findings"))).head()[0]
    assert sentence.startswith("ligne 1 : exécution de commande système (`exec('a')") and " ; ligne 1 : " in sentence


def test_neutralise(spark):
    for token in safety.CONTROL_TOKENS:
        out = evaluate(spark, safety.neutralise, f"a {token} b")
        assert token not in out and out.startswith("a ") and len(out) == len(token) + 4
    plain = "Méthode 'index' — Route: /foo/{id} — Type: render (200) [x] <b>"
    assert evaluate(spark, safety.neutralise, plain) == plain


def test_a_rule_with_negated_classes(spark):
    rule = safety.Rule("own", r"foo\(\D+\)", "own")
    df = spark.createDataFrame([("foo(ABC)",), ("foo(1)",)], "code string")
    found = df.select("code", F.size(safety.findings(F.col("code"), [rule])).alias("n")).collect()
    assert {r.code: r.n for r in found} == {"foo(ABC)": 1, "foo(1)": 0}
