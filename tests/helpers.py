from pyspark.sql import functions as F


def one(spark, expression, **literals):
    """Value of an expression of literal text columns."""
    row = spark.createDataFrame([tuple(literals.values())], ", ".join(f"{k} string" for k in literals))
    return row.select(expression.alias("v")).head()["v"]


def evaluate(spark, function, text):
    """Value of a one-column function of a text."""
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("v")).head()["v"]


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
