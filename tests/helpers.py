"""Evaluate Column functions over literal rows."""


def column(spark, rows, schema, build):
    """Values of build() over the rows, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {schema}")
    return [r.v for r in df.select("i", build().alias("v")).orderBy("i").collect()]
