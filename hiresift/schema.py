"""Schemas of the postings table, of the feed payloads and of the small report tables."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


STR, LONG, DBL, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRS = T.ArrayType(STR)

# A posting as the feeds deliver it.
POSTING = _struct(
    job_id=STR, title=STR, company=STR, description=STR, location=STR, job_type=STR,
    salary_min=DBL, salary_max=DBL, tags=STR, source=STR, apply_url=STR, date_posted=STR,
)

# A stored posting: arrival number first, load time last.
JOBS = T.StructType(
    [T.StructField("id", LONG, False), *POSTING.fields, T.StructField("created_at", T.TimestampType())]
)

# One landed payload per feed page.
FEED_A = T.ArrayType(_struct(
    id=STR, position=STR, company=STR, description=STR, location=STR, apply_url=STR, date=STR,
    tags=STRS, salary_min=DBL, salary_max=DBL,
))
FEED_B = _struct(data=T.ArrayType(_struct(
    slug=STR, title=STR, company_name=STR, description=STR, location=STR, url=STR, remote=BOOL,
    tags=STRS, created_at=LONG,
)))
_NAMED = _struct(name=STR)
FEED_C = _struct(results=T.ArrayType(_struct(
    id=LONG, name=STR, contents=STR, type=STR, publication_date=STR,
    categories=T.ArrayType(_NAMED), locations=T.ArrayType(_NAMED), company=_NAMED,
    refs=_struct(landing_page=STR),
)))
FEED_D = _struct(results=T.ArrayType(_struct(
    id=STR, title=STR, description=STR, contract_time=STR, redirect_url=STR, created=STR,
    salary_min=DBL, salary_max=DBL, category=_struct(label=STR),
    company=_struct(display_name=STR), location=_struct(display_name=STR),
)))

RUNS = _struct(
    run_id=STR, run_date=STR, model_type=STR, feature_type=STR,
    params=T.MapType(STR, STR), metrics=T.MapType(STR, DBL),
)
