"""Registered queries that leave out no row of their tables."""

from pyspark.sql import functions as F

from quarry.plans.inputs import load, whole_aliases
from quarry.plans.queries import QUERIES

from .conftest import SF


def test_reports_count_every_line(spark):
    for name, table in (("report_days_all", "events"), ("report_months_all", "orders")):
        n = QUERIES[name](spark, SF).agg(F.sum("lines_total")).first()[0]
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count(), name


def test_aliases_of_every_part(spark):
    with whole_aliases():
        aliases = load(spark, SF, "aliases")
        assert aliases.count() == spark.read.parquet(f"{SF}/part.parquet").count()
    # Of the parts that the narrow input leaves out (60 and more of each 500) some are targets.
    assert QUERIES["alias_targets_all"](spark, SF).where("code > 'P-000060'").count()
