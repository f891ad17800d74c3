"""The queries on hourly labels take a reading's time from `date`."""

from airledger.plans import reference


def test_more_than_datetime(spark, small):
    n = reference.hourly_clean(spark, small).agg({"n": "sum"}).first()[0]
    assert n > 1.5 * reference.read_table(spark, small, "hourly").where("datetime is not null").count()


def test_draws(spark, tiny):
    assert 900 < reference.bootstrap_r2max(spark, tiny).first()["n_boot"] <= 1000  # draws that meet no band with labels don't count
