"""Queries that take all of their table, whatever its size."""

import pytest
from pyspark.sql import functions as F

from airledger.plans import pictures, reference


@pytest.mark.parametrize("size", ["tiny", "small"])
def test_picks_span_the_labels(spark, request, size):
    d = request.getfixturevalue(size)
    rows = sorted((r["pm25"], r["_row"]) for r in reference.photos(spark, d).select("pm25", "_row").collect())
    got = sorted((r["pm25"], r["_row"]) for r in reference.every_kth(spark, d).collect())
    assert got == rows[:: max(1, len(rows) // 40)][:40]


def test_correlation_of_all_pictures(spark, tmp_path):
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (F.pmod(F.hash(F.col("id"), k), F.lit(1000)) / 1000 - 0.5).cast("float"))
    spark.range(1800).select(F.col("id").alias("vec_id"), (F.col("id") % 10).alias("label"), one.alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    row = pictures.transmission_label_correlation(spark, str(tmp_path)).first()
    both = pictures.mean_transmission(spark, str(tmp_path)).toPandas().set_index("image")["mean_t"]
    label = both.index.map(lambda i: sum((3 * i + k) % 10 for k in range(3)) / 3).to_series(index=both.index)
    assert row["n"] == 600 and abs(row["pearson"] - both.corr(label)) < 1e-6 and abs(row["spearman"] - both.rank().corr(label.round(9).rank())) < 1e-6
