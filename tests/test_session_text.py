"""Session helpers and text functions."""

from __future__ import annotations

from learnlens.functions.text import day_label, is_blank, storage_key
from learnlens.session import cluster_settings


def test_cluster_settings_policy():
    s = cluster_settings()
    assert s["spark.sql.autoBroadcastJoinThreshold"] == "-1"
    assert s["spark.sql.adaptive.enabled"] == "true" and s["spark.sql.session.timeZone"] == "UTC"


def test_text_helpers(spark):
    df = spark.createDataFrame([("u.2/x y", "  ", "2024-11-11")], "u string, t string, d string")
    r = df.select(storage_key("u").alias("k"), is_blank("t").alias("b"),
                  day_label(df.d.cast("date")).alias("l")).first()
    assert (r.k, r.b, r.l) == ("u.2_x_y", True, "Nov 11")
