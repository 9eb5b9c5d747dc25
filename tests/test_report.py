import pytest

from veilframe.sources import sinks


def test_report_sections(spark):
    schema = "metric string, value double"
    speed = spark.createDataFrame([("p95", 1234.5), ("a<b", None)], schema)
    files = spark.createDataFrame([("out/b&c.csv",), ("out/a.json",), ("out/a.json",)], "path string")
    got = sinks.report([("Speed", speed), ("Accuracy & more", spark.createDataFrame([], schema))], files, "T").collect()
    assert [r.html for r in got] == [
        "<html><head><title>T</title></head><body>"
        "<h2>Speed</h2><table><tr><td>a&lt;b</td><td>-</td></tr><tr><td>p95</td><td>1,234.5000</td></tr></table>"
        "<h2>Accuracy &amp; more</h2><table></table>"
        "<h2>Files</h2><ul><li>out/a.json</li><li>out/b&amp;c.csv</li></ul></body></html>"
    ]
    with pytest.raises(ValueError):
        sinks.report([])
