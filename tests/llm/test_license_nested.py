"""A template that lies inside another is found where a text carries the run on into the other."""

import pytest
from gridloom.llm import license_scan


@pytest.mark.parametrize("text", ['Licensed under the Apache License, Version 2.0 (the "License"); and then nothing', "Before. Licensed under the Apache License, Version 2.0 the"])
def test_prefix_of_another_template(spark, text):
    row = license_scan.digest(license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()[0]
    assert (row.labels, row.score) == ("apache,apache-line", 1.0) and [s.label for s in row.spans] == ["apache-line"]


def test_whole_template_keeps_both(spark):
    rows = spark.createDataFrame([(1, license_scan.TEMPLATES["apache-notice"])], "doc_id long, text string")
    assert {(s.label, s.covered) for s in license_scan.scan_licenses(rows).collect()[0].spans} == {("apache-notice", 1.0), ("apache-line", 1.0)}
