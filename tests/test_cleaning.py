"""Single cleaning rules against the whole-text denoiser, on texts where one rule acts alone."""

import json

from gleaner.operators import cleaning, denoise
from pyspark.sql import functions as F

TEXTS = {
    "same": "a\nb  b\nb b\nb b\n\nc\nc\n```\nd\nd\nd\n```\n    e\n    e\n    e\n\tf\nb b\nb b\nb b  ",
    "progress": "go 1%\ngo 2%\ngo 30%\ngo 99%\nother\n3/10 x\n4/10 x\n5/10 x\n\n[#>..] at 3\n[#>..] at 4\n[#>..] at 5\n[#>..] at 77\nend",
    "stamps": "2024-01-01 00:00:01 beat\n2024-01-01 00:00:02 beat\n2024-01-01 00:00:03  beat\nplain\n10:00 x\n10:01 x\n10:02 y\n",
}


def lines_of(spark, name):
    rows = [(name, k, x) for k, x in enumerate(TEXTS[name].splitlines())]
    return cleaning.protected(spark.createDataFrame([*rows, ("nulls", 0, None), ("nulls", 1, None), ("nulls", 2, None)], "doc_id string, idx long, line string"))


def test_rules_agree_with_the_denoiser(spark):
    for name, rule in (("same", cleaning.same_lines), ("progress", cleaning.progress_lines), ("stamps", cleaning.stamped_lines)):
        got = rule(lines_of(spark, name)).where(F.col("doc_id") == name).orderBy("idx", "part").collect()
        text, rules = denoise.cleaned(TEXTS[name], least=0)
        assert "\n".join(r.line for r in got).strip() == text and rules
        assert rule(lines_of(spark, name)).where("doc_id = 'nulls'").count() == 3


def test_controls_and_json(spark):
    texts = ["\x1b[1;31mred\x1b[0m\r\nx\ry\x00\u200b\ufeff", "plain", "", None, "\x1b]0;t\x1b\\z", "tab\tstays"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(cleaning.controls(F.col("t"))).collect()] == [denoise.controls(t or "") for t in texts]
    texts = [json.dumps({"a": [1, 'q"u\\', {"b c": None}], "k": "  "}, indent=3), '{"a":1, "a" :  1.0}', '"open \\', "[ 1 ,\n2 ]", "x" * 50_000 + ' " ' + "y " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(cleaning.minified(F.col("t"))).collect()] == [denoise.minified(t) for t in texts]
