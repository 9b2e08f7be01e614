"""The denoiser and the segmenter: stated results of small texts, and a line-by-line version over random ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.operators import denoise, page_text, segments


def clean(text, kind="text"):
    return denoise.cleaned(text, kind, least=0)


def test_short_texts_stay():
    assert denoise.cleaned("a\r\nb\x00") == ("a\r\nb\x00", [])


def test_controls():
    assert clean("\x1b[31mred\x1b[0m\r\nx\ry​﻿z\x07\tw") == ("red\nx\nyz\tw", ["controls"])


def test_equal_lines_are_counted():
    assert clean("a\n b  c\nb c\nb c \nd") == ("a\n b  c\n[repeated identical line ×3]\nd", ["repetition"])
    assert clean("a\na\nb")[0] == "a\na\nb"
    assert clean("")[0] == ""


def test_code_and_blank_lines_stay():
    text = "```\nx\nx\nx\n```\n    y\n    y\n    y\nend"
    assert clean(text) == (text, [])
    assert clean("a\n\n\n\nb") == ("a\n\nb", ["repetition"])


def test_progress_keeps_its_ends():
    text = "\n".join(f"load {i}0%" for i in range(1, 7))
    assert clean(text) == ("load 10%\n[collapsed 4 intermediate progress updates]\nload 60%", ["repetition"])


def test_time_stamps_do_not_count():
    text = "\n".join(f"2024-01-01 10:00:0{i} poll" for i in range(4))
    assert clean(text) == ("2024-01-01 10:00:00 poll\n[repeated line with volatile prefix ×4]\n2024-01-01 10:00:03 poll", ["volatile_prefix"])


def test_blocks():
    assert clean("a\nb\nc\na\nb\nc\nd") == ("a\nb\nc\n[repeated block ×2]\nd", ["repeated_block"])
    assert clean("a\nb\na\nb")[0] == "a\nb\na\nb"
    assert clean("a\nb\na\nb\na\nb")[0] == "a\nb\n[repeated block ×3]"


def longest_block(lines, i):
    for k in range(min(32, (len(lines) - i) // 2), 1, -1):
        n = 1
        while lines[i + n * k : i + (n + 1) * k] == lines[i : i + k]:
            n += 1
        if n >= (3 if k == 2 else 2):
            return k, n
    return None


def test_blocks_against_every_comparison():
    rnd = random.Random(5)
    for _ in range(300):
        lines = [rnd.choice("ab" if rnd.random() < 0.5 else "abc") for _ in range(rnd.randrange(1, 90))]
        out, i = [], 0
        while i < len(lines):
            if hit := longest_block(lines, i):
                out += [*lines[i : i + hit[0]], f"[repeated block ×{hit[1]}]"]
                i += hit[0] * hit[1]
            else:
                out.append(lines[i])
                i += 1
        assert denoise._walk("\n".join(lines), denoise._blocks)[0] == "\n".join(out)


def test_json_keeps_strings():
    assert clean('{ "a b" : [1.0,\n 2e3 ], "q\\" x": " \\\\" }', "json")[0] == '{"a b":[1.0,2e3],"q\\" x":" \\\\"}'
    assert denoise.minified('{"open  \\') == '{"open  \\'
    assert denoise.minified('"' + "a " * 100_000 + '"  ') == '"' + "a " * 100_000 + '"'


def test_yaml():
    assert clean("a: 1\nb:\n  - x\n  - y\n", "yaml") == ("{a: 1, b: [x, y]}", ["structured_yaml"])
    for kept in ("# c\na: 1", "a: &x 1\nb: *x", "a: [", ""):
        assert denoise.flat_yaml(kept) == kept
    deep = "[" * 128 + "]" * 128
    assert denoise.flat_yaml(f"[{deep}]") == f"[{deep}]"


def test_pages():
    assert page_text.readable("<p>a &amp; b</p><script>x</script><div>c  d</div>") == ("\na & b\n\nc d", False)
    body = "word " * 120
    text, main = page_text.readable(f"<title>T</title><nav>menu</nav><main><p>{body}</p></main>")
    assert main and text.startswith("# T\n\n") and "menu" not in text


def test_denoised_over_rows(spark):
    rows = [(1, "x\n" * 3000), (2, None), (None, "short"), (3, "")]
    got = {r.doc_id: r for r in denoise.denoised(spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))).collect()}
    assert got[1].text == "x\n[repeated identical line ×3000]" and got[1].rules == "repetition" and got[1].input_chars == 6000
    assert got[2].text == "" and got[None].text == "short" and got[3].output_chars == 0


@pytest.mark.parametrize(
    ("line", "is_one"),
    [
        ("# any thing", True), ("2.1 results", True), ("ALL CAPS", True), ("CAPS", True), ("Two Words", True), ("Title Of one", True), ("A plain line of text", False),
        ("Ends Here.", False), ("12 / 34", False), ("See http://x", False), ("", False), ("A" * 141, False), ("Id 123456", False),
    ],
)
def test_headings(line, is_one):
    assert segments.is_heading(line) is is_one


def test_units():
    text = "intro text here and more\n\n# Head\nbody one\nbody two\n\nlast bit of it"
    assert segments.cut(text) == [("L1-L1", "intro text here and more", ""), ("L3-L5", "# Head\nbody one\nbody two", "# Head"), ("L7-L7", "last bit of it", "# Head")]
    assert segments.cut(text, 3)[0][0] == "p3:L1-L1"
    assert segments.cut("") == segments.cut(" \n\n") == []


def test_units_by_size():
    line = "some words that are plain and in lower case " * 3
    assert [u[0] for u in segments.cut("\n".join([line] * 25))] == ["L1-L10", "L11-L20", "L21-L25"]
    items = "\n".join([f"- {line}"] * 8)
    assert [u[0] for u in segments.cut(items)] == ["L1-L4", "L5-L8"]


def test_long_units_cover_all_text():
    rnd = random.Random(7)
    text = " ".join(rnd.choice(["alpha", "beta.", "gamma?", "d"]) for _ in range(3000))
    units = segments.cut(text)
    spans = [tuple(map(int, re.search(r":C(\d+)-(\d+)$", a).groups())) for a, _, _ in units]
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, _), (_, part, _) in zip(spans, spans[1:], units, strict=False):
        assert c == b - 180 and 800 < b - a <= 1600 and part == text[a:b].strip() and text[b - 1] in ".?"
    solid = segments.pieces("x" * 4000)
    assert [(a, b) for a, b, _ in solid] == [(0, 1600), (1420, 3020), (2840, 4000)]


def test_segments_over_rows(spark):
    df = spark.createDataFrame([("k", "# One\ntext\n\n# Two\n\n# One", 1), ("n", None, 2), ("e", "", None)], "doc_id string, text string, page int")
    units = segments.segments(df, page_col="page")
    assert sorted((r.doc_id, r.idx, r.anchor, r.heading) for r in units.collect()) == [("k", 0, "p1:L1-L2", "# One"), ("k", 1, "p1:L4-L4", "# Two"), ("k", 2, "p1:L6-L6", "# One")]
    assert [(r.doc_id, r.headings) for r in segments.skeleton(units).collect()] == [("k", ["# One", "# Two"])]
