"""Requests as they come (JSON that a model wrote) made into typed rows, repaired where that can be done, with warnings.

Everything is an expression over a variant, so a table of requests of any size is read like any other table, and what
is asked becomes columns that plans can join with: needles, slots and terms.

Defined cases: what is no JSON object gives a row without goal and the warning "no object"; null and missing fields are empty; an
array is wanted where a text is given: the text is cut at commas and lines; needles beyond the tenth become slots if there are
none; unknown words for want and scope mean "fact" and "new"; slots may be an array (of objects or questions), an object of
questions by id (in the order of ids), or smeared over a text (of which ids and questions are picked out); equal ids of slots get numbers; numbers and
truth values where an array belongs are warned of; equal requests stay rows of their own; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

#: What may be wanted, scopes and types; other words for them; the most needles, slots and aliases.
WANTS = ("fact", "count", "verbatim", "table", "schema", "list")
WANT_WORDS = {
    "facts": "fact", "answer": "fact", "answers": "list", "number": "count", "numbers": "count", "total": "count", "totals": "count", "exact": "verbatim", "quote": "verbatim", "quotes": "verbatim",
    "string": "verbatim", "strings": "verbatim", "row": "table", "rows": "table", "record": "table", "records": "table", "complete data": "table", "all data": "table", "data rows": "table",
    "full structure": "schema", "structure overview": "schema", "structure": "schema", "overview": "schema",
}
SCOPES = ("new", "narrow", "expand", "verify")
SCOPE_WORDS = {"all": "expand", "full": "expand", "more": "expand", "overview": "new"}
TYPES = ("auto", "pdf", "text", "csv", "xlsx", "json", "yaml", "xml", "mixed", "collection")
NEEDLES, SLOTS, ALIASES, LONG_ID = 10, 12, 8, 20
SLOT = "array<struct<id: string, question: string, expected: string, aliases: array<string>>>"


def _text(v: Column, path: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def _kind(v: Column, path: str = "$") -> Column:
    """string, array, object or the name of a number; none for null and what is missing."""
    kind = F.lower(F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Za-z]+", 0))
    return F.coalesce(F.when(kind != "void", kind), F.lit("none"))


def _filled(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def _cut(text: Column, most: int) -> Column:
    return F.slice(_filled(F.split(text, "[,\n]")), 1, most)


def _array(v: Column, path: str, most: int | None = None) -> Column:
    """The texts of an array; of a text cut at commas and lines, if `most` is given."""
    listed = _filled(F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>")))
    return listed if most is None else F.when(_kind(v, path) == "string", _cut(_text(v, path), most)).otherwise(listed)


def _worded(said: Column, valid: tuple[str, ...], words: dict[str, str], inside: bool) -> Column:
    """The valid word that is said, or meant; null for others."""
    tests: list[tuple[Column, str]] = [(said == w, w) for w in valid]
    tests += [(said.contains(w), w) for w in valid] if inside else []
    tests += [(said == w, to) for w, to in words.items()]
    tests += [(said.contains(w), to) for w, to in words.items()] if inside else []
    return F.coalesce(*[F.when(test, to) for test, to in tests])


def _asks(text: Column) -> Column:
    return text.contains("?") | text.rlike(r"(?i)^(how|what|when|where|which|who|why)\b")


def _slot(id_: Column, question: Column, expected: Column | str = "fact", aliases: Column | None = None) -> Column:
    expected = F.lit(expected) if isinstance(expected, str) else expected
    return F.struct(id_.alias("id"), question.alias("question"), expected.alias("expected"), (F.array().cast("array<string>") if aliases is None else aliases).alias("aliases"))


def _id(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), 1, 64)


def smeared(text: Column) -> Column:
    """Slots picked out of a text that holds ids and questions in the form of JSON, whatever stands between."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\n", " "), r'\\+"', '"'), "<[^>]+>", " ")

    def of(chunk: Column) -> Column:
        question = F.trim(F.regexp_extract(chunk, r'"question"\s*:\s*(?:"question"\s*:\s*)?"(?!question")([^"]{6,240})"', 1))
        expected = F.lower(F.trim(F.regexp_extract(chunk, r'"expected"\s*:\s*"([^"]{1,40})"', 1)))
        return _slot(_id(F.regexp_extract(chunk, r'"id"\s*:\s*"([^"]{1,40})"', 1)), question, F.coalesce(F.nullif(expected, F.lit("")), F.lit("fact")))

    return F.filter(F.transform(F.split(plain, r'(?="id"\s*:\s*"[^"]+")'), of), lambda s: (s["id"] != "") & (s["question"] != ""))


def _object_slot(v: Column, number: Column, id_: Column | None = None) -> Column:
    name = F.concat(F.lit("slot_"), number.cast("string"))
    given = _text(v, "$.id")
    own = F.coalesce(F.nullif(given, F.lit("")), id_ if id_ is not None else name)
    question = F.coalesce(F.nullif(_text(v, "$.question"), F.lit("")), _text(v, "$.goal"))
    names_itself = (question == "") & (F.length(own) > LONG_ID)  # a question in the place of an id
    expected = F.coalesce(F.nullif(F.lower(_text(v, "$.expected")), F.lit("")), F.lit("fact"))
    return _slot(F.when(names_itself, name).otherwise(own), F.when(names_itself, F.substring(own, 1, 240)).otherwise(question), expected, F.slice(_array(v, "$.aliases", ALIASES), 1, ALIASES))


def _is_smeared(text: Column) -> Column:
    plain = F.regexp_replace(text, r'\\+"', '"')
    return (F.regexp_count(plain, F.lit(r'"id"\s*:')) > 1) & plain.contains('"question"')


def _listed_slots(items: Column) -> Column:
    """Of an array's items: objects, questions, and texts of several slots."""

    def of(v: Column, i: Column) -> Column:
        number, said = i + 1, F.trim(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))
        question = F.when(_asks(said), F.array(_slot(F.concat(F.lit("slot_"), number.cast("string")), said))).otherwise(F.array().cast(SLOT))
        thing = F.when(_is_smeared(F.to_json(v)), smeared(F.to_json(v))).otherwise(F.array(_object_slot(v, number)))
        return F.when(_kind(v) == "string", question).when(_kind(v) == "object", thing).otherwise(F.array().cast(SLOT))

    return F.flatten(F.transform(F.slice(items, 1, SLOTS), of))


def _mapped_slots(entries: Column) -> Column:
    def of(e: Column, i: Column) -> Column:
        id_ = F.coalesce(F.nullif(_id(e["key"]), F.lit("")), F.concat(F.lit("slot_"), (i + 1).cast("string")))
        said = F.substring(F.trim(F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.lit(""))), 1, 240)
        return F.when(_kind(e["value"]) == "object", _object_slot(e["value"], i + 1, id_)).otherwise(_slot(id_, said))

    return F.filter(F.transform(F.slice(entries, 1, SLOTS), of), lambda s: s["question"] != "")


def _told_apart(slots: Column) -> Column:
    """Equal ids get the number of slots before them."""

    def add(out: Column, s: Column) -> Column:
        seen = F.exists(out, lambda o: o["id"] == s["id"])
        return F.concat(out, F.array(_slot(F.when(seen, F.concat_ws("_", s["id"], (F.size(out) + 1).cast("string"))).otherwise(s["id"]), s["question"], s["expected"], s["aliases"])))

    return F.slice(F.aggregate(slots, F.array().cast(SLOT), add), 1, SLOTS)


def parsed(raw: DataFrame, column: str = "request") -> DataFrame:
    """raw with goal, needles, want, scope, type_hint, must_keep, slots and warnings (sorted) in place of the column."""
    v = F.try_parse_json(F.col(column))
    out = raw.withColumn("_v", F.when(_kind(v) == "object", v))
    v = F.col("_v")
    items, entries = F.try_variant_get(v, "$.slots", "array<variant>"), F.map_entries(F.try_variant_get(v, "$.slots", "map<string, variant>"))
    kind = _kind(v, "$.slots")
    slots = F.when(kind == "array", _listed_slots(items)).when(kind == "object", _mapped_slots(entries)).otherwise(F.array().cast(SLOT))
    out = out.withColumn("_given", _told_apart(F.coalesce(slots, F.array().cast(SLOT)))).withColumn("_needles", _array(v, "$.needles", NEEDLES))
    repaired = F.when((F.size("_given") == 0) & F.col(column).contains('question'), _told_apart(smeared(F.col(column)))).otherwise(F.col("_given"))
    out = out.withColumn("_slots", F.when(v.isNull(), F.array().cast(SLOT)).otherwise(repaired))
    more = F.slice("_needles", NEEDLES + 1, 1_000)
    overflow = F.transform(more, lambda n, i: _slot(F.concat(F.lit("needle_overflow_"), (i + 1).cast("string")), F.concat(F.lit("Find information about: "), n), "fact", F.array(n)))
    spare = (F.size("_slots") == 0) & (F.size(more) > 0)
    goal, want = _text(v, "$.goal"), F.coalesce(F.nullif(F.lower(_text(v, "$.want")), F.lit("")), F.lit("fact"))
    scope = F.coalesce(F.nullif(F.lower(_text(v, "$.scope")), F.lit("")), F.lit("new"))
    meant, near = _worded(want, WANTS, WANT_WORDS, True), _worded(scope, SCOPES, SCOPE_WORDS, False)
    type_hint = _text(v, "$.type_hint")
    odd: Callable[[str, tuple[str, ...]], Column] = lambda path, fine: ~_kind(v, path).isin("none", *fine)
    without = F.size(F.filter("_slots", lambda s: s["question"] == "")) > 0
    dropped = (kind == "array") & (F.size(F.filter(items, lambda x: (_kind(x) != "object") & ~((_kind(x) == "string") & _asks(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))))) > 0)
    told = {
        "no object": v.isNull(), "goal is missing": v.isNotNull() & (goal == "") & (F.size("_slots") == 0), "needles are no array": odd("$.needles", ("array", "string")), "needles became slots": spare, "want is unknown": meant.isNull(), "scope is unknown": near.isNull(),
        "must_keep is no array": odd("$.must_keep", ("array",)), "slots are no array": odd("$.slots", ("array", "object")) & (F.size("_slots") == 0), "too many slots": F.coalesce(F.size(items) > SLOTS, F.lit(False)) | F.coalesce(F.size(entries) > SLOTS, F.lit(False)), "a slot has no question": without, "a slot is neither object nor question": F.coalesce(dropped, F.lit(False)) & (F.size("_given") + F.size("_slots") > 0),
    }
    warnings = F.array_sort(F.array_compact(F.array(*[F.when(test, text) for text, test in told.items()])))
    kept = [F.col(c) for c in raw.columns if c != column]
    return out.select(
        *kept, goal.alias("goal"), F.slice("_needles", 1, NEEDLES).alias("needles"), F.coalesce(meant, F.lit("fact")).alias("want"), F.coalesce(near, F.lit("new")).alias("scope"), F.when(type_hint.isin(*TYPES), type_hint).otherwise("auto").alias("type_hint"),
        _array(v, "$.must_keep").alias("must_keep"), F.when(spare, F.slice(overflow, 1, SLOTS)).otherwise(F.col("_slots")).alias("slots"), warnings.alias("warnings"),
    )


def rendered(part: DataFrame) -> DataFrame:
    """request_id, request: a request for each part, in nine more or less orderly forms."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit('"n'), i.cast("string"), F.lit('"'))), ", ")
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [
        form('{"goal": " find ', name, ' ", "needles": ["', key, '", " ", "x"], "want": "fact", "scope": "new", "must_keep": ["k"]}'),
        form('{"goal": "g', key, '", "needles": "a, b,\\n,', key, '", "want": "Totals", "scope": "More", "must_keep": "k"}'),
        form('{"goal": "g", "needles": [', many, '], "want": "all the rows please", "scope": "sideways", "type_hint": "csv"}'),
        form('{"slots": [{"id": "a", "question": "Which ', key, '?", "aliases": "x, y"}, {"id": "a", "goal": "Again?", "expected": " DATE "}, "How many?", "no"]}'),
        form('{"slots": {"first one!": "Who ', key, '?", "b": {"question": "Where?", "aliases": ["z"]}, "c": ""}, "want": "poem"}'),
        form('{"goal": "", "needles": 5, "must_keep": null}'),
        form("not json ", key),
        form('{"goal": "g", "slots": [{"id": "a question in place of an id ', key, '"}, {"id": "short"}]}'),
        form('{"goal": "s", "slots": "\\"id\\": \\"p', key, '\\", \\"question\\": \\"What is it?\\" <b> \\"id\\": \\"q\\", \\"question\\": \\"Who was it?\\", \\"expected\\": \\"Name\\""}'),
    ]
    request = reduce(lambda otherwise, k: F.when(F.col("p_partkey") % len(forms) == k, forms[k]).otherwise(otherwise), range(len(forms)), F.lit(None).cast("string"))
    # parsing costs much more than reading: a file of few blocks would be the work of few tasks
    return spread(part).select(F.col("p_partkey").alias("request_id"), request.alias("request"))
