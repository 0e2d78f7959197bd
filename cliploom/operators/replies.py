"""Analyzer requests out, analyzer replies in.

The call itself is some other job's work: this side writes one request row per chunk and
checks the reply rows that come back. A reply is accepted or refused as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import first_problem, is_finite
from cliploom.functions.json import object_keys, shape_problem, starts_list
from cliploom.rules import Policy

#: Text fields of a proposed candidate and their longest accepted length.
MAX_PROPOSALS = 200
FIELDS = ("start", "end", "category", *rules.TEXT_LIMITS, "scores")
_CANDIDATE = "struct<" + ",".join(f"`{f}`:string" for f in FIELDS) + ">"
_SCORES = "struct<" + ",".join(f"`{f}`:string" for f in rules.SCORE_NAMES) + ">"


def _keys_are(text: Column, names: tuple[str, ...]) -> Column:
    return F.array_sort(object_keys(text)) == F.array(*[F.lit(n) for n in sorted(names)])


def _score_ok(text: Column) -> Column:
    number = text.try_cast("double")
    return number.isNotNull() & (number == F.floor(number)) & number.between(0, 100)


def _candidates_ok(items: Column) -> Column:
    """Every proposal has exactly the expected fields, types and sizes.

    Each text is parsed once, in two steps, before the tests look at it.
    """
    read = F.transform(items, lambda raw: F.struct(
        raw.alias("raw"), F.from_json(raw, _CANDIDATE).alias("item"),
        F.regexp_replace(F.schema_of_variant(F.try_parse_json(raw)),
                         "scores: OBJECT<[^>]*>", "scores: OBJECT").alias("kinds"),
    ))
    read = F.transform(read, lambda x: F.struct(
        x["raw"].alias("raw"), x["item"].alias("item"), x["kinds"].alias("kinds"),
        F.from_json(x["item"]["scores"], _SCORES).alias("scores"),
        x["item"]["start"].try_cast("double").alias("start"),
        x["item"]["end"].try_cast("double").alias("end"),
    ))
    return F.forall(read, _candidate_ok)


def _candidate_ok(x: Column) -> Column:
    tests = [
        _keys_are(x["raw"], FIELDS),
        _keys_are(x["item"]["scores"], rules.SCORE_NAMES),
        *[x[side].isNotNull() & is_finite(x[side]) for side in ("start", "end")],
        x["item"]["category"].isin(*rules.CATEGORIES),
        *[x["kinds"].rlike(f"[<, ]{name}: STRING") & F.length(x["item"][name]).between(1, limit)
          for name, limit in rules.TEXT_LIMITS.items()],
        *[_score_ok(x["scores"][name]) for name in rules.SCORE_NAMES],
    ]
    verdict = tests[0]
    for test in tests[1:]:
        verdict = verdict & test
    return F.coalesce(verdict, F.lit(False))


def check_replies(replies: DataFrame, text: str = "raw_response") -> DataFrame:
    """Add ``problem`` (NULL when accepted) and ``items`` (raw JSON of each proposal)."""
    body = F.col(text)
    top = F.from_json(body, "map<string,string>")
    items = F.from_json(top["candidates"], "array<string>")
    held = replies.withColumn("_top", top).withColumn("items", items)
    shape_ok = (
        _keys_are(body, ("candidates",))
        & starts_list(body, "candidates")
        & F.col("items").isNotNull()
        & (F.size("items") <= MAX_PROPOSALS)
        & _candidates_ok(F.col("items"))
    )
    return held.withColumn("problem", F.coalesce(
        F.when(F.trim(F.regexp_replace(body, r"\s+", " ")) == "", F.lit("empty")),
        shape_problem(body),
        F.when(~F.coalesce(shape_ok, F.lit(False)), F.lit("schema")),
    )).drop("_top")


def proposals_from(checked: DataFrame) -> DataFrame:
    """Accepted replies, one row per proposal, with its place in the reply."""
    rows = checked.where("problem IS NULL").select(
        "run_id", "chunk_id", F.posexplode("items").alias("ordinal", "raw"))
    item = F.from_json("raw", _CANDIDATE)
    scores = F.from_json(item["scores"], _SCORES)
    return rows.select(
        "run_id", "chunk_id", F.col("ordinal").cast("bigint").alias("ordinal"),
        item["start"].cast("double").alias("start"), item["end"].cast("double").alias("end"),
        *[item[f].alias(f) for f in ("category", *rules.TEXT_LIMITS)],
        F.struct(*[
            scores[n].cast("double").cast("int").alias(n) for n in rules.SCORE_NAMES
        ]).alias("scores"),
    )


def reply_status(replies: DataFrame, model: str) -> DataFrame:
    """Whether the provider finished, was allowed to, and is the one that was asked."""
    reported, finish = F.col("model_version"), F.col("finish_reason")
    return replies.withColumn("problem", first_problem([
        ("blocked", F.coalesce(F.col("block_reason"), F.lit("")) != ""),
        ("incomplete", (finish != "") & ~finish.isin("STOP", "FINISH_REASON_UNSPECIFIED")),
        ("other_model", (reported != "") & (reported != model)
         & ~reported.startswith(f"{model}-")),
    ]))


def answer_coverage(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks nobody answered and answers to chunks that do not exist."""
    keys = ["run_id", "chunk_id"]
    asked, answered = chunks.select(*keys), answers.select(*keys).distinct()
    missing = asked.join(answered, keys, "left_anti").withColumn("problem", F.lit("missing"))
    unknown = answered.join(asked, keys, "left_anti").withColumn("problem", F.lit("unknown"))
    return missing.unionByName(unknown)


def analyzer_requests(chunks: DataFrame, policy: Policy) -> DataFrame:
    """One request per chunk: parameters and speech in separate columns, never mixed."""
    lines = [
        ("chunk_end_seconds", F.col("end").cast("string")),
        ("chunk_id", F.concat(F.lit('"'), F.col("chunk_id"), F.lit('"'))),
        ("chunk_start_seconds", F.col("start").cast("string")),
        ("max_duration_seconds", F.lit(policy.max_duration).cast("string")),
        ("min_duration_seconds", F.lit(policy.min_duration).cast("string")),
        ("run_target_candidates", F.lit(policy.target).cast("string")),
    ]
    body = F.concat_ws(",\n", *[F.concat(F.lit(f'  "{n}": '), c) for n, c in lines])
    return chunks.select(
        "run_id", "chunk_id",
        F.concat(F.lit(rules.PARAMETERS_TITLE + "\n{\n"), body, F.lit("\n}")).alias("parameters"),
        F.concat(F.lit(rules.SPEECH_PREAMBLE), F.col("text"), F.lit(rules.SPEECH_END))
        .alias("speech"),
    )
