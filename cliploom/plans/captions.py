"""Queries over caption cues and subtitle documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import ms
from cliploom.operators import captions as K
from cliploom.operators import documents as T
from cliploom.plans.registry import part, plan
from cliploom.plans.views import Views

part("q_tokens_clip", """
SELECT t.run_id, t.candidate_id, w.idx, w.word_pos, w.word, w.s AS a, w.e AS b,
  greatest(w.s, t.s) - t.s AS s,
  greatest(least(w.e, t.e) - t.s, greatest(w.s, t.s) - t.s) AS e, t.e - t.s AS clip
FROM q_targets t JOIN q_words w
  ON w.run_id = t.run_id AND w.e - t.s > 1e-9 AND t.e - w.s > 1e-9""")
part("q_bare", """
SELECT *, row_number() OVER (PARTITION BY run_id, candidate_id ORDER BY a, b, idx, word_pos) AS n,
  rtrim(word, '"'')]»”') AS bare FROM q_tokens_clip""")
part("q_marked", """
SELECT *, right(bare, 1) IN ('.', '?', '!', '…') AS ends,
  right(bare, 1) IN (',', ';', ':') AS soft, length(word) AS size FROM q_bare""")
part("q_group_steps", """
SELECT run_id, candidate_id, n, s, e, word, size, clip, ends, soft, 1 AS cnt, size AS chars, 1 AS g
FROM q_marked WHERE n = 1
 UNION ALL 
SELECT m.run_id, m.candidate_id, m.n, m.s, m.e, m.word, m.size, m.clip, m.ends, m.soft,
  CASE WHEN brk THEN 1 ELSE t.cnt + 1 END, CASE WHEN brk THEN m.size ELSE t.chars + m.size END,
  CASE WHEN brk THEN t.g + 1 ELSE t.g END
FROM q_group_steps t JOIN q_marked m USING (run_id, candidate_id),
  LATERAL (SELECT t.cnt >= 8 OR t.ends OR m.s - t.e >= 0.6 OR (t.cnt >= 6 AND t.soft)
    OR t.chars + t.cnt + m.size > 84 AS brk)
WHERE m.n = t.n + 1""")
part("q_groups", """
SELECT run_id, candidate_id, g, min(s) AS s, max(e) AS e, list(word ORDER BY n) AS words,
  first(clip) AS clip FROM q_group_steps GROUP BY run_id, candidate_id, g""")
part("q_limits", """
SELECT *, coalesce(lead(s) OVER (PARTITION BY run_id, candidate_id ORDER BY g), clip) AS lim
FROM q_groups""")
part("q_timed_steps", """
SELECT run_id, candidate_id, 0::BIGINT AS g, 0.0::DOUBLE AS s, 0.0::DOUBLE AS e,
  0.0::DOUBLE AS prev, []::VARCHAR[] AS words, false AS shown
FROM q_limits WHERE g = 1
 UNION ALL 
SELECT t.run_id, t.candidate_id, l.g, x.st, y.en, CASE WHEN y.en - x.st > 1e-9 THEN y.en
    ELSE t.prev END, l.words, y.en - x.st > 1e-9
FROM q_timed_steps t JOIN q_limits l USING (run_id, candidate_id),
  LATERAL (SELECT least(greatest(l.s, t.prev), l.clip) AS st) x,
  LATERAL (SELECT CASE WHEN least(greatest(l.e, x.st), l.clip) - x.st < 0.25
      THEN least(x.st + 0.25, least(greatest(l.lim, x.st), l.clip))
      ELSE least(greatest(l.e, x.st), l.clip) END AS en) y
WHERE l.g = t.g + 1""")
part("q_cues", """
SELECT run_id, candidate_id, row_number() OVER (PARTITION BY run_id, candidate_id ORDER BY g)
  AS index, s, e, words FROM q_timed_steps WHERE shown""")
part("q_splits", """
SELECT run_id, candidate_id, index, k,
  greatest(length(array_to_string(words[1:k], ' ')), length(array_to_string(words[k+1:], ' ')))
  AS cost FROM (SELECT *, unnest(range(1, len(words))) AS k FROM q_cues WHERE len(words) > 1)""")
part("q_lines_of", """
SELECT c.*, CASE WHEN length(array_to_string(words, ' ')) <= 42 OR len(words) = 1
    THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[1:b.k], ' '), array_to_string(words[b.k+1:], ' ')] END AS lines
FROM q_cues c LEFT JOIN (SELECT run_id, candidate_id, index, arg_min(k, cost * 1000 + k) AS k
  FROM q_splits GROUP BY ALL) b USING (run_id, candidate_id, index)""")
part("q_stamps", """
SELECT *, round(s::DECIMAL(18,9) * 1000)::BIGINT AS s_ms, round(e::DECIMAL(18,9) * 1000)::BIGINT
  AS e_ms, round(s::DECIMAL(18,9) * 100)::BIGINT AS s_cs, round(e::DECIMAL(18,9) * 100)::BIGINT
  AS e_cs FROM q_lines_of""")


def _srt(x: str) -> str:
    return (f"printf('%02d:%02d:%02d,%03d', {x} // 3600000, ({x} // 60000) % 60, "
            f"({x} // 1000) % 60, {x} % 1000)")


def _ass(x: str) -> str:
    return (f"printf('%d:%02d:%02d.%02d', {x} // 360000, ({x} // 6000) % 60, "
            f"({x} // 100) % 60, {x} % 100)")


@plan("clip_words", """
SELECT run_id, candidate_id, idx AS seg_index, word_pos, word AS text,
  round(s * 1000)::BIGINT AS start_ms, round(e * 1000)::BIGINT AS end_ms FROM q_tokens_clip""")
def clip_words(v: Views) -> DataFrame:
    return v.tokens.select(
        "run_id", "candidate_id", "seg_index", "word_pos", "text",
        ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"))


@plan("token_order", """
SELECT run_id, candidate_id, idx AS seg_index, word_pos, n AS position FROM q_bare""")
def token_order(v: Views) -> DataFrame:
    return v.tokens.select(
        "run_id", "candidate_id", "seg_index", "word_pos", F.col("token_pos").alias("position"))


@plan("cue_hard_breaks", """
SELECT run_id, candidate_id, n AS token_pos, sum(brk) OVER (PARTITION BY run_id, candidate_id
  ORDER BY n)::BIGINT AS stretch FROM (
  SELECT *, CASE WHEN lag(ends) OVER w OR s - lag(e) OVER w >= 0.6 THEN 1 ELSE 0 END AS brk
  FROM q_marked WINDOW w AS (PARTITION BY run_id, candidate_id ORDER BY n))""")
def cue_hard_breaks(v: Views) -> DataFrame:
    return K.hard_breaks(v.clips_heard)


def _groups(v: Views) -> DataFrame:
    """Rows of grouped words with their position in the clip, from 1."""
    return K.group_words(v.clips_heard).select(
        "run_id", "candidate_id", F.posexplode("groups").alias("_at", "_g"),
    ).select("run_id", "candidate_id", (F.col("_at") + 1).cast("bigint").alias("cue_pos"), "_g.*")


part("q_group_out", """
SELECT run_id, candidate_id, g AS cue_pos, round(s * 1000)::BIGINT AS start_ms,
  round(e * 1000)::BIGINT AS end_ms, array_to_string(words, ' ') AS text,
  round(lim * 1000)::BIGINT AS limit_ms FROM q_limits""")


@plan("cue_grouping", """
SELECT run_id, candidate_id, start_ms, end_ms, text, count(*) AS n FROM q_group_out GROUP BY ALL""")
def cue_grouping(v: Views) -> DataFrame:
    return _groups(v).select(
        "run_id", "candidate_id", ms(F.col("raw_start")).alias("start_ms"),
        ms(F.col("raw_end")).alias("end_ms"), F.array_join("words", " ").alias("text"),
    ).groupBy("run_id", "candidate_id", "start_ms", "end_ms", "text").agg(F.count("*").alias("n"))


@plan("cue_limit", """
SELECT run_id, candidate_id, cue_pos::BIGINT AS cue_pos, start_ms, limit_ms FROM q_group_out""")
def cue_limit(v: Views) -> DataFrame:
    return _groups(v).select(
        "run_id", "candidate_id", "cue_pos", ms(F.col("raw_start")).alias("start_ms"),
        ms(F.col("limit")).alias("limit_ms"))


@plan("cue_timing", """
SELECT run_id, candidate_id, index, s AS start, e AS "end" FROM q_cues""")
def cue_timing(v: Views) -> DataFrame:
    return v.cues.select("run_id", "candidate_id", "index", "start", "end")


@plan("cue_wrap", """
SELECT run_id, candidate_id, index, array_to_string(lines, '|') AS lines FROM q_lines_of""")
def cue_wrap(v: Views) -> DataFrame:
    return v.cues.select(
        "run_id", "candidate_id", "index", F.array_join("lines", "|").alias("lines"))


@plan("sink_transcript_txt", """
SELECT run_id, (idx // 1000)::BIGINT AS part, string_agg(text || chr(10), '' ORDER BY idx) AS text
FROM q_segments GROUP BY run_id, idx // 1000""")
def sink_transcript_txt(v: Views) -> DataFrame:
    return T.transcript_text(v.segments)


@plan("sink_transcript_srt", f"""
SELECT run_id, (idx // 1000)::BIGINT AS part, CASE WHEN idx // 1000 > 0 THEN chr(10) ELSE '' END ||
  string_agg((idx + 1) || chr(10) || {_srt("start_ms")} || ' --> ' || {_srt("end_ms")} || chr(10)
    || text || chr(10), chr(10) ORDER BY idx) AS text
FROM q_segments GROUP BY run_id, idx // 1000""")
def sink_transcript_srt(v: Views) -> DataFrame:
    return T.transcript_srt(v.segments)


part("q_clip_srt", f"""
SELECT t.run_id, t.candidate_id, coalesce(c.body || chr(10), '') AS document FROM q_targets t
LEFT JOIN (SELECT run_id, candidate_id, string_agg(index || chr(10) || {_srt("s_ms")} || ' --> '
    || {_srt("e_ms")} || chr(10) || array_to_string(lines, chr(10)), chr(10) || chr(10)
    ORDER BY index) AS body FROM q_stamps GROUP BY run_id, candidate_id) c
  USING (run_id, candidate_id)""")


@plan("sink_clip_srt", "SELECT * FROM q_clip_srt")
def sink_clip_srt(v: Views) -> DataFrame:
    return T.srt_documents(v.clip_cues)


_HEADER = T.ass_header(1080, 1920, rules.CaptionStyle()).replace("'", "''")
part("q_clip_ass", f"""
SELECT t.run_id, t.candidate_id, '{_HEADER}' || coalesce(c.body, '') || chr(10) AS document
FROM q_targets t LEFT JOIN (
  SELECT run_id, candidate_id, string_agg(chr(10) || 'Dialogue: 0,' || {_ass("s_cs")} || ','
    || {_ass("e_cs")} || ',{rules.CaptionStyle().name},,0,0,0,,'
    || translate(array_to_string(lines, '\\N'), '{{}}', '()'), '' ORDER BY index) AS body
  FROM (SELECT * REPLACE (list_transform(lines, lambda x: replace(x, '\\', '/')) AS lines)
        FROM q_stamps) GROUP BY run_id, candidate_id) c
  USING (run_id, candidate_id)""")


@plan("sink_clip_ass", "SELECT * FROM q_clip_ass")
def sink_clip_ass(v: Views) -> DataFrame:
    return T.ass_documents(v.clip_cues, 1080, 1920)


def _srt_documents(v: Views) -> DataFrame:
    """SRT documents, some of them damaged by a hash of their identifier."""
    fault = F.expr("conv(substr(candidate_id, 6, 4), 16, 10) % 13").cast("int")
    doc = F.col("document")
    damaged = (
        F.when(fault == 0, F.regexp_replace(doc, r"\A1\n", "7\n"))
        .when(fault == 1, F.regexp_replace(doc, r"\A(\d+\n)\d\d:", "$1xx:"))
        .when(fault == 2, F.regexp_replace(
            doc, r"\A(\d+\n)(\S+) --> \S+", "$1$2 --> 00:00:00,000"))
        .when(fault == 3, F.replace(doc, F.lit("\n"), F.lit("\r\n")))
        .when(fault == 4, F.regexp_replace(doc, r"\A(\d+\n[^\n]+)\n[^\n]+\n", "$1\n\n"))
        .otherwise(doc)
    )
    return T.srt_documents(v.clip_cues).withColumn("document", damaged)


def _ass_documents(v: Views) -> DataFrame:
    fault = F.expr("conv(substr(candidate_id, 6, 4), 16, 10) % 13").cast("int")
    doc = F.col("document")
    damaged = (
        F.when(fault == 0, F.regexp_replace(doc, r"\nDialogue: 0,", "\nDialogue: 0;"))
        .when(fault == 1, F.regexp_replace(doc, r"\nDialogue: 0,\d", "\nDialogue: 0,x"))
        .when(fault == 2, F.regexp_replace(
            doc, r"\nDialogue: 0,(\S+?),\S+?,", "\nDialogue: 0,$1,0:00:00.00,"))
        .when(fault == 3, F.replace(doc, F.lit("\n"), F.lit("\r\n")))
        .otherwise(doc)
    )
    return T.ass_documents(v.clip_cues, 1080, 1920).withColumn("document", damaged)


part("q_doc_fault", """
SELECT t.run_id, t.candidate_id, ('0x' || substr(t.candidate_id, 6, 4))::BIGINT % 13 AS fault,
  t.s AS ts, t.e AS te, count(c.index) AS cues, t.e - t.s AS clip
FROM q_targets t LEFT JOIN q_stamps c USING (run_id, candidate_id) GROUP BY ALL""")
_ASS_TEXT = (r"translate(replace(array_to_string(list_transform(lines, "
             r"lambda x: replace(x, '\', '/')), chr(10)), chr(13), ''), '{}', '()')")


@plan("read_srt_events", """
SELECT run_id, candidate_id, index AS position, s_ms AS start_ms, e_ms AS end_ms,
  array_to_string(lines, chr(10)) AS text
FROM q_stamps JOIN q_doc_fault USING (run_id, candidate_id) WHERE fault NOT IN (0, 1, 2, 4)""")
def read_srt_events(v: Views) -> DataFrame:
    return T.events_of(T.parse_srt(_srt_documents(v)))


@plan("read_srt_verdicts", """
SELECT run_id, candidate_id, CASE WHEN cues = 0 THEN 'ok' WHEN fault = 0 THEN 'wrong_number'
  WHEN fault = 1 THEN 'bad_timestamps' WHEN fault = 2 THEN 'ends_before_start'
  WHEN fault = 4 THEN 'no_text' ELSE 'ok' END AS verdict FROM q_doc_fault""")
def read_srt_verdicts(v: Views) -> DataFrame:
    return T.parse_srt(_srt_documents(v)).select(
        "run_id", "candidate_id", F.coalesce("problem", F.lit("ok")).alias("verdict"))


@plan("read_ass_events", f"""
SELECT run_id, candidate_id, index AS position, s_cs * 10 AS start_ms, e_cs * 10 AS end_ms,
  {_ASS_TEXT} AS text
FROM q_stamps JOIN q_doc_fault USING (run_id, candidate_id) WHERE fault NOT IN (0, 1, 2)""")
def read_ass_events(v: Views) -> DataFrame:
    return T.events_of(T.parse_ass(_ass_documents(v)))


@plan("cue_document_check", """
SELECT d.run_id, d.candidate_id, CASE WHEN cues = 0 THEN 'ok' WHEN fault IN (0, 1, 2, 4)
  THEN 'unreadable' WHEN fault = 5 AND last_ms > round_even((clip - 0.5) * 1000, 0)
  THEN 'past_clip_end' ELSE 'ok' END AS verdict
FROM q_doc_fault d LEFT JOIN (SELECT run_id, candidate_id, max(e_ms) AS last_ms FROM q_stamps
  GROUP BY ALL) USING (run_id, candidate_id)""")
def cue_document_check(v: Views) -> DataFrame:
    """Documents against clips; for some clips the interval is half a second too short."""
    fault = F.expr("conv(substr(candidate_id, 6, 4), 16, 10) % 13").cast("int")
    clips = v.targets.withColumn(
        "end", F.when(fault == 5, F.col("end") - 0.5).otherwise(F.col("end")))
    return T.event_problems(T.parse_srt(_srt_documents(v)), clips).select(
        "run_id", "candidate_id", F.coalesce("problem", F.lit("ok")).alias("verdict"))
