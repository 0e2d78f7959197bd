"""SQL pieces for the derived views, written row by row from their recipe."""

from __future__ import annotations

from cliploom import rules
from cliploom.plans.registry import part

part("q_lines", """
SELECT doc_id AS run_id, unnest(string_split(text, chr(10))) AS line,
       generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_pos
FROM documents""")
part("q_tokens", """
SELECT run_id, seg_pos, list_filter(string_split(line, ' '), lambda w: w <> '') AS tokens
FROM q_lines WHERE len(list_filter(string_split(line, ' '), lambda w: w <> '')) > 0""")
part("q_word_parts", """
SELECT run_id, seg_pos, unnest(tokens) AS word,
       generate_subscripts(tokens, 1) - 1 AS word_pos, len(tokens) AS n_words
FROM q_tokens""")
part("q_word_steps", """
SELECT *, (160 + 40 * least(length(word), 15))::BIGINT AS dur,
       CASE WHEN word_pos = n_words - 1 AND seg_pos % 5 = 4 THEN 8000
            WHEN right(word, 1) IN ('.', '?', '!') THEN 700
            WHEN right(word, 1) IN (',', ';', ':') THEN 250 ELSE 60 END::BIGINT AS gap
FROM q_word_parts""")
part("q_words0", """
SELECT run_id, seg_pos, word_pos, word, dur,
       coalesce(sum(dur + gap) OVER (PARTITION BY run_id ORDER BY seg_pos, word_pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
FROM q_word_steps""")
part("q_seg0", """
SELECT run_id, seg_pos, min(start_ms) AS start_ms, max(start_ms + dur) AS end_ms,
       string_agg(word, ' ' ORDER BY word_pos) AS text
FROM q_words0 GROUP BY run_id, seg_pos""")
part("q_segments", """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seg_pos) - 1 AS idx,
       start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e FROM q_seg0""")
part("q_words", """
SELECT w.run_id, w.seg_pos, g.idx, w.word_pos, w.word, w.start_ms, w.start_ms + w.dur AS end_ms,
       w.start_ms / 1000.0::DOUBLE AS s, (w.start_ms + w.dur) / 1000.0::DOUBLE AS e
FROM q_words0 w JOIN q_segments g USING (run_id, seg_pos)""")
part("q_runs", """
SELECT run_id, max(end_ms) + 400 AS duration_ms, (max(end_ms) + 400) / 1000.0::DOUBLE AS duration,
       max(seg_pos) AS last_pos FROM q_segments GROUP BY run_id""")

# --- chunks: brute force over every window of every run ---------------------------------
part("q_windows", """
SELECT run_id, k, k * 90.0::DOUBLE AS ws, k * 90.0::DOUBLE + 120.0::DOUBLE AS we
FROM (SELECT run_id, duration, unnest(range(0, (duration / 90)::BIGINT + 2)) AS k FROM q_runs)
WHERE k * 90.0::DOUBLE < duration""")
part("q_window_members", """
SELECT w.run_id, w.k, w.ws, w.we, g.idx, g.s, g.e, g.text
FROM q_windows w JOIN q_segments g
  ON g.run_id = w.run_id AND g.e > w.ws AND g.s < w.we""")
part("q_window_rows", """
SELECT run_id, k, ws, we, min(s) AS s, max(e) AS e, list(idx ORDER BY idx) AS idxs,
       string_agg('[' || lpad(printf('%.2f', s), 9, ' ') || ' --> '
                  || lpad(printf('%.2f', e), 9, ' ') || '] ' || text, chr(10) ORDER BY idx) AS text
FROM q_window_members GROUP BY run_id, k, ws, we""")
part("q_window_cover", """
SELECT *, coalesce(list_has_all(lag(idxs) OVER (PARTITION BY run_id ORDER BY k), idxs), false)
  AS covered FROM q_window_rows""")
part("q_chunks", """
SELECT *, 'chunk_' || lpad(chunk_index::VARCHAR, 4, '0') AS chunk_id FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.run_id ORDER BY c.k) - 1 AS chunk_index
  FROM q_window_cover c
  LEFT JOIN (SELECT run_id, min(k) AS stop FROM q_window_cover WHERE covered GROUP BY run_id) t
    USING (run_id)
  WHERE t.stop IS NULL OR c.k < t.stop)""")

# --- proposals ---------------------------------------------------------------------------
_CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in rules.CATEGORIES) + "]"
_SCORES = ", ".join(
    f"(40 + (h * {m}) % 61)::INT AS sc_{n}"
    for n, m in zip(rules.SCORE_NAMES, (3, 5, 7, 11, 13, 17), strict=True)
)


def recipe(source: str, ordinals: str) -> str:
    """Proposals by the integer recipe over chunks."""
    return f"""
SELECT *, CASE WHEN h % 37 = 0 THEN ps WHEN h % 31 = 0 THEN ps - 1000 ELSE pe1 END AS pe FROM (
 SELECT *, CASE WHEN h % 29 = 0 THEN -5000 ELSE at0 END AS ps,
   CASE WHEN h % 3 = 0 THEN at0 + 14000 + (h * 31) % 82000
        ELSE least(at0 + 14000 + (h * 31) % 82000, hi) END AS pe1 FROM (
  SELECT *, ((lo + (h * 13) % greatest(1, hi - lo)) // 10) * 10 AS at0 FROM (
   SELECT *, (run_id * 7919 + chunk_index * 104729 + ordinal * 15485863) % 1000003 AS h FROM (
    SELECT run_id, chunk_id, chunk_index, ws, we, s AS cs, e AS ce,
           round(s * 1000)::BIGINT AS lo, round(e * 1000)::BIGINT AS hi,
           unnest({ordinals}) AS ordinal FROM {source}))))"""


part("q_seg_digest", """
SELECT run_id, idx, sha256(idx || '|' || start_ms || '|' || end_ms || '|' || text) AS d
FROM q_segments""")
part("q_tree1", """
SELECT run_id, idx // 1024 AS b, sha256(string_agg(d, '|' ORDER BY idx)) AS d
FROM q_seg_digest GROUP BY run_id, idx // 1024""")
part("q_tree2", """
SELECT run_id, b // 1024 AS b, sha256(string_agg(d, '|' ORDER BY b)) AS d
FROM q_tree1 GROUP BY run_id, b // 1024""")
part("q_transcript", """
SELECT run_id, sha256(string_agg(d, '|' ORDER BY b)) AS tsha FROM q_tree2 GROUP BY run_id""")
part("q_prop0", recipe("q_chunks", "[0, 1, 2, 3]"))
part("q_prop1", f"""
SELECT *, {_CATEGORY_LIST}[(h % 11) + 1] AS category, 'topic ' || (h % 97) AS topic,
  'hook ' || (h % 89) AS hook, 'summary ' || h AS summary, 'reason ' || (h % 7) AS reason,
  {_SCORES} FROM q_prop0""")
part("q_proposals", f"""
SELECT p.*, ps / 1000.0::DOUBLE AS s, pe / 1000.0::DOUBLE AS e, duration,
  'cand_' || substr(sha256(concat_ws('|', {rules.CANDIDATE_ID_VERSION}, tsha, chunk_id, ordinal,
    '{rules.PROMPT_VERSION}', sha256('{rules.PROMPT_TEXT}'), ps, pe, category, topic, hook, summary,
    reason, {", ".join("sc_" + n for n in rules.SCORE_NAMES)})), 1, 16) AS candidate_id
FROM q_prop1 p JOIN q_transcript USING (run_id) JOIN q_runs USING (run_id)""")

# --- anchors and grounding: every edge and interval of the chunk ----------------------------
part("q_chunk_edges", """
SELECT c.run_id, c.chunk_id, 0 AS rank, g.s, g.e FROM q_chunks c JOIN q_segments g
  ON g.run_id = c.run_id AND g.e > c.ws AND g.s < c.we
UNION ALL
SELECT c.run_id, c.chunk_id, 1, w.s, w.e FROM q_chunks c
  JOIN q_segments g ON g.run_id = c.run_id AND g.e > c.ws AND g.s < c.we
  JOIN q_words w ON w.run_id = g.run_id AND w.idx = g.idx""")
part("q_near", """
SELECT p.run_id, p.chunk_id, p.ordinal,
  bool_or((a.s - 1e-6 <= p.s AND p.s <= a.e + 1e-6) OR abs(p.s - a.s) <= 2.5 + 1e-6
          OR abs(p.s - a.e) <= 2.5 + 1e-6) AS start_grounded,
  bool_or((a.s - 1e-6 <= p.e AND p.e <= a.e + 1e-6) OR abs(p.e - a.s) <= 2.5 + 1e-6
          OR abs(p.e - a.e) <= 2.5 + 1e-6) AS end_grounded,
  min({'d': abs(a.s - p.s), 'r': a.rank, 't': a.s, 'v': a.s})
    FILTER (WHERE abs(a.s - p.s) <= 2.5 + 1e-6) AS sa,
  min({'d': abs(a.e - p.e), 'r': a.rank, 't': -a.e, 'v': a.e})
    FILTER (WHERE abs(a.e - p.e) <= 2.5 + 1e-6) AS ea
FROM q_proposals p LEFT JOIN q_chunk_edges a USING (run_id, chunk_id)
GROUP BY p.run_id, p.chunk_id, p.ordinal""")
part("q_checked", """
SELECT p.*, n.sa, n.ea, coalesce(n.start_grounded, false) AS sg, coalesce(n.end_grounded, false) AS eg,
  array_to_string(list_filter([
    CASE WHEN p.s < 0 OR p.e <= p.s + 1e-6 THEN 'invalid_interval' END,
    CASE WHEN p.s < p.cs - 1e-6 OR p.e > p.ce + 1e-6 THEN 'outside_chunk' END,
    CASE WHEN p.e > p.duration + 1e-6 THEN 'end_beyond_source' END,
    CASE WHEN p.e - p.s > 1e-6 AND p.e - p.s < 20.0 - 1e-6 THEN 'too_short' END,
    CASE WHEN p.e - p.s > 1e-6 AND p.e - p.s > 90.0 + 1e-6 THEN 'too_long' END,
    CASE WHEN NOT (coalesce(n.start_grounded, false) AND coalesce(n.end_grounded, false))
         THEN 'ungrounded' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM q_proposals p JOIN q_near n USING (run_id, chunk_id, ordinal)""")
part("q_moved", """
SELECT *, coalesce(sa.v, s) AS ms0, coalesce(ea.v, e) AS me0 FROM q_checked""")
part("q_snapped", """
SELECT *, CASE WHEN reverted THEN s ELSE ms0 END AS fs, CASE WHEN reverted THEN e ELSE me0 END AS fe,
  CASE WHEN reverted OR sa IS NULL THEN 'unchanged' WHEN sa.r = 0 THEN 'segment_start'
       ELSE 'word_start' END AS start_kind,
  CASE WHEN reverted OR ea IS NULL THEN 'unchanged' WHEN ea.r = 0 THEN 'segment_end'
       ELSE 'word_end' END AS end_kind,
  (25 * sc_hook + 20 * sc_value + 20 * sc_context_independence + 15 * sc_clarity
   + 10 * sc_engagement_potential + 10 * sc_relevance) / 100.0::DOUBLE AS total
FROM (SELECT *, me0 - ms0 <= 1e-6 OR ms0 < 0 OR me0 > duration + 1e-6
        OR me0 - ms0 < 20.0 - 1e-6 OR me0 - ms0 > 90.0 + 1e-6 AS reverted FROM q_moved)""")


def greedy(prefix: str, source: str, threshold: str = "0.6", keys: str = "run_id",
           extra: str = "") -> None:
    """Greedy deduplication as a loop over priority positions."""
    part(f"{prefix}_order", f"""
SELECT {keys}, candidate_id AS id, fs AS s, fe AS e, total{extra},
  row_number() OVER (PARTITION BY {keys} ORDER BY total DESC, fs, candidate_id) AS n
FROM {source}""")
    iou = ("CASE WHEN least(k.e, c.e) - greatest(k.s, c.s) <= 0 THEN 0 ELSE "
           "(least(k.e, c.e) - greatest(k.s, c.s)) / ((k.e - k.s) + (c.e - c.s) "
           "- (least(k.e, c.e) - greatest(k.s, c.s))) END")
    hits = f"list_filter(t.kept, lambda k: {iou} >= {threshold} - 1e-9)"
    part(f"{prefix}_steps", f"""
SELECT {keys}, n, id, s, e, total, NULL::VARCHAR AS kept_id, NULL::DOUBLE AS kept_total,
  NULL::DOUBLE AS iou, [{{'id': id, 's': s, 'e': e, 'total': total}}] AS kept
FROM {prefix}_order WHERE n = 1
 UNION ALL 
SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.n, c.id, c.s, c.e, c.total,
  {hits}[1].id, {hits}[1].total,
  list_transform({hits}, lambda k: {iou})[1],
  CASE WHEN len({hits}) > 0 THEN t.kept
       ELSE list_append(t.kept, {{'id': c.id, 's': c.s, 'e': c.e, 'total': c.total}}) END
FROM {prefix}_steps t JOIN {prefix}_order c USING ({keys}) WHERE c.n = t.n + 1""")


part("q_survivors", "SELECT * FROM q_snapped WHERE reasons = '' AND total + 1e-6 >= 65.0")
greedy("q_dedup", "q_survivors")
part("q_ranked", """
SELECT *, CASE WHEN kept_id IS NULL THEN row_number() OVER (
    PARTITION BY run_id, kept_id IS NULL ORDER BY total DESC, s, id) END AS rk FROM q_dedup_steps""")
part("q_outcomes", """
SELECT p.*, r.kept_id, r.kept_total, r.iou,
  CASE WHEN reasons <> '' THEN 'invalid' WHEN p.total + 1e-6 < 65.0 THEN 'below_min_score'
       WHEN r.kept_id IS NOT NULL THEN 'deduplicated' WHEN r.rk > 5 THEN 'not_in_top_n'
       ELSE 'selected' END AS outcome,
  CASE WHEN r.rk <= 5 THEN r.rk END AS rank
FROM q_snapped p LEFT JOIN q_ranked r ON r.run_id = p.run_id AND r.id = p.candidate_id""")
part("q_selected", "SELECT * FROM q_outcomes WHERE outcome = 'selected'")

# --- raw transcripts ---------------------------------------------------------------------
part("q_raw_runs", """
SELECT run_id, CASE WHEN run_id % 29 = 0 THEN 0 ELSE duration_ms END / 1000.0::DOUBLE AS duration,
  CASE WHEN run_id % 19 = 0 THEN NULL WHEN run_id % 23 = 0 THEN duration_ms + 700
       WHEN run_id % 23 = 1 THEN duration_ms + 500 ELSE duration_ms END / 1000.0::DOUBLE AS declared,
  CASE WHEN run_id % 97 = 0 THEN 'nan'::DOUBLE ELSE 0.98 END AS language_probability,
  ((duration_ms * (20 + run_id % 15)) // 100) / 1000.0::DOUBLE AS processing_seconds
FROM q_runs""")
part("q_raw_seg0", """
SELECT g.*, r.duration_ms, r.last_pos, (g.run_id * 31 + g.seg_pos * 17) % 101 AS h,
  coalesce(lag(g.start_ms) OVER (PARTITION BY g.run_id ORDER BY g.seg_pos), 0) AS before
FROM q_segments g JOIN q_runs r USING (run_id)""")
part("q_raw_segments", """
SELECT run_id, seg_pos,
  CASE WHEN h = 7 AND run_id % 5 = 0 THEN 'nan'::DOUBLE ELSE
    CASE WHEN h = 0 THEN before - 30 WHEN h = 3 THEN before - 200 ELSE start_ms END
    / 1000.0::DOUBLE END AS s,
  CASE WHEN h = 8 AND run_id % 5 = 1 THEN 'inf'::DOUBLE ELSE
    CASE WHEN h = 1 THEN end_ms + 40 WHEN h = 6 THEN end_ms - 30
         WHEN h = 2 AND seg_pos = last_pos THEN duration_ms + 45 ELSE end_ms END
    / 1000.0::DOUBLE END AS e,
  CASE WHEN h = 4 THEN '   ' WHEN h = 5 THEN replace(text, ' ', '  ') ELSE ' ' || text END AS text
FROM q_raw_seg0""")
part("q_raw_words", """
SELECT run_id, seg_pos, word_pos, word,
  CASE WHEN h = 0 THEN before - 20 WHEN h = 2 AND run_id % 3 = 0 THEN before - 120
       ELSE start_ms END / 1000.0::DOUBLE AS s,
  CASE WHEN h = 1 THEN end_ms + 45 WHEN h = 3 THEN start_ms - 30 ELSE end_ms END
    / 1000.0::DOUBLE AS e,
  CASE WHEN h = 5 THEN NULL WHEN h = 6 AND run_id % 7 = 0 THEN 'nan'::DOUBLE ELSE 0.9 END AS prob
FROM (SELECT *, (run_id * 13 + seg_pos * 7 + word_pos * 29) % 1009 AS h,
        coalesce(lag(start_ms) OVER (PARTITION BY run_id, seg_pos ORDER BY word_pos), start_ms)
          AS before FROM q_words)""")
_CLEAN = r"trim(regexp_replace({}, '[\s\x{{a0}}\x{{85}}\x{{1c}}-\x{{1f}}\p{{Z}}]+', ' ', 'g'))"


def clean(column: str) -> str:
    return _CLEAN.format(column)


_FAR = "0.05 + 1e-9"


def clamp(source: str, low: str, high: str) -> str:
    return f"""
SELECT *, CASE WHEN NOT isfinite(s) THEN 'start_not_finite'
    WHEN NOT isfinite(e) THEN 'end_not_finite'
    WHEN prob IS NOT NULL AND NOT isfinite(prob) THEN 'probability_not_finite'
    WHEN lo - s > {_FAR} THEN 'start_before_floor' WHEN s1 - hi > {_FAR} THEN 'start_beyond_ceiling'
    WHEN cs - e > {_FAR} THEN 'end_before_start' WHEN e1 - hi > {_FAR} THEN 'end_beyond_ceiling'
  END AS problem,
  CASE WHEN e1 > hi THEN hi ELSE e1 END AS ce,
  list_filter([CASE WHEN s < lo THEN ': raised ' || s || ' to ' || lo END,
    CASE WHEN s1 > hi THEN ': lowered ' || s1 || ' to ' || hi END,
    CASE WHEN e < cs THEN ': raised ' || e || ' to ' || cs END,
    CASE WHEN e1 > hi THEN ': lowered ' || e1 || ' to ' || hi END], lambda x: x IS NOT NULL) AS notes
FROM (SELECT *, CASE WHEN e < cs THEN cs ELSE e END AS e1 FROM (
  SELECT *, CASE WHEN s1 > hi THEN hi ELSE s1 END AS cs FROM (
    SELECT *, CASE WHEN s < lo THEN lo ELSE s END AS s1 FROM (
      SELECT *, {low} AS lo, {high} AS hi FROM {source}))))"""


part("q_cseg0", f"""
SELECT g.*, r.duration, NULL::DOUBLE AS prob, {clean('g.text')} AS clean,
  max(g.s) OVER (PARTITION BY g.run_id ORDER BY g.seg_pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx
FROM q_raw_segments g JOIN q_raw_runs r USING (run_id)""")
part("q_cseg", clamp("q_cseg0", "least(greatest(0.0::DOUBLE, coalesce(mx, 0)), duration)",
                     "duration"))
part("q_cword0", """
SELECT w.*, g.cs AS gs, g.ce AS ge, max(w.s) OVER (PARTITION BY w.run_id, w.seg_pos
    ORDER BY w.word_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx
FROM q_raw_words w JOIN q_cseg g USING (run_id, seg_pos) WHERE g.clean <> ''""")
part("q_cword", clamp("q_cword0", "least(greatest(gs, coalesce(mx, gs)), ge)", "ge"))
part("q_gate", """
SELECT *, CASE WHEN NOT isfinite(duration) THEN 'duration_not_finite'
  WHEN duration <= 0 THEN 'duration_not_positive'
  WHEN NOT isfinite(language_probability) THEN 'language_probability_not_finite'
  WHEN declared IS NOT NULL AND NOT isfinite(declared) THEN 'declared_not_finite'
  WHEN abs(declared - duration) > 0.5 + 1e-9 THEN 'declared_disagrees' END AS problem
FROM q_raw_runs""")
part("q_refused", """
SELECT run_id, min({'a': seg_pos, 'b': part, 'c': problem}) AS f FROM (
  SELECT run_id, -1 AS seg_pos, 0 AS part, problem FROM q_gate
  UNION ALL SELECT run_id, seg_pos, 0, problem FROM q_cseg
  UNION ALL SELECT run_id, seg_pos, word_pos + 1, problem FROM q_cword)
WHERE problem IS NOT NULL GROUP BY run_id""")


def sweep_parts() -> None:
    greedy("q_sweep", "q_sweep_in", threshold="c.iou_limit", keys="policy_id, run_id",
           extra=", iou_limit")
