"""SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

#: The rules of quality_rules.RATIOS as SQL over the base counts: name, expression, reach, slack below, slack above.
_RATIOS = (
    ("symbol_permille", "1000 * n_symbols // greatest(word_chars, 1)", 3, None, 80),
    ("dup_line_permille", "1000 * n_dup_lines // greatest(n_lines, 1)", 3, None, 400),
    ("repeat_permille", "1000 * n_repeat_words // greatest(n_words, 1)", 3, None, 300),
    ("word_length_tenths", "10 * word_chars // greatest(n_words, 1)", 6, 15, 60),
)


def _quartiles(keys: str, name: str) -> str:
    by = f"{keys}, ratio" if keys else "ratio"
    return f"""{name} AS (SELECT {by}, max(size) AS size, min(CASE WHEN 4 * upto >= size THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * size THEN bucket END) AS q3, min(CASE WHEN 1000 * upto >= 990 * size THEN bucket END) AS tail
  FROM (SELECT {by}, bucket, (sum(n) OVER (PARTITION BY {by} ORDER BY bucket))::BIGINT AS upto, (sum(n) OVER (PARTITION BY {by}))::BIGINT AS size FROM (SELECT {by}, bucket, sum(n) AS n FROM sketches GROUP BY ALL)) GROUP BY {by})"""


def _op8() -> str:
    sketches = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS ratio, {rule} AS v FROM counts WHERE NOT base_failed" for name, rule, *_ in _RATIOS)
    drawn = ", ".join(f"(o.size * o.{q} + 200 * ((l.size * l.{q} + 200 * a.{q}) // (l.size + 200))) // (o.size + 200) AS {q}" for q in ("q1", "q3", "tail"))
    tail = "tail + (1::BIGINT << greatest(length(bin(tail)) - 7, 0)::INTEGER)"
    upper = lambda name, reach, above: f"least(q3 + {reach} * (q3 - q1) + {above}, {tail})" if name != "word_length_tenths" else f"q3 + {reach} * (q3 - q1) + {above}"
    low = [f"coalesce({rule} >= max(CASE WHEN ratio = '{name}' THEN q1 - {reach} * (q3 - q1) - {below} END), true)" for name, rule, reach, below, _ in _RATIOS if below is not None]
    high = [f"coalesce({rule} <= max(CASE WHEN ratio = '{name}' THEN {upper(name, reach, above)} END), true)" for name, rule, reach, _, above in _RATIOS if above is not None]
    counts = "n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed"
    return rf"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c
  FROM (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM parts))),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM windows WHERE c > 1) GROUP BY rid),
raw AS (
  SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN repeated USING (rid)),
counts AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM raw),
sketches AS (SELECT lang, source, ratio, (v >> s) << s AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - 7, 0)::INTEGER AS s FROM ({sketches})) GROUP BY ALL),
{_quartiles("lang, source", "own")}, {_quartiles("lang", "langs")}, {_quartiles("", "overall")},
levels AS (SELECT o.lang, o.source, o.ratio, {drawn} FROM own o JOIN langs l ON o.lang IS NOT DISTINCT FROM l.lang AND o.ratio = l.ratio JOIN overall a ON o.ratio = a.ratio)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(low + high)} AS kept
FROM counts c LEFT JOIN levels v ON c.lang IS NOT DISTINCT FROM v.lang AND c.source IS NOT DISTINCT FROM v.source
GROUP BY rid, doc_id, {counts}"""


def _op9() -> str:
    draw = "('0x' || substr(md5('17:' || pass || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT"
    return rf"""
WITH counted AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
sources AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_docs FROM counted GROUP BY source),
shares AS (SELECT tokens / (SELECT sum(tokens) FROM sources) AS p FROM sources WHERE tokens > 0),
grid AS (SELECT k, ln(sum(pow(p, k / 1e6))) - sum(pow(p, k / 1e6) * (k / 1e6) * ln(p)) / sum(pow(p, k / 1e6)) AS h,
         max(pow(p, k / 1e6) / p) / sum(pow(p, k / 1e6)) AS r FROM shares, range(0, 1000001) g(k) GROUP BY k),
target AS (SELECT max(k) AS k FROM grid WHERE h >= 0.5 * (SELECT h FROM grid WHERE k = 0) + 0.5 * (SELECT h FROM grid WHERE k = 1000000)),
chosen AS (SELECT CASE WHEN (SELECT r FROM grid WHERE k = t.k) <= 4 THEN t.k ELSE least(1000000, (SELECT max(k) FROM grid WHERE r > 4) + 1) END AS k FROM target t),
weights AS (SELECT s.*, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM sources), (SELECT k FROM chosen) / 1e6) ELSE 0 END AS w FROM sources s),
allotted AS (SELECT *, floor(w / (SELECT sum(w) FROM weights) * (SELECT sum(tokens) FROM sources))::BIGINT AS allotment FROM weights),
plan AS (SELECT source, CASE WHEN tokens > 0 THEN allotment // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN allotment % tokens ELSE 0 END AS rest, greatest(n_docs // 2048, 1) AS blocks FROM allotted),
passes AS (SELECT c.*, p.whole, p.rest, p.blocks, unnest(range(0, p.whole + 1)) AS pass FROM counted c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source),
dealt AS (SELECT *, draw % blocks AS block FROM (SELECT *, {draw} AS draw FROM passes WHERE pass < whole OR rest > 0)),
slots AS (SELECT *, row_number() OVER (PARTITION BY source, pass, block ORDER BY draw, doc_id, n_tokens) AS slot,
          sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY block, draw, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM dealt)
SELECT doc_id, source, pass::INTEGER AS pass, block::INTEGER AS block, slot::INTEGER AS slot, n_tokens FROM slots WHERE pass < whole OR upto <= rest"""


_OP1 = """
WITH RECURSIVE calls AS (SELECT conv_id, turn, text, conv_id || '-' || turn AS call_id, conv_id || '-' || (turn - 2) AS need FROM conversations WHERE role = 'user'),
results AS (SELECT conv_id, turn, text, conv_id || '-' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
chain AS (SELECT call_id, 0 AS level FROM calls WHERE turn < 2 OR need NOT IN (SELECT call_id FROM calls)
  UNION ALL SELECT c.call_id, k.level + 1 FROM calls c JOIN chain k ON c.need = k.call_id WHERE c.turn >= 2),
linked AS (SELECT c.conv_id, c.call_id, c.turn, c.text, r.turn AS result_turn, r.text AS result, k.level,
    CASE WHEN c.turn >= 2 THEN '[' || to_json(c.need) || ']' ELSE '[]' END AS needs,
    concat_ws('; ', CASE WHEN c.text IS NULL THEN 'missing n_chars' END, CASE WHEN c.text IS NULL THEN 'missing text' END,
      CASE WHEN c.turn >= 2 AND c.need NOT IN (SELECT call_id FROM calls) THEN 'unknown need' END, CASE WHEN r.turn IS NULL THEN 'no result' END) AS errors
  FROM calls c JOIN chain k USING (call_id) LEFT JOIN results r USING (call_id)),
canon AS (SELECT *, '{"arguments":{' || concat_ws(',', CASE WHEN text IS NOT NULL THEN '"n_chars":' || length(text) END, CASE WHEN length(text) > 200 THEN '"style":"long"' END,
    CASE WHEN text IS NOT NULL THEN '"text":' || to_json(text) END) || '},"id":' || to_json(call_id) || ',"name":"reply","needs":' || needs || ',"result":' || coalesce(to_json(result), 'null') || '}' AS canonical FROM linked)
SELECT conv_id, call_id, 'reply' AS name, turn AS call_turn, coalesce(result_turn, -1) AS result_turn, level::INTEGER AS level, errors = '' AS valid, errors, md5(canonical) AS canonical_md5 FROM canon
UNION ALL SELECT conv_id, call_id, NULL, -1, turn, -1, false, 'no call', md5('{"id":' || to_json(call_id) || ',"result":' || coalesce(to_json(text), 'null') || '}')
FROM results WHERE call_id NOT IN (SELECT call_id FROM calls)"""


_OP11 = r"""
WITH marked AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM texts),
masks AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f, i: [a, b, c, d, e][i]) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM failed LEFT JOIN marked USING (doc_id)),
counters AS (SELECT part, fails, count(*) AS n, sum(good)::BIGINT AS n_good, sum(toxic)::BIGINT AS n_toxic FROM masks GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (SELECT filter_order, s.step AS step, substr(filter_order, s.step, 1) AS f, string_split(left(filter_order, s.step - 1), '') AS before FROM orders, range(1, 6) s(step)),
told AS (SELECT *, list_contains(fails, f) AS hit, list_has_any(fails, before) AS gone FROM counters, steps)
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = [f]), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(len(fails), 1))) FILTER (hit), 0)::BIGINT AS shapley
FROM told GROUP BY part, filter_order, step"""


_OP13 = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
cuts AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS one, greatest(h1 % (n + 1), h2 % (n + 1)) AS two,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
pieces AS (SELECT *, substr(t, 1, one) AS prefix, substr(t, one + 1, two - one) AS middle, substr(t, two + 1) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN one END AS prefix_chars, CASE WHEN form <> 'plain' THEN two - one END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces"""


ORACLE = {"op1_tool_call_linking": _OP1, "tool_calls_of_json": _OP1, "op8_quality_rules": _op8(), "op8_quality_tails": _op8(), "op9_source_mixing": _op9(), "op11_filter_interaction_audit": _OP11, "op13_fill_in_middle": _OP13}
