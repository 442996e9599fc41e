"""DuckDB SQL text for the oracle side of every registered query.

The builders mirror ``quarry.functions.text`` and share its regular expressions,
so both engines evaluate the same PHP semantics independently: Spark over the
generic ordered-cells model, DuckDB over the fixture's wide columns.
"""

from __future__ import annotations

import html.entities

from ..functions import text as T
from ..functions.constants import (DEFAULT_CORRECT_MARK, DEFAULT_INCORRECT_MARK, MSG_MISSING_QUESTION,
                                   MSG_NO_OPTIONS, MSG_NOTICE, MSG_UNMATCHED)


def lit(s: str) -> str:
    """A DuckDB string literal (backslashes are literal in DuckDB strings)."""
    return "'" + s.replace("'", "''") + "'"


def php_trim(x: str) -> str:
    return f"regexp_replace({x}, {lit(T.PHP_TRIM_RE)}, '', 'g')"


def ascii_lower(x: str) -> str:
    return f"translate({x}, '{T.UPPER}', '{T.LOWER}')"


def normalize(x: str) -> str:
    c = f"coalesce(CAST({x} AS VARCHAR), '')"
    c = f"regexp_replace({c}, {lit(T.ENTITY_SPACE_RE)}, ' ', 'g')"
    c = f"regexp_replace({c}, {lit(T.ENTITY_GONE_RE)}, '', 'g')"
    c = f"regexp_replace({c}, {lit(T.INVISIBLE_RE)}, ' ', 'g')"
    c = f"regexp_replace({c}, {lit(T.CONTROL_RE)}, '', 'g')"
    c = f"regexp_replace({c}, {lit(T.SPACE_RUN_RE)}, ' ', 'g')"
    return php_trim(c)


def normalize_full(x: str) -> str:
    """With every entity: the text is cut at ampersands and each piece is looked up."""
    table = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    names, texts = ", ".join(map(quoted, table)), ", ".join(map(quoted, table.values()))
    ref = "regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);', 1)"
    num = ("CASE WHEN r LIKE '#x%' OR r LIKE '#X%' THEN TRY_CAST('0x' || ltrim(r[3:], '0') AS BIGINT) "
           "WHEN r LIKE '#%' THEN TRY_CAST(r[2:] AS BIGINT) END")
    good = ("(n BETWEEN 32 AND 126 OR n IN (9, 10, 12) OR n BETWEEN 160 AND 55295 OR n BETWEEN 57344 AND 64975 "
            "OR n BETWEEN 65008 AND 1114111 AND n % 65536 < 65534)")
    return f"""(WITH t AS (SELECT coalesce(CAST({x} AS VARCHAR), '') AS v),
s AS (SELECT unnest(string_split(v, '&')) AS p, generate_subscripts(string_split(v, '&'), 1) AS i FROM t),
r AS (SELECT p, i, {ref} AS r FROM s), n AS (SELECT *, {num} AS n FROM r),
e AS (SELECT i, CASE WHEN i = 1 THEN p ELSE coalesce(CASE WHEN {good} THEN chr(n::INTEGER)
        ELSE MAP([{names}], [{texts}])[r] END || p[length(r) + 2:], '&' || p) END AS o FROM n),
d AS (SELECT string_agg(o, '' ORDER BY i) AS o FROM e),
u AS (SELECT regexp_replace(regexp_replace(regexp_replace(o, '[\\x{{A0}}\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}]', ' ', 'g'),
        '\\p{{C}}+', '', 'g'), '\\p{{Z}}+', ' ', 'g') AS o FROM d)
SELECT trim(o, ' ') FROM u)"""


def strip_all_tags(x: str) -> str:
    c = f"regexp_replace(regexp_replace({x}, {lit(T.SCRIPT_STYLE_RE)}, '', 'g'), {lit(T.TAG_RE)}, '', 'g')"
    return php_trim(c)


def sanitize(x: str) -> str:
    c = f"coalesce({x}, '')"
    c = f"regexp_replace(regexp_replace({c}, {lit(T.SCRIPT_STYLE_RE)}, '', 'g'), {lit(T.TAG_RE)}, '', 'g')"
    c = f"regexp_replace({c}, {lit(T.TEXT_FIELD_SPACE_RE)}, ' ', 'g')"
    for _ in range(3):
        c = f"regexp_replace({c}, {lit(T.PERCENT_OCTET_RE)}, '', 'g')"
    return php_trim(f"regexp_replace({c}, ' +', ' ', 'g')")


def kses(x: str) -> str:
    c = f"coalesce({x}, '')"
    return (f"regexp_replace(regexp_replace({c}, {lit(T.SCRIPT_STYLE_RE)}, '', 'g'), "
            f"{lit(T.EVENT_ATTR_RE)}, '', 'g')")


def is_numeric(x: str) -> str:
    return f"coalesce(regexp_matches({x}, {lit(T.NUMERIC_RE)}), false)"


def floatval(x: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract(coalesce({x}, ''), {lit(T.LEADING_NUMBER_RE)}, 1) AS DOUBLE), 0.0)"


def intval(x: str) -> str:
    """Digits are read by a pattern of their own; HUGEINT holds what BIGINT can't."""
    lead = f"regexp_extract(coalesce({x}, ''), {lit(T.LEADING_NUMBER_RE)}, 1)"
    digits = f"regexp_extract(coalesce({x}, ''), '^[ \\t\\n\\r\\x0B\\f]*([+-]?[0-9]+)', 1)"
    exact = (f"CAST(greatest(least(coalesce(TRY_CAST({digits} AS HUGEINT), CASE WHEN {digits} = '' THEN 0 "
             f"WHEN {digits} LIKE '-%' THEN -9223372036854775808 ELSE 9223372036854775807 END), "
             f"9223372036854775807), -9223372036854775808) AS BIGINT)")
    return (f"(CASE WHEN regexp_matches({lead}, '[.eE]') THEN coalesce(TRY_CAST(trunc({floatval(x)}) AS BIGINT), 0) "
            f"ELSE {exact} END)")


# ---------------------------------------------------------------------------
# Fixtures (FIXTURES.md §3)
# ---------------------------------------------------------------------------
INV = "(chr(160) || chr(8203))"

QF = f"""
SELECT p_partkey AS k, p_partkey % 20 AS import_id, 'file_' || CAST(p_partkey % 20 AS VARCHAR) AS file_name,
       p_partkey AS rec_no, p_partkey + 2 AS orig_row, p_type,
       CASE WHEN p_partkey % 13 = 0 THEN {INV} WHEN p_partkey % 11 = 0 THEN '   ' ELSE p_name END AS question,
       CASE WHEN p_partkey % 13 = 0 THEN {INV} WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS option1,
       CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN '' ELSE p_brand END AS option2,
       CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 OR p_partkey % 4 = 0 THEN '' ELSE p_type END AS option3,
       CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS option4,
       CASE WHEN p_partkey % 13 = 0 THEN ''
            WHEN p_partkey % 9 = 0 THEN p_brand
            WHEN p_partkey % 9 = 1 THEN lower(p_type)
            WHEN p_partkey % 9 = 2 THEN '3'
            WHEN p_partkey % 9 = 3 THEN 'B'
            WHEN p_partkey % 9 = 4 THEN 'Option 2'
            WHEN p_partkey % 9 = 5 THEN substr(p_name, 1, 3)
            WHEN p_partkey % 9 = 6 THEN 'zzz'
            WHEN p_partkey % 9 = 7 THEN ''
            ELSE '10' END AS correct_answer
FROM part
"""


def ladder_cols(opts: str, raw: str) -> str:
    """SELECT-list fragment computing correct_index and match_method."""
    rt = php_trim(raw)
    exact = f"coalesce(list_position(list_transform({opts}, lambda o: lower({php_trim('o')})), lower({rt})), 0)"
    num = f"TRY_CAST(regexp_extract({rt}, '[0-9]+', 0) AS BIGINT)"
    letter = f"regexp_extract({rt}, '[a-fA-F]', 0)"
    num_ok = f"coalesce({num} BETWEEN 1 AND 6, false)"
    parsed = f"(CASE WHEN {num_ok} THEN {num} WHEN {letter} <> '' THEN ascii(upper({letter})) - 64 ELSE 0 END)"
    parsed_ok = f"({parsed} > 0 AND {parsed} <= len({opts}))"
    sub = (f"coalesce(list_position(list_transform({opts}, lambda o: strpos({ascii_lower(php_trim('o'))}, "
           f"{ascii_lower(rt)}) > 0), true), 0)")
    idx = (f"CAST(CASE WHEN {raw} = '' THEN 0 WHEN {exact} > 0 THEN {exact} WHEN {parsed_ok} THEN {parsed} "
           f"WHEN {sub} > 0 THEN {sub} ELSE 0 END AS INTEGER)")
    method = (f"CASE WHEN {raw} = '' THEN 'blank' WHEN {exact} > 0 THEN 'exact' "
              f"WHEN {parsed_ok} AND {num_ok} THEN 'number' WHEN {parsed_ok} THEN 'letter' "
              f"WHEN {sub} > 0 THEN 'substring' ELSE 'none' END")
    return f"{idx} AS correct_index, {method} AS match_method"


def opts_of(cols: list[str]) -> str:
    arr = "[" + ", ".join(cols) + "]"
    return (f"list_transform(list_filter({arr}, lambda x: {php_trim('x')} <> ''), "
            f"lambda x: {sanitize(php_trim('x'))})")


def evaluated(qf: str = QF, opts_cols=("option1", "option2", "option3", "option4"),
              raw: str | None = None, blank_cols=None, extra_content: str = "false",
              opts: str | None = None) -> str:
    """CTEs ``qf``, ``ev0`` (non-blank rows with opts / raw) and ``ev`` (+ ladder, status)."""
    cols = blank_cols or (["question"] + list(opts_cols) + ["correct_answer"])
    blank = " AND ".join(f"{normalize(c)} = ''" for c in cols)
    raw = raw or f"CASE WHEN {php_trim('correct_answer')} <> '' THEN correct_answer ELSE '' END"
    opts = opts or opts_of(list(opts_cols))
    return f"""
qf AS ({qf}),
ev0 AS (
  SELECT *, {php_trim('question')} AS question_text, {opts} AS opts, {raw} AS correct_raw
  FROM qf WHERE NOT ({blank}) OR {extra_content}
),
ev1 AS (
  SELECT *, CASE WHEN question_text = '' THEN 'missing_question' WHEN len(opts) = 0 THEN 'no_options'
                 ELSE 'ok' END AS row_status,
         {ladder_cols('opts', 'correct_raw')}
  FROM ev0
),
ev AS (
  SELECT * REPLACE (CASE WHEN row_status = 'ok' THEN correct_index ELSE 0 END AS correct_index,
                    CASE WHEN row_status = 'ok' THEN match_method END AS match_method),
         CASE WHEN row_status = 'missing_question' THEN printf({lit(MSG_MISSING_QUESTION)}, orig_row)
              WHEN row_status = 'no_options' THEN printf({lit(MSG_NO_OPTIONS)}, orig_row)
              WHEN row_status = 'ok' AND match_method = 'none'
                   THEN printf({lit(MSG_UNMATCHED)}, orig_row, {sanitize('correct_raw')}) END AS message,
         CASE WHEN row_status <> 'ok' THEN 'error' WHEN match_method = 'none' THEN 'warning' END AS severity,
         CASE WHEN row_status = 'missing_question' THEN 'E1' WHEN row_status = 'no_options' THEN 'E2'
              WHEN match_method = 'none' THEN 'E3' END AS code
  FROM ev1
)"""


QA = f"""
SELECT * REPLACE (CASE WHEN k % 4 = 1 THEN p_type ELSE option1 END AS option1),
       CASE WHEN k % 5 = 0 THEN 'note' END AS note, k % 7 AS km7
FROM ({QF})
"""


MANIFEST = """
SELECT CAST(n_nationkey AS BIGINT) AS import_id, 'file_' || CAST(n_nationkey AS VARCHAR) AS file_name,
       CAST(1 AS BIGINT) AS uploader_id, n_nationkey < 10 AS has_taxonomy, n_regionkey, n_name,
       CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS p_quiz,
       CASE n_nationkey % 4 WHEN 0 THEN CAST(n_regionkey + 1 AS VARCHAR) WHEN 1 THEN n_name
            WHEN 2 THEN '' ELSE '0' END AS p_category,
       CASE n_nationkey % 3 WHEN 0 THEN '4' WHEN 1 THEN '' ELSE 'abc' END AS p_points_correct,
       CASE WHEN n_nationkey % 5 = 0 THEN '-1' ELSE '' END AS p_points_incorrect,
       CASE WHEN n_nationkey % 7 = 0 THEN '1' ELSE '' END AS p_type
FROM nation
"""


def params_resolved() -> str:
    """CTEs ``man`` and ``params``."""
    quiz_val = php_trim("p_quiz")
    cat = f"CASE WHEN {php_trim('p_category')} <> '' THEN {sanitize('p_category')} ELSE '' END"
    cm = (f"CASE WHEN {php_trim('p_points_correct')} <> '' AND {is_numeric(sanitize('p_points_correct'))} "
          f"THEN {floatval(sanitize('p_points_correct'))} ELSE {DEFAULT_CORRECT_MARK} END")
    im = (f"CASE WHEN {php_trim('p_points_incorrect')} <> '' AND {is_numeric(sanitize('p_points_incorrect'))} "
          f"THEN {floatval(sanitize('p_points_incorrect'))} ELSE {DEFAULT_INCORRECT_MARK} END")
    qtype = f"CASE WHEN {is_numeric('p_type')} THEN {intval('p_type')} ELSE 0 END"
    return f"""
man AS ({MANIFEST}),
qz AS (SELECT CAST(n_nationkey AS BIGINT) AS quiz_id, n_name AS quiz_name FROM nation),
qz_by_name AS (SELECT quiz_name, min(quiz_id) AS named_id FROM qz GROUP BY quiz_name),
params0 AS (
  SELECT m.*, {cat} AS category_input, CAST({qtype} AS BIGINT) AS question_type,
         CAST({cm} AS DOUBLE) AS correct_mark, CAST({im} AS DOUBLE) AS incorrect_mark,
         CAST(CASE WHEN {quiz_val} = '' THEN 0
                   WHEN {is_numeric(quiz_val)} THEN {intval(quiz_val)}
                   WHEN coalesce(b.named_id, 0) <> 0 THEN b.named_id ELSE 0 END AS BIGINT) AS quiz_id
  FROM man m LEFT JOIN qz_by_name b ON b.quiz_name = {php_trim('m.p_quiz')}
),
params AS (
  SELECT p.*, {is_numeric('p.category_input')} AS category_is_numeric,
         CASE WHEN p.quiz_id > 0 THEN coalesce((SELECT min(quiz_name) FROM qz WHERE qz.quiz_id = p.quiz_id), '')
              ELSE '' END AS quiz_name
  FROM params0 p
)"""


def scored(qf: str = QF) -> str:
    """CTEs for evaluated rows joined to params, with ids for accepted rows."""
    return f"""{evaluated(qf)},
{params_resolved()},
sc AS (
  SELECT ev.*, p.quiz_id, p.quiz_name, p.category_input, p.category_is_numeric, p.question_type,
         p.correct_mark, p.incorrect_mark, p.has_taxonomy,
         CASE WHEN row_status = 'ok' THEN row_number() OVER (PARTITION BY row_status = 'ok'
                                                            ORDER BY ev.import_id, orig_row, rec_no) END AS question_id
  FROM ev LEFT JOIN params p ON p.import_id = ev.import_id
)"""


def import_log_summary(qf: str = QF) -> str:
    return f"""WITH {scored(qf)},
cnt AS (
  SELECT import_id, count(*) AS total_rows, count(*) FILTER (WHERE row_status <> 'ok') AS failed_rows,
         count(*) FILTER (WHERE row_status = 'ok') AS success_rows,
         count(*) FILTER (WHERE message IS NOT NULL) AS n_errors,
         count(*) FILTER (WHERE severity = 'warning') AS n_warnings,
         min(question_id) AS first_question_id, max(question_id) AS last_question_id
  FROM sc GROUP BY import_id
)
SELECT p.import_id AS id, p.file_name, p.uploader_id, p.quiz_id, p.quiz_name,
       CASE WHEN coalesce(c.failed_rows, 0) > 0 THEN 'Partial' ELSE 'Success' END AS status,
       CAST(coalesce(c.total_rows, 0) AS BIGINT) AS total_rows,
       CAST(coalesce(c.success_rows, 0) AS BIGINT) AS success_rows,
       CAST(coalesce(c.failed_rows, 0) AS BIGINT) AS failed_rows,
       CAST(c.first_question_id AS BIGINT) AS first_question_id,
       CAST(c.last_question_id AS BIGINT) AS last_question_id,
       CAST(coalesce(c.n_errors, 0) AS BIGINT) AS n_errors,
       CAST(coalesce(c.n_warnings, 0) AS BIGINT) AS n_warnings,
       CASE WHEN coalesce(c.failed_rows, 0) > 0 THEN 'warning' ELSE 'success' END AS notice_level,
       printf({lit(MSG_NOTICE)}, coalesce(c.success_rows, 0), coalesce(c.failed_rows, 0),
              CAST(p.import_id AS VARCHAR)) AS notice
FROM params p LEFT JOIN cnt c ON c.import_id = p.import_id"""


def _base_cols() -> list[str]:
    return ["question", "option1", "option2", "option3", "option4", "correct_answer"]


def blank_rows() -> str:
    blank = " AND ".join(f"{normalize(c)} = ''" for c in _base_cols())
    return f"SELECT import_id, rec_no, orig_row FROM ({QF}) WHERE {blank}"


def blank_rows_trim_only() -> str:
    nonblank = " OR ".join(f"{php_trim(c)} <> ''" for c in _base_cols())
    return f"""SELECT import_id, rec_no,
       CAST(row_number() OVER (PARTITION BY import_id ORDER BY rec_no) AS BIGINT) AS parser_row
FROM ({QF}) WHERE {nonblank}"""


def parse_meta() -> str:
    trim_ok = " OR ".join(f"{php_trim(c)} <> ''" for c in _base_cols())
    norm_ok = " OR ".join(f"{normalize(c)} <> ''" for c in _base_cols())
    return f"""SELECT import_id, count(*) AS total_before_filter,
       count(*) FILTER (WHERE {trim_ok}) AS total_after_filter,
       count(*) FILTER (WHERE {norm_ok}) AS effective_rows
FROM ({QF}) GROUP BY import_id"""


def options_compacted() -> str:
    return f"""WITH {evaluated()}
SELECT import_id, orig_row, CAST(opt_no AS BIGINT) AS opt_no, opt_text FROM (
  SELECT import_id, orig_row, unnest(opts) AS opt_text, unnest(range(1, len(opts) + 1)) AS opt_no FROM ev)"""


def correct_source() -> str:
    raw = (f"CASE WHEN km7 <> 6 AND {php_trim('correct_answer')} <> '' THEN correct_answer "
           f"WHEN note IS NOT NULL THEN note "
           f"WHEN {php_trim('correct_answer')} <> '' THEN correct_answer ELSE '' END")
    numbered = opts_of(["option1", "option2", "option3", "option4"])
    # Without numbered options the prefix fallback (F14) also takes ``answer_correct``.
    opts = f"CASE WHEN len({numbered}) = 0 AND km7 = 2 THEN {opts_of(['correct_answer'])} ELSE {numbered} END"
    return f"""WITH {evaluated(QA, raw=raw, extra_content='note IS NOT NULL', opts=opts)}
SELECT import_id, orig_row, correct_raw, row_status, correct_index, match_method,
       array_to_string(opts, '|') AS opts_text FROM ev"""


def correct_index() -> str:
    return f"""WITH {evaluated()}
SELECT import_id, orig_row, row_status, correct_index, match_method FROM ev"""


def match_method_counts() -> str:
    return f"""WITH {evaluated()}
SELECT row_status, match_method, count(*) AS n FROM ev GROUP BY ALL"""


def answers_scored_long() -> str:
    return f"""WITH {scored()}
SELECT question_id, import_id, orig_row, CAST(opt_no AS BIGINT) AS opt_no, text,
       CAST(CASE WHEN opt_no = correct_index THEN correct_mark ELSE incorrect_mark END AS DOUBLE) AS points,
       CAST(CASE WHEN opt_no = correct_index THEN 1 ELSE 0 END AS INTEGER) AS is_correct
FROM (SELECT *, unnest(opts) AS text, unnest(range(1, len(opts) + 1)) AS opt_no FROM sc WHERE row_status = 'ok')"""


def _category_text() -> str:
    return ("CASE WHEN category_input = '' THEN '' "
            "WHEN coalesce(has_taxonomy, false) AND category_is_numeric THEN '' ELSE category_input END")


def questions_final() -> str:
    names = ["answer_one", "answer_two", "answer_three", "answer_four", "answer_five", "answer_six"]
    wide = []
    for i, n in enumerate(names, start=1):
        wide.append(f"opts[{i}] AS {n}")
        wide.append(f"CAST(CASE WHEN len(opts) >= {i} THEN CASE WHEN correct_index = {i} THEN correct_mark "
                    f"ELSE incorrect_mark END END AS DOUBLE) AS {n}_points")
    return f"""WITH {scored()}
SELECT CAST(question_id AS BIGINT) AS question_id, import_id, orig_row, CAST(quiz_id AS BIGINT) AS quiz_id,
       '' AS question_name, {", ".join(wide)},
       CAST(correct_index AS BIGINT) AS correct_answer, '' AS question_answer_info,
       CAST(1 AS INTEGER) AS comments, '' AS hints, CAST(0 AS INTEGER) AS question_order,
       CAST(question_type AS BIGINT) AS question_type, CAST(question_type AS VARCHAR) AS question_type_new,
       question_text AS question_title, '1' AS is_published, CAST(1 AS INTEGER) AS required,
       {_category_text()} AS category, CAST(0 AS BIGINT) AS linked_question,
       CAST(0 AS INTEGER) AS deleted, CAST(0 AS INTEGER) AS deleted_question_bank
FROM sc WHERE row_status = 'ok'"""


def row_errors() -> str:
    return f"""WITH {evaluated()}
SELECT import_id, orig_row, CAST(1 AS INTEGER) AS seq, severity, code, message FROM ev WHERE message IS NOT NULL"""


def errors_by_import() -> str:
    return f"""WITH {evaluated()}
SELECT import_id, count(*) FILTER (WHERE severity = 'error') AS n_errors,
       count(*) FILTER (WHERE severity = 'warning') AS n_warnings,
       min(orig_row) AS first_row, arg_min(message, orig_row) AS first_message,
       arg_max(message, orig_row) AS last_message
FROM ev WHERE message IS NOT NULL GROUP BY import_id"""


def dry_run_report() -> str:
    return f"""WITH {evaluated()},
{params_resolved()},
agg AS (SELECT import_id, count(*) AS total_rows, count(*) FILTER (WHERE row_status = 'ok') AS valid_rows,
               count(*) FILTER (WHERE row_status <> 'ok') AS invalid_rows,
               count(*) FILTER (WHERE severity = 'warning') AS warning_rows
        FROM ev GROUP BY import_id)
SELECT p.import_id, CAST(coalesce(total_rows, 0) AS BIGINT) AS total_rows,
       CAST(coalesce(valid_rows, 0) AS BIGINT) AS valid_rows,
       CAST(coalesce(invalid_rows, 0) AS BIGINT) AS invalid_rows,
       CAST(coalesce(warning_rows, 0) AS BIGINT) AS warning_rows,
       CASE WHEN coalesce(invalid_rows, 0) > 0 THEN 'Partial' ELSE 'Success' END AS would_status
FROM params p LEFT JOIN agg a ON a.import_id = p.import_id"""


def params_resolved_q() -> str:
    return f"""WITH {params_resolved()}
SELECT import_id, quiz_id, quiz_name, category_input, category_is_numeric, question_type, correct_mark,
       incorrect_mark FROM params"""


def params_alias_order() -> str:
    """The smaller key number is looked at first; an unusable value leaves the other one."""
    def pick(n, good, second, default):
        a, b = f"(k % {n})", f"((k // {n}) % {n})"
        return (f"CASE WHEN k % 3 <> 0 THEN CASE WHEN {a} <= {b} THEN {good} ELSE {second} END "
                f"WHEN {a} <> {b} THEN {second} ELSE {default} END")
    return f"""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part)
SELECT k AS import_id, CAST({pick(6, 'k % 24 + 1', 'k * 7 % 24 + 1', '0')} AS BIGINT) AS quiz_id,
       {pick(7, "'first ' || k", "'second ' || k", "''")} AS category_input,
       CAST({pick(3, 'k % 7', 'k % 5', '0')} AS BIGINT) AS question_type,
       CAST({pick(5, 'k % 9 + 0.5', 'k % 6', '2.0')} AS DOUBLE) AS correct_mark,
       CAST({pick(5, '-(k % 4)', '-0.25', '-0.67')} AS DOUBLE) AS incorrect_mark
FROM p"""


def question_explanations() -> str:
    return f"""WITH {scored()}
SELECT import_id, orig_row,
       CASE k % 4 WHEN 0 THEN '<b>See</b> ' || {php_trim('question')} WHEN 1 THEN '<i class="x">why</i> ' || {php_trim('question')}
                  WHEN 2 THEN 'because ' || {php_trim('question')} ELSE '' END AS question_answer_info
FROM (SELECT sc.import_id, sc.orig_row, sc.row_status, qf.k, qf.question FROM sc
      JOIN ({QF}) qf ON qf.import_id = sc.import_id AND qf.rec_no = sc.rec_no) WHERE row_status = 'ok'"""


def json_rows_live() -> str:
    return """WITH e AS (SELECT event_id, event_type || '/' || CAST(CAST(floor(event_id / 100) AS BIGINT) AS VARCHAR) AS doc,
                 props FROM events),
odd AS (SELECT DISTINCT doc, unnest([0, 1, 2, 3, 4, 5]) AS pos FROM e),
items AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY event_id) AS rec_no, props FROM e)
SELECT doc, CAST(0 AS BIGINT) AS rec_no, CAST(1 AS BIGINT) AS orig_row, CAST(pos AS INTEGER) AS pos,
       ['k', 'q', 'f', 't', 'z', 'n'][pos + 1] AS key, ['', 'Array', '1.5', '1', '', '9007199254740993'][pos + 1] AS value
FROM odd
UNION ALL
SELECT doc, rec_no, rec_no + 1, CAST(0 AS INTEGER), k, json_extract_string(props, '$."' || k || '"')
FROM items, unnest(json_keys(props)) t(k)"""


def csv_edge_cases() -> str:
    big = "repeat('0123456789', 20001)"
    return f"""WITH r AS (SELECT p_partkey AS k, CAST(p_partkey % 20 AS BIGINT) AS import_id, p_name AS name,
           row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) - 1 AS rec_no FROM part),
v AS (SELECT import_id, rec_no, CASE
        WHEN k % 1000 = 6 THEN ['big', {big}, 'b', '1']
        WHEN k % 8 = 1 THEN ['', '', '', '']
        WHEN k % 8 = 2 THEN [name || chr(10) || 'second "line"' || chr(10), 'a', 'b', '2']
        WHEN k % 8 = 3 THEN [name, '', '', '']
        WHEN k % 8 = 4 THEN [name, 'a', 'b', 'c']
        WHEN k % 8 = 5 THEN ['x, "y"', name, '', '']
        WHEN k % 8 = 7 THEN ['  ' || name || '  ', ' a ', 'b', '  ']
        ELSE [name, 'a', 'b', '1'] END AS cells FROM r)
SELECT import_id, CAST(rec_no AS BIGINT) AS rec_no, CAST(rec_no + 2 AS BIGINT) AS orig_row, CAST(i - 1 AS INTEGER) AS pos,
       ['question', 'option1', 'option1', 'correct_answer'][i] AS key, md5(cells[i]) AS value_md5
FROM v, range(1, 5) t(i)"""


def category_links() -> str:
    return f"""WITH {scored()}
SELECT CAST(question_id AS BIGINT) AS question_id, CAST(quiz_id AS BIGINT) AS quiz_id,
       {intval('category_input')} AS term_id, 'qsm_category' AS taxonomy, import_id
FROM sc WHERE row_status = 'ok' AND coalesce(has_taxonomy, false) AND category_is_numeric
  AND {intval('category_input')} > 0"""


def quiz_id_by_name() -> str:
    return """WITH names AS (SELECT n_name AS quiz_name FROM nation UNION ALL SELECT r_name FROM region),
byname AS (SELECT n_name AS quiz_name, min(CAST(n_nationkey AS BIGINT)) AS quiz_id FROM nation GROUP BY n_name)
SELECT n.quiz_name, b.quiz_id FROM names n LEFT JOIN byname b ON b.quiz_name = n.quiz_name"""


POSTS = """SELECT CAST(r_regionkey + 500 AS BIGINT) AS id, r_name AS title, r_regionkey % 2 = 0 AS quiz FROM region
UNION ALL SELECT s_suppkey + 25, s_name, s_suppkey % 2 = 0 FROM supplier UNION ALL SELECT n_nationkey + 1000, n_name, true FROM nation"""


def quiz_id_by_title() -> str:
    return f"""WITH names AS (SELECT n_name AS quiz_name FROM nation UNION ALL SELECT r_name FROM region
               UNION ALL SELECT s_name FROM supplier), posts AS ({POSTS})
SELECT quiz_name, coalesce((SELECT min(n_nationkey) FROM nation WHERE n_name = quiz_name AND n_nationkey <> 0),
                           (SELECT min(id) FROM posts WHERE title = quiz_name AND quiz))::BIGINT AS quiz_id FROM names"""


def quiz_name_by_post() -> str:
    return f"""WITH posts AS ({POSTS}),
ids AS (SELECT c_custkey::BIGINT AS quiz_id FROM customer UNION SELECT r_regionkey + 500 FROM region
        UNION SELECT -r_regionkey FROM region)
SELECT quiz_id, CASE WHEN quiz_id > 0 THEN coalesce((SELECT min(n_name) FROM nation WHERE n_nationkey = quiz_id),
       (SELECT min(title) FROM posts WHERE id = quiz_id), '') ELSE '' END AS quiz_name FROM ids"""


def import_detail_posts() -> str:
    return f"""WITH posts AS ({POSTS}), l AS (SELECT id, quiz_name, uploader_id % 60 AS q FROM ({LOGS})),
n AS (SELECT id, CASE WHEN trim(quiz_name) <> '' THEN trim(quiz_name) WHEN q > 0 THEN
             coalesce((SELECT min(n_name) FROM nation WHERE n_nationkey = q),
                      (SELECT min(title) FROM posts p WHERE p.id = q), '') ELSE '' END AS name FROM l)
SELECT id, CASE WHEN name = '' THEN '— (not set) —' ELSE name END AS display_quiz_name FROM n"""


def quiz_name_lookup() -> str:
    return """WITH ids AS (SELECT DISTINCT CAST(o_custkey % 30 AS BIGINT) AS quiz_id FROM orders),
byid AS (SELECT CAST(n_nationkey AS BIGINT) AS quiz_id, min(n_name) AS quiz_name FROM nation GROUP BY 1)
SELECT i.quiz_id, CASE WHEN i.quiz_id > 0 THEN coalesce(b.quiz_name, '') ELSE '' END AS quiz_name
FROM ids i LEFT JOIN byid b ON b.quiz_id = i.quiz_id"""


def quizzes_ordered() -> str:
    return "SELECT CAST(n_nationkey AS BIGINT) AS quiz_id, n_name AS quiz_name FROM nation ORDER BY 1"


PQ = """SELECT p_partkey AS question_id,
       CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_type END AS category,
       CAST(p_size % 5 AS BIGINT) AS question_type,
       CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS question_type_new
FROM part"""


def _distinct_categories_sql() -> str:
    return f"""SELECT DISTINCT {sanitize('category')} AS category FROM (
  SELECT DISTINCT category FROM ({PQ}) WHERE category <> '' ORDER BY category LIMIT 200)
WHERE {php_trim('category')} <> ''"""


def distinct_categories() -> str:
    return _distinct_categories_sql()


def category_choices() -> str:
    return f"""SELECT CAST(r_regionkey + 1 AS VARCHAR) AS choice_key, r_name AS label FROM region
UNION ALL
SELECT category AS choice_key, category AS label FROM ({_distinct_categories_sql()})
WHERE NOT EXISTS (SELECT 1 FROM region)"""


def category_choices_no_terms() -> str:
    return f"SELECT category AS choice_key, category AS label FROM ({_distinct_categories_sql()})"


def question_types() -> str:
    return f"""WITH disc AS (SELECT CAST(question_type AS VARCHAR) AS type_key, {sanitize('min(question_type_new)')} AS label
         FROM ({PQ}) WHERE length(question_type_new) > 0 GROUP BY question_type ORDER BY question_type LIMIT 20),
defaults AS (SELECT * FROM (VALUES ('0', 'Multiple Choice (single answer)'),
                                   ('1', 'Multiple Choice (multiple answers)'),
                                   ('2', 'True/False')) t(type_key, label))
SELECT type_key, label FROM defaults
UNION ALL SELECT type_key, label FROM disc WHERE type_key NOT IN (SELECT type_key FROM defaults)"""


LOGS = """
WITH ids AS (SELECT DISTINCT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS question_id,
                             CAST(l_orderkey AS BIGINT) AS import_id FROM lineitem),
nids AS (SELECT import_id, count(*) AS n FROM ids GROUP BY 1)
SELECT CAST(o_orderkey AS BIGINT) AS id, 'file_' || CAST(o_orderkey AS VARCHAR) AS file_name,
       CAST(o_custkey AS BIGINT) AS uploader_id, CAST(o_custkey % 25 AS BIGINT) AS quiz_id,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE coalesce(nt.n_name, '') END AS quiz_name,
       o_orderdate AS import_time,
       CASE o_orderstatus WHEN 'F' THEN 'Success' WHEN 'O' THEN 'Partial' ELSE 'RolledBack' END AS status,
       CAST(coalesce(nids.n, 0) + o_orderkey % 3 AS BIGINT) AS total_rows,
       CAST(coalesce(nids.n, 0) AS BIGINT) AS success_rows, CAST(o_orderkey % 3 AS BIGINT) AS failed_rows,
       CAST(coalesce(nids.n, 0) AS BIGINT) AS n_question_ids
FROM orders LEFT JOIN nation nt ON nt.n_nationkey = o_custkey % 25
LEFT JOIN nids ON nids.import_id = o_orderkey
"""

QIDS = """SELECT DISTINCT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS question_id,
       CAST(l_orderkey AS BIGINT) AS import_id FROM lineitem"""

REQUESTS = """SELECT CAST(o_orderkey AS BIGINT) AS log_id FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT CAST(max(o_orderkey) + 1 AS BIGINT) FROM orders
UNION ALL SELECT CAST(0 AS BIGINT) UNION ALL SELECT CAST(-1 AS BIGINT)"""


def _counts_text(s: str, f: str) -> str:
    return f"printf('%d imported / %d failed', coalesce({s}, 0), coalesce({f}, 0))"


def _eligible() -> str:
    return "(coalesce(n_question_ids, 0) > 0 AND lower(coalesce(status, '')) <> 'rolledback')"


def recent_imports_page() -> str:
    return f"""SELECT id, file_name, quiz_name, strftime(import_time, '%Y-%m-%d %H:%M:%S') AS import_time,
       {_counts_text('success_rows', 'failed_rows')} AS counts, status, {_eligible()} AS can_rollback
FROM ({LOGS}) ORDER BY import_time DESC, id DESC LIMIT 20 OFFSET 20"""


def import_page_count() -> str:
    return f"""SELECT count(*) AS total, CAST(20 AS BIGINT) AS per_page, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
FROM ({LOGS})"""


def import_detail() -> str:
    name = (f"CASE WHEN {php_trim('l.quiz_name')} <> '' THEN {php_trim('l.quiz_name')} "
            "WHEN l.quiz_id > 0 THEN coalesce(q.quiz_name, '') ELSE '' END")
    return f"""WITH l AS ({LOGS}),
q AS (SELECT CAST(n_nationkey AS BIGINT) AS quiz_id, min(n_name) AS quiz_name FROM nation GROUP BY 1)
SELECT l.id, l.file_name,
       CASE WHEN ({name}) = '' THEN '— (not set) —' ELSE ({name}) END AS display_quiz_name,
       strftime(l.import_time, '%Y-%m-%d %H:%M:%S') AS import_time,
       {_counts_text('l.success_rows', 'l.failed_rows')} AS counts, l.total_rows, l.status,
       {_eligible().replace('n_question_ids', 'l.n_question_ids').replace('status', 'l.status')} AS can_rollback
FROM l LEFT JOIN q ON q.quiz_id = l.quiz_id"""


def _rollback_ctes() -> str:
    return f"""lg AS ({LOGS}),
qids AS (SELECT * FROM ({QIDS}) WHERE question_id % 7 <> 0),
req AS (SELECT r.log_id, lg.status AS _status, lg.n_question_ids AS _n, lg.id IS NOT NULL AS _found
        FROM ({REQUESTS}) r LEFT JOIN lg ON lg.id = r.log_id),
req2 AS (SELECT *, CASE WHEN log_id = 0 THEN 'invalid_id' WHEN NOT _found THEN 'not_found'
                         WHEN coalesce(_n, 0) <= 0 THEN 'no_ids'
                         WHEN lower(coalesce(_status, '')) = 'rolledback' THEN 'already_rolled_back'
                         ELSE 'rolled_back' END AS outcome FROM req),
okreq AS (SELECT DISTINCT log_id FROM req2 WHERE outcome = 'rolled_back'),
rm AS (SELECT q.import_id AS log_id, q.question_id FROM qids q
       WHERE q.import_id IN (SELECT log_id FROM okreq))"""


def rollback_outcome() -> str:
    return f"""WITH {_rollback_ctes()},
rem AS (SELECT log_id, count(*) AS removed FROM rm GROUP BY 1)
SELECT r.log_id, r.outcome,
       CAST(CASE WHEN r.outcome = 'rolled_back' THEN r._n ELSE 0 END AS BIGINT) AS attempted,
       CAST(CASE WHEN r.outcome = 'rolled_back' THEN coalesce(rem.removed, 0) ELSE 0 END AS BIGINT) AS removed,
       CASE r.outcome WHEN 'invalid_id' THEN 'Invalid log id for rollback.'
                      WHEN 'not_found' THEN 'Log entry not found.'
                      WHEN 'no_ids' THEN 'No question IDs found for rollback.'
                      WHEN 'already_rolled_back' THEN 'Import was already rolled back.'
                      ELSE printf('Rollback complete. %d questions removed.', r._n) END AS message
FROM req2 r LEFT JOIN rem ON rem.log_id = r.log_id"""


def rollback_survivors() -> str:
    return f"""WITH {_rollback_ctes()}
SELECT question_id, import_id FROM qids WHERE question_id NOT IN (SELECT question_id FROM rm)"""


def rollback_removed() -> str:
    return f"""WITH {_rollback_ctes()}
SELECT question_id, import_id FROM qids WHERE question_id IN (SELECT question_id FROM rm)"""


def rollback_links() -> str:
    return f"""WITH {_rollback_ctes()}
SELECT question_id, import_id, import_id AS quiz_id, CAST(question_id % 5 + 1 AS BIGINT) AS term_id,
       'qsm_category' AS taxonomy FROM qids
WHERE question_id % 2 = 1 AND import_id NOT IN (SELECT log_id FROM okreq)"""


def rollback_status() -> str:
    return f"""WITH {_rollback_ctes()}
SELECT id, CASE WHEN id IN (SELECT log_id FROM okreq) THEN 'RolledBack' ELSE status END AS status FROM lg"""


def import_runs_published() -> str:
    return f"""SELECT import_id, orig_row, question_id AS question_no, question_title, correct_answer, category
FROM ({questions_final()})"""


def removed_id_sets() -> str:
    return f"""SELECT question_id, import_id FROM ({QIDS}) q WHERE question_id % 7 <> 0
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT'
                AND question_id // 10 - o_orderkey IN (0, 1) AND question_id - o_orderkey * 10 BETWEEN 2 AND 15)"""


def questions_by_id() -> str:
    return f"""SELECT question_id, import_id FROM ({QIDS})
WHERE question_id IN (SELECT o_orderkey * 10 + 3 FROM orders WHERE o_orderstatus = 'F')"""


def safe_delete() -> str:
    return """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE NOT coalesce(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT', false)"""


def safe_delete_count() -> str:
    return """SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS BIGINT)
       AS deleted FROM orders"""


def _text_fixture() -> str:
    tail = ("CASE doc_id % 5 WHEN 0 THEN " + INV + " WHEN 1 THEN chr(9) WHEN 2 THEN chr(65279) "
            "WHEN 3 THEN '&nbsp;' ELSE ' &amp;nbsp; &lt;b&gt; &eacute;&bogus; &#8364;&#x1F600;&#13;&NotEqualTilde;&#39;&' END")
    blank = INV + " || '&zwj;' || chr(9) || '&#160;'"
    return f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN {blank} ELSE text || {tail} END AS text FROM documents"


def normalize_text() -> str:
    return f"""SELECT doc_id, normalized, normalized = '' AS is_blank
FROM (SELECT doc_id, {normalize_full('f.text')} AS normalized FROM ({_text_fixture()}) f)"""


def entity_and_tag_clean() -> str:
    html = "html || CASE WHEN page_id % 3 = 0 THEN '&nbsp;' ELSE '' END"
    return f"""SELECT page_id, {sanitize('h')} AS text_clean, {strip_all_tags('h')} AS stripped,
       {kses('h')} AS safe_html, {normalize(strip_all_tags('h'))} = '' AS is_blank
FROM (SELECT page_id, {html} AS h FROM pages)"""


def byte_sample(x: str, n: int) -> str:
    c = f"substring(coalesce({x}, ''), 1, {n})"
    c = f"regexp_replace({c}, {lit(T.UTF8_4_RE)}, repeat(chr(1), 4), 'g')"
    c = f"regexp_replace({c}, {lit(T.UTF8_3_RE)}, repeat(chr(1), 3), 'g')"
    c = f"regexp_replace({c}, {lit(T.UTF8_2_RE)}, repeat(chr(1), 2), 'g')"
    return f"substring({c}, 1, {n})"


def delimiter_detect() -> str:
    t = ("CASE WHEN doc_id % 3 = 1 THEN replace(text, ', ', ';') "
         "WHEN doc_id % 3 = 2 THEN replace(text, ', ', chr(9)) ELSE text END")
    cnt = lambda ch: f"CAST(length(s) - length(replace(s, {ch}, '')) AS BIGINT)"
    return f"""SELECT doc_id, n_comma, n_semicolon, n_tab,
       CASE WHEN n_tab > greatest(n_comma, n_semicolon) THEN chr(9) WHEN n_semicolon > n_comma THEN ';'
            ELSE ',' END AS delimiter
FROM (SELECT doc_id, {cnt("','")} AS n_comma, {cnt("';'")} AS n_semicolon, {cnt('chr(9)')} AS n_tab
      FROM (SELECT doc_id, {byte_sample(t, 4096)} AS s FROM documents))"""


def header_detect() -> str:
    size, price = "CAST(p_size AS VARCHAR)", "CAST(p_retailprice AS VARCHAR)"
    cells = (f"CASE p_partkey % 4 WHEN 0 THEN [p_name, {size}, {price}, p_brand] "
             f"WHEN 1 THEN [{size}, {price}, ''] WHEN 2 THEN [p_name, {size}, {price}] "
             f"ELSE [p_type, p_brand, '', {price}] END")
    t = php_trim("coalesce(x, '')")
    like = f"({t} <> '' AND (regexp_matches({t}, '[A-Za-z]') OR NOT {is_numeric(t)}))"
    return f"""SELECT k, CAST(len(cells) AS INTEGER) AS n_cells,
       CAST(len(list_filter(cells, lambda x: {like})) AS INTEGER) AS n_text,
       CASE WHEN len(cells) > 0 THEN len(list_filter(cells, lambda x: {like})) / len(cells) ELSE 0.0 END AS ratio,
       CASE WHEN len(cells) > 0 THEN len(list_filter(cells, lambda x: {like})) / len(cells) ELSE 0.0 END >= 0.5
       AS is_header
FROM (SELECT CAST(p_partkey AS BIGINT) AS k, {cells} AS cells FROM part)"""


BULK_QF = """
SELECT l_orderkey AS k,
       CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 25 END AS BIGINT) AS import_id,
       CAST(l_partkey * 4294967296 + l_suppkey AS BIGINT) AS rec_no,
       CAST(l_orderkey * 8 + l_linenumber + 2 AS BIGINT) AS orig_row,
       CASE WHEN l_orderkey % 29 = 0 THEN '' ELSE p_name || ' #' || CAST(l_linenumber AS VARCHAR) END AS question,
       p_brand AS option1, p_type AS option2,
       CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS option3,
       l_returnflag AS option4,
       CASE l_linenumber % 5 WHEN 0 THEN 'B' WHEN 1 THEN lower(p_type) WHEN 2 THEN '3' WHEN 3 THEN 'zzz'
            ELSE l_returnflag END AS correct_answer
FROM lineitem JOIN part ON p_partkey = l_partkey
"""


def bulk_import_lineitem() -> str:
    return import_log_summary(BULK_QF)


def json_rows() -> str:
    return """WITH e AS (SELECT event_id, event_type, props, CAST(floor(event_id / 100) AS BIGINT) AS bucket FROM events),
items AS (SELECT event_type || '/' || CAST(bucket AS VARCHAR) AS doc,
                 row_number() OVER (PARTITION BY event_type, bucket ORDER BY event_id)
                 + CASE WHEN bucket % 4 = 0 THEN 1 ELSE 0 END AS item_no, props FROM e),
scalars AS (SELECT DISTINCT event_type || '/' || CAST(bucket AS VARCHAR) AS doc FROM e WHERE bucket % 4 = 0)
SELECT doc, CAST(item_no AS BIGINT) AS item_no, CAST(0 AS INTEGER) AS pos, k AS key,
       json_extract_string(props, '$."' || k || '"') AS value
FROM items, unnest(json_keys(props)) t(k)
UNION ALL SELECT doc, CAST(1 AS BIGINT), CAST(0 AS INTEGER), '0', '42' FROM scalars"""


def processor_summary() -> str:
    cols = ["question", "option1", "option2", "option3", "option4", "correct_answer"]
    blank = " AND ".join(f"{normalize(c)} = ''" for c in cols)
    return f"""SELECT import_id, count(*) FILTER (WHERE {normalize('question')} <> '') AS imported_rows,
       count(*) FILTER (WHERE {normalize('question')} = '') AS failed_rows,
       count(*) FILTER (WHERE {normalize('question')} = '') AS n_errors,
       count(*) AS total_rows
FROM ({QF}) WHERE NOT ({blank}) GROUP BY import_id"""


def writer_outcomes() -> str:
    nonblank = " OR ".join(f"{normalize(c)} <> ''" for c in _base_cols())
    required = f"{normalize('question')} <> ''"
    return f"""WITH r AS (SELECT import_id, rec_no, {required} AS req, rec_no % 8 AS kind FROM ({QF}) WHERE {nonblank})
SELECT import_id, rec_no,
       CASE WHEN req AND kind < 4 THEN 'imported' ELSE 'failed' END AS status,
       CASE WHEN req AND kind < 2 THEN rec_no END AS id,
       CASE WHEN NOT req THEN printf('Row %d: missing required question text.', rec_no + 1)
            WHEN kind < 4 THEN NULL
            WHEN kind = 4 THEN printf('Row %d: Insertion failed', rec_no + 1)
            WHEN kind = 5 THEN printf('Row %d: no space left', rec_no + 1)
            WHEN kind = 6 THEN printf('Row %d: refused %d', rec_no + 1, rec_no)
            ELSE printf('Row %d: unknown insertion result.', rec_no + 1) END AS message FROM r"""


def writer_ledger() -> str:
    nonblank = " OR ".join(f"{normalize(c)} <> ''" for c in _base_cols())
    required = f"{normalize('question')} <> ''"
    return f"""WITH r AS (SELECT import_id, rec_no, {required} AS req, rec_no % 8 AS kind FROM ({QF}) WHERE {nonblank}),
s AS (SELECT *, CASE WHEN NOT req THEN NULL WHEN kind IN (4, 5, 7) THEN 3
                     WHEN import_id % 3 <> 0 THEN 1 ELSE 2 END AS attempt FROM r)
SELECT import_id, rec_no, CASE WHEN req AND kind <> 7 THEN 'imported' ELSE 'failed' END AS status,
       CASE WHEN req AND kind <> 7 THEN rec_no * 10 + attempt END AS id,
       CASE WHEN NOT req THEN printf('Row %d: missing required question text.', rec_no + 1)
            WHEN kind = 7 THEN printf('Row %d: unknown insertion result.', rec_no + 1) END AS message,
       attempt FROM s"""


def parse_files_meta() -> str:
    trim_ok = " OR ".join(f"{php_trim(c)} <> ''" for c in _base_cols())
    return f"""WITH m AS (SELECT import_id, import_id % 5 AS kind, count(*) AS n, count(*) FILTER (WHERE {trim_ok}) AS kept
                   FROM ({QF}) GROUP BY import_id)
SELECT import_id, CASE kind WHEN 0 THEN 'bank.csv' WHEN 3 THEN 'bank.dat' ELSE 'bank.json' END AS name,
       CASE kind WHEN 0 THEN 'csv' WHEN 3 THEN 'dat' ELSE 'json' END AS extension,
       CASE WHEN kind IN (0, 2) THEN 'text/csv' WHEN kind < 4 THEN 'application/json' END AS mime,
       CASE WHEN kind IN (0, 2) THEN 'csv' WHEN kind < 4 THEN 'json' END AS parser,
       CASE WHEN kind < 4 THEN n ELSE 0 END AS total_before_filter, CASE WHEN kind < 4 THEN kept ELSE 0 END AS total_after_filter,
       CASE WHEN kind = 4 THEN 'Invalid file provided to parser.' END AS error,
       CASE WHEN kind < 4 THEN kept ELSE 0 END AS n_numbered FROM m"""


def csv_roundtrip() -> str:
    return f"""WITH {evaluated()}
SELECT import_id, question_text, array_to_string(opts, '|') AS opts_text, row_status, correct_index, match_method
FROM ev"""


def logs_offset_page() -> str:
    return f"""SELECT id, file_name, strftime(import_time, '%Y-%m-%d %H:%M:%S') AS import_time, status
FROM ({LOGS}) ORDER BY import_time DESC, id DESC LIMIT 25"""


def log_defaults() -> str:
    def as_long(c):
        v = f"CAST({c} AS VARCHAR)"
        return f"CAST(CASE WHEN {is_numeric(v)} THEN {intval(v)} ELSE 0 END AS BIGINT)"
    return f"""SELECT id, coalesce({strip_all_tags('file_name')}, '') AS file_name,
       {as_long('uploader_id')} AS uploader_id, {as_long('quiz_id')} AS quiz_id,
       CASE WHEN quiz_name IS NULL THEN '' ELSE {sanitize('quiz_name')} END AS quiz_name,
       strftime(import_time, '%Y-%m-%d %H:%M:%S') AS import_time,
       CASE WHEN status IS NULL THEN 'pending' ELSE {sanitize('status')} END AS status,
       {as_long('total_rows')} AS total_rows, {as_long('success_rows')} AS success_rows,
       {as_long('failed_rows')} AS failed_rows
FROM ({LOGS})"""
