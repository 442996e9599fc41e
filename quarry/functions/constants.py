"""Fixed values that must equal the reference's for right results.

FIXED VALUES (kept in natural order, as the reference states them):
"""

# Characters PHP ``trim`` strips: space, tab, newline, carriage return, NUL, vertical tab.
PHP_TRIM_CHARS = " \t\n\r\x00\x0b"

# Invisible characters replaced by a space before control removal:
# NBSP, ZWSP, ZWNJ, ZWJ, LRM, RLM, BOM.
INVISIBLE_TO_SPACE = ["\u00a0", "\u200b", "\u200c", "\u200d", "\u200e", "\u200f", "\ufeff"]

# Option keys: numbered form and prefix form (case-insensitive).
OPTION_NUMBERED_RE = r"(?i)^(option|answer|opt|ans)[\s_]?(\d+)$"
OPTION_PREFIX_RE = r"(?i)^(option|answer|opt|ans)"

# Correct-answer source keys, in order; then any key containing "correct".
CORRECT_KEYS = ["correct_answer", "correct", "answer_correct", "correctoption",
                "correct_option", "correct answer"]
CORRECT_GENERIC = "correct"

# Import-parameter aliases, in order.
QUIZ_KEYS = ["qsm_target_quiz", "target_quiz", "quiz_id", "quiz", "qsm_quiz",
             "qsm_target_quiz_select"]
CATEGORY_KEYS = ["qsm_question_category", "target_category", "category", "target_cat",
                 "qsm_category", "qsm_category_select", "qsm_category_field"]
TYPE_KEYS = ["qsm_question_type", "question_type", "qsm_type"]
CORRECT_MARK_KEYS = ["qsm_correct_mark", "correct_mark", "marks_correct", "correct_points",
                     "qsm_points_correct"]
INCORRECT_MARK_KEYS = ["qsm_incorrect_mark", "incorrect_mark", "marks_incorrect",
                       "incorrect_points", "qsm_points_incorrect"]
DEFAULT_CORRECT_MARK = 2.0
DEFAULT_INCORRECT_MARK = -0.67

# Wide answer columns of the questions table.
ANSWER_COLUMNS = ["answer_one", "answer_two", "answer_three", "answer_four", "answer_five",
                  "answer_six"]

# Quiz-column synonyms, in order of preference.
QUIZ_COLUMN_SYNONYMS = ["quiz_id", "quizid", "quiz", "qsm_quiz_id", "quizID"]
CATEGORY_COLUMN_SYNONYMS = ["category", "cat", "category_name", "qsm_category", "category_terms"]

TAXONOMY = "qsm_category"

# Default question types (key, label); defaults win over discovered labels.
DEFAULT_QUESTION_TYPES = [("0", "Multiple Choice (single answer)"),
                          ("1", "Multiple Choice (multiple answers)"),
                          ("2", "True/False")]

# Paging and caps.
RECENT_PAGE_SIZE = 20
DISTINCT_CATEGORY_CAP = 200
DISTINCT_TYPE_CAP = 20
DELIMITER_SAMPLE_BYTES = 4096
NO_QUIZ_LABEL = "— (not set) —"

STATUS_SUCCESS = "Success"
STATUS_PARTIAL = "Partial"
STATUS_ROLLED_BACK = "RolledBack"

# Message formats ("Row %d: ..."), PHP sprintf form translated to format_string.
MSG_MISSING_QUESTION = "Row %d: missing question text. Skipped."
MSG_NO_OPTIONS = "Row %d: no options found. Skipped."
MSG_UNMATCHED = ('Row %d: correct_answer value "%s" did not match any option; '
                 "no correct answer assigned for this row.")
MSG_NO_COLUMNS = "Row %d: no writable columns found in the target table. Skipped."
MSG_PROC_MISSING_QUESTION = "Row %d: missing required question text."
MSG_PROC_NO_WRITER = "No insertion function found. Please provide a function to insert questions."
MSG_PROC_FAILED = "Insertion failed"
MSG_PROC_UNKNOWN = "Row %d: unknown insertion result."
MSG_NOTICE = "Import complete. %d inserted, %d failed (log: %s)."
MSG_ROLLBACK_DONE = "Rollback complete. %d questions removed."
MSG_BAD_LOG_ID = "Invalid log id for rollback."
MSG_LOG_NOT_FOUND = "Log entry not found."
MSG_NO_IDS = "No question IDs found for rollback."
MSG_UNSUPPORTED = "Unsupported file type. Upload CSV/XLS/XLSX/JSON."
MSG_JSON_INVALID = "JSON decode failed or invalid JSON structure."
MSG_ALREADY_ROLLED_BACK = "Import was already rolled back."
