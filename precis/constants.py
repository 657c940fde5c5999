"""Fixed values that must equal the behaviour being reproduced.

They are stated plainly, in their natural order; the code that uses them lives
in ``precis.functions``.
"""

# ---------------------------------------------------------------------------
# Text clean-up rules, applied in this order to lower-cased
# text. Pattern -> replacement. The dots in the last three patterns are
# intentionally unescaped (they match any character but a newline).
# ---------------------------------------------------------------------------
CLEANUP_RULES = [
    (r"https?:\/\/.*[\r\n]*", ""),
    (r'[_"\-;%()|.,+&=*%]', " "),
    (r"\.", " . "),
    (r"\!", " !"),
    (r"\?", " ?"),
    (r"\,", " ,"),
    (r":", " : "),
    (r"#", " # "),
    (r" . . . ", " "),
    (r" .  .  . ", " "),
    (r" ! ! ", " ! "),
]

# ---------------------------------------------------------------------------
# Line endings that do not get a " ." appended (story corpus).
# The original list is . ! ? ... ' ` " U+2019 and one two-character string
# U+201D followed by ")" - only single characters can equal the last
# character of a line, so "..." and the two-character entry never match.
# ---------------------------------------------------------------------------
END_TOKENS = [".", "!", "?", "...", "'", "`", '"', "’", "”)"]
END_CHARS = [t for t in END_TOKENS if len(t) == 1]
# Option (not the default): the list as evidently intended, with the closing
# quote and the parenthesis as two separate endings.
END_CHARS_STRICT = END_CHARS + ["”", ")"]

# Sentence markers around each summary sentence.
SENTENCE_START = "<s>"
SENTENCE_END = "</s>"

# Marker that starts a summary line in a story file.
HIGHLIGHT_MARKER = "@highlight"

# ASCII punctuation (Python's string.punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# File tags and split names.
ARTICLES_TAG = "articles"
SUMMARIES_TAG = "summaries"
NEWS_TAG = "ria"
STORIES_TAG = "cnndm"
TRAIN_TAG = "train"
VAL_TAG = "val"
TEST_TAG = "test"
DEFAULT_SPLIT_RATIO = (80, 10, 10)
BY_LENGTH = "length"

# Scoring defaults.
DEFAULT_ROUGE_TYPES = ["rouge1", "rouge2", "rougeL"]
BOOTSTRAP_SAMPLES = 1000
BOOTSTRAP_CONFIDENCE = 0.95

# Python's str.isspace() set (what str.strip() removes), as a regex class that
# means the same in Java regex and RE2.
PY_SPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same set as literal characters (derived from str.isspace), for trims
# that need no regular expression.
PY_SPACE_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
