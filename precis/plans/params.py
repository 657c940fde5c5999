"""Parameters of the registered queries (shared by the Spark and SQL sides)."""

# Bootstrap: resamples, confidence and seed.
BOOT_SAMPLES = 1000
BOOT_CONFIDENCE = 0.95
BOOT_SEED = 0

# Rows of a leaf of the bootstrap's tree in its query (small, so that small tables have several).
BOOT_LEAF_ROWS = 64

# Shards in which scores are added to a stored state.
SCORE_SHARDS = 3

# Rows of a file where tables are written out as files.
FILE_ROWS = 256

# Splits: ratio split shares; absolute split sizes (the published
# 350,000 / 25,000 sizes scaled down by 1,000); head size.
SPLIT_RATIO = (80, 10, 10)
TRAIN_SIZE = 350
TEST_SIZE = 25
HEAD_N = 100

# Sampling by byte length (article bytes incl. the newline must be below).
MAX_LENGTH = 1500
SAMPLE_BYTES = 200

# Vocabulary: tokens seen fewer times get the unknown id.
VOCAB_MIN_COUNT = 2
UNK_ID = -1

# A small fixed lexicon (form -> lemma) for the lemmatization query.
LEXICON = [
    ("was", "be"),
    ("is", "be"),
    ("are", "be"),
    ("were", "be"),
    ("has", "have"),
    ("had", "have"),
    ("ist", "sein"),
    ("sind", "sein"),
    ("war", "sein"),
    ("der", "die"),
    ("des", "de"),
    ("les", "le"),
    ("la", "le"),
    ("une", "un"),
    ("los", "el"),
    ("las", "el"),
    ("eine", "ein"),
    ("einen", "ein"),
    ("einer", "ein"),
    ("ones", "one"),
]
