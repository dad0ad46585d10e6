"""Defaults and fixed values.

Every operator takes these as keyword arguments; the values here are only
the defaults that give the same results as the system being rebuilt.
"""

# --- fixed values: retrieval settings (must equal the original for equal results) ---
CHUNK_SIZE = 500           # characters per chunk
CHUNK_OVERLAP = 50         # characters shared by neighbouring chunks
MIN_CHUNK_CHARS = 20       # shorter stripped chunks are dropped
TOP_K = 5                  # passages per question
MAX_DISTANCE = 0.52        # cosine distance cut-off, inclusive
RRF_CANDIDATES = 20        # candidates taken from each ranking before fusion
RRF_K = 60                 # reciprocal rank fusion constant
ANN_MIN_ROWS = 100         # below this many rows no ANN index is built
HISTORY_MESSAGES = 6       # earlier chat messages kept as context
ANSWER_ID_START = 1000     # first number of the answer sequence
SEARCH_MODES = {"hybrid": "Hybrid", "vector": "Vector"}  # search modes and their labels

# --- fixed values: text patterns ---
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_REDACTION = "[email]"
AMOUNT_PATTERN = r"\d{1,3}(\.\d{3})+ kr"
MASKED_EMAIL_SUFFIX = "XX@XXXX.com"

# --- fixed values: Icelandic stop words of the full-text index ---
ICELANDIC_STOPWORDS = (
    "á að af aðeins allt alltaf annað annars auk eða eftir ef eiga ekki ég eins en enda er eru "
    "fá fær fæ fyrir frá geta getur get gera hafa hann hefur hér hjá hún hvað hvaða hvar hvenær hver hverjar "
    "hverjir hvernig hvort hversu í inn já má með meðan mig mér mín mun nei nú og okkar sem sé sig sín sinn "
    "sitt svo til um undir upp úr út var vera verður við yfir þá það þær þann þar þarf þegar þeir þess þessi "
    "þetta þig þú þín"
)

# --- fixed values: Icelandic number words 1-12 in all inflections ("eins" is left out) ---
NUMBER_WORDS = {
    "1": "einn eina einum ein eitt einni einnar",
    "2": "tveir tvo tveimur tveggja tvær tvö",
    "3": "þrír þrjá þremur þriggja þrjár þrjú",
    "4": "fjórir fjóra fjórum fjögurra fjórar fjögur",
    "5": "fimm", "6": "sex", "7": "sjö", "8": "átta", "9": "níu", "10": "tíu", "11": "ellefu", "12": "tólf",
}

# --- fixed values: refusal text of the chat ---
NOT_FOUND = "No information about this topic was found in the documents."

# --- our own choices (not in the original) ---
BM25_K1 = 1.2
BM25_B = 0.75
DIST_DIGITS = 6            # distances and BM25 scores are rounded before ranking
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"
# Vector blocks for the numpy top-k: rows per block are chosen so one block of
# float64 numbers stays near this many bytes inside a Python worker.
BLOCK_BYTES = 64 << 20
QUERY_BLOCK_BYTES = 16 << 20
# Largest question matrix (questions x dims x 8 bytes) broadcast to the corpus scan, where every
# Python worker holds a copy of it; larger question sets are searched block by block.
BROADCAST_QUERY_BYTES = 16 << 20
# Distances that a worker holds as one matrix.
DISTANCES = 2 << 20
# Largest centroid table we inline into a plan (cells x dims x 8 bytes).
MAX_CENTROID_BYTES = 32 << 20

# --- our mapping of the driver tables' sources to departments (4 IT, 4 Finance, rest HR,
#     as in the original's 14 documents) ---
DRIVER_IT_SOURCES = ["src0", "src1", "src2", "src3"]
DRIVER_FINANCE_SOURCES = ["src4", "src5", "src6", "src7"]
