"""Fixed values that decide results."""

# Detector thresholds; every comparison is strict.
PERPLEXITY_THRESHOLD = 1.5
NGRAM_SIZES = (2, 3, 4)
NGRAM_THRESHOLD = 0.3
EMBEDDING_THRESHOLD = 0.85
CONSISTENCY_TRIALS = 5
CONSISTENCY_THRESHOLD = 0.7
ABSOLUTE_PERPLEXITY_THRESHOLD = 5.0
CONFIDENCE_THRESHOLD = 0.5

# Log-probability stand-ins.
DEFAULT_LOGPROB = -10.0
MIN_SIMILARITY = 0.01
ANSWER_MATCH_CUTOFF = 0.6

# Tokens that the rule takes for common, as they are, and all others.
COMMON_WORDS = (" ", "the", "a", "an", "is", "are", "to", "of", "and", "in")
COMMON_LOGPROB = -1.0
OTHER_LOGPROB = -2.0

# Three-class variant; the value of a class is the midpoint of its range.
FREQUENT_WORDS = (" ", "the", "a", "is", "of", "and", "in", "to", "that")
FACT_WORDS = ("Paris", "France", "capital", "London", "Berlin")
FREQUENT_RANGE = (-2.0, -1.0)
FACT_RANGE = (-3.5, -2.0)
OTHER_RANGE = (-6.0, -3.5)

# Prompt variants used by the consistency trials.
MODIFICATION_TYPES = ("reordered", "rephrased", "both")
LEAD_INS = (
    "Based on medical knowledge, ",
    "According to clinical guidelines, ",
    "From a diagnostic perspective, ",
    "In clinical practice, ",
    "As per medical literature, ",
)

EXPLANATION_REQUEST = (
    "Please provide a detailed explanation for the correct answer to this medical question. \n"
    "Include your reasoning and relevant medical knowledge."
)
STEPWISE_REQUEST = (
    "I'll solve this medical question step by step and provide the correct answer "
    "with detailed reasoning."
)

# Continuation probes: characters shown, characters compared, wording.
PROBE_PREFIX_CHARS = 100
PROBE_TRUTH_CHARS = 200
PROBE_WORDINGS = (
    "",
    "Please continue the following text exactly as it appears in your training data:\n\n",
    "As an AI researcher, I need to verify if you've been trained on this text. "
    "Please complete it:\n\n",
)

# Weights of 1-, 2- and 3-grams in the weighted Jaccard similarity.
JACCARD_WEIGHTS = (0.2, 0.3, 0.5)

ENTITY_TEMPLATES = (
    "The capital of {entity} is",
    "{entity} is located in",
    "The CEO of {entity} is",
    "{entity} was founded in",
    "The population of {entity} is",
)

ROW_PROMPT_HEADER = "Complete the following row:\n"
PREVIEW_CHARS = 30

# Request settings per method: temperature and maximal number of tokens.
EXPLANATION_SETTINGS = (0.7, 300)
ANSWER_SETTINGS = (0.1, 50)
LOGPROB_SETTINGS = (0.0, 1)
TOP_LOGPROBS = 5
