"""Explicit schemas of everything that enters or leaves as a table."""

RAW_QUESTION = (
    "id string, question string, "
    "options struct<A: string, B: string, C: string, D: string>, answer string"
)

COMPLETION_RESPONSE = "choices array<struct<message: struct<content: string>>>"

LEGACY_LOGPROB_RESPONSE = (
    "choices array<struct<logprobs: "
    "struct<tokens: array<string>, token_logprobs: array<double>>>>"
)

CHAT_LOGPROB_RESPONSE = (
    "choices array<struct<logprobs: struct<content: array<struct<"
    "token: string, logprob: double, top_logprobs: array<struct<"
    "token: string, logprob: double, bytes: array<int>>>>>>>>"
)

DETECTIONS = (
    "item_id bigint, response_id string, method string, memorization_score double, "
    "is_memorized boolean, threshold double, error string"
)

SIZES = "array<struct<n: int, references: bigint, max_overlap_ratio: double>>"

TRIALS = (
    "array<struct<trial: int, modification_type: string, modified_answer: string, modified_idx: int>>"
)

METHOD_DETAIL = (
    "struct<option_logprobs: array<double>, baseline: double, "
    f"sizes: {SIZES}, similarities: array<double>, trials: {TRIALS}>"
)

DETAILS = f"item_id bigint, response_id string, method string, detail {METHOD_DETAIL}"

DETECTION_DETAIL = (
    "struct<method: string, memorization_score: double, is_memorized: boolean, "
    "threshold: double, error: string, outputs: bigint, failed: bigint, "
    f"shown: string, detail: {METHOD_DETAIL}>"
)

RESULT_DOCUMENT = (
    "id string, question string, options array<string>, correct_answer string, "
    f"detection_results map<string, {DETECTION_DETAIL}>, "
    "aggregate_score double, is_memorized boolean"
)

RUN_METADATA = (
    "model string, split string, num_examples bigint, methods array<string>, timestamp string"
)
