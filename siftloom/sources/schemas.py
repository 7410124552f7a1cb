"""Explicit schemas of the inputs and of the tables between operators."""

from __future__ import annotations

from siftloom.functions.labels import METRICS

MESSAGES = "array<struct<role: string, content: string>>"
FORMATS = {
    "qwen": "text string, content string, source string",
    "slimpajama": "text string, meta struct<redpajama_set_name: string>",
    "commoncrawl": "text string",
    "ChineseWebText2": "text string, domain struct<single_label: string>, quality_score double",
    "ppl": "txt string, source string, ppl double",
    "preprocessed": "text string, id string, source_domain string, length string, ppl string",
}
DOCUMENT = "doc_id string, text string, source_domain string, ppl double, quality_score double"
ANNOTATED = "text string, document_index string, source_domain string, length int, application_domain string, " + ", ".join(f"{m} string" for m in METRICS)
TOKENIZED = "input_ids array<int>, length int, document_position int, document_index string, text string, source_domain string"
REQUEST = f"index string, request_json struct<model: string, messages: {MESSAGES}, temperature: double, max_tokens: int>"
RESPONSE = REQUEST + ", status string, response struct<data: struct<response: struct<choices: array<struct<message: struct<content: string>>>>>>"
SAMPLE = f"type string, messages {MESSAGES}, source string"
TRAINING_LOG = "log_history array<struct<step: bigint, eval_loss: double>>"
