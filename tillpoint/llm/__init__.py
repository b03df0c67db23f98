"""Training-data operators: language id, quality rules, source mixing, near
duplicates, toxicity, decontamination, token output, LM scoring, substring
dedup and token counts. Nothing outside this subpackage imports it."""
