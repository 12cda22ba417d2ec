"""Evidence-first analytics on Spark: temporal serving, rules, terms, text structure, retrieval and releases."""
