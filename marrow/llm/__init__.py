"""Operators for building training corpora: quality, toxicity, language, dedup,
decontamination, extraction and tokenization.  Nothing else in the library imports
this subpackage, and importing it starts no Spark job."""
