"""Spark-first analytics over evidence texts, model read-outs and corpora."""
