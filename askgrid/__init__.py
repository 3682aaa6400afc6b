"""Questionnaire answering over a document corpus, as Spark DataFrame jobs."""
