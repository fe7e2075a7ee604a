"""Incrementally maintained SQL views on Spark, and operators for training-data pipelines (``deltaloom.llm``)."""
