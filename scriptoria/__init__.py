"""Scriptoria: document-pipeline analytics expressed as Spark DataFrame plans."""
