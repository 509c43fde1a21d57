"""Spanwright: evidence analytics over long documents, declared as Spark DataFrame plans."""
