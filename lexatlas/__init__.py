"""lexatlas: word-sense and ontology-class induction as Spark DataFrame plans."""

__version__ = "0.1.0"
