"""rulemill: governed rule knowledge and data cleaning as PySpark plans."""

__version__ = "0.1.0"
