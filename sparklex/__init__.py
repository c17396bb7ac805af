"""sparklex: a Spark-first engine for multilingual text corpora."""

__version__ = "0.1.0"
