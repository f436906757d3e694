"""tandem: labelled-text corpora and multi-encoder features as Spark DataFrames."""

__version__ = "0.1.0"
