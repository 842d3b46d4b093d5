"""factlens: structural analytics over a catalogue of Parquet tables, as Spark plans."""

__version__ = "0.1.0"
