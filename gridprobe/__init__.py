"""Label grids, embedding tables and concept probes as Spark DataFrame operators."""

__version__ = "0.1.0"
