"""bimosaic: pattern mining over heterogeneous tables as Spark DataFrame programs."""

__version__ = "0.1.0"
