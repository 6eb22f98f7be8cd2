"""Point-in-time panels, trailing features and text scores as Spark DataFrame operators."""

__version__ = "0.1.0"
