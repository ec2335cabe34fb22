"""Feature engineering for tabular machine learning, as operators on Spark DataFrames."""

from sparkfeat import functions, operators, sources
from sparkfeat.session import configure, local_session

__all__ = ["configure", "functions", "local_session", "operators", "sources"]
