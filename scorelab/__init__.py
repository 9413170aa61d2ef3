"""scorelab: build and judge binary risk scores with Spark DataFrames."""

__version__ = "0.1.0"
