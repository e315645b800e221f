"""Training-data pipeline operators on Spark DataFrames.

Each module holds one operator with its general interface and real outputs;
``registry`` derives the registered queries from them. Nothing else in the
library imports this subpackage.
"""
