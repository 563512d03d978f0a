"""Training-data operators on Spark DataFrames.  Nothing else in the library imports this subpackage.

Functions that run in Python workers are pickled by reference, so the package has to be
importable on the executors (PYTHONPATH or ``--py-files``), as with any Spark application.
"""
