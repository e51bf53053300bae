"""Operations for large training-data pipelines, written as Spark jobs.

Nothing else in the library imports this package; removing the folder leaves the rest whole.
"""
