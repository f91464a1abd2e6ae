"""idsignal: identity audit-log analytics as PySpark jobs.

Every public function takes DataFrames (or Columns) and gives DataFrames (or
Columns); nothing runs until the caller acts on the result, except where a
docstring says that a table is staged or a model is trained.
"""
