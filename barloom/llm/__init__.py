"""Operators for preparing language-model training data at cluster scale.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; whatever must outlive a job goes to the folder that the session
names in ``spark.checkpoint.dir`` (see :mod:`barloom.llm.store`).
"""
