"""Operators for preparing language-model training corpora with Spark.

Each module holds one operator with a general interface; :mod:`mensura.llm.queries`
binds the operators to the tables of a data folder.  Nothing outside this subpackage
imports it.
"""
