"""Operators for preparing text corpora for language-model training.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames; the ``op*`` queries in :mod:`gridloom.llm.registry` apply
them with production parameters to the tables of a data folder.
"""
