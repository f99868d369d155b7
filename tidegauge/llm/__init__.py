"""Operators for preparing text corpora at scale.

Nothing outside this subpackage imports it.  ``registry`` lists the queries
and their SQL, ``__spark_entry__.py`` adds them when the subpackage is there.
"""
