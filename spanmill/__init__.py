"""Spanmill: a Spark-first engine for entity and coreference data.

Every stage is a ``DataFrame -> DataFrame`` function; Catalyst plans it.  Python
workers run only for parse trees, assignment, sequential learning and the
string automata that built-in functions can't express.
"""

__version__ = "0.1.0"
