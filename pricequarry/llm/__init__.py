"""Operators that prepare text for training language models at scale.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries only when it is installed.
"""
