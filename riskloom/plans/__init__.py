"""Compositions: registered queries and their SQL, the scoring pipeline, the command line."""
