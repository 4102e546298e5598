"""Training-data operators: ten DataFrame operators over documents and pages, and their registered queries.

Each module holds one operator; ``queries`` registers them.  Nothing outside this folder (and the pipeline at the
repository top) imports it.
"""
