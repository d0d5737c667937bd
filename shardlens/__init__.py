"""Classification queries over sharded text corpora, as DataFrame functions.

Every operator takes DataFrames and returns DataFrames. Paths, page sizes and
the current time (`as_of`) are arguments, so a run can be repeated exactly.
"""
