"""Documentation-corpus engine on PySpark.

Tables of captured pages, site manifests and fetch logs go in; a clean Markdown
corpus and its reports come out. Every operator takes and returns DataFrames and
stays inside Spark's built-in expressions.
"""
