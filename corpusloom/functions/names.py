"""File names from titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import JS_SPACE


def slug(title: Column) -> Column:
    """ASCII letters, digits and `_` runs; may be empty, edges are kept."""
    kept = F.regexp_replace(title, f"[^A-Za-z0-9{JS_SPACE}.\\-]", "")
    return F.lower(F.regexp_replace(kept, f"[{JS_SPACE}.\\-]+", "_"))


def corpus_folder(output_dir: Column, domain: Column) -> Column:
    """Folder of one domain's documents."""
    return F.concat(F.regexp_replace(output_dir, "/+$", ""), F.lit("/"), domain)
