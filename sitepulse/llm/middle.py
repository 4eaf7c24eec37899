"""Fill-in-middle arrangements of texts, in Spark's own functions.

A text is cut into units, words of letters or single other characters, at two places drawn
from the sha256 of its id; prefix, suffix and middle are put in the order that a model learns
to fill a gap from, with sentinels before each.  The text can be rebuilt from the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.common import text_or_empty

UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Before prefix, suffix and middle; a text that contains one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are arranged, and of those the ones that begin with the suffix.
ARRANGED, SUFFIX_FIRST = 90, 20


def draw(id_col: str, seed: int, k: int) -> Column:
    """The k-th number, of 32 bits, that belongs to an id and a seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: sentinels part it, and the form says in which order."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def arrange(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output and restored of every row.

    form 'plain': the text itself, if it's empty, contains a sentinel, or isn't among the
    ``ARRANGED`` per cent; then the lengths are null.  'psm' and 'spm': prefix, suffix and middle
    behind their sentinels, in that order or suffix first.

    Null text counts as empty; a null id draws like an empty one; repeated rows are arranged
    alike; very long texts are taken whole; an empty table gives no rows; further columns, of
    any name, are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("string").alias("t"))
    units = rows.select("doc_id", "t", F.regexp_extract_all("t", F.lit(UNIT), F.lit(0)).alias("u"), *(draw("doc_id", seed, k).alias(f"h{k}") for k in (1, 2, 3, 4)))
    size = F.size("u").cast("long")
    plain = (F.col("t") == "") | F.contains("t", F.lit(PREFIX)) | F.contains("t", F.lit(SUFFIX)) | F.contains("t", F.lit(MIDDLE)) | (F.col("h3") % 100 >= ARRANGED)
    cuts = units.select(
        "doc_id",
        "t",
        "u",
        size.alias("n"),
        F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm").alias("form"),
        F.least(F.col("h1") % (size + 1), F.col("h2") % (size + 1)).cast("int").alias("a"),
        F.greatest(F.col("h1") % (size + 1), F.col("h2") % (size + 1)).cast("int").alias("b"),
    )
    some = F.col("form") != "plain"
    piece = lambda start, length: F.when(some, F.array_join(F.slice("u", start, length), ""))
    parts = cuts.select("doc_id", "t", "n", "form", piece(F.lit(1), F.col("a")).alias("p"), piece(F.col("a") + 1, F.col("b") - F.col("a")).alias("m"), piece(F.col("b") + 1, F.size("u") - F.col("b")).alias("s"))
    psm = F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m")
    spm = F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")
    out = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t"))
    made = parts.select("doc_id", "n", "form", F.length("p").cast("long").alias("prefix_chars"), F.length("m").cast("long").alias("middle_chars"), out.alias("output"))
    return made.withColumn("restored", restored(F.col("output"), F.col("form")))


def digest(arranged: DataFrame) -> DataFrame:
    """``arrange``'s rows with sha256 digests of output and restored text in their place."""
    own = [c for c in arranged.columns if c not in ("output", "restored")]
    return arranged.select(*own, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
