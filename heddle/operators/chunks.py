"""Chunks of texts: Markdown sections, windows and source ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heddle.functions.text import heading_slug


def windows(df: DataFrame, key: str, text: str, size: int = 3500, overlap: int = 200) -> DataFrame:
    """Pieces of at most ``size`` characters that overlap: key, part (from 1), piece."""
    step = size - overlap
    n = F.length(text)
    parts = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / F.lit(float(step)))).cast("int")
    cut = df.select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(1), parts)).alias("part"))
    return cut.select(key, "part", F.substring("_t", (F.col("part") - 1) * step + 1, F.lit(size)).alias("piece"))


def heading_chunks(df: DataFrame, path: str, content: str) -> DataFrame:
    """Sections under headings of level 1 to 3: path, start_line, end_line, slug (numbered from the
    second of its name on), body; lines before the first heading are the preamble, and a text
    without headings is one document chunk."""
    lines = F.split(F.col(content), "\n")
    heads = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("no"), F.regexp_extract(x, r"^#{1,3}\s+(.*)$", 1).alias("title"), x.rlike(r"^#{1,3}\s+\S").alias("is"))), lambda s: s["is"])
    rows = df.select(F.col(path), lines.alias("_l"), heads.alias("_h"))
    found = rows.select(path, "_l", F.explode("_h").alias("h"))
    by = W.partitionBy(path)
    end = F.coalesce(F.lead("h.no").over(by.orderBy("h.no")) - 1, F.size("_l"))
    named = found.select(path, "_l", F.col("h.no").alias("start_line"), end.alias("end_line"), heading_slug(F.col("h.title")).alias("_s"))
    k = F.row_number().over(W.partitionBy(path, "_s").orderBy("start_line"))
    sections = named.select(path, "_l", "start_line", "end_line", F.concat("_s", F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise("")).alias("slug"))
    first = F.coalesce(F.get("_h", F.lit(0))["no"], F.lit(0))
    rest = rows.where((F.size("_h") == 0) | (first > 1)).select(path, "_l", F.lit(1).alias("start_line"), F.when(F.size("_h") == 0, F.size("_l")).otherwise(first - 1).alias("end_line"), F.when(F.size("_h") == 0, "document").otherwise("preamble").alias("slug"))
    out = sections.unionByName(rest)
    return out.select(path, "start_line", "end_line", "slug", F.array_join(F.slice("_l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("body"))


def markdown_embed_text(path: Column, heading: Column, body: Column) -> Column:
    return F.concat(F.lit("# Doc: "), path, F.lit("\n# Section: "), heading, F.lit("\n# ---\n"), body)


def source_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based and inclusive."""
    return F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def extended_start(text: Column, start: Column, most: int = 30) -> Column:
    """First line of the comments and decorators right above ``start``; a blank line ends them."""
    lines = F.split(text, "\n")
    above = F.reverse(F.slice(lines, F.greatest(start - most, F.lit(1)), F.least(start - 1, F.lit(most))))
    other = F.array_position(F.transform(above, lambda x: x.rlike(r"^\s*(#|//|/\*|\*|@|--|\"\"\")")), False)
    return F.when(start <= 1, start).otherwise(start - F.when(other > 0, other - 1).otherwise(F.size(above)).cast("int"))


def leading_comments(text: Column, most: int = 30) -> Column:
    """The block of comment lines at the head of a file, at most ``most`` lines."""
    head = F.slice(F.split(text, "\n"), 1, most)
    code = F.array_position(F.transform(head, lambda x: (F.trim(x) == "") | x.rlike(r"^\s*(#|//|/\*|\*)")), False)
    return F.array_join(F.when(code > 0, F.slice(head, F.lit(1), (code - 1).cast("int"))).otherwise(head), "\n")


def class_chunk(name: Column, signature: Column, members: Column, doc: Column, module: Column) -> Column:
    """Embedding text of a class: its name, module, members, signature and docstring; what is empty is left out."""
    return F.rtrim(F.concat_ws("\n", F.concat(F.lit("# Class: "), name), headed("# Module: ", module), headed("# Members: ", F.array_join(members, ", ")), F.lit("# ---"), nonempty(signature), nonempty(doc)))


def module_chunk(name: Column, path: Column, doc: Column, public: Column) -> Column:
    """Embedding text of a module: its name, path, public names and docstring."""
    return F.rtrim(F.concat_ws("\n", F.concat(F.lit("# Module: "), name), headed("# Path: ", path), headed("# Public: ", F.array_join(public, ", ")), F.lit("# ---"), nonempty(doc)))


def file_chunk(path: Column, text: Column, template: str = "Summarise the file {path}:\n{text}", most: int = 8192) -> Column:
    """Text that a file's summary is asked for with; of the content, so many bytes as whole characters take."""
    cut = F.substring(F.encode(text, "UTF-8"), F.lit(1), F.lit(most)).cast("string")
    spare = F.regexp_replace(F.make_valid_utf8(cut), "\ufffd+$", "")
    body = F.when(F.octet_length(text) <= most, text).otherwise(spare)
    return F.replace(F.replace(F.lit(template), F.lit("{path}"), path), F.lit("{text}"), body)


def headed(label: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))


def nonempty(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def summary_text(kind: str, name: Column, members: Column, most: int = 40) -> Column:
    """Summary chunk of a file, class or module: its name and members."""
    return F.concat_ws("\n", F.concat(F.lit(f"# {kind}: "), name), F.concat(F.lit("# Members: "), F.array_join(F.slice(F.array_sort(members), 1, most), ", ")))


def hydrated(text: Column, most: int = 40) -> Column:
    """First lines of a stored summary."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, most), "\n")


def lexical_document(name: Column, doc: Column, source: Column, most: int = 6000) -> Column:
    """What is indexed of a symbol: name, docstring and source, cut."""
    return F.substring(F.concat_ws("\n", name, doc, source), 1, most)


def lexical_file(path: Column, text: Column, lines: int = 120, most: int = 6000) -> Column:
    """What is indexed of a file: its path and first lines, cut."""
    return F.substring(F.concat_ws("\n", path, F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")), 1, most)
