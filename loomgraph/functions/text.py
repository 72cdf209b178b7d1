"""Scalar functions over paths, identifiers, texts and labels, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and the language of each.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "swift": "swift", "rb": "ruby",
}
#: Directory names whose contents are never read.
EXCLUDED = (".git", "node_modules", "dist", "target")
#: Symbol kinds that have a table of their own.
KINDS = ("Function", "Method", "Class", "Interface", "Struct", "Enum", "Trait", "Module", "Namespace")


def detect_language(path: Column) -> Column:
    """By the last dot-separated part of the path, in lower case (all of it without a dot); null where it is none of ``LANGUAGES``."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.element_at(F.split(path, r"\."), -1)))


def is_included(path: Column) -> Column:
    """False where any part of the path is excluded by name."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def kind_label(kind: Column) -> Column:
    """A symbol kind, in either spelling, to its node label."""
    table = F.create_map(*[F.lit(x) for k in KINDS for form in (k, k.upper()) for x in (form, k)])
    return F.coalesce(F.try_element_at(table, kind), F.lit("CodeElement"))


def strip_prefix(node_id: Column) -> Column:
    """What follows the first colon; all of it without one."""
    return F.regexp_replace(node_id, "^[^:]*:", "")


def identifier_tokens(name: Column) -> Column:
    """Parts at ``_``, ``-`` and before capitals, in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"(\p{Lu})", "_$1")), "[_-]"), lambda x: x != "")


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def process_type(node_type: Column, name: Column) -> Column:
    """The kind of an execution flow, by the first rule that its entry point meets."""
    low = F.lower(name)
    return (
        F.when((node_type == "Route") | low.rlike("route|api"), "HTTP")
        .when((node_type == "Tool") | low.rlike("command|cmd"), "CLI")
        .when(low.rlike("event|listener|subscriber"), "Event")
        .when(low.rlike("cron|schedule|job"), "Cron")
        .otherwise("Unknown")
    )


def is_entry_point(node_type: Column, name: Column) -> Column:
    return node_type.isin("Route", "Tool") | F.lower(name).rlike("handler|controller|command|main")


def process_id(entry: Column) -> Column:
    return F.concat(F.lit("Process:"), F.replace(entry, F.lit(":"), F.lit("_")))


def embed_text(label: Column, name: Column, content: Column) -> Column:
    """What is embedded for a node: label, name and content."""
    return F.concat_ws(" ", F.coalesce(label, F.lit("CodeElement")), F.coalesce(name, F.lit("")), F.coalesce(content, F.lit("")))


def words(text: Column) -> Column:
    """Split at Unicode white space, empties dropped."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Overlapping word windows as array<struct<chunk_index,start_word,end_word,text>>; the next starts where the last ends, less the overlap."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    step = size - overlap
    w = words(text)
    n = F.size(w)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    made = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("chunk_index"),
            (i * step).alias("start_word"),
            F.least(i * step + size, n).alias("end_word"),
            F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ").alias("text"),
        ),
    )
    return F.when(n > 0, made).otherwise(F.filter(made, lambda _: F.lit(False)))
