"""Schemas of the property graph: node labels, edge types, and input tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

STRING, INT, LONG, DOUBLE, BOOL = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()


def struct(**columns) -> StructType:
    return StructType([StructField(k, v) for k, v in columns.items()])


_CODE = {"name": STRING, "file_path": STRING, "start_line": INT, "end_line": INT, "content": STRING}
_TYPED = _CODE | {"is_exported": BOOL}
_CALLABLE = _TYPED | {"parameter_count": INT, "return_type": STRING}
_COMMUNITY = {"label": STRING, "heuristic_label": STRING, "cohesion": DOUBLE, "symbol_count": INT}
_PROCESS = {"label": STRING, "heuristic_label": STRING, "process_type": STRING, "step_count": INT, "entry_point_id": STRING, "terminal_id": STRING}
#: Columns of each node label, after its id.
NODE_TABLES: dict[str, dict] = {
    "File": {"name": STRING, "file_path": STRING, "content": STRING, "content_hash": STRING},
    "Folder": {"name": STRING, "file_path": STRING},
    "Function": _CALLABLE,
    "Class": _TYPED,
    "Interface": _TYPED,
    "Method": _CALLABLE,
    **{k: _CODE for k in ("Struct", "Enum", "Trait", "Module", "Namespace", "CodeElement")},
    "Community": _COMMUNITY,
    "Process": _PROCESS,
    "Route": {"name": STRING, "file_path": STRING},
    "Tool": {"name": STRING, "file_path": STRING, "description": STRING},
    "CodeEmbedding": {"node_id": STRING, "chunk_index": INT, "start_line": INT, "end_line": INT, "content_hash": STRING},
}
#: Edge tables and their properties.
EDGE_TABLES: dict[str, dict] = {
    "CodeRelation": {"type": STRING, "confidence": DOUBLE},
    "FileRelation": {"type": STRING},
    "MemberOf": {"confidence": DOUBLE},
    "StepInProcess": {"step": INT, "confidence": DOUBLE},
    "EntryPointOf": {"confidence": DOUBLE},
    "Defines": {"confidence": DOUBLE},
    "Contains": {},
}
_wide: dict = {}
for _columns in NODE_TABLES.values():
    _wide |= _columns
_wide.pop("label", None)
#: One wide table of all nodes; label is the node's table, display_label the label property of communities and processes.
NODES = struct(id=STRING, label=STRING, display_label=STRING, **_wide)
EDGES = struct(src=STRING, dst=STRING, rel_table=STRING, type=STRING, confidence=DOUBLE, step=INT)
FILES = struct(path=STRING, name=STRING, is_directory=BOOL, content=STRING, size=LONG)
SYMBOL = struct(id=STRING, name=STRING, kind=STRING, file_path=STRING, start_line=INT, end_line=INT, content=STRING, is_exported=BOOL, parameter_count=INT, return_type=STRING)
PARSED = struct(
    file_path=STRING, language=STRING, symbols=ArrayType(SYMBOL), imports=ArrayType(struct(source=STRING, line=INT)), calls=ArrayType(struct(target=STRING, line=INT)), error=STRING
)
VECTORS = struct(node_id=STRING, chunk_index=INT, start_line=INT, end_line=INT, content_hash=STRING, embedding=ArrayType(FloatType(), False))
HASHES = struct(path=STRING, hash=STRING)
