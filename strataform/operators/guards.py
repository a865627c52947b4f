"""Integrity guards: each is a predicate over the manifest tables that must return no row.

Tables: manifest (one row: n_objects, n_blocks, n_attributes, block_size, metadata_bytes,
header_sum, directory_sum, header_sum_found, directory_sum_found), objects, attributes, blocks
and codes (decoded facts of encoded records).  The SQL is plain enough for any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The limits of a container.
MOST_PARTS = 1_000_000
MOST_DEPTH = 1000
MOST_METADATA = 65_536

#: Name of each guard, and the rows that break it.
GUARDS: dict[str, str] = {
    "header_checksum": "SELECT header_sum AS found, header_sum_found AS wanted FROM manifest WHERE header_sum <> header_sum_found",
    "directory_checksum": "SELECT directory_sum AS found, directory_sum_found AS wanted FROM manifest WHERE directory_sum <> directory_sum_found",
    "block_checksum": "SELECT sequence, checksum FROM blocks WHERE checksum <> checksum_found",
    "object_count": f"SELECT n_objects, CAST((SELECT count(*) FROM objects) AS BIGINT) AS found FROM manifest WHERE n_objects > {MOST_PARTS} OR n_objects <> (SELECT count(*) FROM objects)",
    "directory_length": "SELECT n_blocks, CAST((SELECT count(*) FROM blocks) AS BIGINT) AS found FROM manifest WHERE n_blocks <> (SELECT count(*) FROM blocks)",
    "block_offsets": "SELECT sequence, start_at FROM (SELECT sequence, start_at, lag(start_at + stored_len) OVER (ORDER BY sequence) AS wanted FROM blocks) AS b WHERE wanted IS NOT NULL AND start_at <> wanted",
    "compressed_smaller": "SELECT sequence, stored_len, decoded_len FROM blocks WHERE compression = 1 AND stored_len >= decoded_len",
    "declared_block_size": "SELECT sequence, decoded_len FROM blocks WHERE decoded_len > (SELECT max(block_size) FROM manifest)",
    "block_range": "SELECT object_id, first_block, block_count FROM objects WHERE block_count > 0 AND first_block + block_count > (SELECT count(*) FROM blocks)",
    "numeric_length": "SELECT o.object_id, o.logical_len, CAST(sum(b.logical_count) AS BIGINT) AS found FROM objects o JOIN blocks b ON b.object_id = o.object_id WHERE o.type IN ('integer', 'double') GROUP BY o.object_id, o.logical_len HAVING sum(b.logical_count) <> o.logical_len",
    "logical_length": "SELECT o.object_id, o.logical_len, CAST(sum(b.logical_count) AS BIGINT) AS found FROM objects o JOIN blocks b ON b.object_id = o.object_id WHERE o.type = 'logical' GROUP BY o.object_id, o.logical_len HAVING sum(b.logical_count) <> o.logical_len",
    "string_length": "SELECT o.object_id, o.logical_len, CAST(sum(b.logical_count) AS BIGINT) AS found FROM objects o JOIN blocks b ON b.object_id = o.object_id WHERE o.type = 'character' AND b.encoding <> 'entries' GROUP BY o.object_id, o.logical_len HAVING sum(b.logical_count) <> o.logical_len",
    "string_count": "SELECT b.sequence, b.logical_count, b.decoded_len FROM blocks b JOIN objects o ON o.object_id = b.object_id WHERE o.type = 'character' AND b.encoding <> 'index' AND b.logical_count > b.decoded_len / 5",
    "children_range": "SELECT o.object_id, o.child_count, CAST(count(c.object_id) AS BIGINT) AS found FROM objects o LEFT JOIN objects c ON c.parent_id = o.object_id AND c.object_id > o.object_id WHERE o.type IN ('list', 'data.frame', 'factor') GROUP BY o.object_id, o.child_count HAVING count(c.object_id) <> o.child_count",
    "depth": f"SELECT object_id, depth FROM objects WHERE depth > {MOST_DEPTH}",
    "frame_rows": "SELECT c.object_id, c.logical_len, p.logical_len AS wanted FROM objects c JOIN objects p ON c.parent_id = p.object_id WHERE p.type = 'data.frame' AND c.type <> 'data.frame' AND c.logical_len <> p.logical_len",
    "attribute_range": "SELECT a.owner, a.name, a.value_object FROM attributes a LEFT JOIN objects o ON o.object_id = a.owner LEFT JOIN objects v ON v.object_id = a.value_object WHERE o.object_id IS NULL OR v.object_id IS NULL",
    "reference_target": "SELECT o.object_id, o.shared_with FROM objects o LEFT JOIN objects t ON t.object_id = o.shared_with WHERE o.shared_with IS NOT NULL AND (t.object_id IS NULL OR t.object_id >= o.object_id OR t.shared_with IS NOT NULL)",
    "metadata_length": f"SELECT metadata_bytes FROM manifest WHERE metadata_bytes > {MOST_METADATA}",
    "delta_width": "SELECT sequence, width FROM codes WHERE encoding IN ('delta', 'frame') AND (width > 32 OR width < 0)",
    "int_run_end": "SELECT c.sequence, c.last_end FROM codes c JOIN blocks b ON b.sequence = c.sequence WHERE c.encoding = 'int_runs' AND (c.last_end <> b.logical_count OR c.ends_rise = 0)",
    "logical_run_end": "SELECT c.sequence, c.last_end FROM codes c JOIN blocks b ON b.sequence = c.sequence WHERE c.encoding = 'logical_runs' AND (c.last_end <> b.logical_count OR c.ends_rise = 0)",
    "string_record_length": "SELECT c.sequence, c.record_bytes FROM codes c JOIN blocks b ON b.sequence = c.sequence WHERE c.encoding = 'records' AND c.record_bytes > b.decoded_len",
    "dict_index_range": "SELECT sequence, top_id, entries FROM codes WHERE encoding = 'index' AND top_id >= entries",
    "zstd_length": "SELECT c.sequence, c.frame_len, b.decoded_len FROM codes c JOIN blocks b ON b.sequence = c.sequence WHERE b.compression = 1 AND c.frame_len IS NOT NULL AND c.frame_len <> b.decoded_len",
    "alp_exception_position": "SELECT c.sequence, c.top_position FROM codes c JOIN blocks b ON b.sequence = c.sequence WHERE c.encoding = 'decimal' AND (c.top_position >= b.logical_count OR c.ends_rise = 0)",
}

SCHEMAS = {
    "manifest": "n_objects bigint, n_blocks bigint, block_size bigint, metadata_bytes bigint, header_sum string, header_sum_found string, directory_sum string, directory_sum_found string",
    "objects": "object_id bigint, parent_id bigint, type string, logical_len bigint, child_count bigint, first_block bigint, block_count bigint, depth bigint, shared_with bigint",
    "attributes": "owner bigint, name string, value_object bigint",
    "blocks": "sequence bigint, object_id bigint, start_at bigint, stored_len bigint, logical_count bigint, decoded_len bigint, compression bigint, encoding string, checksum string, checksum_found string",
    "codes": "sequence bigint, encoding string, width bigint, last_end bigint, ends_rise bigint, record_bytes bigint, top_id bigint, entries bigint, frame_len bigint, top_position bigint",
}

#: A small clean directory: a frame of a logical, an integer, a double and a character column, and a shared copy.
CLEAN: dict[str, list[tuple]] = {
    "manifest": [(6, 6, 1048576, 120, "a1", "a1", "d1", "d1")],
    "objects": [
        (0, None, "data.frame", 100, 5, 0, 0, 0, None),
        (1, 0, "logical", 100, 0, 0, 1, 1, None),
        (2, 0, "integer", 100, 0, 1, 2, 1, None),
        (3, 0, "double", 100, 0, 3, 1, 1, None),
        (4, 0, "character", 100, 0, 4, 2, 1, None),
        (5, 0, "double", 100, 0, 0, 0, 1, 3),
    ],
    "attributes": [(0, "names", 4), (0, "class", 4)],
    "blocks": [
        (0, 1, 32, 40, 100, 60, 1, "logical_runs", "c0", "c0"),
        (1, 2, 72, 100, 60, 240, 1, "delta", "c1", "c1"),
        (2, 2, 172, 60, 40, 160, 1, "int_runs", "c2", "c2"),
        (3, 3, 232, 300, 100, 800, 1, "decimal", "c3", "c3"),
        (4, 4, 532, 70, 12, 90, 1, "entries", "c4", "c4"),
        (5, 4, 602, 108, 100, 108, 0, "index", "c5", "c5"),
    ],
    "codes": [
        (0, "logical_runs", None, 100, 1, None, None, None, 60, None),
        (1, "delta", 9, None, None, None, None, None, 240, None),
        (2, "int_runs", None, 40, 1, None, None, None, 160, None),
        (3, "decimal", None, None, 1, None, None, None, 800, 97),
        (4, "records", None, None, None, 80, None, None, 90, None),
        (5, "index", None, None, None, None, 11, 12, None, None),
    ],
}

#: For each guard, one cell of the clean directory to change: table, row, column, value.
TAMPERED: dict[str, tuple[str, int, str, object]] = {
    "header_checksum": ("manifest", 0, "header_sum_found", "a2"),
    "directory_checksum": ("manifest", 0, "directory_sum_found", "d2"),
    "block_checksum": ("blocks", 2, "checksum_found", "xx"),
    "object_count": ("manifest", 0, "n_objects", 1_000_001),
    "directory_length": ("manifest", 0, "n_blocks", 7),
    "block_offsets": ("blocks", 2, "start_at", 176),
    "compressed_smaller": ("blocks", 1, "stored_len", 240),
    "declared_block_size": ("manifest", 0, "block_size", 500),
    "block_range": ("objects", 4, "block_count", 3),
    "numeric_length": ("blocks", 2, "logical_count", 41),
    "logical_length": ("blocks", 0, "logical_count", 99),
    "string_length": ("blocks", 5, "logical_count", 98),
    "string_count": ("blocks", 4, "logical_count", 1 << 40),
    "children_range": ("objects", 0, "child_count", 6),
    "depth": ("objects", 3, "depth", 1001),
    "frame_rows": ("objects", 3, "logical_len", 101),
    "attribute_range": ("attributes", 1, "value_object", 50),
    "reference_target": ("objects", 5, "shared_with", 9),
    "metadata_length": ("manifest", 0, "metadata_bytes", 70_000),
    "delta_width": ("codes", 1, "width", 33),
    "int_run_end": ("codes", 2, "last_end", 45),
    "logical_run_end": ("codes", 0, "ends_rise", 0),
    "string_record_length": ("codes", 4, "record_bytes", 100),
    "dict_index_range": ("codes", 5, "top_id", 12),
    "zstd_length": ("codes", 3, "frame_len", 804),
    "alp_exception_position": ("codes", 3, "top_position", 100),
}


def directory(name: str | None = None) -> dict[str, list[tuple]]:
    """The clean directory, or the one that breaks the guard ``name``."""
    out = {t: list(rows) for t, rows in CLEAN.items()}
    if name:
        table, row, column, value = TAMPERED[name]
        place = [c.split()[0] for c in SCHEMAS[table].split(", ")].index(column)
        cells = list(out[table][row])
        cells[place] = value
        out[table][row] = tuple(cells)
    return out


def violations(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of the tables that break the guard."""
    return spark.sql(_with_names(GUARDS[name]), **tables)


def _with_names(sql: str) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN) (manifest|objects|attributes|blocks|codes)\b", r"\1 {\2}", sql)


def frames(spark: SparkSession, rows: dict[str, list[tuple]]) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame(r, SCHEMAS[t]) for t, r in rows.items()}


def check(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Names of the guards that the tables break."""
    return [name for name in GUARDS if violations(spark, name, tables).limit(1).count()]


def sql_values(rows: dict[str, list[tuple]]) -> str:
    """The tables as common table expressions of literals."""

    def literal(x: object, kind: str) -> str:
        kind = {"string": "VARCHAR"}.get(kind, kind.upper())
        return f"CAST({'NULL' if x is None else repr(x)} AS {kind})"

    out = []
    for t, schema in SCHEMAS.items():
        columns = [c.split() for c in schema.split(", ")]
        values = ", ".join("(" + ", ".join(literal(x, k) for x, (_, k) in zip(r, columns, strict=True)) + ")" for r in rows[t])
        out.append(f"{t}({', '.join(c for c, _ in columns)}) AS (VALUES {values})")
    return "WITH " + ", ".join(out) + " "
