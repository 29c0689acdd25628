"""User-defined fields: typed writes and wide reads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: storage column and type per field type ---
COLUMN_OF = {"number": "value_number", "score": "value_number",
             "boolean": "value_bool", "date": "value_date",
             "multiselect": "value_json"}
_TYPES = {"value_text": "string", "value_number": "double", "value_bool": "boolean",
          "value_date": "timestamp", "value_json": "string"}
VALUE_COLUMNS = list(_TYPES)


def _storage(kind: str) -> str:
    return COLUMN_OF.get(kind, "value_text")


def _parsed(kind: str, text: Column) -> Column:
    if kind in ("number", "score"):
        return text.try_cast("double")
    if kind == "boolean":
        # Any non-empty value is true except the ways to write false.
        return ~F.lower(text).isin("false", "0", "no", "f", "n")
    if kind == "date":
        return text.try_cast("timestamp")
    if kind == "multiselect":
        return F.when(F.from_json(text, "array<string>").isNotNull(),
                      F.to_json(F.from_json(text, "array<string>")))
    return text


def write_values(entries: DataFrame, fields: dict) -> tuple[DataFrame, DataFrame]:
    """Split text entries (key, entity, entity_id, value) into typed rows and rejects.

    Every accepted value sits in exactly one typed column; a blank clears all of
    them. Unknown keys and unreadable values go to the second table.
    """
    c = F.col
    blank = F.coalesce("value", F.lit("")) == ""
    cells = {name: F.lit(None).cast(t) for name, t in _TYPES.items()}
    ok = F.lit(False)
    for key, kind in fields.items():
        mine = c("key") == key
        value = _parsed(kind, c("value"))
        column = _storage(kind)
        cells[column] = F.when(mine & ~blank, value.cast(_TYPES[column])).otherwise(
            cells[column])
        ok = ok | (mine & (blank | value.isNotNull()))
    typed = entries.withColumns({**cells, "_ok": F.coalesce(ok, F.lit(False))})
    return (typed.where("_ok").select("key", "entity", "entity_id", *VALUE_COLUMNS),
            typed.where("not _ok").select("key", "entity", "entity_id", "value"))


def upsert_values(stored: DataFrame, written: DataFrame) -> DataFrame:
    """Stored values with the written rows in place of older ones."""
    kept = stored.join(written, ["key", "entity", "entity_id"], "left_anti")
    return kept.unionByName(written.select(*stored.columns))


def read_values(values: DataFrame, fields: dict, entity: str = "job",
                prefix: str = "") -> DataFrame:
    """One row per entity, one typed column per field, missing as NULL.

    The pivot is written out over the known fields, so no pass over the data is
    needed to find them.
    """
    c = F.col
    out = []
    for key, kind in fields.items():
        value = F.max(F.when(c("key") == key, c(_storage(kind))))
        if kind == "multiselect":
            value = F.coalesce(F.from_json(value, "array<string>"),
                               F.array().cast("array<string>"))
            value = F.when(F.max(c("key") == key), value)
        out.append(value.alias(prefix + key))
    return (values.where(c("entity") == entity)
            .groupBy("entity_id").agg(*out))
