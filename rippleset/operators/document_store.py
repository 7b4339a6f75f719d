"""Changes of document stores: operations to typed changes, differences of snapshots, and references between collections by field name.

Names are ASCII and come out in capitals, as those of relational changes. A null or wordless operation is no change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleset.config import KNOWN_COLLECTIONS

# --- Fixed values: forms of the operations, in the order in which they are tried; least length of a bare name that is taken for a collection ---
CREATE, DROP, MODIFY = (rf"(?i)^\s*{word}\s+COLLECTION\s+(\w+)" for word in ("CREATE", "DROP", "MODIFY"))
CREATE_INDEX, DROP_INDEX = r"(?i)(\w+)\.createIndex\s*\([^)]*\)", r"(?i)(\w+)\.dropIndex\s*\([^)]+\)"
FIELD, QUOTED, WORD = r"""\{["']?(\w+)["']?\s*:""", r"""["']([^"']+)["']""", r"(\w+)"
LONGER_THAN = 3
#: The index that every collection has.
OWN_INDEX = "_id_"
# ---


def classify_operations(changes: DataFrame, statement: str = "statement", strict: bool = False) -> DataFrame:
    """``changes`` with ``change_type``, ``collection_name``, ``field_name``, ``index_name``, in capitals.

    What is no known operation is a change of the collection that its first word names; ``strict`` takes only known or longer names.
    """
    text = F.col(statement)
    first = F.lower(F.regexp_extract(text, WORD, 1))
    bare = (first != "") & (first.isin(*KNOWN_COLLECTIONS) | (F.length(first) > LONGER_THAN)) if strict else first != ""
    kinds = (("CREATE_COLLECTION", CREATE), ("DROP_COLLECTION", DROP), ("CREATE_INDEX", CREATE_INDEX), ("DROP_INDEX", DROP_INDEX), ("MODIFY_COLLECTION", MODIFY))
    kind = name = None
    for what, pattern in kinds:
        test, found = text.rlike(pattern), F.regexp_extract(text, pattern, 1)
        kind = F.when(test, what) if kind is None else kind.when(test, what)
        name = F.when(test, found) if name is None else name.when(test, found)
    kind, name = kind.when(bare, "MODIFY_COLLECTION"), name.when(bare, first)
    part = lambda what, pattern: F.when(kind == what, F.upper(F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))))
    return changes.select("*", kind.alias("change_type"), F.upper(name).alias("collection_name"), part("CREATE_INDEX", FIELD).alias("field_name"), part("DROP_INDEX", QUOTED).alias("index_name"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``collection, index_name, change_type, statement`` of the differences of two snapshots (``collection, index_name``; a null index: the collection alone).

    Collections that came or went, and indexes that came or went in any of them; the index that every collection has does not count.
    """
    side = lambda df, was: df.select("collection", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.col("index_name")))).alias("index_name"), F.lit(was).alias("was"))
    both = side(before, True).unionByName(side(after, False)).groupBy("collection", "index_name").agg(F.max("was").alias("was"), F.max(~F.col("was")).alias("now"))
    told = both.where("was <> now and collection is not null").where(F.col("index_name").isNull() | (F.col("index_name") != OWN_INDEX))
    alone, verb = F.col("index_name").isNull(), F.when(F.col("now"), "CREATE").otherwise("DROP")
    on_index = F.when(F.col("now"), F.concat(F.lit("db."), F.col("collection"), F.lit(".createIndex(...)"))).otherwise(F.concat(F.lit("db."), F.col("collection"), F.lit(".dropIndex('"), F.col("index_name"), F.lit("')")))
    return told.select(
        "collection", "index_name", F.concat(verb, F.when(alone, "_COLLECTION").otherwise("_INDEX")).alias("change_type"), F.when(alone, F.concat(verb, F.lit(" COLLECTION "), F.col("collection"))).otherwise(on_index).alias("statement"))


def inferred_fields(documents: DataFrame) -> DataFrame:
    """``collection, field, n`` of every top-level field of JSON documents (``collection, value``), all documents counted; no JSON object, no field."""
    keys = documents.select("collection", F.explode(F.json_object_keys("value")).alias("field"))
    return keys.groupBy("collection", "field").agg(F.count(F.lit(1)).alias("n"))


def key_of(collection: Column) -> Column:
    """The field by which other collections refer to one: its singular with ``_id``."""
    return F.concat(F.regexp_replace(F.lower(collection), "s+$", ""), F.lit("_id"))


def document_references(fields: DataFrame) -> DataFrame:
    """``collection, direction, other, field``: entities that a collection's fields name, and collections that name it; its own key is none."""
    own = fields.select(F.lower("collection").alias("collection"), F.lower("field").alias("field")).distinct()
    named = own.where(F.col("field").rlike(r"^\w+_id$") & (F.col("field") != key_of(F.col("collection"))))
    forward = named.select("collection", F.lit("FORWARD").alias("direction"), F.upper(F.regexp_replace("field", "_id$", "")).alias("other"), "field")
    known = own.select(F.col("collection").alias("of"), key_of(F.col("collection")).alias("field")).distinct()
    back = known.join(named, "field").select(F.col("of").alias("collection"), F.lit("REVERSE").alias("direction"), F.upper("collection").alias("other"), "field")
    return forward.unionByName(back)
