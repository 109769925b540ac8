"""Problem 2: records that are the same but for formatting, by Merkle-style bottom-up hashing.

A text is read as a record: a form (fields `name: value` or `name = value` parted by `;`, `|` or line
ends) is an unordered node over its fields, any other text is one leaf. Leaves are normalised (lower
case, letters and digits only), the digests of unordered children are sorted, and records are grouped
by root digest. A full comparison of the canonical record confirms every group, so a digest collision
can't join two texts. The canonical records are computed once and staged.

Nulls are never copies. Texts without a letter or digit have an empty leaf and are copies of each
other only if their characters agree. An id that arrives more than once counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_KEYS, HOT_ROWS, SALTS, stage

FIELD = r"^\\s*[^:=]+[:=]"
#: A form as a nested record: an unordered array of fields.
FORM = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))


def leaf(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.when(flat == "", F.concat(F.lit("\u0001"), F.trim(text))).otherwise(flat)


def _field(part: str) -> str:
    name = f"regexp_replace(lower(regexp_extract({part}, '^([^:=]*)[:=]', 1)), '[^\\\\p{{L}}\\\\p{{N}}]+', '')"
    value = f"regexp_replace(lower(regexp_replace({part}, '^[^:=]*[:=]', '')), '[^\\\\p{{L}}\\\\p{{N}}]+', '')"
    return f"concat({name}, '\\u0002', {value})"


def _parts(text: str) -> str:
    return f"filter(split({text}, '[;|\\\\r\\\\n]+'), p -> trim(p) <> '')"


def is_form(text: str) -> Column:
    """Most parts of the text are fields, the first of them too."""
    parts = _parts(text)
    fields = f"filter({parts}, p -> p rlike '{FIELD}')"
    return F.expr(
        f"{text} rlike '[:=]' AND {text} rlike '[;|\\\\n]' AND size({fields}) >= 2 "
        f"AND 2 * size({fields}) > size({parts}) AND element_at({parts}, 1) rlike '{FIELD}'"
    )


def form_record(text: str) -> Column:
    """The sorted fields of a form in one string."""
    return F.expr(f"concat('\\u0003', array_join(array_sort(transform({_parts(text)}, p -> {_field('p')})), '\\u0003'))")


def canonical(text: str) -> Column:
    """The canonical record of a text column: its sorted fields for a form, else its one leaf."""
    return F.when(is_form(text), form_record(text)).otherwise(leaf(F.col(text)))


def digest(canonical_col: str) -> Column:
    """Root digest of a canonical record: a form is an unordered node over its fields, any other text a leaf."""
    pair = "struct(split(f, '\\u0002')[0] AS name, split(f, '\\u0002')[1] AS value)"
    form = F.expr(f"transform(split(substring({canonical_col}, 2), '\\u0003'), f -> {pair})")
    return F.when(F.col(canonical_col).startswith("\u0003"), merkle(form, FORM, unordered_arrays=True)).otherwise(F.md5(F.col(canonical_col)))


def merkle(value: Column, kind: T.DataType, unordered_arrays: bool = False) -> Column:
    """Bottom-up digest of a nested value: structs and maps are unordered nodes, arrays ordered ones
    unless told otherwise, strings normalised leaves, other values leaves by their text. Null is a leaf
    of its own."""
    null = F.lit("null")
    if isinstance(kind, T.StructType):
        parts = [F.md5(F.concat(F.lit(f.name.lower()), F.lit("="), merkle(value[f.name], f.dataType, unordered_arrays))) for f in kind]
        node = F.md5(F.array_join(F.array_sort(F.array(*parts)), "")) if parts else F.md5(F.lit("{}"))
        return F.when(value.isNull(), null).otherwise(node)
    if isinstance(kind, T.ArrayType):
        children = F.transform(value, lambda x: merkle(x, kind.elementType, unordered_arrays))
        return F.coalesce(F.md5(F.array_join(F.array_sort(children) if unordered_arrays else children, ",")), null)
    if isinstance(kind, T.MapType):
        pairs = F.transform(
            F.map_entries(value),
            lambda e: F.md5(F.concat(merkle(e["key"], kind.keyType, unordered_arrays), F.lit("="), merkle(e["value"], kind.valueType, unordered_arrays))),
        )
        return F.coalesce(F.md5(F.array_join(F.array_sort(pairs), "")), null)
    if isinstance(kind, T.StringType):
        return F.coalesce(F.md5(leaf(value)), null)
    return F.coalesce(F.md5(value.cast("string")), null)


def records(df: DataFrame, id_col: str, text_col: str, part: str | None = None) -> DataFrame:
    """(part, id, root, canon): the canonical record of every text and its root digest."""
    return (
        df.select((F.col(part) if part else F.lit("")).alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where("text IS NOT NULL AND id IS NOT NULL")
        .select("part", "id", F.explode(F.array(canonical("text"))).alias("canon"))
        .select("part", "id", digest("canon").alias("root"), "canon")
    )


def copy_groups(df: DataFrame, id_col: str, text_col: str, part: str | None = None) -> DataFrame:
    """(part, first_id, copy_id): one row for each further id of every group of copies.

    Hot groups (a third of all rows, say) are found by their digest in a broadcast of at most HOT_KEYS
    keys and salted for the confirming comparison, so no task holds a whole group.
    """
    rows = stage(records(df, id_col, text_col, part), "records")
    key = ["part", "root"]
    groups = rows.groupBy(*key).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select(*key, "n")
    hot = groups.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *key).limit(HOT_KEYS).withColumnRenamed("n", "hot_n")
    marked = rows.join(F.broadcast(hot), key, "left").withColumn(
        "at", F.when(F.col("hot_n").isNotNull(), F.concat(F.lit("hot"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("string"))).otherwise(F.col("root"))
    )
    cold = groups.withColumnRenamed("root", "at")
    members = (
        marked.join(cold, ["part", "at"], "left")
        .where("hot_n IS NOT NULL OR n IS NOT NULL")
        .select(*key, "id", "canon", F.coalesce("hot_n", "n").alias("n"))
        .withColumn("salt", F.when(F.col("n") > HOT_ROWS, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    )
    exact = (
        members.groupBy(*key, "canon")
        .agg(F.min("id").alias("first_id"), F.max("n").alias("n"))
        .withColumn("salt", F.explode(F.when(F.col("n") > HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        .drop("n")
    )
    return (
        members.join(exact, [*key, "canon", "salt"])
        .where("id <> first_id")
        .select("part", "first_id", F.col("id").alias("copy_id"))
        .distinct()
    )


def copy_counts(df: DataFrame, id_col: str, text_col: str, part: str | None = None) -> DataFrame:
    """(part, root, first_id, copies): one row for each distinct record, with its root digest and the number of ids
    that hold it. Ids are counted once, and partly before the shuffle, so a hot group is no hot task."""
    key = ["part", "root", "canon"]
    return (
        records(df, id_col, text_col, part).groupBy(*key, "id").agg(F.lit(1).alias("one"))
        .groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
        .select("part", "root", "first_id", "copies")
    )
