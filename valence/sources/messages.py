"""JSON messages ``{"text": ..., "label": ...}``, written and read with any Spark format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

MESSAGE_SCHEMA = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())]
)


def to_messages(posts: DataFrame, label: str = "target", keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON string per row. ``keep`` names further columns, such as an order key."""
    fields = [F.col("text"), F.col(label).cast("int").alias("label"), *keep]
    return posts.select(F.to_json(F.struct(*fields)).alias("value"))


def publish(messages: DataFrame, fmt: str = "text", **options: str) -> None:
    """Write messages to a topic (``kafka``) or to a folder of lines (``text``)."""
    messages.write.format(fmt).mode("append").options(**options).save()


def message_stream(spark: SparkSession, fmt: str = "text", **options: str) -> DataFrame:
    """A stream of raw messages, from a topic (``kafka``) or a folder of lines (``text``)."""
    return spark.readStream.format(fmt).options(**options).load()


def parse_messages(
    raw: DataFrame,
    schema: T.StructType = MESSAGE_SCHEMA,
    value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Parse the JSON in ``value``; what cannot be read becomes null. Batch or stream.

    ``keep`` names columns of the source to carry along, such as partition and offset.
    """
    parsed = F.from_json(F.col(value).cast("string"), schema).alias("data")
    return raw.select(*keep, parsed).select(*keep, "data.*")


def checked_messages(
    raw: DataFrame,
    schema: T.StructType = MESSAGE_SCHEMA,
    value: str = "value",
    keep: tuple[str, ...] = (),
    required: tuple[str, ...] = ("text",),
) -> DataFrame:
    """Parse the JSON in ``value``, and say in ``reasons`` why what could not be read is null. Batch or stream.

    ``reasons`` maps names of fields to reasons, and is null where all is well. A message that is no JSON object has
    that reason for each required field. A field that is absent or null is without a reason, unless it is required.
    A number is never read from a string, cut to a whole one or made to fit; a string is read from any scalar.
    """
    data = F.try_parse_json(F.col(value).cast("string"))
    kind = F.schema_of_variant(data)
    broken = F.when(data.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object")
    parsed = raw.select(*keep, data.alias("_data"), broken.alias("_broken"))
    fields, reasons = [], []
    for field in schema.fields:
        found, reason = _field(field)
        lacking = F.lit("absent") if field.name in required else F.lit(None).cast("string")
        broken = F.col("_broken") if field.name in required else F.lit(None).cast("string")
        at = F.try_variant_get("_data", _path(field.name), "variant")
        void = at.isNull() | F.is_variant_null(at)
        why = F.when(F.col("_broken").isNotNull(), broken).when(void, lacking).otherwise(reason)
        reasons.append(F.struct(F.lit(field.name).alias("key"), why.alias("value")))
        fields.append(F.when(F.col("_broken").isNull() & ~void, found).cast(field.dataType).alias(field.name))
    given = F.filter(F.array(*reasons), lambda r: r["value"].isNotNull())
    given = F.when(F.size(given) > 0, F.map_from_entries(given))
    return parsed.select(*keep, *fields, given.alias("reasons"))


def _path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def _field(field: T.StructField):
    """The value of a field, and the reason if it cannot be read."""
    path = _path(field.name)
    kind = F.schema_of_variant(F.try_variant_get("_data", path, "variant"))
    scalar = ~kind.rlike("^(OBJECT|ARRAY)")
    if isinstance(field.dataType, T.StringType):
        return F.when(scalar, F.try_variant_get("_data", path, "string")), F.when(~scalar, "not a string")
    if isinstance(field.dataType, T.IntegralType):
        # Numbers without a point are BIGINT, or DECIMAL without a scale if they are longer.
        whole, number = kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        fitting = F.try_variant_get("_data", path, field.dataType.simpleString())
        reason = F.when(~number, "not a number").when(~whole, "not a whole number").when(fitting.isNull(), "out of range")
        return F.when(whole, fitting), reason
    found = F.try_variant_get("_data", path, field.dataType.simpleString())
    return found, F.when(found.isNull(), F.concat(F.lit("not of type "), F.lit(field.dataType.simpleString())))
