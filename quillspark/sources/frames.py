"""Server-sent event frames, widget settings and keys."""

from __future__ import annotations

import secrets

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.url import origin_allowed
from quillspark.operators.billing import signature_valid


def frame(event: Column, payload: Column) -> Column:
    """One frame from an event name and a struct or map."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def read_frames(spark: SparkSession, path: str, payload_type: str, stream: bool = False) -> DataFrame:
    """``event, payload`` of files of frames, also as a stream of new files.

    The reader cuts at blank lines, so a frame is a row wherever it lies in a file of
    any size; the stream's checkpoint knows which files were read, so a restart
    reads none twice.  Frames without data (heartbeats) are left out.
    """
    reader = spark.readStream if stream else spark.read
    raw = reader.option("lineSep", "\n\n").text(path)
    event, data = F.regexp_extract("value", r"(?m)^event: (.*)$", 1), F.regexp_extract("value", r"(?m)^data: (.*)$", 1)
    return raw.where(data != "").select(event.alias("event"), F.from_json(data, payload_type).alias("payload"))


def write_frames(rows: DataFrame, path: str, event_col: str, payload_col: str, mode: str = "append") -> None:
    """Rows as files of frames; a payload is a struct or map."""
    text = F.concat(F.lit("event: "), F.col(event_col), F.lit("\ndata: "), F.to_json(payload_col))
    rows.select(text.alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)


def read_deliveries(spark: SparkSession, path: str, secret: str, stream: bool = False) -> DataFrame:
    """Webhook deliveries, a JSON line ``{body, signature, received}`` each, with ``valid``.

    The signature is checked on the body as it came, at the time it was received
    (epoch seconds); a body that was decoded and encoded again would not verify.
    """
    reader = (spark.readStream if stream else spark.read).schema("body string, signature string, received long")
    rows = reader.json(path)
    return rows.withColumn("valid", signature_valid(F.col("body"), F.col("signature"), secret, received=F.col("received")))


def parse_frames(streams: DataFrame, raw_col: str, payload_type: str) -> DataFrame:
    """``event, payload`` rows of concatenated frames, in order; frames without data are left out."""
    parts = streams.select(*[c for c in streams.columns if c != raw_col], F.posexplode(F.split(raw_col, "\n\n", -1)).alias("n", "__frame"))
    event, data = F.regexp_extract("__frame", r"(?m)^event: (.*)$", 1), F.regexp_extract("__frame", r"(?m)^data: (.*)$", 1)
    return parts.withColumns({"event": event, "payload": F.from_json(data, payload_type)}).where(data != "").drop("__frame")


def json_map(text: Column) -> Column:
    """A JSON object's values as strings; empty or invalid text is no settings at all."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.from_json(text, "map<string,string>"), none)


def pick(settings: Column, key: str, fallback: Column | object) -> Column:
    return F.coalesce(settings[key], fallback if isinstance(fallback, Column) else F.lit(fallback))


def public_widget(config: Column, name: Column) -> Column:
    """What a visitor's browser may see, each field with its fallback."""
    # The widget's defaults.
    defaults = {"accentColor": "#0f6b5c", "logoUrl": None, "badgeOn": "true", "theme": "light", "position": "right", "language": "auto"}
    s = json_map(config)
    return F.struct(pick(s, "name", name).alias("name"), *(pick(s, k, F.lit(v).cast("string")).alias(k) for k, v in defaults.items()))


# Shapes of widget keys and invitation tokens.
KEY = r"^wk_[0-9A-HJKMNP-TV-Z]{26}$"
INVITE = r"^inv_[0-9A-HJKMNP-TV-Z]{52}$"


# Fixed value: the letters of keys.
LETTERS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _new_keys(prefix: str, size: int):
    """Unguessable keys, one for every row; they differ each time a row is computed, so write them once."""

    @F.pandas_udf("string")
    def keys(rows: pd.Series) -> pd.Series:
        return pd.Series([prefix + "".join(LETTERS[b & 31] for b in secrets.token_bytes(size)) for _ in range(len(rows))])

    return keys.asNondeterministic()


def new_widget_key(of: Column | str) -> Column:
    return _new_keys("wk_", 26)(of)


def new_invite(of: Column | str) -> Column:
    return _new_keys("inv_", 52)(of)


def is_widget_key(key: Column) -> Column:
    return F.coalesce(F.rlike(key, F.lit(KEY)), F.lit(False))


def is_invite(token: Column) -> Column:
    return F.coalesce(F.rlike(token, F.lit(INVITE)), F.lit(False))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def source_view(sources: DataFrame) -> DataFrame:
    """What a dashboard may see of sources."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("title", "type", "status", "error")]
    return sources.select("id", *text, F.coalesce(F.col("pages").cast("long"), F.lit(0).cast("long")).alias("pages"))


def string_list(text: Column) -> Column:
    """A JSON list of strings; empty or invalid text is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def resolve_widgets(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Requests ``(request, key, origin)`` with the workspace they reach: a well-formed key that is known, from an allowed origin."""
    shaped = requests.where(is_widget_key(F.col("key")))
    known = workspaces.select("workspace", F.col("widget_key").alias("key"), "allowed_domains")
    return shaped.join(known, "key").where(origin_allowed(string_list(F.col("allowed_domains")), F.col("origin"))).select("request", "workspace")
