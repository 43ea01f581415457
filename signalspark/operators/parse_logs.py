"""Parse raw log lines into level, message, trace/span ids and fields.

Dispatch (after a Unicode trim): strict JSON object if the line starts with
``{`` and parses; else logfmt if it contains ``=``; else plain text with an
optional level prefix. Everything is a native Spark expression, so the parse
runs inside whole-stage codegen with no Python round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (JSON_LEVEL_KEYS, JSON_MESSAGE_KEYS, LEVEL_PREFIX_WORDS,
                         LOGFMT_LEVEL_KEYS, LOGFMT_MESSAGE_KEYS, SPAN_ID_KEYS,
                         TRACE_ID_KEYS, WS_CHARS)
from ..functions.text import WS, normalize_level, utrim

# Strict JSON: no single quotes, no NaN/Infinity literals, no comments.
JSON_OPTS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
             "allowComments": "false", "allowUnquotedFieldNames": "false"}

LEVEL_PREFIX_RE = (
    "(?i)^" + WS + "*[\\[\\(<]?(" + "|".join(LEVEL_PREFIX_WORDS) + ")[\\]>):" + WS_CHARS + "-]*"
    + WS + "*"
)
# key = text up to the next '=', value = quoted (closing quote optional) or up
# to the next space. Matches are contiguous, so no \G anchor is needed.
LOGFMT_PAIR_RE = WS + '*([^=]*)=(?:"([^"]*)"?|([^ ]*))'


def _sorted_json(m: Column) -> Column:
    """Compact JSON object text with keys in byte order."""
    return F.to_json(F.map_from_entries(F.transform(F.array_sort(F.map_keys(m)),
                                                    lambda k: F.struct(k, m[k]))))


def _json_str(m: Column, key: str) -> Column:
    """String value of ``key`` if it is a JSON string, else NULL."""
    v = m[key]
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))


def _first_present(m: Column, keys) -> Column:
    """Name of the first key present in ``m`` (NULL if none)."""
    out = None
    for k in keys:
        cond = F.map_contains_key(m, k)
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return out


def _stage_line(df: DataFrame, col: str) -> DataFrame:
    """Stage 1: the trimmed line and the dispatch flags."""
    line = utrim(F.col(col))
    x = df.withColumn("_line", line)
    ln = F.col("_line")
    as_array = F.from_json(F.concat(F.lit("["), ln, F.lit("]")), "array<map<string,variant>>", JSON_OPTS)
    as_field = F.from_json(F.concat(F.lit('{"w":'), ln, F.lit("}")), "struct<w:map<string,variant>>", JSON_OPTS)
    # the object wrap is parsed only for lines starting with '{' and kept as a
    # column, so later steps read the parsed map instead of re-parsing it
    x = x.withColumn("_obj", F.when(ln.startswith("{"), as_field["w"]))
    x = x.withColumn("_is_json", F.col("_obj").isNotNull()
                     & F.coalesce(F.when(ln.startswith("{"), F.size(as_array) == 1), F.lit(False)))
    x = x.withColumn("_is_logfmt", ~F.col("_is_json") & ln.contains("="))
    return x


def _stage_maps(x: DataFrame) -> DataFrame:
    """Stage 2: the JSON map (last duplicate wins) and the logfmt pair map,
    each built only for lines of that format."""
    ln = F.col("_line")
    pat = F.lit(LOGFMT_PAIR_RE)
    pairs = F.arrays_zip(F.regexp_extract_all(ln, pat, 1).alias("k"),
                         F.regexp_extract_all(ln, pat, 2).alias("q"),
                         F.regexp_extract_all(ln, pat, 3).alias("u"))
    lm = F.map_from_entries(F.transform(pairs, lambda p: F.struct(utrim(p["k"]).alias("key"),
                                                                  F.concat(p["q"], p["u"]).alias("value"))))
    x = x.withColumn("_jm", F.when(F.col("_is_json"), F.map_from_entries(F.map_entries("_obj"))))
    x = x.withColumn("_lm", F.when(F.col("_is_logfmt"), lm))
    x = x.withColumn("_prefix", F.when(~F.col("_is_json") & ~F.col("_is_logfmt"),
                                       F.regexp_extract(ln, LEVEL_PREFIX_RE, 0)))
    return x


def _stage_out(x: DataFrame) -> DataFrame:
    """Stage 3: the parsed columns."""
    ln, jm, lm = F.col("_line"), F.col("_jm"), F.col("_lm")
    is_json, is_logfmt = F.col("_is_json"), F.col("_is_logfmt")
    j_message = F.coalesce(*[_json_str(jm, k) for k in JSON_MESSAGE_KEYS], _sorted_json(jm))
    j_level = F.coalesce(*[_json_str(jm, k) for k in JSON_LEVEL_KEYS], F.lit("INFO"))
    j_trace = F.when(F.map_contains_key(jm, TRACE_ID_KEYS[0]), _json_str(jm, TRACE_ID_KEYS[0])) \
               .otherwise(_json_str(jm, TRACE_ID_KEYS[1]))
    j_span = F.when(F.map_contains_key(jm, SPAN_ID_KEYS[0]), _json_str(jm, SPAN_ID_KEYS[0])) \
              .otherwise(_json_str(jm, SPAN_ID_KEYS[1]))
    skip = F.array(*[F.lit(k) for k in JSON_MESSAGE_KEYS + JSON_LEVEL_KEYS + TRACE_ID_KEYS + SPAN_ID_KEYS])
    j_fields = _sorted_json(F.map_filter(jm, lambda k, v: ~F.array_contains(skip, k)))

    msg_key = _first_present(lm, LOGFMT_MESSAGE_KEYS)
    lvl_key = _first_present(lm, LOGFMT_LEVEL_KEYS)
    trc_key = _first_present(lm, TRACE_ID_KEYS)
    spn_key = _first_present(lm, SPAN_ID_KEYS)
    l_fields = _sorted_json(F.map_filter(
        lm, lambda k, v: ~(k.eqNullSafe(msg_key) | k.eqNullSafe(lvl_key)
                           | k.eqNullSafe(trc_key) | k.eqNullSafe(spn_key))))

    prefix = F.col("_prefix")
    p_level = F.when(F.length(prefix) > 0, F.regexp_extract(ln, LEVEL_PREFIX_RE, 1)).otherwise(F.lit("INFO"))
    p_message = F.substring(ln, F.length(prefix) + 1, 1 << 30)
    cols = {
        "log_format": F.when(is_json, "json").when(is_logfmt, "logfmt").otherwise("plain"),
        "level": normalize_level(F.when(is_json, j_level).when(is_logfmt, F.coalesce(lm[lvl_key], F.lit("INFO")))
                                 .otherwise(p_level)),
        "message": F.when(is_json, j_message).when(is_logfmt, F.coalesce(lm[msg_key], ln)).otherwise(p_message),
        "trace_id": F.when(is_json, j_trace).when(is_logfmt, lm[trc_key]),
        "span_id": F.when(is_json, j_span).when(is_logfmt, lm[spn_key]),
        "fields": F.when(is_json, j_fields).when(is_logfmt, l_fields).otherwise(F.lit("{}")),
    }
    # a generator's output is never substituted into later filters, so the parser
    # stays in the plan once; filters on the other columns still pass below it
    return x.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


STAGE_COLS = ["_line", "_obj", "_is_json", "_is_logfmt", "_jm", "_lm", "_prefix"]


def parse_logs(df: DataFrame, col: str = "raw", keep_raw: bool = True) -> DataFrame:
    """Add ``log_format, level, message, trace_id, span_id, fields`` parsed from ``col``.

    ``fields`` is the JSON object text of the extra keys, keys in byte order
    (logfmt values as JSON strings, JSON values as they were). The parse is
    staged so each line is JSON-decoded and pair-split at most once, also under
    later filters on the parsed columns.
    """
    out = _stage_out(_stage_maps(_stage_line(df, col))).drop(*STAGE_COLS)
    return out if keep_raw else out.drop(col)
