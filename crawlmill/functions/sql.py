"""The URL and signature functions under SQL names, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PATH = "if(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) = '', '/', regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1))"
_PARTS = "filter(split(element_at(split({0}, '/'), -1), '[.]'), x -> x <> '')".format(_PATH)
_ENDED = f"if(endswith({_PATH}, '/'), {_PATH}, {_PATH} || '/')"
_CLEAN = "filter(split(regexp_replace(substring_index(substring_index(trim(link), '?', 1), '#', 1), '[\\\\s\"<>^`{|}\\\\\\\\]', ''), '/'), p -> p <> '')"
FUNCTIONS = {
    "url_path(url STRING) RETURNS STRING": _PATH,
    "url_depth(url STRING) RETURNS INT": f"if(regexp_like(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), length({_ENDED}) - length(replace({_ENDED}, '/', '')), 0)",
    "url_extension(url STRING) RETURNS STRING": f"if(size({_PARTS}) > 1, element_at({_PARTS}, -1), null)",
    "sub_paths(link STRING) RETURNS ARRAY<STRING>": f"transform(filter(sequence(size({_CLEAN}), 0, -1), i -> i > 0), i -> array_join(slice({_CLEAN}, 1, i), '/') || if(i < size({_CLEAN}), '/', ''))",
    "hamming64(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "simhash64(tokens ARRAY<STRING>) RETURNS BIGINT": "aggregate(sequence(0, 63), 0L, (s, i) -> s | if(aggregate(tokens, 0, (n, t) -> n + if(getbit(xxhash64(t), i) = 1, 1, -1)) > 0, shiftleft(1L, i), 0L))",
}


def register_functions(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
