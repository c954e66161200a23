"""Deduplication of log bodies: exact, canonical, by mined template, and of consecutive runs.

Token classes and canonical forms are SQL expressions; only nested JSON and template mining (``templates``) run in Python, on distinct bodies.
Non-ASCII text is kept as it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.operators import ranges, templates

# Keys whose numeric values are always replaced in key=value bodies, and those whose numbers become 0 in JSON
# (lower case, without '_', '-' and '.').
KV_KEYS = "agentid requestid reqid traceid spanid messageid task tasks count total num size queuesize maxqueuesize maxqueuesizeseen".split()
JSON_KEYS = """requestid reqid pathid routeid sessionid correlationid traceid spanid messageid offset position cursor size length len
task tasks count total num timestamp time epoch ts duration elapsed latency port pid tid threadid""".split()

#: Patterns of token classes and their placeholders; the first that matches counts. None keeps the token.
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0?[0-9]?[0-9])"
TOKEN_CLASSES: tuple[tuple[str, str | None], ...] = (
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "_UUID_"),
    (r"^[0-9a-fA-F]{0,4}(:[0-9a-fA-F]{0,4}){6,}$", "_IPV6_"),
    (r"^[0-9a-fA-F]{2}(:[0-9a-fA-F]{2}){5}$", "_MAC_"),
    (rf"^{OCTET}(\.{OCTET}){{3}}$", "_IPV4_"),
    (r"^0[xX][0-9a-fA-F]+$", "_HEX_"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}", "_TS_"),
    (r"^/[^/]*/", "_PATH_"),
    (r"^[0-9]*[a-fA-F][0-9a-fA-F]*$", None),  # hexadecimal: replaced from eight characters on
    (r"^\".{17,}\"$|^'.{17,}'$", '"_"'),
    (r"^\".*\"$|^'.*'$", None),
    (r"^[^0-9:.]*[a-zA-Z][^0-9:.]*$", None),
    (r"::", None),
)


def split_tail(token: str) -> tuple[str, str]:
    """SQL: a token without trailing punctuation, and that punctuation."""
    return f"regexp_replace({token}, '[,;:)\\\\]}}]+$', '')", f"regexp_extract({token}, '[,;:)\\\\]}}]+$', 0)"


def compound(token: str) -> str:
    """SQL: letters and frame characters kept, long hexadecimal and digit runs replaced."""
    runs = f"regexp_extract_all({token}, '(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{{8,}}|[A-Za-z]+|[0-9][0-9a-fA-F]*|[^A-Za-z0-9]', 0)"
    long_hex = "length(r) >= 8 and r rlike '^[0-9a-fA-F]+$' and r rlike '[0-9]' and r rlike '[a-fA-F]'"
    return f"array_join(transform({runs}, r -> case when {long_hex} then '_HEX_' when r rlike '^[0-9]' and length(r) >= 3 then '_N_' else r end), '')"


def _plain(token: str) -> list[str]:
    """SQL: cases of plain numbers and words, which most tokens are; their results are those of the classes, which needn't be tried one by one."""
    number = f"when {token} rlike '^[0-9]+$' then if({token} rlike '^[0-9]{{3,}}$', '_N_', {token})"
    return [number, f"when {token} rlike '^[a-zA-Z]+$' then if(length({token}) >= 8 and {token} rlike '^[a-fA-F]+$', '_HEX_', {token})"]


def classified(token: str) -> str:
    """SQL: a token by its class."""
    cases = _plain(token)
    for pattern, name in TOKEN_CLASSES:
        p = pattern.replace("\\", "\\\\").replace("'", "\\'")
        if name is None and "a-fA-F][0-9a-fA-F]*$" in pattern:
            cases.append(f"when length({token}) >= 8 and {token} rlike '{p}' then '_HEX_'")
        else:
            cases.append(f"when {token} rlike '{p}' then " + (f"'{name}'" if name else token))
    return (
        f"case {' '.join(cases)} when {token} rlike '[a-zA-Z]' and {token} rlike '[0-9]' then {compound(token)} "
        f"when {token} rlike '^[0-9]{{3,}}$' then '_N_' when {token} rlike '^[0-9]+\\\\.[0-9]+$' then '_F_' else {token} end"
    )


def freetext(body: str) -> Column:
    """Free text with each word classified, joined by single spaces."""
    core, tail = split_tail("t")
    return F.expr(f"array_join(transform(filter(split({body}, '\\\\s+'), t -> t <> ''), t -> concat(transform(array({core}), c -> {classified('c')})[0], {tail})), ' ')")


def key_value(body: str) -> Column:
    """key=value text: keys kept, values classified; words without '=' are classified whole."""
    core, tail = split_tail("substring(t, instr(t, '=') + 1)")
    key = "substring(t, 1, instr(t, '=') - 1)"
    always = ", ".join(f"'{k}'" for k in KV_KEYS)
    value = f"case when c = '' then '' when lower(regexp_replace({key}, '[^A-Za-z0-9]', '')) in ({always}) and c rlike '^[0-9.-]+$' then if(contains(c, '.'), '_F_', '_N_') else {classified('c')} end"
    pair = f"concat({key}, '=', transform(array({core}), c -> {value})[0], {tail})"
    return F.expr(f"array_join(transform(filter(split({body}, '\\\\s+'), t -> t <> ''), t -> if(instr(t, '=') > 1, {pair}, {classified('t')})), ' ')")


PREFIX = r"^\[[0-9:]+\]\s+\S+\.\w+:[0-9]+:?\s*"


def shape(body: str) -> Column:
    """json, kv, prefixed or freetext."""
    b = F.col(body)
    is_json = b.rlike(r"^\s*[\{\[]") & F.try_parse_json(F.ltrim(b)).isNotNull()
    return F.when(is_json, "json").when(F.regexp_count(b, F.lit(r"\b\w+=\S+")) >= 2, "kv").when(b.rlike(PREFIX + r"\S"), "prefixed").otherwise("freetext")


def _json_value(key: str, v: object) -> object:
    if isinstance(v, dict):
        return {k: _json_value(k, x) for k, x in v.items()}
    if isinstance(v, list):
        if not v:
            return []
        if not any(isinstance(x, (dict, list)) for x in v):
            return {"__arr": "scalar"}
        return {"__arr": "object", "__shape": sorted(v[0])} if isinstance(v[0], dict) else {"__arr": "mixed"}
    if isinstance(v, str):
        if len(v) == 36 and re.match(TOKEN_CLASSES[0][0], v):
            return "_UUID_"
        if v.startswith("/"):
            return "_PATH_"
        plain = v.isascii() and all(c.isalpha() or c == "_" for c in v)
        if len(v.encode()) <= 12 and plain:
            return v
        return "_" if len(v.encode()) > 40 or any(c.isdigit() and c.isascii() or c in ".-/" for c in v) else v
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        if "".join(c for c in key.lower() if c.isalnum() and c.isascii()) in JSON_KEYS:
            return 0
        if isinstance(v, float):
            return v if v in (0.0, 1.0) else 0.0
        return v if abs(v) < 1000 else 0
    return v


def json_text(body: str) -> Column:
    """JSON with sorted keys, variable values replaced and arrays as descriptors; null for what isn't JSON."""

    @F.pandas_udf(T.StringType())
    def canonical_json(s: pd.Series) -> pd.Series:
        out = []
        for text in s:
            try:
                out.append(json.dumps(_json_value("", json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return canonical_json(F.col(body))


def canonical(body: str) -> Column:
    """The canonical form by shape, without JSON (see ``json_text``); a source prefix is stripped first."""
    return F.when(shape(body) == "kv", key_value(body)).otherwise(freetext(f"regexp_replace({body}, '" + PREFIX.replace("\\", "\\\\") + "', '')"))


def groups(df: DataFrame, keys: Sequence[str], position: str, ts: str, body: str) -> DataFrame:
    """Per key: count, first and last time, and the body that comes first in order."""
    first = F.col(body) if body in keys else F.min_by(body, position)  # texts kept in aggregates make Spark sort the rows
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), first.alias("representative"), F.min(position).alias("first_pos"))


def merged_groups(exact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of groups: counts add up, spans widen, the first group's representative stays."""
    return exact.groupBy(*keys).agg(*_merging())


def _merging() -> list[Column]:
    return [F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("representative", "first_pos").alias("representative"), F.min("first_pos").alias("first_pos")]


def collapse(df: DataFrame, stream: str, position: str, keys: Sequence[str], ts: str, body: str) -> DataFrame:
    """Runs of consecutive rows of a stream with equal keys, as groups with ``run`` numbers from 1."""
    rows = ranges.previous(ranges.ranged(df, position), [stream], [position], keys, "__previous")
    changed = F.col("__previous").isNull()
    for k in keys:
        changed |= ~F.col(k).eqNullSafe(F.col("__previous")[k])
    runs = ranges.running(rows, [stream], [position], F.when(changed, 1).otherwise(0), "run").drop("__previous", "__range")
    return groups(runs, [stream, "run", *keys], position, ts, body)


def reduction(groups_df: DataFrame) -> DataFrame:
    """(groups, events, reduction_pct): one row."""
    n, total = F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))
    return groups_df.agg(n.alias("groups"), total.cast("long").alias("events"), F.round(F.when(total > 0, (1 - n / total) * 100).otherwise(0.0), 1).alias("reduction_pct"))


def similarity(a: str, b: str) -> Column:
    """Share of equal tokens of two equally long token arrays."""
    return F.expr(f"case when size({a}) <> size({b}) then 0.0D when size({a}) = 0 then 1.0D else size(filter(zip_with({a}, {b}, (x, y) -> x = y), t -> t)) / size({a}) end")


def template(a: str, b: str) -> Column:
    """The tokens of two arrays, with '<*>' where they differ."""
    return F.expr(f"zip_with({a}, {b}, (x, y) -> if(x = y, x, '<*>'))")


def distinct_full(df: DataFrame, position: str, ts: str, body: str, threshold: float = 0.7, bucket: Sequence[str] = (), depth: int = 4, delimiters: Sequence[str] = ()) -> DataFrame:
    """The whole chain: bucket columns, n, first_seen, last_seen, representative, first_pos, template (null unless mining merged).

    Equal bodies are grouped, then groups with equal canonical forms; what is still alone in its bucket is mined for templates by its
    canonical form, in order of position. Positions must be distinct. Null bodies are equal to each other and have no canonical form.
    """
    keys = list(bucket)
    exact = groups(df, [*keys, body], position, ts, body)
    merged = merged_groups(exact.withColumn("__form", F.coalesce(canonical(body), F.lit(""))), [*keys, "__form"]).persist()  # read several times: forms are costly
    alone = merged.filter("n = 1")
    name = F.to_json(F.struct(*keys)) if keys else F.lit("")
    found = templates.assigned(alone.select(name.alias("bucket"), F.col("first_pos").alias("pos"), F.col("__form").alias("body")), threshold, depth, delimiters)
    alone = alone.join(found.select(F.col("pos").alias("first_pos"), "cluster", F.col("template").alias("__template")), "first_pos")
    alone = alone.groupBy(*keys, "cluster").agg(*_merging(), F.max_by("__template", "first_pos").alias("template"))
    alone = alone.withColumn("template", F.when(F.col("n") > 1, F.col("template")))
    out = [*keys, "n", "first_seen", "last_seen", "representative", "first_pos"]
    return merged.filter("n > 1").select(*out, F.lit(None).cast("string").alias("template")).unionByName(alone.select(*out, "template"))


def described(groups_df: DataFrame, behaviour: str, matcher: str, template: str | None = None) -> DataFrame:
    """Groups with the attributes that emitted records carry, as columns ``dedup_*``, and the groups' times and body."""
    mined = F.col(template).isNotNull() if template else F.lit(False)
    used = F.when(mined & F.lit(matcher == "full"), "drain3").otherwise("canon" if matcher == "full" else matcher)
    names = {"distinct": ("global", "whole-selection"), "collapse": ("bucketed", "consecutive-run")}
    scope, window = names.get(behaviour, ("unknown", "unknown"))
    return groups_df.select(
        F.col("first_seen").alias("time_ns"),
        F.col("last_seen").alias("observed_ns"),
        F.col("representative").alias("body"),
        F.col("n").alias("dedup_count"),
        F.concat(F.lit(behaviour + "/"), used).alias("dedup_mode"),
        F.lit(behaviour).alias("dedup_behaviour"),
        used.alias("dedup_matcher"),
        F.lit(scope).alias("dedup_scope"),
        F.lit(window).alias("dedup_window"),
        F.expr("greatest(last_seen - first_seen, 0) div 1000000").alias("dedup_time_span_ms"),
    )
