"""Robots rules as rows: parsing, canonical paths, the longest match by way of the patterns' literal heads."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bound

#: Patterns of a file that are read; a file of more is cut there, as readers of such files do.
MAX_RULES = 2000
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_KEPT = _PLAIN | frozenset("/*$?=&+,;:@!'()")


def canonical_path(path: str) -> str:
    """One spelling of a path or pattern: unreserved characters plain, all others as upper-case escapes."""
    out, i, data = [], 0, path
    while i < len(data):
        code = data[i + 1 : i + 3]
        if data[i] == "%" and len(code) == 2 and all(c in "0123456789abcdefABCDEF" for c in code):
            plain = chr(int(code, 16))
            out.append(plain if plain in _PLAIN else "%" + code.upper())
            i += 3
        else:
            out.append(data[i] if data[i] in _KEPT else "".join(f"%{b:02X}" for b in data[i].encode("utf-8", "surrogatepass")))
            i += 1
    return "".join(out)


def canonical_path_column(paths: Column) -> Column:
    spelled = F.pandas_udf(lambda rows: rows.map(lambda p: None if p is None else canonical_path(p)), "string")
    return spelled(paths)


_RULES = "origin string, agent string, seq int, allow boolean, pattern string, crawl_delay double"


def rules_of(text: str) -> list[tuple[str, bool | None, str | None, float | None]]:
    """(agent, allow, pattern, crawl_delay) in file order; a row without pattern states a group or its delay."""
    out: list[tuple] = []
    agents: list[str] = []
    naming, patterns = False, 0
    for line in (text or "").splitlines():
        name, colon, value = line.split("#", 1)[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents = [*agents, value.lower()] if naming else [value.lower()]
            naming = True
            out.append((value.lower(), None, None, None))
            continue
        naming = False
        if name in ("allow", "disallow") and value:
            pattern = value if value[0] in "/*" else "/" + value
            patterns += 1
            if patterns > MAX_RULES:
                continue
            out += [(a, name == "allow", canonical_path(pattern), None) for a in agents]
        elif name == "crawl-delay":
            try:
                delay = float(value)
            except ValueError:
                continue
            out += [(a, None, None, delay if delay > 0 else 0.0) for a in agents]
    return out


def parse(robots: DataFrame) -> DataFrame:
    """Rows (origin, agent, seq, allow, pattern, crawl_delay) of (origin, body) rows."""
    schema = pa.schema([("origin", pa.string()), ("agent", pa.string()), ("seq", pa.int32()), ("allow", pa.bool_()), ("pattern", pa.string()), ("crawl_delay", pa.float64())])

    def parsed(batches):
        for batch in batches:
            rows = [(origin, agent, i, allow, pattern, delay) for origin, body in zip(batch.column("origin").to_pylist(), batch.column("body").to_pylist(), strict=True) for i, (agent, allow, pattern, delay) in enumerate(rules_of(body))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return robots.select("origin", "body").mapInArrow(parsed, _RULES)


def literal_head(pattern: Column) -> Column:
    """What a pattern begins with, up to its first wildcard or closing mark."""
    return F.regexp_replace(F.substring_index(pattern, "*", 1), "[$]$", "")


def matches(path: Column, pattern: Column) -> Column:
    """Whether a path fits a pattern: ``*`` is any run, the end is open unless ``$`` closes it. The parts between wildcards are looked for from left to right, so time grows with the path."""
    closed = pattern.endswith("$")
    body = F.when(closed, F.substr(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)

    def placed(parts: Column) -> Column:
        n = F.size(parts)
        first, last = F.get(parts, F.lit(0)), F.get(parts, n - 1)
        begin = F.when(path.startswith(first), F.length(first) + 1).otherwise(0)
        inner = F.slice(parts, 2, F.greatest(n - F.when(closed, 2).otherwise(1), F.lit(0)))
        step = lambda at, part: F.when(at > 0, bound(F.call_function("locate", part, path, at), lambda i: F.when(i > 0, i + F.length(part)).otherwise(0))).otherwise(0)
        at = F.aggregate(inner, begin, step)
        ends = path.endswith(last) & (at <= F.length(path) - F.length(last) + 1)
        return F.when(closed & (n == 1), path == first).when(closed, (at > 0) & ends).otherwise(at > 0)

    return bound(F.split(body, r"\*+"), placed)


def decide(requests: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """(origin, path, allowed, crawl_delay) of (origin, path) rows: the most specific group for the agent, its longest matching pattern, allow on ties."""
    named = rules.where((F.col("agent") != "*") & F.lit(agent.lower()).contains(F.col("agent")) | (F.col("agent") == "*"))
    weight = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent") + 1)
    best = named.groupBy("origin").agg(F.max(F.struct(weight.alias("w"), "agent"))["agent"].alias("agent"))
    own = named.join(best, ["origin", "agent"])
    delay = own.where(F.col("crawl_delay").isNotNull()).groupBy("origin").agg(F.max(F.struct("seq", "crawl_delay"))["crawl_delay"].alias("crawl_delay"))
    patterns = own.where(F.col("pattern").isNotNull()).select("origin", "pattern", literal_head(F.col("pattern")).alias("head"), F.struct(F.length("pattern").alias("n"), F.col("allow").cast("int").alias("a")).alias("rank"))
    # a path meets the patterns whose literal head it begins with: of its beginnings, those as long as a head of its origin
    heads = patterns.groupBy("origin").agg(F.collect_set(F.length("head")).alias("lengths"))
    paths = requests.select("origin", "path").distinct().withColumn("spelled", canonical_path_column(F.col("path")))
    begins = paths.join(heads, "origin").select("origin", "path", "spelled", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("spelled")), lambda n: F.substr("spelled", F.lit(1), n))).alias("head"))
    met = begins.join(patterns, ["origin", "head"]).where(matches(F.col("spelled"), F.col("pattern"))).groupBy("origin", "path").agg(F.max("rank")["a"].alias("a"))
    asked = requests.select("origin", "path").join(met, ["origin", "path"], "left").join(delay, "origin", "left")
    return asked.select("origin", "path", (F.coalesce("a", F.lit(1)) == 1).alias("allowed"), F.nullif(F.col("crawl_delay"), F.lit(0.0)).alias("crawl_delay"))


def permitted(decisions: DataFrame, policy: str = "enforce") -> DataFrame:
    """decisions with ``permitted`` and ``warning``: ``enforce`` refuses what the rules disallow, ``warn`` lets it pass with a warning, ``off`` does not look."""
    bad = ~F.col("allowed")
    return decisions.withColumn("permitted", ~bad if policy == "enforce" else F.lit(True)).withColumn("warning", bad if policy == "warn" else F.lit(False))
