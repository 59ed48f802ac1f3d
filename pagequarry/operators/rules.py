"""Rules, policies by pattern and sink routing (JN-11, JN-12, POL-08 to POL-15, SNK-07)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators.ranking import written

RULE = "id string, url_pattern string, content_type string, domain string, path_pattern string, priority int, enabled boolean, action string"


def glob_regex(pattern: str) -> str:
    """POL-11: a path glob as a regular expression: `*` and `?` do not cross `/`, `[a-z]` and `[^a-z]` are classes, `\\` takes the next character as it is.

    A pattern that is no glob (an open class, a backslash at the end) matches nothing.
    """
    out, i = [], 0

    def literal(at: int) -> tuple[str, int]:
        """(a character as a regular expression, what is behind it), perhaps behind a backslash."""
        at += pattern[at : at + 1] == "\\"
        if at >= len(pattern):
            raise IndexError
        return re.escape(pattern[at]), at + 1

    try:
        while i < len(pattern):
            if pattern[i] in "*?":
                out.append("[^/]*" if pattern[i] == "*" else "[^/]")
                i += 1
            elif pattern[i] == "[":
                negated = pattern[i + 1 : i + 2] == "^"
                i += 1 + negated
                parts: list[str] = []
                while pattern[i] != "]" or not parts:
                    low, i = literal(i)
                    if pattern[i] == "-":
                        high, i = literal(i + 1)
                        low = f"{low}-{high}"
                    parts.append(low)
                i += 1
                out.append(f"[{'^' if negated else ''}{''.join(parts)}]")
            else:
                part, i = literal(i)
                out.append(part)
    except IndexError:
        return "(?!)"
    return "^" + "".join(out) + "$"


def url_regex(pattern: str) -> tuple[str, str]:
    """POL-10: (`host` or `url`, regular expression).  `*.x` has no dot border, so `notx` matches as well."""
    if pattern == "*":
        return "url", "^"
    if pattern.startswith("*."):
        rest = pattern[2:]
        return "host", re.escape(rest.split("*")[0]) + ("" if "*" in rest else "$")
    return "url", glob_regex(pattern) if "*" in pattern else f"^{re.escape(pattern)}$"


#: a compiled rule: the conditions that must all hold (null: none), and one of them as a join key
COMPILED = "rule_id string, kind string, key string, ends string, holds string, url string, regex string, path_regex string, domain string, content_type string, priority int, action string"


def _prefix(glob: str) -> str | None:
    """The folders that a glob names before its first sign."""
    literal = re.split(r"[*?\[\\]", glob, maxsplit=1)[0]
    return literal[: literal.rfind("/") + 1] or None


def compile_rule(url_pattern: str | None, content_type: str | None, domain: str | None, path_pattern: str | None) -> tuple:
    """kind, key and the conditions ends, holds, url, regex, path_regex, domain, content_type of a rule.

    The key is the condition that the fewest rows meet, by kind: a host, an address, the end of a host, the folders of an address or of a path, a part of a host, a
    content type.  A rule without any is under the key of all rows.
    """
    ends = holds = url = regex = folders = None
    if url_pattern and url_pattern != "*":
        place, pattern = url_regex(url_pattern)
        if place == "host":
            rest = url_pattern[2:].split("*")[0]
            ends, holds = (None, rest) if "*" in url_pattern[2:] else (rest, None)  # an empty one holds for any host
        elif "*" in url_pattern:
            regex, folders = pattern, _prefix(url_pattern)
        else:
            url = url_pattern
    path_regex = glob_regex(path_pattern) if path_pattern else None
    keys = (("host", domain or None), ("url", url), ("ends", ends or None), ("folder", folders), ("path", _prefix(path_pattern) if path_pattern else None), ("holds", holds or None), ("type", content_type or None))
    kind, key = next(((k, v) for k, v in keys if v is not None), ("all", ""))
    return kind, key, ends, holds, url, regex, path_regex, domain or None, content_type or None


def compiled(rules: DataFrame) -> DataFrame:
    """POL-08: rules (as RULE has them) with their patterns compiled, in the tasks that hold them; disabled rules go, a rule is enabled where nothing is said."""
    import pyarrow as pa

    names = [f.split()[0] for f in COMPILED.split(", ")]

    def run(batches):
        for b in batches:
            out = [(r["id"], *compile_rule(r["url_pattern"], r["content_type"], r["domain"], r["path_pattern"]), r["priority"], r["action"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32() if n == "priority" else pa.string()) for i, n in enumerate(names)], names=names)

    known = rules.filter(F.coalesce("enabled", F.lit(True))).select("id", "url_pattern", "content_type", "domain", "path_pattern", F.coalesce("priority", F.lit(0)).alias("priority"), "action")
    return known.mapInArrow(run, COMPILED)


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """POL-08: a compiled table of rules that are at hand as dictionaries."""
    names = [f.split()[0] for f in RULE.split(", ")]
    return compiled(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rules], RULE))


def _folders(path: Column) -> Column:
    """Every beginning of a path that ends in `/`."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))


def _host_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules keyed by ends or parts of hosts, under each host of rows that has them; all ends of a host, and its parts of the lengths in use, are looked up, once for each host."""
    hosts = rows.select("host").filter("host IS NOT NULL").distinct()
    size = F.length("host")
    ends = F.transform(F.sequence(F.lit(1), size), lambda n: F.struct(F.lit("ends").alias("kind"), F.right("host", n).alias("key")))
    lengths = rules.filter("kind = 'holds'").agg(F.collect_set(F.length("key")).alias("lengths"))  # no more than a host has characters
    parts = F.flatten(F.transform(F.filter("lengths", lambda n: n <= size), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.struct(F.lit("holds").alias("kind"), F.substring(F.col("host"), i, n).alias("key")))))
    ends = hosts.filter(size > 0).select("host", F.explode(ends).alias("k"))
    parts = hosts.filter(size > 0).join(F.broadcast(lengths)).select("host", F.explode(F.array_distinct(parts)).alias("k"))
    named = ends.unionByName(parts).select("host", "k.kind", "k.key").join(rules, ["kind", "key"])
    return named.withColumn("kind", F.lit("host")).withColumn("key", F.col("host")).drop("host")


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """JN-12, POL-09, WIN-07: rows (url, host, path, content_type) with every rule they satisfy and its rank by priority, ties by id.

    rules: compiled.  Every rule has one key and every row a few (its host, its address, the folders of address and path, its type), so rows meet rules by an
    equi-join; expressions are tried on the pairs that meet.  The plan is the same for any number of rules, and none comes to the driver.  Only rules without a key meet every row.
    """
    rules = written(rules)
    indexed = rules.filter(~F.col("kind").isin("ends", "holds")).unionByName(_host_rules(rows, rules))
    indexed = indexed.select(*(F.col(c).alias(f"_{c}") for c in indexed.columns))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    keys = F.concat(
        F.array(key("host", F.col("host")), key("url", F.col("url")), key("type", F.col("content_type")), key("all", F.lit(""))),
        F.coalesce(F.transform(_folders(F.col("url")), lambda f: key("folder", f)), F.array().cast("array<struct<kind:string,key:string>>")),
        F.coalesce(F.transform(_folders(F.col("path")), lambda f: key("path", f)), F.array().cast("array<struct<kind:string,key:string>>")),
    )
    asked = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_k", F.explode(keys))
    met = asked.join(indexed, (F.col("_k.kind") == F.col("_kind")) & (F.col("_k.key") == F.col("_key")))
    same = lambda name, value: F.col(value).isNull() | F.coalesce(F.col(name) == F.col(value), F.lit(False))
    holds = lambda rule, test: F.col(rule).isNull() | F.coalesce(test, F.lit(False))
    plain = same("host", "_domain") & same("url", "_url") & same("content_type", "_content_type") & holds("_ends", F.endswith("host", "_ends")) & holds("_holds", F.contains("host", "_holds"))
    found = met.filter(plain).filter(holds("_regex", F.rlike("url", F.col("_regex"))) & holds("_path_regex", F.rlike("path", F.col("_path_regex"))))
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("_priority"), "_rule_id"))
    return found.select(*rows.columns, F.col("_rule_id").alias("rule_id"), F.col("_priority").alias("priority"), F.col("_action").alias("action"), rank.cast("long").alias("rank"))


def wildcard_policy(host: Column, patterns: list[str]) -> Column:
    """JN-11: the pattern for a host: exact first, then `*` and `*.x`, the longest, ties by name."""
    exact = [p for p in patterns if p != "*" and not p.startswith("*.")]
    wild = sorted((p for p in patterns if p.startswith("*.")), key=lambda p: (-len(p), p)) + [p for p in patterns if p == "*"]
    out = F.lit(None).cast("string")
    for p in reversed(wild):
        out = F.when(F.lit(True) if p == "*" else host.endswith(p[2:]), p).otherwise(out)
    for p in reversed(exact):
        out = F.when(host == p, p).otherwise(out)
    return out


def sink_of(value: Column, routes: list[tuple[str, str]], default: str) -> Column:
    """POL-15: the sink of the first pattern (`*`, `*.ending`, exact) that matches, else the default."""
    out = F.lit(default)
    for pattern, sink in reversed(routes):
        hit = F.lit(True) if pattern == "*" else value.endswith(pattern[1:]) if pattern.startswith("*.") else value == pattern
        out = F.when(hit, sink).otherwise(out)
    return out


def routed(rows: DataFrame, routes: list[tuple[str, Column]]) -> DataFrame:
    """SNK-07: a row for every route whose condition holds; rows of no route get the route null."""
    hits = F.filter(F.array(*[F.when(condition, F.lit(name)) for name, condition in routes]), lambda x: x.isNotNull())
    return rows.select("*", F.explode_outer(hits).alias("route"))


def processing_steps(flags: dict[str, Column]) -> Column:
    """POL-13: the two steps that always run and those that are on, in order."""
    names = ("metadata_extraction", "image_extraction", "markdown_conversion", "content_validation")
    steps = [F.lit("content_extraction"), F.lit("content_cleaning"), *[F.when(flags[n], F.lit(n)) for n in names if n in flags]]
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def first_per(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
