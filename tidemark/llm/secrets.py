"""Secret scanning with multipart credential linking.

Base spans are regular-expression matches. Weak candidates, such as an account name, a random-looking
token or a service address, say nothing alone; they are reported only where a complementary part lies in
the same scope: the same paragraph and at most ``reach`` characters away. Positions come from the lengths
of what lies between the matches, so matching stays inside the scan; only the short part rows are joined
by interval, as a range window per document and paragraph. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import fresh_name

# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

#: kinds in the order in which spans of one start are listed
KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")
#: kind -> what the part is for a credential
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "token": "secret", "endpoint": "endpoint"}
IDENTIFIER = r"""(?i)\b(?:access_?key(?:_?id)?|client_?id|account(?:_?name|_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})"""
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?i)\b(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s\"'<>]+"
BREAK = r"\n[\x20\t\r]*\n\s*"
#: regular expressions that hold for every text with a match of the kind, cheap to test
PATTERNS = {
    # a hex run or key of the least length is a match of the base pattern that passes, and the other way round
    "assign": ASSIGN, "access": rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}", "hex": rf"[0-9a-f]{{{HEX_LENGTH},}}",
    "identifier": IDENTIFIER, "token": TOKEN, "endpoint": ENDPOINT, "break": BREAK,
}
BASE = KINDS[:3]
REACH = 300
MATCHES = "array<struct<kind:string,number:int,gap:int,length:int,ok:boolean>>"


def _passes(kind: str, hit: Column, value: Column) -> Column:
    if kind == "assign":
        return F.length(value) >= ASSIGN_VALUE
    if kind == "token":  # random-looking: capitals, small letters and digits
        return hit.rlike("[A-Z]") & hit.rlike("[a-z]") & hit.rlike("[0-9]")
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    """The matches of one kind, each with the length of the text since the one before; null if there are none."""
    pattern = F.lit(PATTERNS[kind])
    between = F.transform(F.split(text, PATTERNS[kind], -1), lambda piece: F.length(piece))
    zipped = F.arrays_zip(
        between.alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(2 if kind == "assign" else 0)).alias("value"),
    )
    rows = F.transform(
        F.filter(zipped, lambda m: m["hit"].isNotNull()),  # what follows the last match has none
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("number"), m["gap"].alias("gap"), F.length(m["hit"]).alias("length"), _passes(kind, m["hit"], m["value"]).alias("ok")
        ),
    )
    return F.when(text.rlike(PATTERNS[kind]), rows).otherwise(F.array().cast(MATCHES))


def _any_weak(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(PATTERNS[k]) for k in KINDS[3:]])


def parts(documents: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """One row per match that passes: keys, kind, start, end, scope (number of the paragraph).

    Each document has a further row with a null kind. Positions are in code points, ends exclusive.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    none = F.array().cast(MATCHES)
    marker = F.array(F.lit(None)).cast(MATCHES)  # a row of nulls, so that no document gets lost
    breaks = F.when(_any_weak(text), _matches("break", text)).otherwise(none)
    found = documents.select(*keys, F.concat(marker, *[_matches(k, text) for k in KINDS], breaks).alias("found"))
    rows = found.select(*keys, F.explode("found").alias("m")).select(*keys, "m.*")
    so_far = Window.partitionBy(*keys, "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far)).withColumn("start", F.col("end") - F.col("length"))
    paragraph = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    scoped = placed.withColumn("scope", F.count_if(F.col("kind") == "break").over(paragraph))
    return scoped.where(F.col("kind").isNull() | (F.col("ok") & (F.col("kind") != "break"))).select(*keys, "kind", "start", "end", "scope")


def link(found: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """The parts to report: base spans, and weak candidates beside a complementary part.

    A secret needs an identifier, an identifier a secret, an endpoint both. A weak token that overlaps a
    base span is that span again and not reported.
    """
    role = reduce(lambda c, kind: c.when(F.col("kind") == kind, F.lit(ROLES[kind])), KINDS, F.when(F.lit(False), F.lit("")))
    is_base = F.col("kind").isin(*BASE)
    near = Window.partitionBy(*keys, "scope").orderBy("start").rangeBetween(-reach, reach)
    before = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    joined = (
        found.withColumn("role", role)
        .withColumn("covered", F.coalesce(F.max(F.when(is_base, F.col("end"))).over(before) > F.col("start"), F.lit(False)))
        .withColumn("cut", F.coalesce(F.min(F.when(is_base, F.col("start"))).over(after) < F.col("end"), F.lit(False)))
        .withColumn("again", ~is_base & (F.col("covered") | F.col("cut")))
    )
    counted = joined.withColumn("secrets", F.count_if((F.col("role") == "secret") & ~F.col("again")).over(near)).withColumn(
        "identifiers", F.count_if((F.col("role") == "identifier") & ~F.col("again")).over(near)
    )
    complementary = (
        F.when(F.col("kind") == "token", F.col("identifiers") > 0)
        .when(F.col("kind") == "identifier", F.col("secrets") > 0)
        .otherwise((F.col("identifiers") > 0) & (F.col("secrets") > 0))
    )
    return counted.where(F.col("kind").isNull() | is_base | (~F.col("again") & complementary)).select(*keys, "kind", "start", "end")


def spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: doc_id, text_key, and ``found``, its spans (start, order, kind, end) in order.

    A null text counts as empty and has none. Rows that repeat an id or are null there are documents of
    their own; ``text_key`` (a hash of the text) tells texts of one id apart.
    """
    source = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column)).alias("text_key"), F.col(text_column).alias("text")
    )
    keys = ["row", "doc_id", "text_key"]
    order = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(KINDS.index(k))), KINDS, F.when(F.lit(False), F.lit(0)))
    linked = link(parts(source, keys), keys, reach)
    one = F.when(F.col("kind").isNotNull(), F.struct(F.col("start"), order.alias("order"), F.col("kind"), F.col("end")))
    all_docs = linked.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("found"))
    return all_docs.select("doc_id", "text_key", "found")


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    spans_of = F.col("found")
    base = F.filter(spans_of, lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(spans_of, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(spans_of).alias("spans")
    )


def redact(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", mask: str = "[secret]", reach: int = REACH) -> DataFrame:
    """The documents with every reported span replaced by ``mask``; overlapping spans become one mask.

    All columns stay; n_chars, where there is one, is the new length. Documents without spans are unchanged.
    """
    taken = documents.columns
    found_name, text_name, key_name, id_name, hash_name = (fresh_name(c, taken) for c in ("found", "text", "key", "id", "found_key"))
    found = spans(documents, id_column, text_column, reach).where(F.size("found") > 0).dropDuplicates(["doc_id", "text_key"])
    text = F.col(text_name)
    merged = F.aggregate(
        F.col(found_name),
        F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).cast("long").alias("done")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["done"], F.concat(acc["pieces"], F.array(F.substring(text, (acc["done"] + 1).cast("int"), (s["start"] - acc["done"]).cast("int")), F.lit(mask))))
            .otherwise(acc["pieces"])
            .alias("pieces"),
            F.greatest(acc["done"], s["end"]).alias("done"),
        ),
        lambda acc: F.concat(F.array_join(acc["pieces"], ""), F.substring(text, (acc["done"] + 1).cast("int"), F.length(text))),
    )
    keyed = documents.withColumn(text_name, F.col(text_column)).withColumn(key_name, F.xxhash64(F.col(text_column)))
    joined = keyed.join(
        found.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(hash_name), F.col("found").alias(found_name)).hint("merge"),
        keyed[id_column].eqNullSafe(F.col(id_name)) & (F.col(key_name) == F.col(hash_name)),
        "left",
    )
    new = F.when(F.col(found_name).isNotNull(), merged).otherwise(text)
    columns = [new.alias(c) if c == text_column else F.length(new).cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in documents.columns]
    return joined.select(*columns)
