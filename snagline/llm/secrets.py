"""Secret scan with linking of multipart credentials.  DataFrame functions only.

Strong patterns are reported wherever they match.  Weak ones (a bare key-like
token, a user or client identifier, an endpoint) mean little alone: each is
reported only where its complement stands in the same scope, which an interval
join over (text, block of places) finds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import stored, text_of

#: Characters around an identifier that belong to its scope.
REACH = 200
#: Matches of a text whose places are added up together: arrays that grow stay this short.
BLOCK = 256


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_IDS = "|".join(map(_either_case, ("access_?key_?id", "client_?id", "user_?name", "user", "login", "account")))
_SCHEMES = "https?|postgres(?:ql)?|mysql|mongodb(?:[+]srv)?|redis|amqps?|jdbc:[a-z]+|s3"

#: Fixed by the contract: kind, expression, the group whose length counts, its least length.
STRONG = (
    ("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"(AKIA[A-Z0-9]{12,})", 1, 16),  # the same as AKIA[A-Z0-9]+ of 16 and more
    ("hex", r"([0-9a-f]{32,})", 1, 32),  # the same as [0-9a-f]+ of 32 and more
)
#: Of the method: parts that count only together.
WEAK = (
    ("id", rf"(?:{_IDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]+)", 1, 3),
    ("key", r"(?<![A-Za-z0-9+/=_-])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=_-])", 1, 40),
    ("endpoint", rf"((?:{_SCHEMES})://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+)", 1, 8),
)
KINDS = [k for k, *_ in STRONG + WEAK]
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, however often a lambda in use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, kind: str, expression: str, group: int, least: int) -> Column:
    """Spans of the matches: the gaps between them and their own lengths add up to their places."""
    gaps = F.split(text, expression, -1)
    matches = F.regexp_extract_all(text, F.lit(f"({expression})"), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(expression), F.lit(group))
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(matches)),
        F.arrays_zip(matches.alias("m"), counted.alias("c")),
        lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x["m"]).alias("own"), F.length(x["c"]).alias("counts")),
    )
    def spans(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out"))

        def add(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            span = F.struct(
                begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (begin + x["own"]).alias("end")
            )
            out = F.when(x["counts"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct((begin + x["own"]).alias("at"), out.alias("out"))

        return F.aggregate(block, start, add, lambda acc: acc["out"])

    def placed(all_steps: Column) -> Column:
        n = F.floor((F.size(all_steps) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(all_steps, i * BLOCK + 1, F.lit(BLOCK)))
        return _once(blocks, joined)

    def joined(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["own"]))
        # where each block begins; one number a block, so this array stays short as well
        begins = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), spans))

    found = _once(steps, placed)
    return F.when(text.rlike(expression), found).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """(k1, k2, spans) of the weak parts that have their complement in scope."""
    covered = F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach))
    bare, within = parts.where("kind = 'key'").alias("p"), parts.where("kind = 'assign'").withColumn("block", F.explode(covered)).alias("a")
    spot = [F.col(f"p.{c}") == F.col(f"a.{c}") for c in ("k1", "k2", "block")]
    crossing = (F.col("a.start") < F.col("p.end")) & (F.col("p.start") < F.col("a.end"))
    # a key inside an assignment is that assignment's value
    taken = bare.withColumn("block", F.explode(covered)).alias("p").join(within, spot[0] & spot[1] & spot[2] & crossing, "left_semi")
    parts = parts.join(taken.select("k1", "k2", "kind", "start").distinct(), ["k1", "k2", "kind", "start"], "left_anti")
    parts = parts.withColumn("block", F.floor(F.col("start") / reach))
    ids = parts.where(F.col("kind").isin("access", "id"))
    blocks = F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))
    scopes = ids.select(
        "k1", "k2", "kind", F.col("start").alias("s"), F.col("end").alias("e"), "rank", F.explode(blocks).alias("block")
    )
    secrets = parts.where(F.col("kind").isin("assign", "key"))
    inside = (F.col("p.start") >= F.col("i.s") - reach) & (F.col("p.start") <= F.col("i.e") + reach)
    equal = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in ("k1", "k2", "block")]
    on = equal[0] & equal[1] & equal[2] & inside
    keys = secrets.where("kind = 'key'").alias("p").join(scopes.alias("i"), on, "left_semi")
    full = scopes.alias("i").join(secrets.alias("p"), on, "left_semi")
    # a scope was cut into blocks; what one block found holds for the whole scope
    full = full.select("k1", "k2", "kind", "s", "e", "rank").distinct()
    again = F.sequence(F.floor((F.col("s") - reach) / reach), F.floor((F.col("e") + reach) / reach))
    ends = parts.where("kind = 'endpoint'").alias("p").join(full.withColumn("block", F.explode(again)).alias("i"), on, "left_semi")
    columns = ["k1", "k2", "start", "rank", "kind", "end"]
    weak_ids = full.where("kind = 'id'").select("k1", "k2", F.col("s").alias("start"), "rank", "kind", F.col("e").alias("end"))
    every = keys.select(columns).unionAll(ends.select(columns)).unionAll(weak_ids.select(columns))
    return every.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "rank", "kind", "end")).alias("linked"))


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", reach: int = REACH) -> DataFrame:
    """One row per document with its secrets.

    Strong kinds: assign, access, hex.  Linked kinds: key (a bare token of 40
    characters with an identifier within `reach` characters), id (an
    identifier with a secret in its scope) and endpoint (in the scope of an
    identifier that has a secret).  Spans are code points, end exclusive,
    ordered by start, then by kind in that order.  A null text counts as empty;
    an empty text has no spans and the digest of the empty string.  Repeated
    rows stay; other columns are not read.  An empty table gives no rows.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    arrays = [_spans(F.col("text"), *kind).alias(kind[0]) for kind in STRONG + WEAK]
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2")]
    rows = stored(whole.select("doc_id", *key, *arrays), "spans")
    weak = rows.where(F.size("id") + F.size("key") + F.size("endpoint") > 0)
    parts = weak.select("k1", "k2", F.explode(F.concat("assign", "access", "id", "key", "endpoint")).alias("x"))
    parts = stored(parts.select("k1", "k2", "x.*").distinct(), "parts")
    linked = stored(_linked(parts, reach), "linked")
    base = F.array_sort(F.concat("assign", "access", "hex"))
    every = F.array_sort(F.concat("assign", "access", "hex", F.coalesce("linked", F.array().cast(_SPAN))))
    return rows.join(linked, ["k1", "k2"], "left").select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in STRONG],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )
