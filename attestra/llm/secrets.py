"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base spans (assign, access, hex) are certain enough on their own. Three weaker
kinds are reported only where complementary parts stand in one scope, SCOPE
characters to either side: an `ident` (an access or account name) beside a
secret, an `opaque` string (long, with digits and letters of both cases) beside an
identifier, an `endpoint` (an address) beside both. For that, the candidates of
texts that have such parts are laid out as intervals and joined with their
neighbours on either side by windows over each text, in the order of their places: linear in
their number, never pair by pair. Equal texts are linked once.

Cases: null text is empty, without spans; equal rows give equal results; an
empty table gives no rows; other columns are ignored. Places count code points,
ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents
from .fingerprint import let

SCOPE = 400

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: name -> pattern. Runs are whole, so a least length drops just the runs that are shorter.
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
WEAK = {
    "ident": r"""(?i)(?<![a-z0-9])(?:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[a-z0-9@._-]{3,}""",
    "opaque": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{20,}",
    "endpoint": r"(?<![A-Za-z0-9])(?:https?|s3|ftp|amqps?|postgres(?:ql)?|mysql|mongodb|redis)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+",
}
KINDS = [*BASE, *WEAK]
#: Even, as matches stand at odd places.
BLOCK = 128
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _cut(text: Column, pattern: str) -> Column:
    """text before, in, after, ... each match: matches at odd places."""
    mark = F.concat(F.lit("﷐"), F.hex(F.xxhash64(text)), F.lit("﷑"))  # no text holds its own hash
    return F.split(F.regexp_replace(text, F.lit(pattern), F.concat(mark, F.lit("$0"), mark)), mark)


def found(text: Column, kind: str) -> Column:
    """All spans of a kind, leftmost first, without overlap.

    Pieces are summed up in blocks of BLOCK, then the blocks: arrays that grow in a fold stay short in texts of very many spans.
    """
    pattern = (BASE | WEAK)[kind]
    rank = KINDS.index(kind)
    span = lambda start, end: F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
    none = F.array().cast(SPAN)

    def step(s: Column, piece: Column) -> Column:
        end = s["at"] + F.char_length(piece)
        right = s["i"] % 2 == 1
        if kind == "assign":
            right = right & (F.char_length(F.regexp_extract(piece, pattern, 2)) >= 6)
        return F.struct(end.alias("at"), (s["i"] + 1).alias("i"), F.when(right, F.concat(s["spans"], F.array(span(s["at"], end)))).otherwise(s["spans"]).alias("spans"))

    def blocks(cut: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), none.alias("spans"))
        return F.transform(F.sequence(F.lit(1), F.size(cut), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(cut, i, F.lit(BLOCK)), start, step))

    def placed(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(blocks, start, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.transform(b["spans"], lambda x: span(x["start"] + at, x["end"] + at))))

    return F.when(text.rlike(pattern), let(let(_cut(text, pattern), blocks), placed)).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end, by start, then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, base and added: arrays of spans."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.sha2("text", 256).alias("text_key"), *[found(F.col("text"), k).alias(k) for k in KINDS])
    idents, secrets = F.size("access") + F.size("ident"), F.size("assign") + F.size("hex") + F.size("opaque")
    linkable = (idents > 0) & (secrets > 0) & (F.size("ident") + F.size("opaque") + F.size("endpoint") > 0)

    parts = rows.where(linkable).select("text_key", F.explode(F.concat(*KINDS)).alias("s")).select("text_key", "s.*").distinct()
    a_ident, a_secret = F.col("kind").isin("access", "ident"), F.col("kind").isin("assign", "hex", "opaque")
    before = Window.partitionBy("text_key").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("text_key").orderBy("start", "rank", "end").rowsBetween(1, Window.unboundedFollowing)
    by_end = lambda what: F.max(F.when(what, F.col("end"))).over(before)
    by_start = lambda what: F.min(F.when(what, F.col("start"))).over(after)
    near = lambda what: F.coalesce(F.col("start") - by_end(what) <= scope, F.lit(False)) | F.coalesce(by_start(what) - F.col("end") <= scope, F.lit(False))
    parts = parts.withColumn("by_ident", near(a_ident)).withColumn("by_secret", near(a_secret))
    # a weak candidate inside a certain span is that span
    sure = F.col("kind").isin(*BASE)
    inside = F.coalesce(F.max(F.when(sure, F.col("end"))).over(Window.partitionBy("text_key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)) > F.col("start"), F.lit(False))
    linked = parts.withColumn("inside", inside).where(
        ~F.col("inside")
        & (((F.col("kind") == "ident") & F.col("by_secret")) | ((F.col("kind") == "opaque") & F.col("by_ident")) | ((F.col("kind") == "endpoint") & F.col("by_ident") & F.col("by_secret")))
    )
    linked = linked.groupBy("text_key").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("linked"))
    # texts with nothing to link get a key of their own: none to join, and no hot one
    rows = rows.withColumn("text_key", F.when(linkable, F.col("text_key")).otherwise(F.xxhash64("doc_id", "text_key").cast("string")))
    out = rows.join(linked, "text_key", "left")
    return out.select("doc_id", "assign", "access", "hex", F.concat(*BASE).alias("base"), F.coalesce("linked", F.array().cast(SPAN)).alias("added"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(documents(spark, sf_dir))
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return s.select("doc_id", size("assign"), size("access"), size("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
