"""Secret scans with linking of multipart credentials, in DataFrame functions only.

Strong patterns are reported as they are.  Weak parts (access identifiers, bare secrets, endpoints) are
reported only if complementary parts stand close together: an interval join within the document pairs each
identifier or endpoint with the secrets less than ``SCOPE`` characters away.

Matches of a pattern and the text between them alternate, so positions are running sums over the
pieces of ``split`` and the strings of ``regexp_extract_all``; only texts with a match are split.
The interval join's key is (row, cell of ``SCOPE`` characters), and a part meets only the
neighbouring cells, so a document with very many parts is no hot spot: a cell holds few of them.
A secret is in all cells up to ``SCOPE`` around it, an identifier or endpoint in those of its first and its
last character, of which the one that faces the secret is less than ``SCOPE`` away from it.

Nulls and edge cases: a null text is empty and has no spans; positions are code points; each row is joined
with its own parts by a number given before the scan is stored, so a null or repeated doc_id needs no care, and
repeated rows get equal results; other columns are passed on; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import stored

SCOPE = 200

# fixed values: patterns of the base kinds, and the least length of what counts
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = {"assign": (ASSIGN, 1, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32)}
# a run of 32 letters of a class is found by the same scan as one of any length, without the short runs
_QUICK = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
WEAK = {
    "id": r"""(?i:client_?id|user(?:name)?|login|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{4,}""",
    "key": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}",
    "url": r"(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9._~:@-]+",
}
ORDER = {k: i for i, k in enumerate([*BASE, *WEAK])}


def _spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """(start, end, kind) of each match of a pattern that never matches nothing; ``group`` must have ``least`` characters."""
    quoted = F.lit(pattern)
    found = F.regexp_extract_all(text, quoted, F.lit(0))
    counted = F.regexp_extract_all(text, quoted, F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.transform(found, F.length).alias("n"), F.transform(counted, F.length).alias("m"), F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        first = state.at + p["gap"]
        own = F.array(F.struct(first.alias("start"), (first + p["n"]).alias("end"), F.lit(kind).alias("kind")))
        return F.struct((first + p["n"]).alias("at"), F.when(p["m"] >= least, F.concat(state.spans, own)).otherwise(state.spans).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(parts, empty, step, lambda s: s.spans)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def scanned(docs: DataFrame, text: bool = False) -> DataFrame:
    """The columns of ``docs`` (``text`` only if asked for) with ``base`` and ``spans``: arrays of (start, end, kind), by start and kind."""
    own = [c for c in docs.columns if c not in ("base", "spans", "row ", "weak", "linked") and (text or c != "text")]
    whole = F.coalesce("text", F.lit(""))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    base = F.concat(*(_spans(whole, k, _QUICK[k], group, least) for k, (_, group, least) in BASE.items()))
    found = docs.withColumn("base", base)
    complement = F.exists("base", lambda s: s.kind.isin("assign", "access", "hex")) | whole.rlike(WEAK["key"])
    weak = F.when(complement, F.concat(*(_spans(whole, k, p) for k, p in WEAK.items()))).otherwise(empty)
    # the patterns run once; what they found is written and read by both sides of the join
    found = stored(found.withColumn("weak", weak).select(*own, F.monotonically_increasing_id().alias("row "), "base", "weak"))

    several = found.where("size(weak) > 0 AND size(base) + size(weak) > 1").select("row ", "base", "weak")
    part = several.select("row ", F.explode(F.concat("base", "weak")).alias("s")).select("row ", "s.*")
    secret = F.col("kind").isin("assign", "hex", "key")
    near = lambda c: F.explode(F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE))).alias(c)
    secrets = part.where(secret).select("row ", "start", "end", "kind", near("cell")).alias("b")
    ends = F.explode(F.array_distinct(F.array(F.floor(F.col("start") / SCOPE), F.floor((F.col("end") - 1) / SCOPE)))).alias("cell")
    others = part.where(~secret).select("row ", "start", "end", "kind", ends).alias("a")
    pairs = others.join(secrets, ["row ", "cell"]).where(
        (F.col("a.start") < F.col("b.end") + SCOPE) & (F.col("b.start") < F.col("a.end") + SCOPE) & ((F.col("a.end") <= F.col("b.start")) | (F.col("b.end") <= F.col("a.start")))
    )
    both = pairs.select("row ", F.explode(F.array(*(F.struct(F.col(f"{x}.start").alias("start"), F.col(f"{x}.end").alias("end"), F.col(f"{x}.kind").alias("kind")) for x in "ab"))).alias("s"))
    linked = both.where(F.col("s.kind").isin(*WEAK)).groupBy("row ").agg(F.collect_set("s").alias("linked"))
    place = F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv))

    def ordered(spans: Column) -> Column:
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), place[s.kind].alias("o"), s.end.alias("end"), s.kind.alias("kind"))))
        return F.transform(keyed, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))

    joined = found.join(linked, ["row "], "left")
    return joined.select(*own, ordered(F.col("base")).alias("base"), ordered(F.concat("base", F.coalesce("linked", empty))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(found: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``found`` with every span of its texts replaced by ``mask``; overlapping spans are one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, s: Column) -> Column:
        gap = F.expr("text").substr(state.at + 1, F.greatest(s.start - state.at, F.lit(0)))
        fresh = s.start >= state.at
        return F.struct(F.greatest(state.at, s.end).alias("at"), F.when(fresh, F.concat(state.kept, F.array(gap, F.lit(mask)))).otherwise(state.kept).alias("kept"))

    end = lambda s: F.concat(F.array_join(s.kept, ""), F.expr("text").substr(s.at + 1, F.length("text")))
    text = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, end)).otherwise(F.col("text"))
    return found.withColumn("text", text)
