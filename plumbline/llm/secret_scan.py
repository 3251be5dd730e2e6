"""Secret scan with multipart credential linking, in DataFrame functions alone.

Strong parts (assignments, access identifiers, hex strings) are always reported. Weak ones (user names, mail
addresses, opaque strings, endpoints) are reported only when the parts that would make them usable stand within the same scope: a user name next
to a secret, an opaque string next to an identifier, an endpoint next to both. Parts become rows, and an interval join
on scope-sized bins finds each weak part's neighbours; bins are summed up first, so their number of parts has no say in
the number of joined rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

KEY = r"(?i:password|passwd|secret|token|api_?key)"
#: kind: (role, strong, pattern, least length of what is measured, cheap test that every match passes). What is measured
#: is the match without ``LEAD``, if that is given. No pattern repeats a group: Java's matcher would recurse on it.
LEAD = {"assign": rf"""^{KEY}["']?\x20*[:=]\x20*["']?"""}
KINDS: dict[str, tuple] = {
    "assign": ("secret", True, rf"""{KEY}["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, rf"""{KEY}["']?\x20*[:=]"""),
    "access": ("id", True, r"AKIA[A-Z0-9]+", 16, r"AKIA[A-Z0-9]"),
    "hex": ("secret", True, r"[0-9a-f]+", 32, r"[0-9a-f]{32}"),
    "user": ("id", False, r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}""", 1, r"""(?i:user|name|login|client_?id|account)["']?\x20*[:=]"""),
    "mail": ("id", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9-]", 6, "@"),
    "blob": ("secret", False, r"(?<![A-Za-z0-9+/_-])(?![0-9a-f]++(?![A-Za-z0-9+/_-]))(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}={0,2}", 24, r"[A-Za-z0-9+/_-]{24}"),
    "url": ("endpoint", False, r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D\"'<>]+", 8, r"://"),
}
ORDER = list(KINDS)


def _matches(text: Column, kind: str) -> Column:
    """Leftmost matches that don't overlap, as structs of the gap before, the length and whether it is long enough.

    Matches and what lies between them come from one pass each. Hex strings are taken together with shorter runs, as
    their pattern has it; only runs of enough characters are looked for there, which are the same ones. A long enough
    match of another kind may fail as a whole match and be dropped, but not begin later.
    """
    _, _, pattern, least, test = KINDS[kind]
    if kind == "hex":
        pattern = rf"[0-9a-f]{{{least},}}"
    both = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("own"))
    both = F.filter(both, lambda x: x["own"].isNotNull())  # the text ends with a gap
    measured = (lambda x: F.regexp_replace(x, LEAD[kind], "")) if kind in LEAD else (lambda x: x)
    rows = F.transform(
        both,
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("at"), F.length(x["gap"]).alias("gap"), F.length(x["own"]).alias("size"), (F.length(measured(x["own"])) >= least).alias("fits")),
    )
    quick = text.contains(test) if test in ("://", "@") else text.rlike(test)
    return F.when(quick, rows).otherwise(F.array().cast("array<struct<kind:string,at:int,gap:int,size:int,fits:boolean>>"))


def parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, kind, start, end): all strong and weak parts, and one row with nulls for each row of ``df``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    none = F.array(F.struct(*[x.alias(n) for n, x in zip(("kind", "at", "gap", "size", "fits"), (F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit(0), F.lit(True)))]))
    found = rows.select("row", "doc_id", F.explode(F.concat(none, *[_matches(text, k) for k in KINDS])).alias("x"))
    flat = found.select("row", "doc_id", "x.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("at"))
    placed = flat.withColumn("end", end).filter("fits")
    return placed.select("row", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(found: DataFrame, scope: int) -> DataFrame:
    """The weak parts whose complements start at most ``scope`` code points away."""
    role = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[0])])[F.col("kind")]
    real = found.filter("kind is not null").select("row", "doc_id", "kind", "start", "end", role.alias("role"), F.floor(F.col("start") / scope).alias("bin"))
    bins = real.filter("role != 'endpoint'").groupBy("row", "bin", "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    near = bins.select("row", "role", "lo", "hi", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")).withColumnRenamed("role", "other")
    strong = F.col("kind").isin([k for k, v in KINDS.items() if v[1]])
    taken = real.filter(strong).select("row", F.explode(F.sequence("bin", F.floor((F.col("end") - 1) / scope))).alias("bin"), F.col("start").alias("s"), F.col("end").alias("e"))
    weak = real.filter(~strong)
    spread = weak.select("row", "kind", "start", "end", F.explode(F.sequence("bin", F.floor((F.col("end") - 1) / scope))).alias("bin"))
    inner = spread.join(taken, ["row", "bin"]).filter("start < e and s < end").select("row", "kind", "start").distinct()
    weak = weak.join(inner, ["row", "kind", "start"], "left_anti")  # what a strong part covers is known
    inside = (F.col("lo") - F.col("start") <= scope) & (F.col("start") - F.col("hi") <= scope)
    met = weak.join(near, ["row", "bin"]).filter(inside).groupBy("row", "doc_id", "kind", "start", "end", "role").agg(F.collect_set("other").alias("others"))
    has = lambda x: F.array_contains("others", x)
    complete = F.when(F.col("role") == "id", has("secret")).when(F.col("role") == "secret", has("id")).otherwise(has("id") & has("secret"))
    return met.filter(complete).select("row", "doc_id", "kind", "start", "end")


def secrets(df: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_assign, n_access, n_hex, base_sha256, spans (and found, the spans as structs).

    Null texts count as empty and have no spans. Rows without an id and repeated rows have results of their own;
    parts link within one row only. Parts of the same kind never overlap, those of different kinds may. Very long texts
    are matched whole, in space that doesn't grow with a match. Other columns are ignored; an empty table gives no rows.
    """
    found = cut(parts(df, id_col, text_col))
    strong = [k for k, v in KINDS.items() if v[1]]
    shown = found.filter(F.col("kind").isNull() | F.col("kind").isin(strong)).unionByName(linked(found, scope))
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "kind", "end"))
    per_row = shown.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("found"))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["rank"] <= len(strong))
    of_kind = lambda k: F.filter("found", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in strong]
    return per_row.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), F.col("found"))
