"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans come from fixed patterns. Weak candidates (login names, mail addresses, short key identifiers, bare 40-character keys, URLs)
are added only where complementary parts lie in their scope: an interval join on (text, bin of positions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Base patterns, the group whose length counts and its least length. Fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the runs AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # the runs [0-9a-f]+ of 16 characters or more
#: Weak candidates: key identifiers, login names and mail addresses; bare secret keys; endpoints.
WEAK_ID = r"(?<![A-Za-z0-9])(?:(?:ASIA|AROA|AIDA|ABIA|ACCA)[A-Z0-9]{12,}|AKIA[A-Z0-9]{12,13}(?![A-Z0-9])|(?i:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,})|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
WEAK_KEY = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/@%?&=#-]+"
#: Kinds in the order in which ties are listed. The last three are the added ones.
KINDS = ["assign", "access", "hex", "weak_id", "weak_key", "endpoint"]
#: What a kind is evidence of.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_key": "secret", "endpoint": "endpoint"}
#: Code points between two parts of one credential at most.
SCOPE = 256
#: Matches of a text that are put in place together.
PIECE = 256
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: Column, pattern: str, kind: str, value: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points; value: the least length of group 2, if it counts.

    Positions follow from the lengths of the pieces between the matches. Texts without a match stop at rlike.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if value else 0))
    lengths = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(matches, F.length).alias("size"),
        F.transform(values, F.length).alias("value"),
    )

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        ok = x["size"].isNotNull() & (F.coalesce(x["value"], F.lit(0)) >= value)
        return F.struct(end.alias("at"), F.when(ok, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    none = F.expr(f"cast(array() as {SPAN})")

    def folded(all_of_them):
        """By pieces, as a fold copies what it has found with each match."""
        before = lambda k: F.aggregate(F.slice(all_of_them, F.lit(1), k * PIECE), F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["size"], F.lit(0)))
        own = lambda k: F.aggregate(F.slice(all_of_them, k * PIECE + 1, F.lit(PIECE)), F.struct(before(k).alias("at"), none.alias("out")), step, lambda s: s["out"])
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(all_of_them) - 1) / PIECE).cast("int")), own))

    found = F.get(F.transform(F.array(lengths), folded), F.lit(0))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def scan(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with base and weak spans (in order) and h1, h2 (a 128-bit key of the text). Null texts count as empty."""
    text = _text(text_col)
    base = F.array_sort(F.concat(_spans(text, ASSIGN, "assign", ASSIGN_VALUE), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))
    weak = F.array_sort(F.concat(_spans(text, WEAK_ID, "weak_id"), _spans(text, WEAK_KEY, "weak_key"), _spans(text, ENDPOINT, "endpoint")))
    return df.select(*keep, base.alias("base"), weak.alias("weak"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def link(found: DataFrame) -> DataFrame:
    """(h1, h2, added): for each text with such, the weak spans that complementary parts confirm.

    A weak identifier needs a secret in its scope, a weak key an identifier, an endpoint both. Parts and candidates meet
    by the bins of SCOPE code points that they touch; equal texts are joined once. A bin holds few spans, as spans of
    one kind never overlap, so no bin's pairs grow with the data. A weak span inside a base span isn't repeated.
    """
    some = found.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).select("h1", "h2", "base", "weak").dropDuplicates(["h1", "h2"])
    role = F.create_map([F.lit(x) for kv in ROLES.items() for x in kv])
    bins = lambda start, end: F.explode(F.sequence(F.floor(F.greatest(start, F.lit(0)) / SCOPE), F.floor(end / SCOPE)))
    parts = some.select("h1", "h2", F.explode(F.concat("base", "weak")).alias("p")).select("h1", "h2", F.col("p.start").alias("ps"), F.col("p.end").alias("pe"), (F.col("p.rank") < 3).alias("strong"), role[F.col("p.kind")].alias("part"))
    parts = parts.select("*", bins(F.col("ps"), F.col("pe")).alias("bin"))
    weak = some.select("h1", "h2", F.explode("weak").alias("w"))
    weak = weak.select("*", bins(F.col("w.start") - SCOPE, F.col("w.end") + SCOPE).alias("bin"))
    near = (F.col("ps") < F.col("w.end") + SCOPE) & (F.col("pe") > F.col("w.start") - SCOPE)
    met = weak.join(parts, ["h1", "h2", "bin"]).where(near).groupBy("h1", "h2", "w")
    flags = met.agg(
        F.max(F.col("part") == "id").alias("id"),
        F.max(F.col("part") == "secret").alias("secret"),
        F.max(F.col("strong") & (F.col("ps") <= F.col("w.start")) & (F.col("pe") >= F.col("w.end"))).alias("inside"),
    )
    own = role[F.col("w.kind")]
    ok = F.when(own == "id", F.col("secret")).when(own == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret"))
    return flags.where(ok & ~F.col("inside")).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("w")).alias("added"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added, spans): spans of each whole text as arrays of (start, rank, kind, end), in order of start, then kind.

    Positions are code points, end exclusive. Null texts count as empty; null ids and repeated rows stay; an empty table
    gives no rows; other columns are not read.
    """
    found = materialize(df.sparkSession, scan(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"]), "found")
    none = F.expr(f"cast(array() as {SPAN})")
    out = found.join(link(found), ["h1", "h2"], "left").withColumn("added", F.coalesce("added", none))
    return out.select(F.col("id").alias(id_col), "base", "added", F.array_sort(F.concat("base", "added")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by "[SECRET]"."""

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        later = F.struct(s["end"].alias("at"), F.concat(state["out"], gap, F.lit("[SECRET]")).alias("out"))
        longer = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when((s["start"] >= state["at"]) & ((state["at"] > 0) | (state["out"] == "")), later).otherwise(longer)

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redact(df: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of df, with secrets in the text replaced and, if there is such a column, the characters counted anew.

    Texts without secrets, null and empty ones stay as they are; repeated rows stay; an empty table gives no rows. Texts
    are scanned once; only rows with weak candidates are joined to the links. df's columns may have any names.
    """
    found = materialize(df.sparkSession, scan(df.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), ["row", "text"]), "scanned")  # no column of df can clash
    none = F.expr(f"cast(array() as {SPAN})")
    links = link(found.where(F.size("weak") > 0))
    alone = found.where(F.size("weak") == 0).withColumn("added", none)
    joined = found.where(F.size("weak") > 0).join(links, ["h1", "h2"], "left").withColumn("added", F.coalesce("added", none))
    rows = alone.unionByName(joined)
    hit = F.size("base") + F.size("added") > 0
    new = F.when(hit, redacted(_text("text"), F.array_sort(F.concat("base", "added")))).otherwise(F.col("text"))
    out = rows.withColumn("new", new).withColumn("hit", hit)

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("new").alias(c)
        old = F.col("row").getField(c)
        return (F.when(F.col("hit"), F.length("new").cast(df.schema[c].dataType)).otherwise(old) if c == count_col else old).alias(c)

    return out.select(*map(column, df.columns))
