"""Secret scans: key patterns and sliding-window entropy, in DataFrame functions only.

A pattern's places come from two passes that agree on the matches: split() gives the gaps,
regexp_extract_all() what was found, and their lengths add up to the offsets. Beside the patterns,
long strings that mix letters and digits are candidates: a window slides over each, the count of the
character that comes and of the one that goes changes by one, and with it the sum of c * log2(c) that
Shannon entropy needs. A candidate whose richest window reaches its character class's threshold is a
finding, unless the allow-list knows its form (UUIDs, mere words or digits) or a pattern's span meets it.
The parts of a candidate between '/', '_', '+' and '-' that hold a placeholder's word don't count: the rest
is measured.

Every row is worked on by itself: no shuffle, nothing is collected. Time is in proportion to the text.

Cases: null text is empty and has no spans; repeated rows have equal results; texts of any length are
scanned whole; an empty table gives an empty one; findings() doesn't read columns beside doc_id and
text, redacted() keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base, by kind (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of 24 and more is found where the run starts
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates for the entropy scan, and forms that aren't secrets.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
QUICK = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}"
ALLOWED = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^[0-9+/_-]*$|^[a-z+/_-]*$"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|x{6}|0123456789|abcdefgh"
#: Characters in a window, and bits a character from which a window counts as random, by class.
WINDOW = 16
THRESHOLDS = {"hex": 2.8, "alnum": 3.2, "base64": 3.4}

_SPANS = "array<struct<start:int,stop:int,said:string>>"
#: Items that running() appends to one array: an array is copied whenever it grows.
_PIECE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states after each of items, beginning from zero, as an array of struct type kind. Arrays grow by pieces, so
    that the time stays in proportion to their length."""
    def append(s: Column, x: Column) -> Column:
        return let(step(s["now"], x), lambda new: F.struct(new.alias("now"), F.concat(s["out"], F.array(new)).alias("out")))

    def piece(s: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(s["now"].alias("now"), F.array().cast(f"array<{kind}>").alias("out")), append)
        return let(done, lambda d: F.struct(d["now"].alias("now"), F.concat(s["out"], F.array(d["out"])).alias("out")))

    def all_pieces(every: Column) -> Column:
        starts = F.when(F.size(every) > 0, F.sequence(F.lit(1), F.size(every), F.lit(_PIECE))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.slice(every, i, F.lit(_PIECE)))
        first = F.struct(zero.alias("now"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(parts, first, piece, lambda s: s["out"]))

    return let(items, all_pieces)


def located(text: Column, pattern: str, quick: Column) -> Column:
    """The matches of pattern as structs (start, stop, said); looked for only where quick holds."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, said: F.struct(F.length(gap).alias("gap"), said.alias("said")))

    def step(s: Column, x: Column) -> Column:
        return let(s["stop"] + x["gap"], lambda start: F.struct(
            start.alias("start"), (start + F.length(x["said"])).alias("stop"), x["said"].alias("said")))

    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(None).cast("string").alias("said"))
    found = F.filter(running(pairs, zero, step, "struct<start:int,stop:int,said:string>"), lambda m: m["said"].isNotNull())
    return F.when(quick, found).otherwise(F.array().cast(_SPANS))


def richest_window(said: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of width characters."""
    # c * log2(c) as whole multiples of 2**-32, so that sums don't drift however far the window slides
    weight = [round(n * math.log2(n) * 2**32) if n else 0 for n in range(width + 1)]
    grows = F.array(*(F.lit(weight[n + 1] - weight[n]).cast("long") for n in range(width)))

    def count(window: Column, char: Column) -> Column:
        return F.length(window) - F.length(F.replace(window, char, F.lit("")))

    def step(s: Column, new: Column) -> Column:
        full = F.length(s["window"]) == width
        gone = F.substring(s["window"], 1, 1)
        rest = F.when(full, F.substring(s["window"], 2, width - 1)).otherwise(s["window"])
        lost = F.when(full, F.get(grows, count(s["window"], gone) - 1)).otherwise(F.lit(0))
        return let(F.struct(rest.alias("rest"), lost.alias("lost")), lambda t: F.struct(
            F.concat(t["rest"], new).alias("window"),
            (s["sum"] - t["lost"] + F.get(grows, count(t["rest"], new))).alias("sum"),
            F.when(full, F.least(s["least"], s["sum"])).otherwise(s["least"]).alias("least")))

    def bits(s: Column) -> Column:
        least = F.least(s["least"], F.when(F.length(s["window"]) == width, s["sum"]))
        return F.coalesce(F.lit(math.log2(width)) - least / F.lit(float(2**32 * width)), F.lit(0.0))

    zero = F.struct(F.lit("").alias("window"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("least"))
    return F.aggregate(F.split(said, ""), zero, step, bits)


def _as_spans(found: Column, kind: str) -> Column:
    """Spans in the order of the result: by start, then by kind as listed."""
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["stop"].alias("stop"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """docs with base and spans, sorted arrays of structs (start, rank, stop, kind)."""
    text = F.coalesce("text", F.lit(""))
    assign = F.filter(located(text, ASSIGN, text.rlike(ASSIGN)), lambda m: F.length(F.regexp_extract(m["said"], ASSIGN, 1)) >= 6)
    access = F.filter(located(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda m: m["stop"] - m["start"] >= 20)
    base = {"assign": assign, "access": access, "hex": located(text, HEX, text.rlike(HEX))}
    found = docs.withColumns({f"_{k}": _as_spans(v, k) for k, v in base.items()} | {
        "_candidates": located(text, CANDIDATE, text.rlike(QUICK))})
    found = found.withColumn("base", F.array_sort(F.concat(*(f"_{k}" for k in base))))

    def level(said: Column) -> Column:
        return (F.when(said.rlike("^([0-9a-f]+|[0-9A-F]+)$"), THRESHOLDS["hex"])
                .when(said.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"]))

    def is_random(said: Column) -> Column:
        """A string without '=' at its end: outside the allow-list, with a window that is rich enough."""
        parts = F.transform(F.split(said, "(?=[+/_-])"), lambda p: F.when(p.rlike(PLACEHOLDER), " ").otherwise(p))
        real = F.split(F.array_join(parts, ""), " ")  # what stands between placeholders
        return said.rlike("[0-9]") & said.rlike("[A-Za-z]") & ~said.rlike(ALLOWED) & F.exists(real, lambda r: F.when(
            F.length(r) >= WINDOW, richest_window(r) >= level(r)).otherwise(F.lit(False)))

    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    random = F.filter("_candidates", lambda c: let(F.regexp_replace(c["said"], "=+$", ""), is_random) & apart(c))
    found = found.withColumn("_entropy", _as_spans(random, "entropy"))
    return found.withColumn("spans", F.array_sort(F.concat("base", "_entropy"))).drop(
        *(f"_{k}" for k in base), "_candidates", "_entropy")


def findings(docs: DataFrame) -> DataFrame:
    """One row a document: counts by kind, a digest of the base and all spans."""
    rows = scanned(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"),
                       F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span in text replaced by mark; overlapping spans by one."""
    def reach(s: Column, x: Column) -> Column:
        """A span that starts inside those before it is part of their mark."""
        return F.struct(s["stop"].alias("before"), (x["start"] >= s["stop"]).alias("fresh"), x["start"].alias("start"),
                        F.greatest(s["stop"], x["stop"]).alias("stop"))

    def pieces(reached: Column) -> Column:
        return let(F.split("text", ""), lambda chars: F.concat(F.array_join(F.flatten(F.transform(
            F.filter(reached, lambda r: r["fresh"]),
            lambda r: F.concat(F.slice(chars, r["before"] + 1, r["start"] - r["before"]), F.array(F.lit(mark))))), ""),
            F.array_join(F.slice(chars, F.element_at(reached, -1)["stop"] + 1, F.size(chars)), "")))

    zero = F.struct(F.lit(0).alias("before"), F.lit(True).alias("fresh"), F.lit(0).alias("start"), F.lit(0).alias("stop"))
    clean = let(running(F.col("spans"), zero, reach, "struct<before:int,fresh:boolean,start:int,stop:int>"), pieces)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text")  # its names clash with none
    rows = scanned(whole).withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    return rows.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
