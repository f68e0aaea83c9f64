"""Personal data: patterns for the base, and bootstrapped contextual extraction for the rest.

Seeds are the spans that the base patterns find. Every identifier-like token of every text, seed or
not, is an instance, seen in contexts: the words before it, alone or with the word after it or the token's shape.
Contexts and instances make a bipartite graph, a row an edge. Rounds of scoring go to and fro:
a context is as reliable as the instances seen in it (weighed down while it has seen few), an
unknown token as reliable as its best contexts. A context that is reliable and has MIN_SEEDS instances of
known kind is a pattern of the kind that most of them have. Tokens in it are discovered; from the next round on
they are instances of known kind themselves, so that they induce patterns where no seed stands. Tokens in the
last round's patterns that no base span meets are found, with the kind of the most reliable one.

Spark side: the texts are read twice, for edges and for the result; only edges (a text has few) are
shuffled. Counts are summed before the shuffle, so a context or an instance with a third of all edges
is no hot key, and joins on it are split by adaptive execution.

Cases: null text is empty and has no spans; rows that share doc_id (null ids too) get the spans of
their own text; repeated rows have equal results; texts are read whole, in time proportional to
their length; an identifier beside the base has SHORTEST characters at least; an empty table gives an empty
one; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base (fixed values).
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a match never starts behind a digit
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What an identifier may look like: a token with a digit or an at sign, of SHORTEST characters at least.
TOKEN, MARK, SHORTEST = re.compile(r"[A-Za-z0-9._%+()@#/:-]+"), re.compile("[0-9@]"), 4
_WORD = re.compile(r"\S+")
#: Longer parts of a context are kept as a digest: only their being equal matters.
SPELLED = 64
#: Rounds of scoring, how much a context has to have seen and how reliable it has to be.
ROUNDS, MIN_SEEDS, RELIABLE, PRIOR = 3, 5, 0.8, 2.0


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    for d in digits[-2::-2]:
        total += sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer, from at sign to at sign: long runs without one would take quadratic time."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "._%+-"):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) by kind as listed, then by start."""
    found = [("email", *s) for s in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def shape(token: str) -> str:
    """The token's kinds of characters, runs as one."""
    kinds = re.sub(r"[A-Za-z]+", "a", token)
    return _brief(re.sub(r"[0-9]+", "9", kinds))


def _brief(part: str) -> str:
    return part if len(part) <= SPELLED else hashlib.sha256(part.encode("utf-8", "replace")).hexdigest()


class Places:
    """The lexical patterns of a text's places. Words are what stands between spaces; of the word that a place stands
    in, its beginning and its rest, as far as the places beside it, count as words too."""

    def __init__(self, text: str):
        self.text, self.spelled = text, {}
        words = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.stops = [w[0] for w in words], [w[1] for w in words]

    def word(self, k: int) -> str:
        if k not in self.spelled:
            self.spelled[k] = _brief(self.text[self.starts[k]:self.stops[k]].lower())
        return self.spelled[k]

    def before(self, start: int, last: int, n: int = 2) -> list[str]:
        """The last n words before a place; last: where the place before it stops."""
        k = bisect.bisect_left(self.starts, start)
        own = []
        if k and self.stops[k - 1] >= start:  # it stands in this word, or at its end
            k -= 1
            own = [_brief(self.text[max(self.starts[k], last):start].lower())] if last < start else []
        return [*(self.word(i) for i in range(max(0, k - n + len(own)), k)), *own]

    def after(self, stop: int, following: int) -> str:
        """The next word behind a place; following: where the place behind it starts."""
        k = bisect.bisect_right(self.stops, stop)
        if k == len(self.stops):
            return ""
        rest = _brief(self.text[stop:min(self.stops[k], max(following, stop))].lower()) if self.starts[k] < stop else self.word(k)
        return rest.rstrip(".,;:!?")

    def contexts(self, start: int, stop: int, last: int, following: int) -> list[str]:
        """The two words before, with the shape and (where there are two) for any shape; the word before with the
        shape; the word on either side with the shape."""
        form, before = shape(self.text[start:stop]), self.before(start, last)
        previous = before[-1] if before else ""
        shaped = [f"b2|{' '.join(before)}|{form}", f"b1|{previous}|{form}", f"ba|{previous}|{self.after(stop, following)}|{form}"]
        return [*shaped, f"l2|{' '.join(before)}"] if len(before) > 1 else shaped


def seen(text: str) -> Iterator[tuple[int, int, str | None, list[str]]]:
    """instances() with their contexts."""
    found = instances(text)
    where = Places(text) if found else None
    found.sort(key=lambda s: s[:2])
    for k, (start, stop, kind) in enumerate(found):
        last = found[k - 1][1] if k else 0
        following = found[k + 1][0] if k + 1 < len(found) else len(text)
        yield start, stop, kind, where.contexts(start, stop, last, following)


def instances(text: str) -> list[tuple[int, int, str | None]]:
    """Identifier-like places: base spans with their kind, and other tokens, which no base span meets."""
    base = sorted((start, stop, kind) for kind, start, stop in base_spans(text))
    out: list[tuple[int, int, str | None]] = list(base)
    k, reach = 0, 0
    for m in TOKEN.finditer(text):
        if not MARK.search(text, *m.span()):
            continue
        start, stop = m.span()
        while stop > start and text[stop - 1] in ".:-/(":
            stop -= 1
        while k < len(base) and base[k][0] < stop:
            reach = max(reach, base[k][1])
            k += 1
        if stop - start >= SHORTEST and reach <= start:
            out.append((start, stop, None))
    return out


EDGE = "context string, instance string, kind string, n long"


def edges(docs: DataFrame) -> DataFrame:
    """(text) -> EDGE, one row a context and instance: how often they meet, and the seed's kind or null."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in (t.as_py() or "" for t in batch.column("text")):
                for start, stop, kind, contexts in seen(text):
                    said = _brief(text[start:stop])
                    rows += [(c, said, kind) for c in contexts]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["context", "instance", "kind"])

    met = docs.select("text").mapInArrow(collect, "context string, instance string, kind string")
    return met.groupBy("context", "instance", "kind").agg(F.count(F.lit(1)).alias("n"))


def patterns(graph: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, reliable: float = RELIABLE) -> DataFrame:
    """EDGE -> (context, kind, confidence): the reliable contexts."""
    # distinct instances count, not their repetitions: a copied text is no further evidence
    links = staged(graph.select("context", "instance", "kind"), "graph")
    first = Window.partitionBy("context").orderBy(F.desc("seeds"), "kind")  # four kinds at most
    known = links.withColumn("trust", F.col("kind").isNotNull().cast("double"))  # kind: a seed's or a discovered one
    for _ in range(rounds):
        best = known.groupBy("context").agg((F.sum("trust") / (F.count(F.lit(1)) + PRIOR)).alias("confidence"))
        kinds = known.filter("kind IS NOT NULL").groupBy("context", "kind").agg(F.count(F.lit(1)).alias("seeds"))
        kinds = kinds.withColumn("place", F.row_number().over(first)).filter(
            (F.col("place") == 1) & (F.col("seeds") >= min_seeds)).drop("place", "seeds")
        scored = staged(best.join(kinds, "context", "left"), "contexts")
        sure = scored.filter((F.col("confidence") >= reliable) & F.col("kind").isNotNull())
        belief = F.max(F.when((F.col("confidence") >= reliable) & F.col("found").isNotNull(), F.struct("confidence", "found"))).alias("best")
        unknown = (links.filter("kind IS NULL").join(scored.withColumnRenamed("kind", "found"), "context").groupBy("instance")
                   .agg(F.max("confidence").alias("belief"), belief))
        known = links.join(unknown, "instance", "left").select(
            "context", "instance", F.coalesce("kind", F.col("best.found")).alias("kind"),
            F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("belief", F.lit(0.0))).alias("trust"))
    return sure


SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_key, base, start, stop, context): every text's base spans in a
    row of its own (start null), and a row for each context of each token that may be found."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, key in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("text_key").to_pylist(), strict=True):
                text = text.as_py() or ""
                rows.append((doc, key, [dict(zip(("kind", "start", "stop"), s, strict=True)) for s in base_spans(text)], None, None, None))
                for start, stop, kind, contexts in seen(text):
                    if kind is None:
                        rows += [(doc, key, None, start, stop, c) for c in contexts]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
            types = [pa.int64(), pa.int64(), pa.list_(span), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["doc_id", "text_key", "base", "start", "stop", "context"])

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(locate, f"doc_id long, text_key long, base {SPANS}, start long, stop long, context string")


def found(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text) -> (doc_id, base, spans), one row a document; base and spans (with
    the discovered ones): arrays of (kind, start, stop), by kind as listed, then by start."""
    known = patterns(edges(docs), **how)
    places = staged(located(docs), "places")
    hit = places.filter("context IS NOT NULL").join(known, "context")
    new = hit.groupBy("doc_id", "text_key", "start", "stop").agg(
        F.max(F.struct("confidence", "kind")).alias("best"))  # repeated rows meet here and give one span
    listed = new.groupBy("doc_id", "text_key").agg(  # of one text: no more than it has tokens
        F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "stop")).alias("new"))
    listed = listed.withColumnsRenamed({"doc_id": "_d", "text_key": "_t"})
    rows = places.filter("context IS NULL").select("doc_id", "text_key", "base")
    both = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left")
    every = F.concat("base", F.coalesce("new", F.array().cast(SPANS)))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return both.select("doc_id", "base", ordered.alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def findings(docs: DataFrame, **how) -> DataFrame:
    """One row a document: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    rows = found(docs, **how)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
