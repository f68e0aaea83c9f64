"""Toxicity of noisy text: Viterbi deobfuscation under a character language model, then a classifier.

1. Every document's characters are counted as trigrams where they are read; Spark sums the counts. The
   table has at most SYMBOLS**3 rows whatever the corpus, so the model that tasks get has a known size.
2. Tokens that look disguised (digits or signs among letters or behind them, letters doubled in what isn't a
   common word of the corpus, letters set apart), and the parts of compounds, become lattices: each character offers the letters it may stand for, a separator or a
   repeated letter may vanish. Viterbi finds the likeliest reading under channel and language model,
   for tokens and runs of any length. Runs of letters set apart, by separators of any width, are also parted
   into the words that LEXICON of all documents have, for separators of one width don't show where words end.
3. A logistic model over words and word beginnings of the restored text gives the score. Its features
   and weights come from at most SAMPLE labelled rows, taken by hash order among the rows that aren't
   held out; everything else covers all documents. Labels, language, source and id are never features.

What a token stands for doesn't depend on its text, so tasks keep it for the tokens that they meet again.

Cases: null and empty texts score as texts without any feature; documents without labels are scored
like others; labels that are null are left out, repeated labels of one id count as their maximum;
repeated rows score alike; without usable labels all texts score alike; texts are
read whole; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylot.llm.common import staged

#: Labelled rows that the classifier is fitted on at most; a feature's toxic rows, and their share, at least.
SAMPLE, MIN_DOCS, MIN_SHARE = 20_000, 5, 0.5
#: Letters of a word's beginnings beside the first four, and words of a family that are told apart.
BEGINNINGS, FAMILY = (5, 7), 4
_STARTS = (4, *BEGINNINGS)
THRESHOLD = 0.7
#: Log odds of a text without any feature.
BIAS = -2.0
#: Symbols of the language model: 0 is a word's edge, 1 to 26 are a to z, 27 is any other letter.
SYMBOLS = 28

#: What a disguised character may stand for (fixed values).
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
            "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: What may stand between letters of one word.
SEPARATORS = " .-_*~'"
#: Costs in the channel: a sign read as a letter, a repeated letter or a separator that vanishes, one
#: that parts two words.
_AS_LETTER, _REPEATED, _GONE, _PARTS = 0.7, 1.2, 0.2, 3.0
#: Share of documents that have a word which is kept to part letters without any word's edge. So many words
#: at most, whatever the corpus: a document's distinct words on average, over the share. Further, what a letter
#: costs there that belongs to none; distinct words counted before they are sent on.
LEXICON, _UNKNOWN, _COUNTED = 0.002, 20.0, 100_000
#: A word is common if it stands in COMMON_DOCS documents and in COMMON_SHARE of all; its doubled letters are its own.
COMMON_DOCS, COMMON_SHARE = 20, 0.002
#: Tokens up to this length are kept in a task's tables, so many at most; longer ones are decoded anew.
CACHED, KEPT = 64, 60_000

_SIGNS = re.escape("".join(READINGS))
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?[\\]^_`{|}~«»„“”‚‘’…–—¿¡"
_SPACED = re.compile(rf"(?<![^\W\d_])[a-z{_SIGNS}](?:[ .\-_*~]++[a-z{_SIGNS}]){{2,}}(?![^\W\d_])")
#: The last two letters of such a run: searched for first, for texts without any are the rule.
_PAIR = re.compile(rf"[ .\-_*~](?=[a-z{_SIGNS}][ .\-_*~]++[a-z{_SIGNS}](?![^\W\d_]))")
_WIDTHS = re.compile(r"[ .\-_*~]+")
_JOINTS = re.compile(r"[.\-_*~'/,:;=&?]+")
_RUNS = re.compile(r"(.)\1*", re.DOTALL)
_REPEATS = re.compile(r"(.)\1+", re.DOTALL)
_TWICE = re.compile(r"([^\W\d_])\1")
#: A sign in the place of a letter: before a letter, with at most two more between, or behind one.
_SIGN = re.compile(rf"[{_SIGNS}]{{1,3}}[a-z]|[a-z][{_SIGNS}]")
_BEFORE = re.compile(rf"[{_SIGNS}]{{1,3}}[a-z]")
#: What ends sentences and brackets rather than stands for a word's last letter.
_ENDS = "!()\"'.,;:?-_*~#%&<>[]{}«»„“”"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PARTED = re.compile(rf"[{re.escape(SEPARATORS)}]+")
_PLAIN = str.maketrans({s: "l" if "i" in letters else letters for s, letters in READINGS.items()} | {"i": "l"})

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[[0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 27


class Kept(dict):
    """A function's values by token, for tokens up to CACHED characters and KEPT of them at most: those that
    come first, among which the frequent ones are. Begins anew when many others have come."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of, self.missed = of, 0

    def __missing__(self, token: str):
        value = self.of(token)
        if len(self) < KEPT:
            if len(token) <= CACHED:
                self[token] = value
        else:
            self.missed += 1
            if self.missed > 50 * KEPT:
                self.clear()
                self.missed = 0
        return value


def _word(token: str) -> str:
    """The word that a token is but for signs about it, or an empty one."""
    plain = token if token.isalpha() else token.strip(_EDGES)
    return plain if plain.isalpha() else ""


def counted(docs: DataFrame) -> DataFrame:
    """(trigram int, word string, n long) over all texts: how often each trigram stands there, a number in
    base SYMBOLS, and how many documents have each word. The empty word stands in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(trigrams: list, words: list[str | None], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(trigrams, pa.int32()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["trigram", "word", "n"])

        cube, total, word = np.zeros(SYMBOLS**3, np.int64), Counter(), Kept(_word)
        for batch in batches:
            for text in batch.column("text"):
                low = (text.as_py() or "").lower()
                kinds = _CLASS[np.frombuffer(f"  {low}  ".encode("latin-1", "replace"), np.uint8)]
                cube += np.bincount((kinds[:-2] * SYMBOLS + kinds[1:-1]) * SYMBOLS + kinds[2:], minlength=SYMBOLS**3)
                there = {token if token.isalpha() else word[token] for token in set(low.split())}
                there.add("")
                total.update(there)
                if len(total) > _COUNTED:
                    yield sent([None] * len(total), list(total), list(total.values()))
                    total.clear()
        there = np.flatnonzero(cube)
        yield sent([*there, *[None] * len(total)], [*[None] * len(there), *total], [*cube[there], *total.values()])

    return docs.select("text").mapInArrow(count, "trigram int, word string, n long").groupBy("trigram", "word").agg(F.sum("n").alias("n"))


def _summed(sets: Iterator[set[str]], name: str) -> Iterator[pa.RecordBatch]:
    """How many sets have each string, in parts of bounded size: rows (name, n)."""
    total: Counter = Counter()
    for found in itertools.chain(sets, [None]):
        total.update(found or ())
        if found is None or len(total) > _COUNTED:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], [name, "n"])
            total.clear()


def lexicon(counts: DataFrame) -> tuple[dict[str, int], int]:
    """The words that LEXICON of all documents have, with the number of documents that have each, and the
    number of all. Only words taken reach the driver. counts: counted(), written."""
    docs = counts.filter("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = {r["word"]: r["n"] for r in counts.filter((F.col("word") != "") & (F.col("n") >= LEXICON * docs)).select("word", "n").collect()}
    return found, docs


class Reader:
    """Viterbi decoding of disguised tokens."""

    def __init__(self, counts: np.ndarray, lexicon: dict[str, int] | None = None, docs: int = 0):
        self.lexicon = lexicon or {}
        least = max(COMMON_DOCS, COMMON_SHARE * docs)
        self.common = frozenset(w for w, n in self.lexicon.items() if n >= least)
        self.sorted, self.all = sorted(self.lexicon), sum(self.lexicon.values())
        self.counts = counts
        cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        back_off = (cube.sum(0) + 0.5) / (cube.sum((0, 1))[None, :].sum() + 0.5 * SYMBOLS)
        back_off /= back_off.sum(1, keepdims=True)
        smooth = cube + 5.0 * back_off[None, :, :]
        self.cost = (-np.log(smooth / smooth.sum(2, keepdims=True))).tolist()

    def read(self, token: str) -> str:
        """The likeliest words behind a token of letters, signs and separators, whatever its length."""
        return " ".join(self.readings(token)[0])

    def readings(self, token: str) -> tuple[list[str], list[str]]:
        """What read() gives, as words, and the likeliest single word of the corpus that the token may stand for."""
        runs = [m[0] for m in _RUNS.finditer(token)] if token.isalpha() else []
        if runs and math.prod(map(len, runs)) <= 64:  # only repeated letters: all ways to drop some
            kept = ("".join(c) for c in itertools.product(*([r[:k] for k in range(1, len(r) + 1)] for r in runs)))
            whole = [((len(token) - len(w)) * _REPEATED - math.log(self.lexicon[w]), w) for w in kept if w in self.lexicon]
            return self._read(token).split(), [min(whole)[1]] if whole else []
        letters = "".join(c for c in token if c.isalpha() or c in READINGS)
        whole = [(cost - math.log(self.lexicon[w]), w) for end, cost, w in self.spelt(letters, 0) if end == len(letters) and w in self.lexicon]
        return self._read(token).split(), [min(whole)[1]] if whole else []

    def _read(self, token: str) -> str:
        # a word is a chain of (what stands before, letter): the live states are few, however long the token
        best: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for char in token:
            letters = [(char, 0.0)] if char.isalpha() else [(c, _AS_LETTER) for c in READINGS.get(char, "")]
            vanishes = char in SEPARATORS
            found: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            for (a, b, last), (cost, word) in best.items():
                options = [((b, s, c), cost + extra + self.cost[a][b][s], (word, c))
                           for c, extra in letters for s in (ord(c) - 96 if "a" <= c <= "z" else 27,)]
                if vanishes or not letters:
                    options.append(((a, b, last), cost + _GONE, word))
                if vanishes and last:  # or it does part two words
                    options.append(((b, 0, ""), cost + _PARTS + self.cost[a][b][0], (word, " ")))
                options += [((a, b, last), cost + extra + _REPEATED, word) for c, extra in letters if c == last]
                for state, total, text in options:
                    if state not in found or total < found[state][0]:
                        found[state] = (total, text)
            best = found
        return min((cost + self.cost[a][b][0], _spelled(word)) for (a, b, _), (cost, word) in best.items())[1].strip()

    def spelt(self, letters: str, start: int) -> Iterator[tuple[int, float, str]]:
        """(end, cost, beginning of a word of the corpus) for all that may be read from start."""
        live = {"": 0.0}
        for end in range(start, len(letters)):
            char, after = letters[end], {}
            options = [(char, 0.0)] if char.isalpha() else [(c, _AS_LETTER) for c in READINGS[char]]
            for begun, cost in live.items():
                for c, extra in options:
                    k = bisect.bisect_left(self.sorted, begun + c)
                    if k < len(self.sorted) and self.sorted[k].startswith(begun + c):
                        after[begun + c] = min(cost + extra, after.get(begun + c, math.inf))
                    if c == begun[-1:]:
                        after[begun] = min(cost + extra + _REPEATED, after.get(begun, math.inf))
            if not after:
                return
            live = after
            yield from ((end + 1, cost, begun) for begun, cost in live.items())

    def parted(self, letters: str) -> list[str]:
        """The likeliest words of the corpus that make up letters and signs without any separator. What is begun
        alike at several places goes on as one, so that repeated letters take time in proportion to their number."""
        if not self.lexicon:
            return []
        ended: tuple[float, tuple | None] = (0.0, None)  # cost and words of all that is read
        live: dict[str, tuple[float, tuple | None]] = {}  # the same by the beginning of the word that follows them
        for char in letters:
            options, after = [(char, 0.0)] if char.isalpha() else [(c, _AS_LETTER) for c in READINGS[char]], {}
            for begun, (cost, words) in [("", ended), *live.items()]:
                for c, extra in options:
                    k = bisect.bisect_left(self.sorted, begun + c)
                    if k < len(self.sorted) and self.sorted[k].startswith(begun + c) and (
                            begun + c not in after or cost + extra < after[begun + c][0]):
                        after[begun + c] = (cost + extra, words)
                    if c == begun[-1:] and (begun not in after or cost + extra + _REPEATED < after[begun][0]):
                        after[begun] = (cost + extra + _REPEATED, words)
            ended = (ended[0] + _UNKNOWN, ended[1])
            for begun, (cost, words) in after.items():
                if (n := self.lexicon.get(begun)) and cost + math.log(self.all / n) < ended[0]:
                    ended = (cost + math.log(self.all / n), (words, begun))
            live = after
        found, chain = [], ended[1]
        while chain:
            chain, word = chain
            found.append(word)
        return found[::-1]


def _spelled(chain: tuple | None) -> str:
    letters = []
    while chain:
        chain, letter = chain
        letters.append(letter)
    return "".join(reversed(letters))


def levelled(run: str) -> tuple[str, int]:
    """A run whose separators are as wide as their place among the run's widths, from the narrowest, and the
    number of places. Beyond three, widths count by doublings, so that even long runs have few places."""
    kinds = sorted({min(len(w), 2 + len(w).bit_length()) for w in _WIDTHS.findall(run)})
    place = {kind: i for i, kind in enumerate(kinds, 1)}
    return _WIDTHS.sub(lambda m: m[0][0] * place[min(len(m[0]), 2 + len(m[0]).bit_length())], run), len(kinds)


def spaced_out(run: str, reader: Reader) -> set[str]:
    """The words of a run of letters set apart: as the reader parts the whole run, as the corpus's words part
    it, and as wider separators do where their widths differ."""
    run, places = levelled(run)
    found = {*reader.read(run).split(), *reader.parted(_WIDTHS.sub("", run))}
    for width in range(2, places + 1):
        for part in re.split(rf"[ .\-_*~]{{{width},}}", run):
            said = reader.read(part).split()
            found.update(said)
            found.add("".join(said))
    return found


def skeleton(letters: str) -> str:
    """What all readings of the same letters and signs share: l for i, no repetition, nothing but letters."""
    if not letters.isalpha():
        letters = _NOT_LETTERS.sub("", letters.translate(_PLAIN))
    return _REPEATS.sub(r"\1", letters.replace("i", "l"))


class Names:
    """The words, and the beginnings of words, that features are about."""

    def __init__(self, named: Iterator[str]):
        named = set(named)
        self.words = frozenset(f for f in named if "*" not in f)
        self.starts = frozenset(f.partition("*")[0] for f in named if "*" in f)
        self.heads = frozenset(f[:4] for f in self.words | self.starts)
        self.skeletons = frozenset(map(skeleton, self.words | self.starts))
        self.lengths = sorted({len(s) for s in self.skeletons})
        self.begun = frozenset(s[:4] for s in self.skeletons if len(s) > 3)
        self.short = frozenset(s for s in self.skeletons if len(s) < 4)
        firsts = {s[:1] for s in self.skeletons}
        #: First letters of words whose skeletons may matter.
        self.firsts = frozenset(firsts | {"i"} if "l" in firsts else firsts)

    def __contains__(self, word: str) -> bool:
        """Whether any feature is about a word."""
        if word[:4] not in self.heads:
            return False
        if word in self.words:
            return True
        for n in _STARTS:  # a plain loop, for this is asked of each word of each text
            if word[:n] in self.starts:
                return True
        return False

    def may_begin(self, token: str) -> bool:
        """Whether a word in a reading of token may be one of the words or begin as they do: then its skeleton begins so."""
        starts = (0,) if token.isalpha() else (0, *(m.end() for m in _PARTED.finditer(token)))
        for at in starts:
            said = skeleton(token[at:])
            if said[:4] in self.begun or self.short and (said[:3] in self.short or said[:2] in self.short or said[:1] in self.short):
                for n in self.lengths:
                    if said[:n] in self.skeletons:
                        return True
        return False


def spaced(text: str) -> Iterator[re.Match]:
    """The runs of three letters and more that are set apart in a lower-case text."""
    if _PAIR.search(text):
        yield from _SPACED.finditer(text)


class Finder:
    """Finds the words of texts, with what disguised ones stand for. names: what features are about; other words
    are passed over, and a token whose readings can't be about them isn't decoded."""

    def __init__(self, reader: Reader, names: Names | None = None):
        self.reader, self.names = reader, names
        self.said = Kept(self._said)

    def words(self, text: str) -> set[str]:
        """The distinct words of a text, lower case."""
        text, names, twice = text.lower(), self.names, _TWICE.search
        found: set[str] = set()
        for token in set(text.split()):
            if token.isalpha() and (not twice(token) or token in self.reader.common):  # stands for itself
                if names is None or token[:4] in names.heads and token in names:
                    found.add(token)
            elif said := self.said[token]:
                found.update(said)
        for m in spaced(text):
            found.update(spaced_out(m[0], self.reader))
        return found

    def _said(self, token: str) -> tuple[str, ...]:
        names = self.names
        if names is None:
            return tuple(self._readings(token))
        plain = _word(token)  # most tokens are mere words without a doubled letter that matters; signs behind them end sentences
        if plain and not self._doubled(plain) and (plain is token or not _SIGN.search(token.rstrip(_ENDS))):
            return (plain,) if plain in names else ()
        return tuple(w for w in self._readings(token) if w in names)

    def _doubled(self, word: str) -> bool:
        """Whether a word's doubled letters may be a disguise that matters."""
        return ((self.names is None or word[0] in self.names.firsts) and _TWICE.search(word) is not None
                and word not in self.reader.common and (self.names is None or self.names.may_begin(word)))

    def _readings(self, token: str) -> set[str]:
        reader, found = self.reader, set()
        plain = token.strip(_EDGES)
        parts = [plain] if plain.isalpha() else [p for p in _NOT_LETTERS.split(plain) if p]
        for p in parts:
            found.add(p)
            if self._doubled(p):
                found.update(*reader.readings(p))
        if len(parts) > 1:
            found.add("".join(parts))
        if not token.isalpha() and _SIGN.search(token):
            core = token.strip("\"'.,;:?-_*~#%&<>[]{}«»„“”")
            ended = core.lstrip("(").rstrip(_ENDS)
            for part in {core, ended, *_JOINTS.split(ended)}:  # also the parts of a compound by themselves
                if _SIGN.search(part) and (part != core or core == ended or _BEFORE.search(core)) and (
                        self.names is None or self.names.may_begin(part)):
                    found.update(*reader.readings(part))
        return found


def features(found: set[str]) -> set[str]:
    """Words, their beginnings, and beginnings that two, three and more distinct words share: one word of a
    family may be chance where several aren't."""
    out, families = set(), Counter()
    for w in found:
        out.add(w)
        if len(w) > 4:
            out.add(w[:4] + "*")
        for n in BEGINNINGS:
            if len(w) > n:
                out.add(w[:n] + "*")
                families[w[:n]] += 1
    for start, n in families.items():
        out.update(f"{start}*{k}" for k in range(2, min(n, FAMILY) + 1))
    return out


def fit(rows: list[tuple[list[int], int]], n: int, rounds: int = 1000, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression by accelerated gradient steps: rows of (features there, label) -> weights.
    The bias stays at BIAS: free, it would sink with the share of clean rows until a single sure word
    no longer weighs it up."""
    y = np.array([label for _, label in rows], float)
    at = np.array([i for i, (there, _) in enumerate(rows) for _ in there], np.int64)
    which = np.array([k for there, _ in rows for k in there], np.int64)
    weight = ahead = np.zeros(n)
    scale = np.bincount(which, minlength=n) / max(1, len(rows)) + 1e-3  # a step by each feature's frequency
    for t in range(rounds):
        z = BIAS + np.bincount(at, ahead[which], len(rows))
        error = (1 / (1 + np.exp(-z)) - y) / max(1, len(rows))
        new = ahead - (np.bincount(which, error[at], n) + ridge * ahead) / (scale * 2)
        ahead, weight = new + t / (t + 3) * (new - weight), new
    return weight


class Model:
    """What tasks get: the trigram counts, the lexicon and the weights, all of bounded size."""

    def __init__(self, counts: np.ndarray, known: dict[str, int], docs: int, weights: dict[str, float]):
        self.counts, self.known, self.docs, self.weights = counts, known, docs, weights

    @functools.cached_property
    def finder(self) -> Finder:
        return Finder(Reader(self.counts, self.known, self.docs), Names(self.weights))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "finder"}

    def score(self, text: str) -> float:
        there = features(self.finder.words(text))
        # in one order, so that equal texts have equal sums
        z = BIAS + math.fsum(self.weights[f] for f in there if f in self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of docs (doc_id, text), with weights from labels (doc_id, toxic)."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    every = staged(counted(docs), "counts")
    for row in every.filter("trigram IS NOT NULL").collect():  # at most SYMBOLS**3 rows
        counts[row["trigram"]] = row["n"]
    known, n_docs = lexicon(every.filter("word IS NOT NULL"))
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `sample` narrow rows
    # of an id's rows one, so that no more than `sample` are fitted on
    rows = staged(texts.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("row")).select("row.*"), "labelled")

    def in_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Reader(counts, known, n_docs))
        yield from _summed((features(finder.words(t.as_py() or "")) for batch in batches for t in batch.column("text")), "feature")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = Kept(_word)
        yield from _summed(({word[w] for w in set((t.as_py() or "").lower().split())} for batch in batches for t in batch.column("text")), "feature")

    # toxic rows name the candidates; those whose word alone stands in too many rows can't be features
    toxic = rows.filter("toxic = 1").mapInArrow(in_toxic, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("toxic"))
    often = rows.select("text").mapInArrow(plain, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    own = F.array("feature", *(F.when(F.length("feature") > n, F.concat(F.substring("feature", 1, n), F.lit("*"))) for n in (4, *BEGINNINGS)))
    often = often.select(F.explode(F.array_compact(own)).alias("feature"), "n").groupBy("feature").agg(F.max("n").alias("n"))
    left = toxic.filter(F.col("toxic") >= MIN_DOCS).join(often, "feature", "left").filter(F.col("toxic") >= MIN_SHARE * F.coalesce("n", F.lit(0)))
    number = {r["feature"]: i for i, r in enumerate(left.select("feature").orderBy("feature").collect())}  # words of `sample` texts at most
    chosen = Model(counts, known, n_docs, dict.fromkeys(number, 0.0))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = [sorted(number[f] for f in features(chosen.finder.words(t.as_py() or "")) if f in number)
                     for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.list_(pa.int32())), batch.column("toxic").cast(pa.int32())], ["there", "toxic"])

    table = [(r["there"], r["toxic"]) for r in rows.mapInArrow(placed, "there array<int>, toxic int").collect()]  # at most `sample` rows
    n, n_toxic = Counter(f for there, _ in table for f in there), Counter(f for there, label in table if label for f in there)
    kept = {f: i for i, f in enumerate(f for f in range(len(number)) if n_toxic[f] >= max(MIN_DOCS, MIN_SHARE * n[f]))}
    weight = fit(sorted(([kept[f] for f in there if f in kept], label) for there, label in table), len(kept))
    return Model(counts, known, n_docs, {f: float(weight[kept[i]]) for f, i in number.items() if i in kept})


SCORED = "doc_id long, score double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, SCORED).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score THRESHOLD and more, in the same pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # its names may hold dots

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [shared.value.score(t.as_py() or "") < THRESHOLD for t in batch.column("row").field(docs_text)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    docs_text = docs.columns.index("text")
    return whole.mapInArrow(keep, whole.schema).select("row.*")
