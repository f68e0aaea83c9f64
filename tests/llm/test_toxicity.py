import random
import time
import zlib

import pytest

from skylot.llm import toxicity
from tests.llm.docs import empty, frame, odd


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_documents_score_as_their_labels(spark, tables):
    docs, labels = tables
    model = toxicity.trained(docs, labels)
    scores = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores.values())
    held = [(r["toxic"], scores[r["doc_id"]]["predicted"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(scores[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in scores)
    toxic, hit = sum(y for y, _ in held), sum(y and p for y, p in held)
    wrong = sum(p and not y for y, p in held)
    assert len(held) > 300 and hit >= 0.85 * toxic and wrong <= 0.01 * len(held), (len(held), toxic, hit, wrong)
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in scores.values())


def words_of(spark, texts):
    return toxicity.counted(frame(spark, texts)).filter("word IS NOT NULL")


def reader(spark):
    import numpy as np

    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    texts = ["you are a stupid idiot and the moron is here with us all", "this is a horrible and stupid idea of an idiot"] * 50
    for r in toxicity.counted(frame(spark, texts)).filter("trigram IS NOT NULL").collect():
        counts[r["trigram"]] = r["n"]
    return toxicity.Reader(counts)


def test_viterbi_reads_disguised_words(spark):
    read = reader(spark).read
    assert read("stup1d") == "stupid" and read("1d10t") == "idiot" and read("$tup!d") == "stupid"
    assert read("s.t.u.p.i.d") == "stupid" and read("stuuuupid") == "stupid" and read("i d i o t") == "idiot"
    assert toxicity.Finder(reader(spark)).words("An 1D10T, s t u p i d!") >= {"idiot", "stupid"}


def test_long_spaced_out_texts_are_read_whole(spark):
    said = "you are a stupid idiot and the moron is a horrible idea " * 8
    known, n = toxicity.lexicon(words_of(spark, ["you are a stupid idiot and the moron is here", "a horrible idea", None] * 9))
    assert n == 27 and known["a"] == 18 and known["moron"] == 9
    read = toxicity.Reader(reader(spark).counts, known)
    wanted = set(said.split())
    for apart in (" ".join(said.replace(" ", "")), "  ".join(said.replace(" ", "")), "   ".join(" ".join(w) for w in said.split())):
        assert len(apart) > 600 and toxicity.Finder(read).words(apart) >= wanted
    hidden = "x" + "-x" * 40 + "-stup1d-1d10t"
    assert toxicity.Finder(read).words(hidden) >= {"stupid", "idiot"}


def test_the_words_kept_follow_shares_of_documents(spark):
    """However many words there are: none is left out for their number, and the rare ones of many documents are."""
    for n in (15_000, 30_000):
        many = [" ".join(f"{w}{a}" for a in map("".join, toxicity.itertools.product("abcdefghij", repeat=3))) for w in
                ("".join(x) for x in toxicity.itertools.islice(toxicity.itertools.product("klmno", repeat=3), n // 1000))]
        known, docs = toxicity.lexicon(words_of(spark, many + ["a stupid idiot"] * 50))
        assert docs == n // 1000 + 50 and len(known) == n + 3 and known["stupid"] == 50
        assert toxicity.Reader(reader(spark).counts, known).parted("astupidkkkabcidiot") == ["a", "stupid", "kkkabc", "idiot"]
    known, docs = toxicity.lexicon(words_of(spark, [f"rare{i} seldom{i // 2} word".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(1000)]))
    assert docs == 1000 and known["word"] == 1000 and len(known) == 501  # two documents in a thousand


def test_separators_of_any_width(spark):
    known, _ = toxicity.lexicon(words_of(spark, ["you are a stupid idiot and the moron is here"] * 9))
    find = toxicity.Finder(toxicity.Reader(reader(spark).counts, known))
    for width in (1, 2, 3, 4, 5, 9, 40, 3000):
        assert find.words("so " + (" " * width).join("stupid") + "!") >= {"stupid"}, width
        assert find.words((" " * 2 * width).join((" " * width).join(w) for w in ("an", "id1ot"))) >= {"idiot"}, width
        assert find.words(("-" * width).join("idiot")) >= {"idiot"}, width
    plain = toxicity.Finder(toxicity.Reader(reader(spark).counts))  # by the widths alone
    assert plain.words("          ".join("    ".join(w) for w in ("stupid", "idiot"))) >= {"stupid", "idiot"}
    assert toxicity.levelled("a b  c   d    e     f      g       h") == ("a b  c   d    e     f     g     h", 5)
    # what is searched for first misses no run
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab1é9 .-  _x") for _ in range(rng.randrange(14)))
        assert [m[0] for m in toxicity.spaced(text)] == [m[0] for m in toxicity._SPACED.finditer(text)], text
    began = time.perf_counter()
    wide = "".join("x" + " " * k for k in range(1500)) + "-" * 300_000 + "a " * 30_000
    find.words(wide)
    assert time.perf_counter() - began < 60  # a few passes, not one a width


def test_every_form_of_disguise_reaches_the_reader(spark):
    texts = ["you are a stupid idiot and the moron is here", "a worthless and disgusting ass"] * 20 + ["see all that is good"] * 60
    counts = toxicity.np.zeros(toxicity.SYMBOLS**3, toxicity.np.int64)
    for r in toxicity.counted(frame(spark, texts)).filter("trigram IS NOT NULL").collect():
        counts[r["trigram"]] = r["n"]
    read = toxicity.Reader(counts, *toxicity.lexicon(words_of(spark, texts)))
    for said, meant in {"idio7": "idiot", "worthle55": "worthless", "disgustin9": "disgusting", "a$$": "ass", "idio7!": "idiot", "(idio7)": "idiot",
                        "stuupid": "stupid", "iddiot": "idiot", "stuuupid-head": "stupid", "iddiot/moron": "idiot", "my-idio7": "idiot",
                        "1D10T!": "idiot"}.items():
        assert meant in toxicity.Finder(read).words(f"such {said} there"), said
        assert meant in toxicity.Finder(read, toxicity.Names([meant])).words(said), said  # what is passed over can't matter
    assert toxicity.Finder(read).words("see good all! idiot!") == {"see", "good", "all", "idiot"}


def test_passing_over_words_changes_no_score(spark):
    texts = ["you are a stupid idiot and the moron is here", "a worthless and disgusting ass"] * 20 + ["see all that is good"] * 60
    counts = reader(spark).counts
    known, n = toxicity.lexicon(words_of(spark, texts))
    weights = {"stupid": 1.0, "idio*": 2.0, "worth*2": 0.5, "disgust*": 1.5, "ass": 0.25, "moro*": 0.75, "all": 0.1}
    model, every = toxicity.Model(counts, known, n, weights), toxicity.Finder(toxicity.Reader(counts, known, n))
    rng = random.Random(3)
    for _ in range(300):
        words = rng.choices([w for t in texts[:2] for w in t.split()] + ["worthy", "worthwhile", "asset", "all!", "(good)", "!see", "idiom"], k=6)
        noisy = ["".join(rng.choice([c, c, c, c + c, {"i": "1", "s": "$", "o": "0", "t": "7"}.get(c, c), c + "-"]) for c in w) + rng.choice(["", "", "!", ",", "."]) for w in words]
        text = " ".join(noisy)
        z = toxicity.BIAS + sum(weights.get(f, 0.0) for f in toxicity.features(every.words(text)))
        assert abs(model.score(text) - 1 / (1 + toxicity.math.exp(-z))) < 1e-12, text


def test_viterbi_finds_the_cheapest_of_all_readings(spark):
    """Against enumeration: every way to read or drop each character of short tokens."""
    read = reader(spark)

    def every(token, a=0, b=0, last="", cost=0.0):
        if not token:
            yield cost + read.cost[a][b][0]
            return
        char, rest = token[0], token[1:]
        letters = [(char, 0.0)] if char.isalpha() else [(c, toxicity._AS_LETTER) for c in toxicity.READINGS.get(char, "")]
        for c, extra in letters:
            s = ord(c) - 96
            yield from every(rest, b, s, c, cost + extra + read.cost[a][b][s])
            if c == last:
                yield from every(rest, a, b, last, cost + extra + toxicity._REPEATED)
        if char in toxicity.SEPARATORS or not letters:
            yield from every(rest, a, b, last, cost + toxicity._GONE)
        if char in toxicity.SEPARATORS and last:
            yield from every(rest, b, 0, "", cost + toxicity._PARTS + read.cost[a][b][0])

    def price(token, said):
        """The cheapest cost at which token is read as said."""
        def walk(token, a, b, last, left):
            if not token:
                return read.cost[a][b][0] if not left.strip() else float("inf")
            char, rest, best = token[0], token[1:], float("inf")
            letters = [(char, 0.0)] if char.isalpha() else [(c, toxicity._AS_LETTER) for c in toxicity.READINGS.get(char, "")]
            for c, extra in letters:
                if left.startswith(c):
                    s = ord(c) - 96
                    best = min(best, extra + read.cost[a][b][s] + walk(rest, b, s, c, left[1:]))
                if c == last:
                    best = min(best, extra + toxicity._REPEATED + walk(rest, a, b, last, left))
            if char in toxicity.SEPARATORS or not letters:
                best = min(best, toxicity._GONE + walk(rest, a, b, last, left))
            if char in toxicity.SEPARATORS and last and (left.startswith(" ") or not left):
                best = min(best, toxicity._PARTS + read.cost[a][b][0] + walk(rest, b, 0, "", left[1:]))
            return best

        return walk(token, 0, 0, "", said)

    for token in ("1d10t", "st1pp", "a$$-1t", "i.d.1.o", "m0r0n", "s t u"):
        assert abs(price(token, read.read(token)) - min(every(token))) < 1e-9, token


def test_odd_rows(spark):
    docs = odd(spark, "fine words")
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 1), (2, None, 0), (None, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == 6 and len({r["score"] for r in rows if r["doc_id"] in (1, None)}) == 1
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert toxicity.clean(docs, model).columns == docs.columns
    assert toxicity.scored(empty(spark), toxicity.trained(empty(spark), labels)).count() == 0
