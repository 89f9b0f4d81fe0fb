"""Similarity join, phrase mining and spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxfold.llm.common import small_batches
from fluxfold.llm import jaccard_join
from fluxfold.llm.jaccard_join import jaccard_groups, prefix_length
from fluxfold.llm.phrases import collocations, mine_phrases
from fluxfold.llm.spans import PART_BYTES, cut
from fluxfold.llm.spelling import near_words, spelling_variants

#: Extra columns carry names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, node string, word string, size int"
WORDS = [a + b + c for a in ("br", "st", "kl", "m", "t") for b in ("a", "ei", "o") for c in ("nde", "ppel", "rk", "s")]


def prose(seed, n, vocabulary=WORDS):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(vocabulary, n))


def edited(text, seed, share):
    rng = np.random.default_rng(seed)
    return " ".join(w if rng.random() > share else f"x{rng.integers(10**6)}" for w in text.split())


def corpus():
    base, other = prose(1, 220), prose(2, 90)
    texts = [base] * 3 + [edited(base, s, 0.02) for s in range(40)] + [edited(other, s, 0.025) for s in range(25)]
    texts += [edited(edited(base, 99, 0.03), s, 0.02) for s in range(12)]
    texts += [None, "", "   \n\t", "One", "one", "one two", "ONE  two", prose(3, 5), prose(3, 5), "a b c d", "a b c d e"]
    texts += [prose(s, 60) for s in range(10, 30)] + [prose(7, 30) + " " + base for _ in range(2)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", None, "fr")[i % 3], "n", "w", 1) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- similarity join --------------------------------------------------------------------------


def _groups(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
        sets[i] = {tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))} if words else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and label[a] != label[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("size, percent, hot, block", [(4, 85, None, 512), (5, 80, None, 7), (3, 90, 10, 3), (4, 85, 1, 2)])
def test_jaccard_groups(docs, size, percent, hot, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(docs, size=size, percent=percent, hot_limit=hot, block=block).collect()}
    assert got == _groups(corpus(), size, percent)


def test_prefix_length_is_enough():
    for n in range(1, 200):
        for percent in (50, 80, 85, 100):
            # Of n shingles, all but the prefix are too few for the overlap with any partner.
            assert n - prefix_length(n, percent) < n * percent / 100


def test_jaccard_of_odd_tables(spark, empty):
    assert jaccard_groups(empty).collect() == []
    text = prose(4, 50)
    rows = [(None, text, None, None, None, None)] * 2 + [(7, text, None, None, None, None)] * 2 + [(9, text + " x", None, None, None, None)]
    got = jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (7, 7), (7, 7), (9, 7)]


def test_jaccard_ranges_cost_no_bytes(spark):
    """A document's number goes beside each token, not its node once per range it has tokens in."""
    base = prose(1, 300)
    texts = [edited(base, s, 0.05) for s in range(30)] + [edited(base, 1, 0.05), base + " One one", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    read = jaccard_join._read_sets(docs, 4)
    nodes = read.where("h IS NULL AND n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    shingles = nodes.agg(F.sum("n")).first()[0]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sent = spark.sparkContext.broadcast(none)
    found = []
    for parts in (1, 7, 400):
        packed = jaccard_join._packs(docs, nodes, 4, parts, sent)
        assert packed.agg(F.sum(F.length("entries"))).first()[0] <= 8 * shingles + 12 * len(texts)
        shared = jaccard_join._shared_shingles(docs, nodes, 4, parts, *none)
        found.append(sorted(map(tuple, jaccard_join._postings(shared, parts, 85).collect())))
    assert found[0] and found[0] == found[1] == found[2]


def test_jaccard_of_a_very_long_text(spark):
    vocabulary = [f"w{k}é" for k in range(50_000)]
    long = prose(5, 400_000, vocabulary)
    assert len(long.encode()) > 2 * PART_BYTES
    near = long.replace(" w17é ", " other ")
    one_word = "y" * (3 * PART_BYTES)
    rows = [(k, t, None, None, None, None) for k, t in enumerate([long, near, one_word, one_word, long.replace(" ", " ")])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    words = long.split(" ")
    assert got[0] == (len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}), 0)
    assert got[1][1] == 0 and got[2] == (1, 2) and got[3] == (1, 2) and got[4] == (1, 4)


def test_parts_of_long_texts():
    space = re.compile(rb"[\x20\x09-\x0D]")
    raw = (" \t".join(f"word{k}" for k in range(500)) + "  \n ").encode()
    whole = raw.split()
    for size in (1, 7, 50, 10_000):
        found = []
        for part in cut(0, raw, space, 2, size):
            starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", part.raw)]
            words = part.raw.split()
            for k, start in enumerate(starts):
                if start < part.own:
                    found.append(words[k])
                    assert words[k : k + 3] == whole[len(found) - 1 : len(found) + 2]
        assert found == whole


# -- phrases ----------------------------------------------------------------------------------


def _counts(rows):
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, " ".join(words[i : i + k])] += 1
    return n, f


def _collocations(rows, low, top):
    n, f = _counts(rows)
    f = {k: v for k, v in f.items() if v >= low}
    out = defaultdict(list)
    for (lang, phrase), a in f.items():
        w = phrase.split(" ")
        padded = f" {phrase} "
        if len(w) == 1 or any(
            x == lang and len(p.split(" ")) > len(w) and padded in f" {p} " and 100 * v >= 100 * a for (x, p), v in f.items()
        ):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, phrase.encode(), left, right))
    return {
        (lang, rank): (p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


def _phrase_texts():
    rng = np.random.default_rng(3)
    phrases = ["New York city hall", "of the", "of the river bank now", "à la carte", "a\tb"]
    texts = []
    for k in range(120):
        parts = [str(rng.choice(WORDS)) if rng.random() < 0.7 else str(rng.choice(phrases)) for _ in range(60)]
        joins = rng.choice([" ", " ", "  ", ", ", "\n", ".\x0b", " "], 60)
        texts.append(((None, "en", "fr", "")[k % 4], "".join(map("".join, zip(parts, joins, strict=True)))))
    return texts + [("en", None), (None, ""), ("de", " ,;\n")]


@pytest.mark.parametrize("share", [0.02, 0.3, 1.0])
def test_collocations(spark, share):
    texts = _phrase_texts()
    rows = [(k, t, lang, "n", "w", 1) for k, (lang, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {
        (r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score)
        for r in collocations(docs, min_count=12, top=40, share=share).collect()
    }
    assert got == _collocations([("und" if x is None else x, t) for x, t in texts], 12, 40)
    # A sample that misses nearly all still loses nothing: failures are expanded to the end.
    named = {(r.lang, r.phrase): r.f for r in mine_phrases(docs, min_count=12, share=share).where("size > 0").collect()}
    counts = _counts([("und" if x is None else x, t) for x, t in texts])[1]
    assert named == {k: v for k, v in counts.items() if v >= 12}


def test_collocations_of_odd_tables(spark, empty):
    assert collocations(empty).collect() == []
    big = 3 * 10**9
    named = spark.createDataFrame(
        [("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big), ("en", 0, "", 10**13)], "lang string, size int, phrase string, f long"
    )
    from fluxfold.llm.phrases import scored_phrases

    (row,) = scored_phrases(named).collect()
    assert row.score == 1000 * big * 10**13 // (big * big)
    # A very long text: more than a part, repeated words over the seams.
    long = "ab cd ef. " * (2 * PART_BYTES // 10)
    table = spark.createDataFrame([(1, long, "en", None, None, None)] * 2, SCHEMA)
    got = {r.phrase: r.f for r in mine_phrases(table).where("size > 0").collect()}
    n = 2 * (2 * PART_BYTES // 10)
    assert got == {"ab": n, "cd": n, "ef": n, "ab cd": n, "cd ef": n, "ab cd ef": n}


# -- spelling ---------------------------------------------------------------------------------


def _near(words):
    near, without = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            without[i, w[:i] + w[i + 1 :]].add(w)
    for (_, rest), group in without.items():
        for a in group:
            near[a] |= group - {a}
            if rest in words:
                near[a].add(rest)
                near[rest].add(a)
    return near


@pytest.mark.parametrize("list_rows", [1, 1000])
def test_near_words(spark, list_rows):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(700)}
    words |= {"a" * n for n in range(5, 12)} | {"ab" * n for n in range(3, 7)} | {"bcdefghabc", "cdefghabc"}
    table = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = [tuple(sorted((r.a, r.b))) for r in near_words(table, list_rows).collect()]
    want = {tuple(sorted((a, b))) for a, group in _near(words).items() for b in group}
    assert len(got) == len(set(got)) and set(got) == want


def test_spelling_variants(spark):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdeéß"), 8)) for _ in range(40)]
    texts = []
    for k in range(300):
        words = list(rng.choice(base, 40))
        words += [w[:-1] + "z" if rng.random() < 0.5 else w + "Q" for w in rng.choice(base, 3)]
        texts.append((k if k % 50 else None, "-".join(words) if k % 9 else " ".join(words).upper()))
    texts += [(500, None), (501, ""), (502, "kurz"), (503, "sevenxy sevenxy")]
    counts = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = _near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    want = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        want[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    assert any(form.values())
    docs = spark.createDataFrame([(k, t, "en", "n", "w", 1) for k, t in texts], SCHEMA)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(docs).collect()}
    assert got == want


def test_spelling_of_odd_tables(spark, empty):
    assert spelling_variants(empty).collect() == []
    # Forms in a chain: abcdefg <- abcdefh <- abcdeih.
    text = "abcdefg " * 1000 + "abcdefh " * 100 + "abcdeih " * 5
    docs = spark.createDataFrame([(1, text, None, None, None, None)], SCHEMA)
    got = {r.word: (r.form, r.root) for r in spelling_variants(docs.withColumn("doc_id", F.lit(4))).collect()}
    assert got["abcdeih"] == ("abcdefh", "abcdefg") and got["abcdefg"] == (None, "abcdefg")


def test_batches_on_their_way_are_small():
    batch = pa.record_batch({"n": pa.array(range(1000)), "b": pa.array([bytes(3000)] * 1000)})
    cut = list(small_batches(iter([batch, batch.slice(0, 0), batch.slice(7, 1)]), 1 << 18))
    assert pa.Table.from_batches(cut).to_pydict() == pa.Table.from_batches([batch, batch.slice(7, 1)]).to_pydict()
    assert max(c.nbytes for c in cut) <= 1 << 18
