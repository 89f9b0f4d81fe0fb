"""Operator 13: words one edit apart, found by pivotal bigrams, and the form each word varies.

A word's bigrams are ordered by how rare they are among all words. One edit destroys at most two
neighbouring bigrams, so of two disjoint ones at least one stays. Per word the prefix holds the
three rarest bigrams (with every place of the last one), and a dynamic program over the prefix in
text order picks two disjoint ones, the pivots, of least total frequency. Of two near words, take
the one whose prefix ends earlier in the order: one of its pivots stands in the other's prefix. So
pivots are indexed and the prefixes look them up. An edit right of the pivot leaves its place and
all letters before it; an edit left of it shifts its place by the difference of the lengths and
leaves all letters after it. So place, length and the letters on the side that stays are part of
the join key, in six combinations. Pairs found are verified by their edit distance.

Hot bigrams: lists of pivots above ``LIST_ROWS`` are dealt over several salts, and the prefixes look
in each of them. A word has at most about 90 near words per letter and gap, so no group is larger.

Words come from whole texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least seven
letters, A-Z lower-cased. A run whose checksum with the key of its row is divisible by 31 loses one
letter (``mutate``). A null text has no words; a null key counts as the empty string; repeated rows
count again; ties of the form go to the smallest word; very long texts are one row of words, cut
up at once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxfold.llm.common import ascii_lower, keep, null_safe_text, tidy_shuffles

MIN_LETTERS = 7
MIN_COUNT = 2
FORM_FACTOR = 10
MUTATION_STEP = 31
#: Three bigrams: twice the letters of a bigram, less one, lie in reach of one edit; one more stays.
PREFIX = 3
#: Pivots with one key that a task looks up at once.
LIST_ROWS = 1000
#: Letters that stay (0 left of the bigram, 1 right of it), shift of its place, difference of length:
#: what one edit on the other side can cause.
MOVES = ((0, 0, 0), (1, 0, 0), (0, 0, 1), (1, 1, 1), (0, 0, -1), (1, -1, -1))


def mutate(key: Column, run: Column) -> Column:
    """``run`` without one letter where the checksum of ``<key>:<run>`` says so."""
    checksum = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = (checksum % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(checksum % MUTATION_STEP == 0, shorter).otherwise(run)


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""
    runs = F.regexp_extract_all(null_safe_text(text), F.lit(f"[A-Za-zÀ-ÿ]{{{min_letters},}}"), F.lit(0))
    found = docs.select(F.col(key).alias("_key"), F.explode(runs).alias("_run"))
    found = found.select("_key", ascii_lower(F.col("_run")).alias("_run"))
    words = found.select(mutate(F.col("_key"), F.col("_run")).alias("word"))
    words = words.where(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _bigrams(words: DataFrame) -> DataFrame:
    places = F.sequence(F.lit(1), F.length("word") - 1)
    return words.where(F.length("word") > 1).select("word", F.explode(places).alias("place")).withColumn(
        "gram", F.substring(F.col("word"), F.col("place"), F.lit(2))
    )


def _best_pair(prefix: Column) -> Column:
    """The two disjoint places of least total frequency among ``prefix`` (place, gram, rank, n).

    Dynamic program from left to right, ``prefix`` in order of place: ``ended`` is the cheapest
    place before ``last``, so the next place may be paired with it, and with ``last`` too unless
    that is its neighbour.
    """
    none = F.lit(None).cast("struct<place:int,gram:string,rank:int,n:bigint>")
    start = F.struct(
        none.alias("ended"), none.alias("last"), none.alias("one"), none.alias("two"),
        F.lit(None).cast("bigint").alias("cost"),
    )

    def step(state: Column, here: Column) -> Column:
        ended, last = state["ended"], state["last"]
        cheapest = F.when(ended.isNull() | (last["n"] < ended["n"]), last).otherwise(ended)
        partner = F.when(last["place"] + 2 <= here["place"], cheapest).otherwise(ended)
        cost = partner["n"] + here["n"]
        better = partner.isNotNull() & (state["cost"].isNull() | (cost < state["cost"]))
        return F.struct(
            cheapest.alias("ended"), here.alias("last"),
            F.when(better, partner).otherwise(state["one"]).alias("one"),
            F.when(better, here).otherwise(state["two"]).alias("two"),
            F.when(better, cost).otherwise(state["cost"]).alias("cost"),
        )

    return F.aggregate(prefix, start, step, lambda s: F.array(s["one"], s["two"]))


def _odd_letters(word: Column) -> Column:
    """64 bits, one per class of letters: whether the word has an odd number of them. One edit
    turns at most two bits over."""
    one = F.lit(1).cast("long")
    bits = F.transform(
        F.split(word, ""), lambda c: F.call_function("shiftleft", one, (F.crc32(c) % 64).cast("int"))
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def signatures(words: DataFrame) -> DataFrame:
    """word, length, odd (letter bits), last (rank that ends the prefix), prefix and pivots: arrays
    of (place, gram, rank, n). ``words`` has one row per distinct word of two letters or more."""
    grams = _bigrams(words)
    # One row per bigram of the alphabet, whatever the number of words.
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    ranks = keep(counts.withColumn("rank", F.row_number().over(Window.orderBy("n", "gram"))), "gram_ranks")
    listed = grams.join(ranks, "gram").groupBy("word").agg(
        F.array_sort(F.collect_list(F.struct("rank", "place", "gram", "n"))).alias("all")
    )
    # The rank of the third bigram ends the prefix, with every place of that bigram in it.
    listed = listed.withColumn("last", F.element_at("all", F.least(F.lit(PREFIX), F.size("all")))["rank"])
    prefix = F.array_sort(
        F.transform(
            F.filter("all", lambda g: g["rank"] <= F.col("last")),
            lambda g: F.struct(g["place"].alias("place"), g["gram"].alias("gram"), g["rank"].alias("rank"), g["n"].alias("n")),
        )
    )
    odd = _odd_letters(F.col("word")).alias("odd")
    return listed.select("word", F.length("word").alias("length"), odd, "last", prefix.alias("prefix")).withColumn(
        "pivots", _best_pair(F.col("prefix"))
    )


def _beside(side: Column) -> Column:
    """The letters left (``side`` 0) or right (1) of the bigram at ``place`` of ``word``."""
    left = F.substring(F.col("word"), F.lit(1), F.col("place") - 1)
    right = F.substring(F.col("word"), F.col("place") + 2, F.col("length"))
    return F.when(side == 0, left).otherwise(right)


def near_words(words: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b): every two words of the column ``word`` (distinct, of five letters or more) that
    differ by exactly one letter inserted, deleted or replaced; each pair once, in no fixed order."""
    made = keep(signatures(words), "signatures")
    key = ["rank", "place", "length", "side", "letters"]
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    pivots = made.select("word", "last", "odd", "length", F.inline("pivots")).select("*", sides)
    pivots = pivots.withColumn("letters", _beside(F.col("side"))).select(
        F.col("word").alias("a"), F.col("last").alias("last_a"), F.col("odd").alias("odd_a"), *key
    )
    moves = F.array(*[F.struct(F.lit(x).alias("side"), F.lit(p).alias("dp"), F.lit(n).alias("dn")) for x, p, n in MOVES])
    looks = made.select("word", "last", "odd", "length", F.inline("prefix")).select("*", F.inline(moves))
    looks = looks.withColumn("letters", _beside(F.col("side"))).select(
        F.col("word").alias("b"), F.col("last").alias("last_b"), F.col("odd").alias("odd_b"), "rank", "side", "letters",
        (F.col("place") + F.col("dp")).alias("place"), (F.col("length") + F.col("dn")).alias("length"),
    )
    sizes = pivots.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(list_rows)).cast("int").alias("salts"))
    hot = keep(sizes.where("salts > 1"), "long_lists")
    salts = F.coalesce("salts", F.lit(1))
    dealt = pivots.join(hot, key, "left").withColumn("salt", F.pmod(F.hash("a"), salts)).drop("salts")
    asked = looks.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    earlier = (F.col("last_a") < F.col("last_b")) | ((F.col("last_a") == F.col("last_b")) & (F.col("a") < F.col("b")))
    pairs = dealt.join(asked.hint("merge"), [*key, "salt"]).where(
        (F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2)
        & earlier & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    )
    return pairs.select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): follow ``forms`` (word, form) to the last; every round halves the way."""
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = now.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        step = keep(
            now.join(next_, now["root"] == F.col("_at"), "left").select(
                "word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")
            ),
            "roots",
        )
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT, form_factor: int = FORM_FACTOR, list_rows: int = LIST_ROWS,
) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word.

    ``form`` is the near word of largest n if that is at least ``form_factor`` times the word's.
    """
    if min_letters < 5:
        raise ValueError("two disjoint bigrams of three need words of five letters")
    with tidy_shuffles(docs.sparkSession):
        words = keep(word_counts(docs, key, text, min_letters, min_count), "words")
        pairs = keep(near_words(words, list_rows), "near_words")
        both = pairs.union(pairs.select("b", "a"))
        counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
        best = counted.groupBy("a").agg(
            F.count("*").alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b").alias("near"))).alias("best"),
        )
        joined = words.join(best, words["word"] == best["a"], "left")
        has_form = -F.col("best.less") >= form_factor * F.col("n")
        found = keep(
            joined.select(
                "word", F.when(has_form, F.col("best.near")).alias("form"), "n",
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(has_form, -F.col("best.less")).alias("form_n"),
            ),
            "forms",
        )
        ends = roots(found.where("form IS NOT NULL"))
        return keep(
            found.join(ends, "word", "left").select(
                "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
            ),
            "spelling_variants",
        )
