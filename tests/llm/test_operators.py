"""The training-data operators against brute force, and their defined results for odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import difference, oracle_connection
from conftest import SMALL

import corpus_pipeline
from fluxfold.llm import config_lp
from fluxfold.llm import decontamination as dc
from fluxfold.llm import licenses as lic
from fluxfold.llm import sql
from fluxfold.llm.catalog import LLM_ORACLES, LLM_QUERIES
from fluxfold.llm.common import keep
from fluxfold.llm.decontamination import contamination, drop_contaminated
from fluxfold.llm.html_text import extract_text, page_text
from fluxfold.llm.licenses import scan_licences
from fluxfold.llm.line_dedup import drop_repeated_lines, line_report
from fluxfold.llm.near_dedup import drop_near_duplicates, near_duplicates
from fluxfold.llm.packing import cut_pieces, pack_documents, packed_sequences, place_pieces
from fluxfold.llm.quality_rules import quality_filter, quality_verdicts
from fluxfold.llm.substring_dedup import maximal_repeats, substring_dedup, text_contexts
from fluxfold.llm.token_counts import count_tokens
from fluxfold.llm.token_files import token_file_digests
from fluxfold.llm.wavelet import WaveletMatrix, encode

SCHEMA = "doc_id long, text string, id string, n long, key string, h long"
WORDS = ("the of and stone river to in a wind bridge is that mountain it valley for as harbour with was "
         "garden by on winter not summer this lantern are from").split()  # fmt: skip


def prose(seed, n):
    rng = np.random.default_rng(seed)
    words = [WORDS[i] + ("" if i < 20 else str(rng.integers(90))) for i in rng.integers(0, len(WORDS), n)]
    return " ".join(w + ("\n" if i % 11 == 10 else "") for i, w in enumerate(words)).replace("\n ", "\n")


def texts():
    base = prose(1, 120)
    rows = [None, "", "   \n\t ", "one", "two words", base, base, base + " tail", prose(2, 120), prose(2, 118)]
    rows += [prose(3, 90) + "\n" + prose(1, 60), "same line of text\n" * 40, "x" * 3000, "é ß 日本\xa0語 " * 30]
    rows += ["word " * 400, prose(4, 6000), "\x00\x1c odd\x85 bytes", "<|endoftext|> a<|endoftext|>"]
    return list(enumerate(rows, start=3))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "k", 2) for i, t in texts()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    rows = [(None, None, None, None, None, None), (None, prose(1, 120), None, None, None, None)]
    rows += [(5, prose(1, 120), None, None, None, None)] * 2
    return spark.createDataFrame(rows, SCHEMA)


def _tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


# -- near duplicates --------------------------------------------------------------------------


def _components(rows, size):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))} if words else set()
        sets[i] = grams
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, size):
    want = _components(texts(), size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, size=size).collect()}
    assert got == want
    kept = {r.doc_id for r in drop_near_duplicates(docs, size=size).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_of_null_keys(nulls):
    rows = near_duplicates(nulls).collect()
    assert len(rows) == 4 and all(r.kept for r in rows)
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]


# -- tokens -----------------------------------------------------------------------------------


def test_token_counts(docs):
    tokenizer = _tokenizer("byte_bpe_50k.json")
    for row in count_tokens(docs).collect():
        text = dict(texts())[row.doc_id] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 512)


def test_token_files(docs):
    tokenizer, start = _tokenizer("word_bpe_49k.json"), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_file_digests(docs).collect()}
    for i, text in texts():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n, symbols", [(0, 1), (1, 1), (700, 1), (5000, 3), (5000, 4000)])
def test_wavelet_matrix(n, symbols):
    ids = np.random.default_rng(n).integers(0, symbols, n) * 7
    matrix = WaveletMatrix(encode(ids, np.array([n])))
    assert (matrix.ids() == ids).all()
    assert [matrix.access(i) for i in range(0, n, 97)] == ids[::97].tolist()
    for token in [*ids[:5].tolist(), 10**6]:
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places)
        assert matrix.count(token, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
        assert [matrix.occurrence(token, j) for j in range(0, len(places), 50)] == places[::50].tolist()


def test_packing(docs):
    tokenizer = _tokenizer("word_bpe_49k.json")
    placed = pack_documents(docs, capacity=256).collect()
    want = {}
    for i, text in texts():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 256):
            part = ids[s : s + 256]
            want[i, s // 256] = (s, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in placed} == want
    by_sequence = {}
    for row in placed:
        by_sequence.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for parts in by_sequence.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 256
    assert len(by_sequence) <= -(-sum(r.length for r in placed) // 256) + 2


def test_packed_sequences(docs):
    pieces = cut_pieces(docs, capacity=256, with_ids=True).cache()
    placed = place_pieces(pieces, 256)
    total = sum(len(r.ids) for r in packed_sequences(placed).collect())
    assert total == sum(r.length for r in placed.collect())


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    histogram = Counter((rng.gamma(2, 400, 4000).astype(int) % 4096 + 1).tolist())
    groups, bound = config_lp.plan(histogram, 4096)
    held = Counter()
    for group in groups:
        assert sum(group.lengths) <= 4096
        for length in group.lengths:
            held[length] += group.count
    assert held == histogram
    assert sum(g.count for g in groups) <= 1.01 * bound + 1


def test_plan_always_solves_the_program(monkeypatch):
    calls = []
    solve = config_lp.solve_covering
    monkeypatch.setattr(config_lp, "solve_covering", lambda *a: calls.append(a) or solve(*a))
    # Filler enough for best-fit alone to meet the bound, and a histogram without it.
    for histogram in ({2048: 40, 700: 90, 3: 5000}, {3000: 5, 2000: 7}):
        groups, bound = config_lp.plan(histogram, 4096)
        assert sum(g.count for g in groups) <= 1.02 * bound + 1
    assert len(calls) == 2
    # Nothing above filler size, or nothing at all: there is no program.
    assert config_lp.plan({}, 4096)[0] == [] and sum(g.count for g in config_lp.plan({5: 900}, 4096)[0]) == 2
    assert len(calls) == 2


def test_covering_bound():
    amounts, bound = config_lp.solve_covering(np.array([6, 5, 4]), np.array([10.0, 10.0, 10.0]), 10)
    # 6 + 4 and 5 + 5 fill every sequence: 15 are needed.
    assert 14 <= bound <= 15 + 1e-9 and 15 <= sum(amounts.values()) + 0.5


@pytest.mark.parametrize("seed", range(2))
def test_covering_gap_with_many_classes(seed):
    sizes = np.arange(97, 257)
    demand = np.random.default_rng(seed).pareto(1, len(sizes)) * 1000 + 1
    amounts, bound = config_lp.solve_covering(sizes, demand, 256)
    covered = np.zeros(len(sizes))
    for pattern, amount in amounts.items():
        assert sizes[list(pattern)].sum() <= 256
        np.add.at(covered, list(pattern), amount)
    assert (covered >= demand * (1 - 1e-9)).all()
    assert sum(amounts.values()) <= (1 + 2 * config_lp.GAP) * bound


@pytest.mark.parametrize("histogram, fewest", [({1536: 6000, 1280: 12000}, 6000), ({1365: 3000, 1366: 3000, 1000: 10}, 2250)])
def test_plan_of_few_lengths(histogram, fewest):
    groups, bound = config_lp.plan(histogram, 4096)
    held = Counter()
    for group in groups:
        assert sum(group.lengths) <= 4096
        held.update({length: n * group.count for length, n in Counter(group.lengths).items()})
    assert held == histogram
    assert sum(g.count for g in groups) == bound == fewest


# -- quality, lines, substrings ---------------------------------------------------------------


def _against(spark, con, docs, query, frame):
    con.register("documents", docs.toPandas())
    return difference(frame.toPandas(), con.execute(query).df())


def test_quality_rules(spark, docs):
    import duckdb

    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    assert _against(spark, duckdb.connect(), docs, sql.quality_sql(), quality_verdicts(docs).select(columns)) is None
    kept = quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_verdicts(docs).where("kept").collect()}


def test_line_dedup(spark, docs):
    import duckdb

    assert _against(spark, duckdb.connect(), docs, sql.line_sql(), line_report(docs)) is None
    report = {r.doc_id: r for r in line_report(docs).collect()}
    left = {r.doc_id: r.text for r in drop_repeated_lines(docs).collect()}
    assert None in left.values() and report[9].n_removed and 9 not in left
    for i, text in left.items():
        assert hashlib.md5((text or "").encode()).hexdigest() == report[i].kept_md5


def test_line_dedup_of_single_lines(spark):
    line, short = "Share this page with all your friends today.", "Menu"
    rows = [(i, f"own text {i} of this page\n{short}\n{line}\nmore text {i} of this page") for i in range(4)]
    rows += [(4, f"Menu\nHome page\nContact us\nown text 4\n{short}"), (5, "text 5\nMenu\nHome page\nContact us")]
    left = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # A line too short by itself goes with its run, and only with it.
    want = dict(rows) | {i: rows[i][1].replace(f"\n{short}\n{line}", "") for i in (1, 2, 3)} | {5: "text 5"}
    assert left == want


def _removed(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        cover = np.zeros(len(data), bool)
        windows = [data[p : p + 50] for p in range(len(data) - 49)]
        for p, window in enumerate(windows):
            if first.get(window, i) < i:
                cover[p : p + 50] = True
        for window in windows:
            first.setdefault(window, i)
        kept = bytes(np.frombuffer(data, np.uint8)[~cover])
        spans = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        out[i] = (len(data), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [2000, 1])
def test_substring_dedup(docs, monkeypatch, heavy):
    monkeypatch.setattr("fluxfold.llm.substring_dedup.HEAVY", heavy)
    got = {r[0]: tuple(r[1:]) for r in substring_dedup(docs).collect()}
    assert got == _removed(texts())


def test_substring_dedup_of_a_common_passage(spark, monkeypatch):
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    passage, ends = letters(140), [letters(n) for n in (1, 3, 9, 20, 33)]
    rows = [(i, letters(60) + ends[i % 5][: i % 4] + passage[i % 2 :] + ends[i % 3] + letters(60)) for i in range(80)]
    sizes = {}

    def kept(df, name):
        out = keep(df, name)
        sizes[name] = max(out.count(), sizes.get(name, 0))
        return out

    module = "fluxfold.llm.substring_dedup."
    for name, value in (("keep", kept), ("HEAVY", 10), ("PACK_CONTEXTS", 400), ("RANGE_BYTES", 4000), ("_BLOB", 7)):
        monkeypatch.setattr(module + name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = {r[0]: tuple(r[1:]) for r in substring_dedup(docs).collect()}
    assert got == _removed(rows)
    # Contexts of very common anchors are parted in halves, not taken apart into all their windows.
    assert sizes["parted_contexts"] > 0
    assert max(sizes.values()) <= 3 * sizes["context_bytes"]


def test_contexts_fill_their_ranges_evenly():
    rng = np.random.default_rng(9)
    h = text_contexts(np.array([1, 2]), [bytes(rng.integers(97, 123, 100_000).astype(np.uint8)) for _ in range(2)]).h
    counts = np.bincount((h >> np.uint64(44)).astype(int), minlength=16)
    assert len(counts) == 16 and counts.max() < 1.5 * counts.mean()


def test_maximal_repeats():
    rng = np.random.default_rng(3)
    shared = bytes(rng.integers(97, 123, 60).astype(np.uint8))
    contexts = [b"A" + shared + b"x" * 10, b"B" + shared + b"y" * 5, shared[5:] + b"x" * 4]
    found = {(n, tuple(sorted(zip(w.tolist(), o.tolist(), strict=True)))) for n, w, o in maximal_repeats(contexts)}
    assert found == {(60, ((0, 1), (1, 1))), (59, ((0, 6), (2, 0))), (55, ((0, 6), (1, 6), (2, 0)))}


# -- licences, pages, benchmark ---------------------------------------------------------------


def test_licences(spark):
    rows = [
        (1, "Under the MIT License, or the Apache License; see CC BY. GNU General Public License!"),
        (2, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause"),
        (3, "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 more words"),
        (4, "mit licenses, submit license"),
        (5, None),
    ]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (4, 2, 11)
    assert got[1].base_labels == "apache,cc-by,gpl,mit"
    assert (got[2].labels, got[2].copyleft, got[2].score) == ("bsd,gpl,mit", 0, 1.0)
    assert (got[3].labels, got[3].copyleft) == ("gpl", 1)
    assert (got[4].n_base, got[4].base_labels, got[4].score) == (0, "", 0.0)
    assert (got[5].n_words, got[5].first_word, got[5].labels) == (0, None, "")


@pytest.mark.parametrize(
    "expression, strength",
    [("MIT", 0), ("GPL-3.0 OR MIT", 0), ("GPL-3.0 AND MIT", 2), ("MIT OR GPL-3.0 AND LGPL-2.1", 0),
     ("(MIT OR GPL-3.0) AND LGPL-2.1", 1), ("MIT OR", None), ("( MIT", None), ("MIT )", None), ("", None)],
)
def test_licence_expressions(expression, strength):
    value = lic.evaluate(lic._PART.findall(expression))
    assert (value.strength if value else None) == strength


def test_pages(spark):
    page = (
        "<title>no</title><p>One<p>Two <b>bold</b><br>line<ul><li>a<li>b<ol start=3><li>x</ol><li>c</ul>"
        "<table><tr><th>Name<th>Qty<tr><td>kiwi &amp; co<td>10</table><div hidden>no</div>"
        "<div style='display: none'>no</div><pre>a  b\n  c</pre>end 2 < 3<script>no</script></div>"
    )
    want = "One\n\nTwo bold\nline\n\n- a\n- b\n  3. x\n- c\n\nName      | Qty\nkiwi & co | 10\n\na  b\n  c\n\nend 2 < 3"
    assert page_text(page) == want
    assert page_text(None) == "" and page_text("") == ""
    assert page_text("<div>" * 5000 + "deep").strip() == "deep"
    frame = spark.createDataFrame([(1, page, "u"), (2, None, None)], "page_id long, html string, text string")
    assert {r.page_id: r.text for r in extract_text(frame).collect()} == {1: want, 2: ""}


def test_page_words_against_a_plain_parser(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("head", "script", "style")
            if tag == "body":
                self.skip = 0

        def handle_endtag(self, tag):
            self.skip -= tag in ("head", "script", "style") and self.skip > 0

        def handle_data(self, data):
            if not self.skip:
                self.words.append(data)

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for row in LLM_QUERIES["op8_html_extraction"](spark, SMALL).collect():
        plain = Plain()
        plain.feed(raw[row.page_id])
        squeezed = re.sub(r"\s+", "", "".join(plain.words))
        assert re.sub(r"\s+", "", re.sub(r"(?m)^ *- ", "", row.text)) == squeezed


def test_masks_find_two_substitutions():
    from itertools import combinations

    for bad in combinations(range(dc.WINDOW), 2):
        assert any(
            all(start + o not in bad for o in dc._offsets(mask))
            for mask in dc.MASKS
            for start in range(dc.WINDOW - len(mask) + 1)
        )


def test_decontamination(spark, docs):
    item = prose(50, 30).split()
    changed = [w if i not in (4, 15) else "other" for i, w in enumerate(item)]
    rows = [
        (1, "before " + " ".join(item).upper() + " after"),
        (2, prose(2, 30) + " " + ", ".join(changed)),
        (3, " ".join(item[:9]) + " " + prose(60, 40)),
        (4, None),
        (5, " ".join(item[12:27])),
    ]
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, "few words")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_words, r.n_equal) for r in contamination(frame, bench).collect()}
    assert got == {1: (9, 30, 30), 2: (9, 30, 28), 5: (9, 15, 15)}
    assert {r.doc_id for r in drop_contaminated(frame, bench).collect()} == {3, 4}
    assert contamination(frame, bench.limit(0)).count() == 0


def _leaks(doc, item):
    """(start, words, equal words) of every alignment of two word lists, window by window."""
    size = min(len(item), 13)
    needed = size if size < 8 else -(-size * 8 // 10)
    for shift in range(-len(item) + size, len(doc) - size + 1):
        equal = {i: doc[i] == item[i - shift] for i in range(max(0, shift), min(len(doc), shift + len(item)))}
        starts = [i for i in equal if i + size - 1 in equal and sum(equal[j] for j in range(i, i + size)) >= needed]
        if starts and size >= 3:
            reach = range(starts[0], starts[-1] + size)
            yield starts[0], len(reach), sum(equal[i] for i in reach)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    items = [[rng.choice(words) for _ in range(n)] for n in [*range(1, 25), 3, 8, 10, 12] for _ in range(2)]
    docs = []
    for i in range(4 * len(items)):
        doc = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        part = list(items[i % len(items)])
        for at in rng.sample(range(len(part)), min(len(part), i // len(items))):
            part[at] = "changed"
        docs.append(doc[:20] + part + doc[20:])
    # One item inside a text of more than one Arrow slice, and a repeated item.
    docs.append([rng.choice(words) + "x" for _ in range(90_000)] + items[30])
    items.append(items[30])
    want = sorted((d, i, *leak) for d, doc in enumerate(docs[:-1]) for i, item in enumerate(items) for leak in _leaks(doc, item))
    far = [(len(docs) - 1, i, 90_000, len(items[30]), len(items[30])) for i in (30, len(items) - 1)]
    frame = spark.createDataFrame([(d, " ".join(doc)) for d, doc in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    got = sorted(tuple(r) for r in contamination(frame, bench).collect())
    assert [g for g in got if g[0] < len(docs) - 1] == want
    assert set(far) <= set(got)
    found = {len(items[g[1]]) for g in got}
    assert found == set(range(3, 25))
    kept = {r.doc_id for r in drop_contaminated(frame, bench).collect()}
    assert kept == set(range(len(docs))) - {g[0] for g in got}


def test_short_mask_finds_every_place():
    from itertools import combinations

    offsets = dc._offsets(dc.SHORT_MASK)
    for n in range(dc.EXACT_BELOW, dc.WINDOW):
        allowed = int(n - dc.MIN_MATCH * n + 1e-9)
        for bad in combinations(range(n), allowed):
            assert any(all(s + o not in bad for o in offsets) for s in range(n - offsets[-1]))


def test_decontamination_in_blocks(spark, monkeypatch):
    whole = {tuple(r) for r in LLM_QUERIES["op10_benchmark_decontamination"](spark, SMALL).collect()}
    monkeypatch.setattr(dc, "BLOCK_CHARS", 3000)
    assert {tuple(r) for r in LLM_QUERIES["op10_benchmark_decontamination"](spark, SMALL).collect()} == whole


# -- every operator on odd tables -------------------------------------------------------------

OPERATORS = {
    "near": near_duplicates, "near_drop": drop_near_duplicates, "counts": count_tokens, "files": token_file_digests,
    "pack": pack_documents, "quality": quality_verdicts, "quality_drop": quality_filter, "lines": line_report,
    "lines_drop": drop_repeated_lines, "bytes": substring_dedup, "licences": scan_licences,
    "pages": lambda d: extract_text(d, "doc_id", "text"),
    "leaks": lambda d: contamination(d, d, item_key="n"), "leaks_drop": lambda d: drop_contaminated(d, d.limit(0), item_key="n"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_and_null_tables(empty, nulls, name):
    assert OPERATORS[name](empty).count() == 0
    rows = OPERATORS[name](nulls).count()
    assert rows == 4 or name in ("leaks", "quality_drop")


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_queries_against_sql(spark, name):
    assert difference(LLM_QUERIES[name](spark, SMALL).toPandas(), oracle_connection(SMALL).execute(LLM_ORACLES[name]).df()) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.toPandas().set_index("doc_id")
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), docs.schema)
        after = docs.toPandas().set_index("doc_id")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert set(after.index) <= set(before.index) and len(after) >= 0.6 * len(before), name
        if name == "near_dedup":
            want = _components(list(before.text.items()), 5)
            assert set(after.index) == {i for i, (_, c) in want.items() if i == c}
    assert contamination(docs, bench).count() == 0
    placed = corpus_pipeline.packing(spark, docs, SMALL)
    assert placed.select("doc_id").distinct().count() == docs.count()
