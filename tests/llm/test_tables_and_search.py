"""Filter audit, token files and hard negatives against brute force; the piece table against the library."""

import itertools
import math
import random
import re
import zlib
from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contactlink.llm import filter_audit as audit
from contactlink.llm import hard_negatives as hard
from contactlink.llm import token_files as files
from contactlink.llm.piece_table import PieceTable, byte_table, word_table

BPE, WORD_BPE = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
LIBRARY = {path: Tokenizer.from_file(path) for path in (BPE, WORD_BPE)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- pieces ----------------------------------------------------------------------------

PARTS = ["word", "Word", "é", "İ", "ß", "×", "ñandú", "’s", "'s", "'ll", "'", "12", "3", ".", ",", "...", "|", "<|endoftext|>", "<|", "日本", "😀", "é",
         "́", " ", " ", "\x1c", "\x00", "\x7f", "\x85", "_", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "Ω", "ж", "й", "й", "½", "٣", "x" * 70]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=5))
def test_ids_equal_the_library(texts):
    for make, path in ((byte_table, BPE), (word_table, WORD_BPE)):
        ids, bounds = make(path).encode(pa.array(texts, pa.string()))
        want = [e.ids for e in LIBRARY[path].encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


def test_a_full_table_forgets_and_learns_again():
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    small = PieceTable(byte_table(BPE).learn, byte_table(BPE).specials, room=100)
    library = LIBRARY[BPE]
    for at in range(0, 2000, 40):
        text = " ".join(["common", *words[at : at + 40], "common"])
        ids, _ = small.encode(pa.array([text, None, ""]))
        assert ids.tolist() == library.encode(text).ids
        assert len(small.number) <= 100 + 43 and " common" in small.number


# --- filter audit ----------------------------------------------------------------------

sorted_lists = st.lists(st.integers(0, 60), unique=True).map(sorted)


@given(st.lists(sorted_lists, max_size=5), sorted_lists)
def test_galloping_merges(lists, items):
    assert audit.union(lists) == sorted(set().union(*lists))
    for other in lists:
        assert audit.difference(items, other) == sorted(set(items) - set(other))
        assert audit.common(items, other) == len(set(items) & set(other))


@given(sorted_lists, st.integers(0, 60), st.integers(0, 70))
def test_gallop_finds_the_first_place(items, low, bound):
    low = min(low, max(0, len(items) - 1))
    if items:
        assert audit.gallop(items, low, bound) == max(low, bisect_left(items, bound))


def audit_by_brute_force(rows, labels):
    """Rows are (doc_id, text, lang); every order is walked through document by document."""
    texts = [r[1] or "" for r in rows]
    fails = []
    for (doc, _, _), text in zip(rows, texts):
        words = WORD.findall(text)
        capitals = sum("A" <= c <= "Z" for c in text)
        smaller = doc is not None and any(o is not None and o < doc and t == text for (o, _, _), t in zip(rows, texts))
        fails.append({f for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), any(c in "#$%&*|" for c in text), smaller)) if bad})
    good = [any(d == r[0] is not None and q == 1 for d, q, _ in labels) for r in rows]
    toxic = [any(d == r[0] is not None and t == 1 for d, _, t in labels) for r in rows]
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                removed = {i for i in left if f in fails[i]}
                failing = [i for i in own if f in fails[i]]
                left -= removed
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), len(failing) - len(removed), sum(fails[i] == {f} for i in own), sum(good[i] for i in removed), sum(toxic[i] for i in removed), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]] if isinstance(row[6], str) else row[6]
    return out


def audited(spark, rows, labels, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, mask string, good int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.filter_audit(audit.audited_documents(docs, marks), "ABCDE")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in found.collect()}


def test_audit_matches_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = [rng.choice(["one", "Two", "THREE", "é日", f"w{rng.randrange(500)}"]) for _ in range(rng.choice([0, 1, 50, 199, 200, 230, 500]))]
        rows.append((i * 3 - 50, rng.choice([" ", "\n", "\t"]).join(words) + rng.choice(["", "", "#", "$5", "|"]), rng.choice(["en", "de", None, ""])))
    long = "A long text of Words " * 30_000
    rows += [(500 + i, rows[7][1], "en") for i in range(40)]  # many copies
    rows += [(None, "", "en"), (None, rows[3][1], None), (700, None, "de"), (701, "", "fr"), (702, long, "de"), (703, long, "de"), (9, "same id", "en"), (9, "same id", "en"), (9, "other text", "de")]
    rng.shuffle(rows)
    labels = [(i * 3 - 50, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(9, 1, 1), (9, 0, 0), (None, 1, 1), (12345, 1, 1)]
    assert audited(spark, rows, labels) == audit_by_brute_force(rows, labels)


def test_audit_of_empty_tables_and_small_ranges(spark):
    assert audited(spark, [], []) == {}
    rows = [(i, "one two", "en") for i in range(30)]
    assert audited(spark, rows, []) == audit_by_brute_force(rows, [])
    # Ranges of any size add up to the same sums.
    flags = spark.range(1000).selectExpr("cast(id % 3 as string) AS part", "id", "cast(id * 7 % 32 as int) AS mask", "cast(id % 2 as int) AS good", "cast(id % 5 = 0 as int) AS toxic")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(audit.part_sums(flags, 5, range_rows=7)) == told(audit.part_sums(flags, 5))


# --- token files -----------------------------------------------------------------------


def test_files_give_back_every_id(spark, tmp_path):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["Some", "words", "é", "12", "it's", "<|endoftext|>", "\n"]) for _ in range(n))
    rows = [(i, say(rng.choice([0, 1, 5, 40, 300]))) for i in rng.sample(range(-200, 5000), 150)]
    rows += [(60_000, say(30_000)), (1, None), (2, ""), (3, "twice"), (3, "twice"), (3, "again"), (None, "no id")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 7, "p") for i, t in rows], "doc_id long, text string, start int, path string")
    index = files.with_starts(files.write_token_files(df.repartition(5), str(tmp_path / "out"), WORD_BPE, sequence=16, batch_rows=3))
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], list(r["ids"])) for r in files.read_documents(index, keep_ids=True).orderBy("start").collect()]
    library = LIBRARY[WORD_BPE]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [r[0] for r in ordered]
    ids_of = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    by_id = lambda pairs: sorted(((i is not None, i or 0), v) for i, v in pairs)
    assert by_id((g[0], g[4]) for g in got) == by_id((i, ids_of(t)) for i, t in rows)
    start = 0
    for _, at, n, crc, ids in got:
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n


@pytest.mark.parametrize("vocabulary", [1 << 16, (1 << 16) + 1])
def test_random_access_is_by_views(tmp_path, vocabulary):
    path = str(tmp_path / "one.arrow")
    writer = files.TokenFileWriter(path, sequence=8, batch_rows=4, pad_id=9, vocabulary=vocabulary)
    places = [writer.append(np.arange(a, b, dtype="<u4")) for a, b in ((0, 5), (5, 5), (5, 70), (70, 101))]
    assert not (tmp_path / "one.arrow").exists()  # not there before it is whole
    assert (places, writer.close()) == ([0, 5, 5, 70], 101)
    file = files.TokenFile(path)
    assert len(file) == 13
    ids, mask = file[12]
    assert ids.tolist() == [96, 97, 98, 99, 100, 9, 9, 9] and mask.to_pylist() == [True] * 5 + [False] * 3
    assert not ids.flags.owndata and not ids.flags.writeable and not file.ids(33, 20).flags.owndata
    assert file.ids(30, 60).tolist() == list(range(30, 90)) and file.ids(7, 0).tolist() == []
    assert ids.dtype == (np.uint16 if vocabulary == 1 << 16 else np.uint32)
    batch = pa.ipc.open_file(path).get_batch(0)
    assert pa.types.is_fixed_size_list(batch.schema.field("ids").type) and batch.schema.field("mask").type.list_size == 8


def test_empty_table_writes_no_file(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert files.token_files(df, WORD_BPE, str(tmp_path / "none")).count() == 0
    assert not (tmp_path / "none").exists()


def test_a_text_longer_than_a_slice(spark, tmp_path):
    text = "a long text " * 400_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in files.token_files(df, WORD_BPE, str(tmp_path / "long")).collect()}
    ids = np.array([*LIBRARY[WORD_BPE].encode(text, add_special_tokens=False).ids, 1], "<u4")
    assert (got[1]["start"], got[1]["n_tokens"], got[1]["ids_crc32"]) == (0, len(ids), zlib.crc32(ids.tobytes())) and got[2]["start"] == len(ids)


# --- hard negatives --------------------------------------------------------------------


def negatives_by_brute_force(rows, positives=5, negatives=3, low=50, high=95):
    good = [(i, label, [math.floor(256 * Fraction(x)) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, v in good:
        if a % 5:
            continue
        scored = sorted((-max(min(sum(x * y for x, y in zip(v, w)), hard.LONG.max), hard.LONG.min), i, other) for i, other, w in good if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            found = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, rank, n, int(-s), int(-t)) for rank, (t, n, _) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, kind="double", **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, label int, embedding array<{kind}>, rank string")
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in hard.hard_negatives(df, F.col("vec_id") % 5 == 0, **options).collect())


@pytest.mark.parametrize("options", [{}, {"block_rows": 37, "anchor_rows": 11}])
def test_negatives_match_brute_force(spark, options):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), int(rng.integers(0, 4)), (centres[i % 12] * rng.choice([0.5, 1.0]) + rng.normal(size=16) * rng.choice([0, 0.2, 0.6])).tolist()) for i in rng.permutation(260)]
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(30)]  # one vector many times, under two labels
    rows += [(2000, None, rows[0][2]), (2005, 1, None), (2010, 1, [float("nan")] * 16), (2015, 1, [None] * 16), (2020, 1, [float("inf")] * 16), (None, 1, rows[0][2])]
    rows += [(2025, 1, [0.0] * 16), (2030, 2, [0.0] * 16), (2035, 1, []), (2040, 1, [1.0, -1.0]), (2045, 77, rows[1][2])]
    assert mined(spark, rows, **options) == negatives_by_brute_force(rows)


def test_negatives_of_repeated_rows_extremes_and_empty_tables(spark):
    rows = [(5, 1, [0.5, 0.25]), (5, 1, [0.5, 0.25]), (6, 1, [0.5, 0.3]), (7, 2, [0.4, 0.1]), (7, 2, [0.4, 0.1]), (8, 3, [0.3, 0.2])]
    assert mined(spark, rows) == negatives_by_brute_force(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(5, 1, [1.0])]) == []
    huge = [(5, 1, [1e30, 1.0]), (6, 1, [1e20, -1.0]), (7, 2, [7e7, 1e-300]), (8, 2, [-1e300, 0.0]), (9, 2, [3e15, 2.5]), (10, 1, [1e8, 1e8]), (15, 2, [1e308, 1e308])]
    assert mined(spark, huge) == negatives_by_brute_force(huge)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 10**6))
def test_search_is_exact_with_ties(n, width, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-2, 3, (n, width)).astype(float)
    ids = rng.permutation(n).astype(np.int64)
    anchor = rng.integers(-2, 3, width).astype(float)
    windows = [(hard.NO_LOW, hard.NO_HIGH, 3), (0, 2, 2), (-3, 0, 4), (5, 4, 1)]
    scored = sorted((-int(s), int(i)) for s, i in zip(vectors @ anchor, ids) if i != 0)
    want = [[(-s, i) for s, i in scored if low <= -s <= high][:k] for low, high, k in windows]
    assert hard.SortedLists(ids, vectors).search(anchor, windows, 0) == want


def test_search_stops_before_the_end():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(5000, 3))
    vectors[:10] += 20
    lists = hard.SortedLists(np.arange(5000), np.floor(256 * vectors))
    reads = []
    lists.vectors = type("Counted", (np.ndarray,), {"__getitem__": lambda self, k: reads.append(np.size(k)) or np.asarray(self)[k]})(lists.vectors.shape, lists.vectors.dtype, lists.vectors.copy())
    assert {i for _, i in lists.search(np.array([1.0, 2.0, 1.0]), [(hard.NO_LOW, hard.NO_HIGH, 5)], -1)[0]} <= set(range(10))
    assert sum(reads) < 500


def test_lists_are_not_read_on_when_all_rows_are_met():
    rng = np.random.default_rng(4)
    lists = hard.SortedLists(np.arange(4000), np.floor(256 * rng.normal(size=(4000, 32))))
    reads = []
    lists.order = type("Counted", (np.ndarray,), {"__getitem__": lambda self, k: reads.append(np.asarray(self)[k]) or reads[-1]})(lists.order.shape, lists.order.dtype, lists.order.copy())
    anchor = np.floor(256 * rng.normal(size=32))
    ((_, lowest),) = lists.search(anchor, [(hard.NO_LOW, int((lists.vectors @ anchor).min()), 2)], -1)[0] or [(None, None)]
    assert lowest == (lists.vectors @ anchor).argmin()
    assert sum(r.size for r in reads) < 32 * 4000 * 3 // 4


def test_new_pieces_are_learned_as_flat_ids_in_their_order():
    pieces = [" word", "12", " über", "Ċ", "'s", "abc", " |"]
    for make, path in ((byte_table, BPE), (word_table, WORD_BPE)):
        ids, lengths = make(path).learn(pieces)
        alone = [make(path).learn([p]) for p in pieces]
        assert ids.tolist() == [i for one, _ in alone for i in one] and lengths.tolist() == [n for _, one in alone for n in one]
