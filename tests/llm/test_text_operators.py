"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contactlink.llm import exchange, fingerprints, hashing
from contactlink.llm import jaccard_join as jaccard
from contactlink.llm.jaccard_join import jaccard_join
from contactlink.llm.packing import cut, pack, places, plan
from contactlink.llm.substring_dedup import substring_dedup
from contactlink.llm.token_counts import count_tokens, load_merger

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made_texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß", "日本", " x", "#", "a b"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(60)
    base = say(120)
    texts = [say(80), passage, say(30) + " " + passage + "\n" + say(20), base, base, None, "", "   \t\n", "one", "one two three"]
    for _ in range(12):  # near copies of one text
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["lol " * 300, "again and again " * 40, say(12) + " <|endoftext|> it's 12  spaces\n\n\ttabs", "x" * 5000, say(20_000), passage.upper(), passage]
    return texts


def table(spark, texts, first=10, step=3):
    rows = [(first + step * i, t, f"s{i % 2}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept_text string, `odd.name` long")


def words_of(text):
    return WORD.findall(text or "")


def removed_by_brute_force(rows, window=20):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = words_of(text)
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[doc_id] = words, gone
    return out


def test_substring_dedup_matches_brute_force(spark):
    df = table(spark, made_texts())
    got = {r["doc_id"]: r for r in substring_dedup(df).collect()}
    assert set(substring_dedup(df).columns) == {"doc_id", "odd.name", "n_words", "n_removed", "removed", "kept_text"}
    want = removed_by_brute_force([(r["doc_id"], r["text"]) for r in df.collect()])
    assert got.keys() == want.keys()
    for doc_id, (words, gone) in want.items():
        row = got[doc_id]
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (row["n_words"], row["n_removed"], row["kept_text"] or "") == (len(words), sum(gone), kept)
        spans = {i for s in row["removed"] for i in range(s["start"], s["start"] + s["length"])}
        assert spans == {i for i, g in enumerate(gone) if g}


def test_substring_dedup_of_empty_table_and_verbatim(spark):
    df = table(spark, ["a  b\n", None])
    assert substring_dedup(df.limit(0)).count() == 0
    assert {r["kept_text"] for r in substring_dedup(df, verbatim=True).collect()} == {"a  b\n", None}


def test_repeated_rows_and_missing_ids_of_substring_dedup(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    removed = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup(df).collect())
    assert removed == [(0, 0), (0, 30), (1, 0), (1, 30)]


def components_by_brute_force(rows, n=5):
    sets = {}
    for doc_id, text in rows:
        words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_jaccard_join_matches_brute_force(spark):
    rng = random.Random(5)
    texts = made_texts()
    chain = [f"c{i}" for i in range(60)]
    for i in range(40):  # a chain: neighbours are linked, its ends are not; many share all prefix n-grams
        chain[rng.randrange(60)] = f"d{i}"
        texts.append(" ".join(chain))
    df = table(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(df).collect()}
    assert got == components_by_brute_force([(r["doc_id"], r["text"]) for r in df.collect()])


def test_every_pair_is_verified_once(spark, monkeypatch):
    rng = random.Random(8)
    chain = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(60):
        chain[rng.randrange(60)] = f"d{i}"
        texts.append(" ".join(chain))
    seen, plain = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: seen.extend(map(tuple, pairs.collect())) or plain(pairs, *rest))
    jaccard_join(table(spark, texts)).collect()
    assert len(seen) > 60 and len({frozenset(p) for p in seen}) == len(seen)


def test_ids_with_several_texts_keep_all_links(spark):
    a, b = (" ".join(f"{s}{i}" for i in range(60)) for s in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " z"), (3, b + " z"), (5, b), (5, "other words only here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (5, 5)]


def test_jaccard_join_of_empty_table_and_missing_ids(spark):
    df = table(spark, ["a b c d e f", None])
    assert jaccard_join(df.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_join(lost).collect()) == [(0, 0), (4, 4), (4, 4)]


def test_token_counts_match_the_library(spark):
    texts = made_texts() + ["  double  spaces ", " lead", "trail ", "\n\n", "a  \n b", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>"]
    tokenizer = Tokenizer.from_file(BPE)
    df = table(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in count_tokens(df, BPE, limit=512).collect()}
    for row in df.collect():
        text = row["text"] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        found = got[row["doc_id"]]
        assert (found["n_bytes"], found["n_tokens"], found["over_limit"]) == (len(text.encode()), n, n > 512)
    assert count_tokens(df.limit(0), BPE).count() == 0


def test_merging_equals_the_library_on_random_words():
    rng = random.Random(1)
    words = ["".join(rng.choice("aaabehinrst'é") for _ in range(rng.randint(1, 60))) for _ in range(500)] + ["a" * 999, "ab" * 700]
    tokenizer = Tokenizer.from_file(BPE)
    merger = load_merger(BPE)
    whole = [w for w in words if "'" not in w]
    symbols, counts = merger.merge([w.encode() for w in whole])
    at = 0
    for word, n in zip(whole, counts):
        assert symbols[at : at + n].tolist() == tokenizer.encode(word, add_special_tokens=False).ids
        at += n


def test_window_hashes_are_equal_only_for_equal_words():
    texts = [b"a b c d a b c", b"ab c", b"a bc", b"", b"c d a"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    words = hashing.Words(data, np.cumsum([0, *map(len, texts)]))
    hashes, at = hashing.window_hashes(words, words.hashes(1), 3, 1)
    flat = [t.split() for t in texts]
    joined = [w for t in flat for w in t]
    same = defaultdict(set)
    for h, i in zip(hashes.tolist(), at.tolist()):
        same[tuple(joined[i : i + 3])].add(h)
    assert len(at) == 5 + 1 and all(len(v) == 1 for v in same.values()) and len(set(hashes.tolist())) == len(same)


def test_word_hashes_keep_little_memory_whatever_the_batch():
    text = " ".join(f"word{i % 700}" for i in range(400_000)).encode()
    words = hashing.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    hashing._powers.cache_clear()
    powers = []
    keep, hashing._powers = hashing._powers, lambda base, n: powers.append(n) or keep(base, n)
    try:
        hashes = words.hashes(1)
    finally:
        hashing._powers = keep
    assert max(powers) * 8 <= 8 << 20
    assert (hashes.reshape(-1, 100)[7::7] == hashes[700:800]).all() and len(np.unique(hashes)) == 700


def test_chunks_follow_the_texts_and_not_the_shuffle_partitions(spark):
    docs = table(spark, ["some words " * 20_000] * 50)
    few = exchange.chunks_and_buckets(docs, "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        assert exchange.chunks_and_buckets(docs, "text") == few == (8, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert exchange.chunks_and_buckets(docs.unionByName(docs).unionByName(docs), "text") == (16, 4)
    assert exchange.chunks_and_buckets(docs.limit(0), "text") == (8, 2)


def test_fingerprints_estimate_likeness_and_pair_with_the_next(spark):
    texts = [t for t in made_texts() if t]
    df = table(spark, texts, first=1, step=1500).select("doc_id", "text")  # ids far apart: many slices
    got = fingerprints.with_next(df, "doc_id", "text", {"sketch": fingerprints.sketch(F.col("text"))})
    rows = {r["doc_id"]: r for r in got.withColumn("edited", fingerprints.edited_by_next(F.col("text"), F.col("next_text"))).collect()}
    order = sorted(rows, reverse=True)
    for i, doc_id in enumerate(order):
        following = rows[order[(i + 1) % len(order)]]
        row = rows[doc_id]
        assert (row["next_text"], row["next_sketch"]) == (following["text"], following["sketch"])
        third = len(row["text"]) // 3
        assert row["edited"] == row["text"][: len(row["text"]) - third] + following["text"][:third]
    long = max(texts, key=len)
    half = " ".join(long.split(" ")[:10_000])
    pair = spark.createDataFrame([(long, half)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    near, inside, union = pair.select(
        fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.containment(F.col("b"), F.col("a")), fingerprints.merged(F.col("a"), F.col("b")) == F.col("a")
    ).first()
    assert abs(near - 0.5) < 0.03 and inside > 0.99
    assert union or inside < 1  # the shorter text's sketch is part of the longer one's, but for its last windows


def test_fingerprints_of_short_texts(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        long = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        at, n = rng.randrange(380), (6, 8, 12, 20)[i % 4]
        short = long[:12] + [f"v{rng.randrange(10**6)}" for _ in range(12)]
        rows.append((" ".join(long[at : at + n]), " ".join(long), " ".join(long[:24]), " ".join(short)))
    s = {c: fingerprints.sketch(F.col(c)) for c in "abcd"}
    exact = [fingerprints.sketch(F.col(c), fraction=1 - 2**-20) for c in "cd"]
    got = spark.createDataFrame(rows, "a string, b string, c string, d string").select(
        fingerprints.containment(s["a"], s["b"]).alias("inside"), fingerprints.containment(s["a"], s["a"]).alias("itself"),
        fingerprints.likeness(s["c"], s["d"]).alias("near"), fingerprints.likeness(*exact).alias("truth"),
    ).collect()
    assert {r["inside"] for r in got} == {1.0, None} and sum(r["inside"] is None for r in got) < 0.15 * len(got)
    assert {r["itself"] for r in got} == {1.0}
    assert sum(abs(r["near"] - r["truth"]) for r in got) / len(got) < 0.1


def test_fingerprints_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "one two"), (5, "one two")], "doc_id long, text string")
    rows = fingerprints.fingerprint(df).collect()
    assert [len(r["sketch"]) for r in rows] == [0, 0, 0, 1, 1] and rows[3]["fingerprint"] == rows[4]["fingerprint"] != ""
    nexts = fingerprints.with_next(df.fillna(""), "doc_id", "text", {})
    assert sorted(nexts.count() for _ in range(1)) == [5]
    assert {(r["doc_id"], r["next_text"]) for r in nexts.collect()} >= {(None, "one two"), (1, "one two")}


@pytest.mark.parametrize("keep_ids", [False, True])
def test_packing_places_every_id_once(spark, keep_ids):
    df = table(spark, made_texts())
    rows = pack(df, BPE, keep_ids=keep_ids).collect()
    tokenizer = Tokenizer.from_file(BPE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    tokens = 0
    for row in df.collect():
        ids = np.array(tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces[row["doc_id"]], key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]].tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(piece), len(ids))
            assert not keep_ids or bytes(r["ids"]) == piece
            at += r["length"]
        assert at == len(ids)
        tokens += at
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == -(-tokens // 1024)
    assert pack(df.limit(0), BPE).count() == 0


def test_plans_fill_sequences():
    rng = random.Random(2)
    for _ in range(5):
        counts = defaultdict(int)
        for _ in range(3000):
            for _, length in cut(int(rng.lognormvariate(6, 1)) + 1, 1024, 16):
                counts[length] += 1
        patterns = plan(dict(counts), 1024)
        placed = defaultdict(int)
        for pattern, times in patterns:
            assert sum(x * n for x, n in pattern.items()) <= 1024
            for x, n in pattern.items():
                placed[x] += n * times
        assert placed == counts
        tokens = sum(x * n for x, n in counts.items())
        assert sum(t for _, t in patterns) <= -(-tokens // 1024) + 3
        served = defaultdict(list)
        for length, low, high, *_ in places(patterns):
            served[length].append((low, high))
        for length, spans in served.items():
            assert [a for a, _ in sorted(spans)] == [0, *(b + 1 for _, b in sorted(spans)[:-1])] and max(b for _, b in spans) == counts[length] - 1


def test_kept_text_digest_is_of_utf8(spark):
    row = substring_dedup(table(spark, ["é  ß x"])).select(F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")).first()
    assert row["h"] == hashlib.sha256("é ß x".encode()).hexdigest()
