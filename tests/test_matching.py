import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import model
from contactlink.operators import blocking, clusters, linking, matching, neighbours, reports, skew, tiles
from contactlink.operators.rules import RuleSet, active_rules, comparator, default_rules, parse_rules
from contactlink.operators.standardize import standardize
from contactlink.operators.storage import materialize
from contactlink.plans.contacts import contacts
from contactlink.plans.run import run_match
from contactlink.sources.keystore import KeyState, empty_state

FIELDS = ["SOURCE_TYPE", "SOURCE_ID", "COMPANY_NAME", "ADDRESS_LINE_1", "ADDRESS_LINE_2", "ZIP_CODE", "PHONE_NUMBER", "DEDUP_KEY"]
SCHEMA = "RID long, " + ", ".join(f"{c} string" for c in FIELDS)
TINY = {"direct_rows": 2, "look_ahead": 1, "slice_bits": 3, "tile_rows": 5}


def people(seed: int, n: int, hot: bool = False) -> list[dict]:
    """Random records; with ``hot`` a third of them are in one block, many of those copies."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        busy = hot and rng.random() < 0.4
        name = rng.choice(["Acme works", "The ACME wroks Inc", "acme holdings", "acorn", "acme work co"])
        if busy:
            name = rng.choice(["Acme works", "acme works inc", f"acme {rng.choice('abcdefgh') * 9} {i}"])
        out.append(
            dict(
                SOURCE_TYPE=rng.choice(["CRM", " crm", "WEB", None]),
                SOURCE_ID=str(rng.randint(1, 4)),
                COMPANY_NAME=name if rng.random() < 0.95 else rng.choice(["", None, "The Co"]),
                ADDRESS_LINE_1=rng.choice(["1 North Main Street", "1 n. main st", "99 Harbour Blvd", "", None]),
                ADDRESS_LINE_2=rng.choice(["", "Suite 4", "ste 4", "Floor 9"]),
                ZIP_CODE=rng.choice(["94105", "", None]) if not busy else "94105",
                PHONE_NUMBER=rng.choice(["4155551234", "1-415-555-1234", "2125551234", ""]) if not busy else "4155551234",
                DEDUP_KEY=rng.choice(["", "", None, f"K{rng.randint(1, 3)}"]),
            )
        )
    return out


def frame(spark, records):
    rows = [(10 * i, *(r[f] for f in FIELDS)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def narrow(df, rules):
    clean = standardize(df)
    return matching.match_columns(clean, rules, "RID", matching.record_block_key(clean))


MORE_RULES = parse_rules(
    {
        "rules": {
            "LATE": {"priority": 500, "conditions": [{"field": "PHONE_NUMBER", "percentage": "100"}]},
            "NOT_SAME_SUITE": {
                "priority": 50,
                "conditions": [
                    {"field": "COMPANY_NAME", "percentage": 90},
                    {"field": "ADDRESS_LINE_2", "percentage": "80", "include": False},
                ],
            },
            "OFF": {"priority": 1, "enabled": False, "conditions": [{"field": "ZIP_CODE"}]},
            "EMPTY": {"priority": 2},
            "TIE": {"priority": 50, "conditions": [{"field": "ADDRESS_LINE_1", "percentage": "", "blank_allowed": True}, {"field": "COMPANY_NAME", "percentage": 60}]},
        }
    }
)


@pytest.mark.parametrize("search", [{}, TINY], ids=["direct", "search"])
@pytest.mark.parametrize("rules", [default_rules(), MORE_RULES], ids=["default", "more"])
def test_best_match_equals_brute_force(spark, rules, search):
    records = people(3, 48, hot=True)
    rule_set = RuleSet(rules)
    best = matching.named_matches(matching.best_match(narrow(frame(spark, records), rule_set), rule_set, **search), rule_set)
    got = {r.ord // 10: (r.match_ord // 10, r.rule_id) for r in best.collect()}
    assert got == model.matches(records, active_rules(rules))
    assert got


def test_group_of_copies_is_resolved_at_once(spark):
    # A third of all rows in one block, all alike: one look each, linear output.
    records = [dict(r, COMPANY_NAME="Acme", ADDRESS_LINE_1="1 Main St", ZIP_CODE="94105", PHONE_NUMBER="4155551234") for r in people(9, 400)]
    rule_set = RuleSet(default_rules())
    best = matching.best_match(narrow(frame(spark, records), rule_set), rule_set, direct_rows=50, look_ahead=8, slice_bits=5)
    got = {r.ord // 10: r.match_ord // 10 for r in best.collect()}
    assert got == {i: m[0] for i, m in model.matches(records, active_rules(default_rules())).items()}


ALPHABET = "abcdefgh é"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0, 30, 60, 67, 70, 80, 90, 100]), st.booleans(), st.sampled_from([12, 90]))
def test_first_matches_of_tiles_equal_brute_force(seed, percentage, include, longest):
    rng = random.Random(seed)
    say = lambda: rng.choice([None, "", *("".join(rng.choices(ALPHABET, k=rng.randint(1, longest))) for _ in range(4))])
    base = [say() for _ in range(5)]
    near = lambda: (v := rng.choice(base)) and "".join(c if rng.random() < 0.85 else rng.choice(ALPHABET) for c in v)
    left, right = ({"a": [near() for _ in range(n)], "b": [rng.choice(["x", "y", "", None]) for _ in range(n)]} for n in (9, 14))
    checks = [tiles.Test("b", "equal", 100.0, True, True), tiles.Test("a", "fuzzy", percentage, include, rng.random() < 0.5)]
    allowed = np.array([[rng.random() < 0.8 for _ in range(14)] for _ in range(9)])

    def passes(i, j):
        x, y = left["b"][i], right["b"][j]
        if not (x is None or y is None or (x == y and x != "")):
            return False
        x, y = left["a"][i], right["a"][j]
        if x is None or y is None:
            return checks[1].blank_allowed
        return (model.indel(x, y) >= percentage) == include

    want = [next((j for j in range(14) if allowed[i, j] and passes(i, j)), -1) for i in range(9)]
    assert tiles.first_matches(left, right, checks, allowed.copy()).tolist() == want


@pytest.mark.parametrize("search", [{}, TINY], ids=["direct", "search"])
def test_a_condition_may_count_edits(spark, search):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _step(row, i, x, b)
        return row[-1]

    def _step(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return new

    rules = parse_rules({"rules": {"E": {"conditions": [{"field": "COMPANY_NAME", "percentage": 70, "method": "levenshtein"}]}}})
    records = people(31, 40, hot=True)
    names = [model.words_sorted(model.company(r["COMPANY_NAME"])) for r in records]
    score = lambda a, b: 100 * (1 - edits(a, b) / max(len(a), len(b))) if a and b else 0
    want = {}
    for i, r in enumerate(records):
        later = [j for j in range(i + 1, 40) if model.block(records[j]) == model.block(r) and (r["COMPANY_NAME"] or "").strip() and (records[j]["COMPANY_NAME"] or "").strip()]
        hit = next((j for j in later if score(names[i], names[j]) >= 70), None)
        if hit is not None:
            want[i] = hit
    rule_set = RuleSet(rules)
    best = matching.best_match(narrow(frame(spark, records), rule_set), rule_set, **search)
    assert {r.ord // 10: r.match_ord // 10 for r in best.collect()} == want
    with pytest.raises(ValueError, match="unknown method"):
        parse_rules({"rules": {"E": {"conditions": [{"field": "CITY", "method": "guess"}]}}})


def test_distinct_records_of_a_large_block_are_compared_by_tiles(spark):
    rng = random.Random(12)
    name = lambda: "acme " + "".join(rng.choices("abcdefghijklmnop", k=14))
    records = [dict(r, COMPANY_NAME=name(), ADDRESS_LINE_1="1 Main St", ADDRESS_LINE_2="", ZIP_CODE="94105", PHONE_NUMBER="4155551234") for r in people(5, 350)]
    for i, j in ((0, 340), (3, 349), (100, 330)):  # partners beyond the short looks
        records[j]["COMPANY_NAME"] = records[i]["COMPANY_NAME"][:-2] + "zz"
    rule_set = RuleSet(default_rules())
    best = matching.best_match(narrow(frame(spark, records), rule_set), rule_set, direct_rows=50, look_ahead=4, tile_rows=64)
    got = {r.ord // 10: r.match_ord // 10 for r in best.collect()}
    want = {i: m[0] for i, m in model.matches(records, active_rules(default_rules())).items()}
    assert got == want and {(0, 340), (3, 349), (100, 330)} <= set(got.items())


def _many_blocks(spark, records):
    """The narrow table under three blockings, and the pairs that share any of their keys, first blocking first."""
    blocks = [matching.record_block_key, blocking.phone_block, blocking.address_block]
    clean = standardize(frame(spark, records))
    rule_set = RuleSet(default_rules())
    table = matching.match_columns(clean, rule_set, "RID", blocks[0](clean), extra=matching.block_columns(clean, blocks))
    table = materialize(table, "narrow")
    keys = {r.ord // 10: (r.block_key, r._block_1, r._block_2) for r in table.collect()}
    shared = {
        (i, j): [k for k in range(3) if keys[i][k] is not None and keys[i][k] == keys[j][k]]
        for i in keys for j in keys if i < j
    }
    return table, rule_set, {pair: same for pair, same in shared.items() if same}


@pytest.mark.parametrize("search", [{}, TINY], ids=["direct", "search"])
def test_several_blockings_equal_brute_force(spark, search):
    records = people(41, 45, hot=True)
    table, rule_set, shared = _many_blocks(spark, records)
    assert any(len(same) > 1 for same in shared.values()) and any(same[0] > 0 for same in shared.values())
    rules = active_rules(default_rules())
    links = {}
    for i, j in sorted(shared):
        rank = next((n for n, rule in enumerate(rules) if all(model.holds(c, records[i], records[j]) for c in rule.conditions)), None)
        if rank is not None:
            links.setdefault(i, []).append((rank, j))
    tables = matching.by_block(table, 3)
    best = matching.best_of_blocks([matching.best_match(t, rule_set, **search) for t in tables])
    assert {r.ord // 10: (r.rule_rank, r.match_ord // 10) for r in best.collect()} == {i: min(found) for i, found in links.items()}
    if search:  # clusters by short looks are compared elsewhere
        return
    root = list(range(len(records)))
    for i, found in links.items():
        for _, j in found:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    got = {r.ord // 10: r.cluster // 10 for r in clusters.cluster_labels(tables, rule_set, **search).collect()}
    assert got == {i: r for i, r in enumerate(root) if root.count(r) > 1}


def test_a_pair_with_several_keys_is_compared_once(spark, monkeypatch):
    table, rule_set, shared = _many_blocks(spark, people(42, 40, hot=True))
    seen = []
    verdicts = matching._verdicts

    def counted(pairs, *rest):
        seen.extend((r.l_ord // 10, r.r_ord // 10) for r in pairs.select("l_ord", "r_ord").collect())
        return verdicts(pairs, *rest)

    monkeypatch.setattr(matching, "_verdicts", counted)
    for t in matching.by_block(table, 3):
        matching.best_match(t, rule_set).count()
    assert len(seen) == len(set(seen)) and set(seen) <= set(shared)
    gains = {r.blocking: (r.pairs, r.compared) for r in reports.block_gains(table, ["block_key", "_block_1", "_block_2"]).collect()}
    assert gains == {k: (sum(k in s for s in shared.values()), sum(s[0] == k for s in shared.values())) for k in range(3)}
    nothing = table.limit(0)
    assert {tuple(r) for r in reports.block_gains(nothing, ["block_key", "_block_1"]).collect()} == {(0, 0, 0), (1, 0, 0)}


def test_block_plan_counts_what_rules_leave(spark):
    rules = RuleSet(parse_rules({"rules": {
        "KEYS": {"priority": 1, "conditions": [{"field": "COMPANY_NAME", "percentage": 50}, {"field": "ZIP_CODE", "percentage": 100}, {"field": "SOURCE_ID", "percentage": 100}]},
        "NONE": {"priority": 2, "conditions": [{"field": "COMPANY_NAME", "percentage": 50}]},
        "NOBODY": {"priority": 3, "conditions": [{"field": "COMPANY_NAME", "percentage": 50}, {"field": "CITY", "percentage": 100}]},
    }}))
    records = people(51, 60)
    table = materialize(narrow(frame(spark, records), rules), "narrow")
    name, zip_code, source = (rules.name(c) for c in rules.rules[0].conditions)
    rows = [r.asDict() for r in table.collect()]
    pairs = lambda some, *on: sum(all(a[c] == b[c] for c in on) for i, a in enumerate(some) for b in some[:i])
    want = set()
    for block in {r["block_key"] for r in rows}:
        able = [r for r in rows if r["block_key"] == block and r[name]]
        if len(able) <= 3:
            continue
        keyed = [r for r in able if r[zip_code] and r[source]]
        if keyed:
            cost, key = min((pairs(keyed, c), i) for i, c in enumerate((zip_code, source)))
            want.add((block, "KEYS", len(keyed), pairs(keyed), ("ZIP_CODE", "SOURCE_ID")[key], cost, pairs(keyed, zip_code, source)))
        want.add((block, "NONE", len(able), pairs(able), None, pairs(able), pairs(able)))
    got = blocking.plan(table, rules, limit=3)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 3
    assert blocking.plan(table, rules).isEmpty() and blocking.plan(table.limit(0), RuleSet([])).isEmpty()


@pytest.mark.parametrize("with_keys", [True, False])
def test_run_equals_sequential_model(spark, with_keys):
    records = people(11, 60)
    if not with_keys:
        for r in records:
            r["DEDUP_KEY"] = None
    df = frame(spark, records)
    df = df if with_keys else df.drop("DEDUP_KEY")
    stored = {model.data_hash(records[0]): "STORED-0", model.data_hash(records[5]): "STORED-5"}
    empty = empty_state(spark)
    state = KeyState(
        spark.createDataFrame([(h, k, 0) for h, k in stored.items()], empty.hash_key.schema), empty.key_identifier, empty.key_hash
    )
    rules = default_rules() + MORE_RULES
    run = run_match(df, rules, order="RID", state=state, slice_bits=3)
    found = model.matches(records, active_rules(rules))
    want, final, linked = model.assign_keys(records, found, stored)
    rows = {r.RID // 10: r for r in run.result.collect()}
    assert [(rows[i].DEDUP_KEY, rows[i].is_new, rows[i].MATCHED_RECORD_IDS) for i in range(len(records))] == want
    assert {i for i, r in rows.items() if r.MATCH_REASON != "NEW"} == set(found)
    changed = {r.data_hash: r.dedup_key for r in run.changes.hash_key.collect()}
    assert {**stored, **changed} == final
    links = {(r.dedup_key, r.identifier) for r in run.changes.key_identifier.collect()}
    assert links == {(k, name) for k, names in linked.items() for name in names}
    stats = reports.run_statistics(run.result).first()
    assert stats.total_records == len(records) and stats.matched_existing == len(found) and stats.errors == 0
    assert stats.new_dedup_keys == sum(new for i, (_, new, _) in enumerate(want) if i not in found)


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("search", [{}, TINY], ids=["direct", "search"])
def test_clusters_equal_union_find(spark, search):
    records = people(21, 36, hot=True)
    rule_set = RuleSet(default_rules())
    table = narrow(frame(spark, records), rule_set)
    labels = {r.ord // 10: r.cluster // 10 for r in clusters.cluster_labels(table, rule_set, **search).collect()}
    want = components(len(records), model.all_links(records, active_rules(default_rules())))
    assert {i: labels.get(i, i) for i in want} == want


@pytest.mark.parametrize("seed", range(4))
def test_joined_labels_are_the_components_of_their_pairs(seed):
    rng = np.random.default_rng(seed)
    labels, a, b = rng.integers(0, 30, 60), rng.integers(0, 60, 12 * seed), rng.integers(0, 60, 12 * seed)
    codes = np.unique(labels, return_inverse=True)[1]
    want = components(30, [(int(codes[x]), int(codes[y])) for x, y in zip(a, b)])
    assert neighbours._joined(codes, a, b).tolist() == [want[int(c)] for c in codes]


def test_star_and_chain_components(spark):
    edges = [(0, i) for i in range(1, 9)] + [(i, i + 1) for i in range(20, 40)] + [(50, 49)]
    got = {r.node: r.root for r in clusters.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(9)} | {i: 20 for i in range(20, 41)} | {49: 49, 50: 49}


def test_blocks_of_a_task_are_joined_at_once(spark, monkeypatch):
    """A chain of records that only match the next one is a cluster after one round, whose edges are stars already."""
    rules = RuleSet(parse_rules({"rules": {"N": {"conditions": [{"field": "COMPANY_NAME", "percentage": 90}]}}}))
    names = ["abcdefghij" * 3]
    for i in range(25):  # each differs from the one before in two characters, from the others in more
        names.append(names[-1][:i] + "Z" + names[-1][i + 1 :])
    rows = [(f"b{c}", 100 * c + (i * 7) % 26, n) for c in range(3) for i, n in enumerate(names)]
    table = spark.createDataFrame(rows, "block_key string, ord long, c0 string")
    rounds, linked = [], clusters.linking_edges
    monkeypatch.setattr(clusters, "linking_edges", lambda *a, **b: rounds.append(1) or linked(*a, **b))
    monkeypatch.setattr(clusters, "_large_star", lambda *a: pytest.fail("stars need no step"))
    got = {r.ord: r.cluster for r in clusters.cluster_labels(table, rules).collect()}
    assert got == {100 * c + i: 100 * c for c in range(3) for i in range(26)} and len(rounds) == 1


def test_cluster_keys_join_narrow_rows(spark, sf_dir, monkeypatch):
    """Keys are settled without a second look at the stored keys of whole records."""
    looked, stored = [], linking.with_stored_key
    monkeypatch.setattr(linking, "with_stored_key", lambda rows, state: looked.append(rows.columns) or stored(rows, state))
    run = run_match(contacts(spark, sf_dir).filter("RID < 40"), order="RID", mode="cluster")
    assert run.result.count() == 40 and not any("identifier" in columns for columns in looked)


def test_cluster_mode_shares_a_key(spark, sf_dir):
    run = run_match(contacts(spark, sf_dir).filter("RID < 40"), order="RID", mode="cluster")
    rows = {r.RID: r for r in run.result.collect()}
    assert rows[4].DEDUP_KEY == rows[5].DEDUP_KEY == rows[6].DEDUP_KEY != rows[7].DEDUP_KEY
    assert rows[6].MATCH_REASON == "CLUSTER" and rows[7].MATCH_REASON == "NEW"


def test_no_rules_match_nothing(spark, sf_dir):
    result = run_match(contacts(spark, sf_dir), [], order="RID").result
    assert result.filter("MATCH_REASON <> 'NEW'").isEmpty()


def test_fixture_counts(spark, sf_dir):
    run = run_match(contacts(spark, sf_dir), order="RID")
    counts = {r.MATCH_REASON: r.records for r in reports.reason_counts(run.result).collect()}
    assert counts == {"CMP_ADDR": 600, "CMP_PHN_BLNK_ADDR": 152, "NEW": 748}


def test_comparator_order():
    assert comparator("EMAIL_ADDRESS") == "address" and comparator("EMAIL_ADDRESS", strict_email=True) == "email"
    assert comparator("email_std") == "email" and comparator("PHONE_TYPE") == "phone" and comparator("ZIP_CODE") == "text"
    assert comparator("CONTACT_NAME") == "company" and comparator("CONTACT_NAME", for_score=True) == "text"


def test_percentage_must_be_a_number():
    with pytest.raises(ValueError, match="percentage"):
        parse_rules({"rules": {"R": {"conditions": [{"field": "CITY", "percentage": "high"}]}}})


def test_score_of_a_name_is_text(spark):
    rules = parse_rules({"rules": {"R": {"conditions": [{"field": "CONTACT_NAME", "percentage": "100"}]}}})
    rows = [(1, "The Smith", "x"), (2, "smith", "x")]
    result = run_match(spark.createDataFrame(rows, "RID long, CONTACT_NAME string, COMPANY_NAME string"), rules, order="RID").result
    first = result.filter("RID = 1").first()
    assert first.MATCH_REASON == "R" and first.contact_name_score == round(model.indel("Smith The", "smith"), 2)


def test_positions_and_carried_values_across_slices(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), 7 * i, rng.choice([None, f"v{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o long, v string").repartition(5)
    got = {r.o: r for r in skew.with_position(df, ["k"], "o", bits=4).collect()}
    carried = {r.o: r.last for r in skew.with_last_before(df, ["k"], "o", "v", "last", bits=4).collect()}
    later = {r.o: r for r in skew.with_followers(df, ["k"], "o", bits=4).collect()}
    for key, order, _ in rows:
        group = [r for r in rows if r[0] == key]
        before = [r for r in group if r[1] < order]
        after = [r[1] for r in group if r[1] > order]
        assert (got[order].pos, got[order].n) == (len(before), len(group))
        assert carried[order] == next((r[2] for r in reversed(before) if r[2]), None)
        assert (later[order].n_later, later[order].next_later, later[order].last_later) == (
            len(after), min(after, default=None), max(after, default=None))


def test_seen_and_unseen_hashes(spark):
    empty = empty_state(spark)
    state = KeyState(spark.createDataFrame([("h1", "k1", 0)], empty.hash_key.schema), empty.key_identifier, empty.key_hash)
    hashes = spark.createDataFrame([("h1",), ("h2",)], "data_hash string")
    assert [r[0] for r in linking.seen_hashes(hashes, state).collect()] == ["h1"]
    assert [r[0] for r in linking.unseen_hashes(hashes, state).collect()] == ["h2"]


def test_blocks_in_a_task_keep_blocks_whole():
    batches = [pa.record_batch({"block_key": list(keys), "ord": list(range(len(keys)))}) for keys in ("aab", "bb", "bbc", "dd")]
    tables = [t["block_key"].to_pylist() for t in neighbours._whole_blocks(iter(batches), 3)]
    assert tables == [["a", "a"], ["b"] * 5, ["c"], ["d", "d"]]


def test_similar_records_of_a_block_are_not_all_compared(spark, monkeypatch):
    """Every record has a partner among its next two, so comparisons grow with the records, not with their pairs."""
    rules = RuleSet(default_rules())
    records = [
        {"RID": i, "SOURCE_TYPE": "A", "SOURCE_ID": str(i), "COMPANY_NAME": f"long company name {i:04d}", "ADDRESS_LINE_1": "1 Main St",
         "ADDRESS_LINE_2": "", "ZIP_CODE": "12345", "PHONE_NUMBER": "4155550000", "DEDUP_KEY": ""}
        for i in range(400)
    ]
    seen = []
    compared = neighbours.Column.ratio
    monkeypatch.setattr(neighbours.Column, "ratio", lambda self, a, b: seen.append(len(a)) or compared(self, a, b))
    rows = narrow(frame(spark, records), rules).orderBy("ord").toArrow()
    a, b = neighbours.Block(rows, rules).search(rules.rules[0], np.ones(400, bool))
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, i + 1) for i in range(399)]
    assert sum(seen) < 400 * 8


@pytest.mark.parametrize("backward", [False, True])
def test_tiles_in_rounds_find_what_one_round_finds(spark, monkeypatch, backward):
    """Two records match over several tiles; rounds of one tile each reach them and stop."""
    monkeypatch.setattr(matching, "ROUND_ROWS", 1)
    rules = RuleSet(parse_rules({"rules": {"N": {"conditions": [{"field": "COMPANY_NAME", "percentage": 95}]}}}))
    names = ["same partner far away", *(f"{chr(97 + i) * 12}" for i in range(20)), "same partner far awaz"]
    rows = [{"block_key": "b", "ord": i, "pos": i, "first": 0, "last": 21, "last_copy": None, "c0": n} for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "block_key string, ord long, pos long, first long, last long, last_copy long, c0 string")
    found = matching._by_tiles(materialize(df, "todo"), materialize(df, "everyone"), ["block_key"], rules, 0, rules.rules[0], 0, backward, 4)
    assert [(r.ord, r.match_ord) for r in found.collect()] == ([(21, 0)] if backward else [(0, 21)])


@pytest.mark.parametrize("backward", [False, True])
def test_slices_of_a_group_find_the_first_partner_within_their_rows(spark, backward):
    """Slices of eight places, in two groups: what is found is the first partner, and none within eight places is missed."""
    rng = random.Random(8)
    rules = RuleSet(parse_rules({"rules": {"N": {"conditions": [{"field": "COMPANY_NAME", "percentage": 70}]}}}))
    names = ["".join(rng.choices("abc", k=7)) if rng.random() < 0.9 else None for _ in range(120)]
    rows = [(f"g{i % 2}", i, i // 2, i % 11 > 1, i // 6 if backward else None, n) for i, n in enumerate(names) if n]
    rows = [(*r[:2], sum(o[0] == r[0] for o in rows[:k]), *r[3:]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "block_key string, ord long, pos long, wanted boolean, label long, c0 string")
    df = materialize(df if backward else df.drop("label"), "placed")
    found = {r.ord: r.match_ord for r in neighbours.sliced_partners(df, ["block_key"], rules, 0, 8, backward).collect()}
    first = {}
    for i, a in enumerate(rows):
        others = reversed(rows[:i]) if backward else rows[i + 1 :]
        near = [b for b in others if b[0] == a[0] and (not backward or a[4] != b[4]) and model.indel(a[5], b[5]) >= 70]
        if a[3] and near:
            first[a[1]] = (near[0][1], abs(near[0][2] - a[2]))
    assert set(found) <= set(first) and {k for k, (_, away) in first.items() if away <= 8} <= set(found)
    assert len(found) > 30 and (backward or all(found[k] == first[k][0] for k in found))


def test_records_that_search_share_tiles(spark):
    """Ten records far apart in a group of 1,000 are a tile and a half, not ten."""
    rows = [("b", 100 * i, 100 * i, 999) for i in range(10)]
    todo = spark.createDataFrame(rows, "block_key string, ord long, pos long, last long")
    mine = {r.pos: r.mine for r in tiles.packed(todo, ["block_key"], 8).collect()}
    assert mine == {100 * i: i // 8 for i in range(10)}


def test_records_of_one_number_are_no_partners_and_come_once(spark):
    """Numbers repeat or are missing; against all pairs in a join."""
    rules = RuleSet(default_rules())
    records = [r | {"RID": [1, 1, 2, 2, 3, None, 4, 5][i % 8] + 8 * (i // 8) if i % 8 != 5 else None} for i, r in enumerate(people(3, 80, hot=True))]
    table = materialize(narrow(frame(spark, records), rules), "narrow")
    want = matching._first_per_record(matching._direct_pairs(table, rules, labelled=False))
    got = matching.best_match(table, rules)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(got) == rows(want) and want.count()
