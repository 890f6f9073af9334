"""Best match of every record: the earliest later record of its block under the best rule.

Input is a narrow table with ``ord`` (unique record order), ``block_key`` and the
comparison columns of a ``RuleSet``; a ``given_key`` column is carried along if present.

Blocks of up to ``direct_rows`` rows are searched whole, many to a task (``neighbours``; where a rule counts
edits, they are joined with themselves on the block key). Larger blocks never are: each rule adds its equality conditions to the key, records are
numbered inside the resulting group, and a task takes slices of the group, each with the slice after it
(``neighbours.sliced_partners``). Found records leave the search; what is left after the next ``SLICE_TILES`` tiles goes
through the rest of its group tile by tile (``tiles``), which keeps the result exact. Exact copies bound the work further:
a record never looks past its next copy, which matches anyway, nor at a copy of something it has met before. A rule that
counts edits looks at longer and longer stretches of followers instead; there the join key holds the bucket of the
follower's number. Either way a group of any size spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlink.functions import keys
from contactlink.operators import neighbours, tiles
from contactlink.operators.rules import Rule, RuleSet
from contactlink.operators.skew import SLICE_BITS, with_followers, with_last_before, with_position
from contactlink.operators.storage import materialize

#: Rows up to which a block is joined with itself, and up to which it is searched in one task.
DIRECT_ROWS, BLOCK_ROWS = 128, 8192
LOOK_AHEAD = 32
#: Tiles in a slice of a group.
SLICE_TILES = 2
#: Rows that a round of tiles may copy, and how much further than all rounds before it a round may reach.
ROUND_ROWS, REACH = 1 << 24, 4
GROWTH = 8
BUCKET_ROWS = 1024


def match_columns(
    df: DataFrame, rules: RuleSet, order: str, block: Column, given_key: str | None = None, extra: list[Column] | None = None
) -> DataFrame:
    """The narrow table that matching shuffles: order, block key, comparison columns; of a standardised table."""
    given = [F.nullif(F.col(f"`{given_key}`"), F.lit("")).alias("given_key")] if given_key else []
    return df.select(
        F.col(order).cast("long").alias("ord"),
        block.alias("block_key"),
        *given,
        *(extra or []),
        *(c.alias(name) for name, c in rules.record_columns(df, standardised=True).items()),
    )


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _not_met(records: DataFrame) -> Column:
    """The pair shares no key of an earlier blocking, where it is compared already; see ``by_block``.

    The bounds by copies stay exact: the pair of a record and its copy has its verdict in one table or another.
    """
    shared = [F.coalesce(F.col(f"l_{c}") == F.col(f"r_{c}"), F.lit(False)) for c in records.columns if c.startswith(tiles.MET)]
    return ~_any(shared)


def _verdicts(pairs: DataFrame, rules: RuleSet, ranked: list[tuple[int, Rule]]) -> DataFrame:
    """Matched pairs with the rank of their best rule and its scores."""
    used = [rule for _, rule in ranked]
    with_sims = rules.with_similarities(pairs, used, "l_", "r_")
    rank = F.lit(None).cast("int")
    for place, rule in reversed(ranked):
        rank = F.when(rules.matches(rule, "l_", "r_"), place).otherwise(rank)
    matched = with_sims.withColumn("rule_rank", rank).filter(F.col("rule_rank").isNotNull())
    per_rule = {place: rules.scores(rule, "l_", "r_") for place, rule in ranked}
    scores = []
    for i, name in enumerate(rules.score_fields):
        score = F.lit(None).cast("double")
        for place, by_field in per_rule.items():
            if name in by_field:
                score = F.when(F.col("rule_rank") == place, by_field[name]).otherwise(score)
        scores.append(score.alias(f"score_{i}"))
    given = [F.col("r_given_key").alias("match_given_key")] if "r_given_key" in matched.columns else []
    return matched.select(
        F.col("l_ord").alias("ord"), "rule_rank", F.col("r_ord").alias("match_ord"), *given, *scores
    )


def _first_per_record(matched: DataFrame) -> DataFrame:
    """One row per record: best rule, then earliest partner."""
    rest = [c for c in matched.columns if c != "ord"]
    return matched.groupBy("ord").agg(F.min(F.struct(*rest)).alias("best")).select("ord", "best.*")


def _direct_pairs(records: DataFrame, rules: RuleSet, labelled: bool) -> DataFrame:
    """Matched pairs inside blocks of bounded size."""
    ranked = list(enumerate(rules.rules))
    left, right = _side(records, "l_"), _side(records, "r_")
    on = (F.col("l_block_key") == F.col("r_block_key")) & (F.col("r_ord") > F.col("l_ord"))
    if labelled:
        on = on & (F.col("l_label") != F.col("r_label"))
    on = on & _not_met(records)
    possible = _any([rules.eligible(r, "l_") & rules.eligible(r, "r_") & rules.possible(r, "l_", "r_") for r in rules.rules])
    return _verdicts(left.join(right, on & possible), rules, ranked)


def _placed(able: DataFrame, on: list[str], rules: RuleSet, rule: Rule, bits: int) -> DataFrame:
    """Records of the rule with their place in the group, the places of their nearest
    copies, and ``first``/``last``: how far a search from here needs to go."""
    placed = with_position(able, on, "ord", bits).withColumn("profile", rules.profile(rule))
    same = [*on, "profile"]
    placed = with_followers(placed, same, "pos", bits).drop("n_later", "last_later").withColumnRenamed("next_later", "next_copy")
    placed = with_last_before(placed, same, "pos", "pos", "last_copy", bits).drop("profile")
    copies = rules.accepts_copy(rule)
    placed = placed.withColumns(rules.bag_columns(rule))
    return placed.withColumns(
        {
            "first": F.when(copies, F.coalesce("last_copy", F.lit(0))).otherwise(0),
            "last": F.when(copies, F.coalesce("next_copy", F.col("n") - 1)).otherwise(F.col("n") - 1),
        }
    )


def _look(
    todo: DataFrame, everyone: DataFrame, on: list[str], rules: RuleSet, place: int, rule: Rule,
    start: int, width: int, backward: bool,
) -> DataFrame:
    """First partner among the neighbours ``start+1 .. start+width`` places away."""
    rows = min(width, BUCKET_ROWS)
    if backward:
        low = F.greatest(F.col("pos") - start - width, F.col("first"))
        high = F.col("pos") - start - 1
    else:
        low = F.col("pos") + start + 1
        high = F.least(F.col("pos") + start + width, F.col("last"))
    buckets = F.sequence(F.floor(low / rows), F.floor(high / rows))
    left = _side(
        todo.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("bucket", F.explode(buckets)), "l_"
    )
    right = _side(everyone.withColumn("bucket", F.floor(F.col("pos") / rows)), "r_")
    test = F.col("r_pos").between(F.col("l_low"), F.col("l_high")) & _not_met(todo) & rules.possible(rule, "l_", "r_", bags=True)
    for c in ["bucket", *on]:
        test = test & (F.col(f"l_{c}") == F.col(f"r_{c}"))
    if "label" in todo.columns:
        test = test & (F.col("l_label") != F.col("r_label"))
    else:
        # An earlier copy after the record itself has had the same verdict.
        test = test & (F.coalesce("r_last_copy", F.lit(-1)) <= F.col("l_pos"))
    return _first_per_record(_verdicts(left.join(right, test), rules, [(place, rule)]))


def _by_tiles(
    todo: DataFrame, everyone: DataFrame, on: list[str], rules: RuleSet, place: int, rule: Rule, start: int, backward: bool, tile_rows: int,
    bits: int = SLICE_BITS,
) -> DataFrame:
    """First partner among all neighbours more than ``start`` places away.

    Records that search are packed into tiles of their own, however far apart they are, and meet the tiles of their group in
    rounds, near ones first; a record with a partner takes no part in the next. A round reaches ``REACH`` times as far as those
    before it, unless its copies of rows would pass ``ROUND_ROWS``, or twice the rows there are, so disk does not grow with
    the square of a group.
    """
    parts, begin = [], start
    total = everyone.count()
    searching = materialize(tiles.packed(todo, on, tile_rows, bits), "todo")
    while True:
        ends = searching.groupBy(*on, "mine").agg(F.count(F.lit(1)).alias("rows"), (F.max("pos") - F.min("pos")).alias("span"))
        n_tiles, rows, span = ends.agg(F.count(F.lit(1)), F.sum("rows"), F.sum("span")).first()
        if not n_tiles:
            break
        room = max(ROUND_ROWS, 2 * total) - span - n_tiles * tile_rows
        reach = tile_rows * max(1, min(room // (n_tiles + rows // tile_rows + 1), REACH * begin) // tile_rows)
        parts.append(materialize(tiles.search(searching, everyone, on, rules, rule, begin, backward, tile_rows, reach), "tiles"))
        begin += reach
        left_over = F.col("pos") - F.col("first") if backward else F.col("last") - F.col("pos")
        rest = searching.join(parts[-1].select("ord"), "ord", "left_anti").filter(left_over > begin)
        searching = materialize(tiles.packed(rest, on, tile_rows, bits), "todo")
    found = reduce(DataFrame.unionByName, parts) if parts else todo.select("ord", F.col("ord").alias("match_ord")).limit(0)
    left = _side(todo.join(found, "ord"), "l_")
    pairs = left.join(_side(everyone, "r_"), F.col("l_match_ord") == F.col("r_ord"))
    return _first_per_record(_verdicts(pairs, rules, [(place, rule)]))


def _by_looks(
    rows: DataFrame, earlier: list[DataFrame], on: list[str], rules: RuleSet, place: int, rule: Rule, look_ahead: int, bits: int, backward: bool
) -> list[DataFrame]:
    """Best matches under a rule that counts edits, by longer and longer looks."""
    found: list[DataFrame] = []
    everyone = materialize(_placed(rows, on, rules, rule, bits), "placed")
    todo = everyone
    for part in earlier:
        todo = todo.join(part.select("ord"), "ord", "left_anti")
    start, width = 0, look_ahead
    while True:
        hits = materialize(_look(todo, everyone, on, rules, place, rule, start, width, backward), "hits")
        found.append(hits)
        start, width = start + width, width * GROWTH
        left_over = F.col("pos") - F.col("first") if backward else F.col("last") - F.col("pos")
        todo = materialize(todo.join(hits.select("ord"), "ord", "left_anti").filter(left_over > start), "todo")
        if todo.isEmpty():
            return found


def _search(
    rows: DataFrame, rules: RuleSet, look_ahead: int, bits: int, backward: bool = False, tile_rows: int = tiles.TILE_ROWS
) -> list[DataFrame]:
    """Best matches inside oversized blocks, rule by rule: slices of each group with the next ones, then the rest by tiles."""
    found: list[DataFrame] = []
    for place, rule in enumerate(rules.rules):
        on = ["block_key", *rules.equal_columns(rule)]
        able = rows.filter(rules.eligible(rule))
        if any(rules.by_edits(c) for c in rule.conditions):
            found += _by_looks(able, found, on, rules, place, rule, look_ahead, bits, backward)
            continue
        placed = with_position(able, on, "ord", bits).withColumns({"first": F.lit(0).cast("long"), "last": F.col("n") - 1}).drop("n")
        wanted = F.lit(True)
        if found:
            done = reduce(DataFrame.unionByName, (part.select("ord") for part in found)).withColumn("_done", F.lit(True))
            placed, wanted = placed.join(done, "ord", "left"), F.col("_done").isNull()
        everyone = materialize(placed.withColumn("wanted", wanted).drop("_done"), "placed")
        width = SLICE_TILES * tile_rows
        hits = materialize(_first_per_record(neighbours.sliced_partners(everyone, on, rules, place, width, backward)), "hits")
        found.append(hits)
        left_over = F.col("pos") - F.col("first") if backward else F.col("last") - F.col("pos")
        todo = everyone.filter("wanted").filter(left_over > width).drop("wanted").join(hits.select("ord"), "ord", "left_anti")
        todo = materialize(todo, "todo")
        if not todo.isEmpty():
            found.append(materialize(_by_tiles(todo, everyone.drop("wanted"), on, rules, place, rule, width, backward, tile_rows, bits), "hits"))
    return found


def _split(records: DataFrame, direct_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Records of bounded blocks, and those of larger ones if there are any."""
    large = materialize(
        records.groupBy("block_key").count().filter(F.col("count") > direct_rows).select("block_key"), "large-blocks"
    )
    if large.isEmpty():
        return records, None
    rest = materialize(records.join(large, "block_key", "left_semi"), "large-rows")
    return records.join(large, "block_key", "left_anti"), rest


def best_match(
    records: DataFrame,
    rules: RuleSet,
    direct_rows: int | None = None,
    look_ahead: int = LOOK_AHEAD,
    slice_bits: int = SLICE_BITS,
    tile_rows: int = tiles.TILE_ROWS,
) -> DataFrame:
    """``ord, rule_rank, match_ord, [match_given_key], score_0..`` for records with a match."""
    able = records.filter(F.col("block_key").isNotNull() & rules.any_eligible())
    small, large = _split(able, direct_rows or (DIRECT_ROWS if _counts_edits(rules) else BLOCK_ROWS))
    if _counts_edits(rules):
        best = _first_per_record(_direct_pairs(small, rules, labelled=False))
    else:
        best = _first_per_record(neighbours.first_partners(small, rules))
    if large is not None:
        for part in _search(large, rules, look_ahead, slice_bits, tile_rows=tile_rows):
            best = best.unionByName(part)
    return best


def linking_edges(
    records: DataFrame,
    rules: RuleSet,
    direct_rows: int | None = None,
    look_ahead: int = LOOK_AHEAD,
    slice_bits: int = SLICE_BITS,
    tile_rows: int = tiles.TILE_ROWS,
) -> tuple[DataFrame, bool]:
    """``src, dst``, and whether these join all that is linked. Blocks that fit a task are joined whole there. In larger ones,
    and where rules count edits, a record has one partner before and one after it, where it has any with another ``label``.
    At most two edges per record, however large the block."""
    able = records.filter(F.col("block_key").isNotNull() & rules.any_eligible())
    edits = _counts_edits(rules)
    limit = direct_rows or (DIRECT_ROWS if edits else BLOCK_ROWS)
    blocks = able.groupBy("block_key").agg(F.count(F.lit(1)).alias("rows"), (F.min("label") != F.max("label")).alias("mixed"))
    small = able.join(blocks.filter("mixed").select("block_key"), "block_key", "left_semi") if edits else able
    large = materialize(blocks.filter(F.col("rows") > limit).select("block_key", "mixed"), "large-blocks")
    rest = None
    if not large.isEmpty():
        small = small.join(large, "block_key", "left_anti")
        rest = materialize(able.join(large.filter("mixed"), "block_key", "left_semi"), "large-rows")
        rest = None if rest.isEmpty() else rest
    edges = _direct_edges(small, rules) if edits else neighbours.linking_partners(small, rules)
    if rest is not None:
        for backward in (False, True):
            for part in _search(rest, rules, look_ahead, slice_bits, backward, tile_rows):
                edges = edges.unionByName(part.select(F.col("ord").alias("src"), F.col("match_ord").alias("dst")))
    return edges, not edits and rest is None


def _counts_edits(rules: RuleSet) -> bool:
    return any(rules.by_edits(c, s) for r in rules.rules for c in r.conditions for s in (False, True))


def _direct_edges(records: DataFrame, rules: RuleSet) -> DataFrame:
    pairs = _direct_pairs(records, rules, labelled=True).select("ord", "match_ord")
    ends = pairs.select(
        F.explode(F.array(F.struct("ord", F.col("match_ord").alias("other")), F.struct(F.col("match_ord").alias("ord"), F.col("ord").alias("other")))).alias("e")
    ).select("e.*")
    edges = ends.groupBy("ord").agg(F.min("other").alias("a"), F.max("other").alias("b"))
    return edges.select(F.col("ord").alias("src"), F.explode(F.array_distinct(F.array("a", "b"))).alias("dst"))


def block_columns(df: DataFrame, blocks: list[Callable[[DataFrame], Column]]) -> list[Column]:
    """The keys under further blockings, as columns that the narrow table carries besides ``block_key``."""
    return [block(df).alias(f"_block_{i}") for i, block in enumerate(blocks[1:], 1)]


def by_block(narrow: DataFrame, n: int) -> list[DataFrame]:
    """The narrow table once for each of ``n`` blockings; all read the same written table.

    A table carries the keys of the blockings before its own, and a pair is compared in the first one where it shares
    a key, so a pair with several keys in common is compared once.
    """
    blocks = ["block_key", *(f"_block_{i}" for i in range(1, n))]
    rest = [c for c in narrow.columns if c not in blocks]
    return [
        narrow.select(*rest, F.col(key).alias("block_key"), *(F.col(c).alias(f"{tiles.MET}{j}") for j, c in enumerate(blocks[:i])))
        for i, key in enumerate(blocks)
    ]


def best_of_blocks(tables: list[DataFrame]) -> DataFrame:
    """Best match over several block keys: the best of the bests, no pair is repeated."""
    if len(tables) == 1:
        return tables[0]
    return _first_per_record(reduce(DataFrame.unionByName, tables))


def named_matches(best: DataFrame, rules: RuleSet) -> DataFrame:
    """Replace the rule's rank by its id and reason, and number columns by score names."""
    if not rules.rules:
        named = best.withColumns({"rule_id": F.lit(None).cast("string"), "match_reason": F.lit(None).cast("string")})
    else:
        at = F.col("rule_rank") + 1
        named = best.withColumns(
            {
                "rule_id": F.element_at(F.array(*(F.lit(r.id) for r in rules.rules)), at),
                "match_reason": F.element_at(F.array(*(F.lit(r.match_reason) for r in rules.rules)), at),
            }
        )
    names = {f"score_{i}": score_name(f) for i, f in enumerate(rules.score_fields)}
    return named.withColumnsRenamed(names).drop("rule_rank")


def score_name(field: str) -> str:
    return f"{field.lower()}_score"


def record_block_key(df: DataFrame) -> Column:
    """Block key of a standardised record."""
    return keys.block_key(F.col("COMPANY_NAME_STD"), keys.field(df, "ZIP_CODE"), F.col("PHONE_STD"))
