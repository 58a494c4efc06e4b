"""Result validation: rules over rows give violations, and split the rows into clean and quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import PENT

#: Bounds of what a result may hold.
MEAN_LOW, MEAN_HIGH, MAX_SCORE, MAX_EQUITY, MAX_TURN, MAX_PLAY, MAX_POSITION = -100.0, 3000.0, 100_000, 200_000.0, 400, 256, 4096
MAX_MOVES_PER_MS, MAX_INFERENCES, RACK_TILES, MAX_MEAN_EQUITY, MAX_OCCURRENCES = 1_000_000, 10, 7, 5000.0, 1000


def c(name: str) -> Column:
    return F.col(name)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every rule that a row breaks; a rule is a condition that must not hold."""
    broken = F.array_compact(F.array(*(F.when(condition, F.lit(rule)) for rule, condition in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def quarantined(rows: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and the others."""
    bad = found.select(key).distinct()
    return rows.join(bad, key, "left_anti"), rows.join(bad, key, "left_semi")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def aggregate_rules() -> dict[str, Column]:
    """Tallies: what they sum to, their signs and the range of means."""
    return {
        "tally_sum": c("wins") + c("losses") + c("ties") != c("games"),
        "tally_negative": F.least("games", "wins", "losses", "ties") < 0,
        "mean_range": ~finite(c("p1_score_mean")) | ~finite(c("p2_score_mean")) | ~c("p1_score_mean").between(MEAN_LOW, MEAN_HIGH) | ~c("p2_score_mean").between(MEAN_LOW, MEAN_HIGH),
    }


def pentanomial_rules() -> dict[str, Column]:
    """Pairs: their number, the range of the five counts, half-points, and draws that fit the counts."""
    pairs = sum((c(x) for x in PENT[1:]), c(PENT[0]))
    odd = c("pent_1") + c("pent_3")
    return {
        "pent_games": pairs * 2 != c("games"),
        "pent_range": (F.least(*PENT) < 0) | (F.greatest(*PENT) > c("games")),
        "pent_half_points": sum((c(x) * i for i, x in enumerate(PENT)), F.lit(0)) != 2 * c("wins") + c("ties"),
        # a pair of 1 or 3 half-points holds one draw; one of 2 holds none or two
        "pent_draws": (c("ties") < odd) | ((c("ties") - odd) % 2 != 0) | (c("ties") > odd + 2 * c("pent_2")),
    }


def divergent_rules() -> dict[str, Column]:
    """Divergent games as a part of all: no count exceeds, and what is left is even."""
    same = c("games") - c("divergent_games")
    return {
        "divergent_exceeds": (c("divergent_games") > c("games")) | (c("divergent_wins") > c("wins")) | (c("divergent_losses") > c("losses")) | (c("divergent_ties") > c("ties")),
        "divergent_rest": (c("wins") - c("divergent_wins") != c("losses") - c("divergent_losses")) | ((c("ties") - c("divergent_ties")) % 2 != 0),
        "divergent_unsplit": c("pent_2") - same / 2 > c("divergent_games") / 2,
    }


def validate_results(results: DataFrame) -> DataFrame:
    """All violations of a results table."""
    return violations(results, "result_id", aggregate_rules() | pentanomial_rules() | divergent_rules())


def validate_positions(positions: DataFrame, games: int) -> DataFrame:
    """Positions: one for each game and turn, indexes in range, a player of two, a move at least."""
    same = F.count("*").over(W.partitionBy("task", "game_index", "turn"))
    rules = {
        "position_repeated": c("same") > 1,
        "game_range": ~c("game_index").between(0, games - 1),
        "turn_range": ~c("turn").between(0, MAX_TURN),
        "player": ~c("player").isin(1, 2),
        "no_moves": c("num_moves") < 1,
    }
    return violations(positions.withColumn("same", same), "record_id", rules)


def registered(found: dict[str, DataFrame]) -> DataFrame:
    """(table, key, rule): what the validators of unlike tables have found, as one table; a validator's first column is its key."""
    out = None
    for name, df in found.items():
        rows = df.select(F.lit(name).alias("table"), F.col(df.columns[0]).cast("string").alias("key"), "rule")
        out = rows if out is None else out.unionByName(rows)
    return out


def split(rows: DataFrame, key: Column, table: str, registry: DataFrame) -> DataFrame:
    """The rows of a table with `rules`: the sorted rules that each breaks, by the registry; none for clean rows."""
    broken = registry.filter(F.col("table") == table).groupBy("key").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    keyed = rows.withColumn("key", key.cast("string")).join(broken, "key", "left").drop("key")
    return keyed.withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))


def validate_boards(positions: DataFrame, batches: DataFrame) -> DataFrame:
    """Batches of pairs (task, pairs) against the first divergences that they keep: one of each divergent pair, whose two positions have one board.

    positions: task, game_index, position; the board is a position's first field.
    """
    board = F.substring_index("position", " ", 1)
    pairs = positions.groupBy("task", F.floor(c("game_index") / 2).cast("long").alias("pair")).agg(F.min(board).alias("b0"), F.max(board).alias("b1"))
    kept = pairs.groupBy("task").agg(F.count("*").alias("kept"), F.count_if(c("b0") != c("b1")).alias("unlike"))
    rows = batches.join(kept, "task", "left").fillna(0, ["kept", "unlike"])
    return violations(rows, "task", {"divergent_count": c("kept") != c("pairs"), "boards_differ": c("unlike") > 0})


def validate_pairings(jobs: DataFrame, configs: DataFrame) -> DataFrame:
    """Jobs whose two unlike players have unlike win models; a player without one goes with any. configs: config, model."""
    rows = jobs.select("job_id", "p1", "p2")
    for p in ("p1", "p2"):
        rows = rows.join(configs.select(c("config").alias(p), c("model").alias(f"{p}_model")), p, "left")
    return violations(rows, "job_id", {"win_models_differ": (c("p1") != c("p2")) & (c("p1_model") != c("p2_model"))})


def validate_divergences(positions: DataFrame) -> DataFrame:
    """Pairs of games whose first divergence isn't two positions, one per game, with one turn and one rack."""
    pairs = positions.groupBy("task", F.floor(c("game_index") / 2).cast("long").alias("pair")).agg(
        F.count("*").alias("n"), F.count_distinct("game_index").alias("games"), F.min("turn").alias("t0"), F.max("turn").alias("t1"), F.min("rack").alias("r0"), F.max("rack").alias("r1")
    )
    return violations(pairs.withColumn("id", F.concat_ws(":", "task", "pair")), "id", {"not_two": c("n") != 2, "not_one_each": c("games") != 2, "turns_differ": c("t0") != c("t1"), "racks_differ": c("r0") != c("r1")})


def validate_moves(moves: DataFrame) -> DataFrame:
    """Moves by record and rank: scores, equity, percentage and utility in range, texts short and without NUL."""
    rules = {
        "score_range": ~c("score").between(0, MAX_SCORE),
        "play_text": (F.length("move") > MAX_PLAY) | F.contains("move", F.lit("\0")),
        "rank": c("rank") < 1,
        "equity_range": ~finite(c("equity")) | (F.abs("equity") > MAX_EQUITY),
        "win_range": ~c("win_percentage").between(0, 100),
        "utility": ~c("blended_utility").between(0, 1),
    }
    return violations(moves.withColumn("id", F.concat_ws(":", "record_id", "rank")), "id", rules)


def validate_records(records: DataFrame) -> DataFrame:
    """Records (record_id, num_moves, listed, position, rack, previous_move): no more moves listed than there are, texts short and without NUL."""
    texts = ("position", "rack", "previous_move")
    rules = {
        "listed": c("listed") > c("num_moves"),
        "position_length": F.length("position") > MAX_POSITION,
        "play_length": F.greatest(F.length("rack"), F.length("previous_move")) > MAX_PLAY,
        "nul": F.coalesce(F.contains(F.concat_ws("", *texts), F.lit("\0")), F.lit(False)),
    }
    return violations(records, "record_id", rules)


def validate_deviations(results: DataFrame) -> DataFrame:
    """Deviations of scores: finite and not negative; none where there is one game."""
    both = F.least("p1_score_sd", "p2_score_sd"), F.greatest("p1_score_sd", "p2_score_sd")
    return violations(results, "result_id", {"sd_range": (both[0] < 0) | ~finite(both[0]) | ~finite(both[1]), "sd_of_one": (c("games") <= 1) & (both[1] > 0)})


#: Which fields an analysis of each kind carries (win percentage, utility, iterations).
KINDS = {"static": (False, False, False), "sim": (True, True, True), "peg": (True, True, False), "endgame": (False, False, False)}


def validate_kinds(analyses: DataFrame) -> DataFrame:
    """Analyses whose fields don't go with their kind."""
    fields = ("win_percentage", "blended_utility", "iterations")
    expected = {f: F.when(F.lit(False), False) for f in fields}
    for kind, carried in KINDS.items():
        for f, has in zip(fields, carried):
            expected[f] = expected[f].when(c("analysis") == kind, F.lit(has))
    return violations(analyses, "record_id", {"unknown_kind": ~c("analysis").isin(*KINDS)} | {f"{f}_carried": c(f).isNotNull() != expected[f] for f in fields})


def validate_settings(analyses: DataFrame, configs: DataFrame) -> DataFrame:
    """Analyses that their player's settings can't make: simulations, solved endgames, inferences, plies beyond the limit."""
    rows = analyses.join(configs, "config", "left")
    rules = {
        "unknown_player": c("can_simulate").isNull(),
        "cannot_simulate": (c("analysis") == "sim") & ~c("can_simulate"),
        "cannot_solve": (c("analysis") == "endgame") & ~c("can_solve"),
        "cannot_infer": c("has_inference") & ~c("can_infer"),
        "too_deep": c("plies") > c("max_plies"),
    }
    return violations(rows, "record_id", rules)


def validate_inference(records: DataFrame) -> DataFrame:
    """Inferences: ten leaves at most, draws falling and within the total, fewer tiles than a rack."""
    draws = F.transform("leaves", lambda x: x["draws"])
    falling = F.forall(F.zip_with(draws, F.slice(draws, 2, MAX_INFERENCES + 1), lambda a, b: b.isNull() | (a >= b)), lambda x: x)
    rules = {
        "too_many": F.size("leaves") > MAX_INFERENCES,
        "not_sorted": ~falling,
        "above_total": F.aggregate(draws, F.lit(0).cast("long"), lambda a, b: a + b) > c("total_draws"),
        "tiles": F.exists("leaves", lambda x: F.coalesce(tile_count(x["leave"]), F.lit(RACK_TILES)) >= RACK_TILES),
    }
    return violations(records, "record_id", rules)


def validate_plies(moves: DataFrame) -> DataFrame:
    """Plies ascend from 0 or more, percentages and scores are in range."""
    numbers = F.transform("plies", lambda p: p["ply"])
    rising = F.forall(F.zip_with(numbers, F.slice(numbers, 2, 1 << 20), lambda a, b: b.isNull() | (a < b)), lambda x: x)
    rules = {
        "ply_order": ~rising | (F.coalesce(F.get(numbers, F.lit(0)), F.lit(0)) < 0),
        "bingo_range": F.exists("plies", lambda p: ~p["bingo_percentage"].between(0, 100)),
        "score_range": F.exists("plies", lambda p: ~p["average_score"].between(-MAX_SCORE, MAX_SCORE)),
    }
    return violations(moves, "move_id", rules)


def tile_count(rack: Column) -> Column:
    """Tiles of a rack, with bracketed tiles of several letters; null if it is malformed."""
    tiles = F.regexp_extract_all(rack, F.lit(r"(\[[^\[\]]{1,8}\]|[^\[\]])"), F.lit(1))
    return F.when(F.array_join(tiles, "") == rack, F.size(tiles))


def validate_occurrences(rows: DataFrame, games: int) -> DataFrame:
    """Rack occurrences of a batch (batch, rack, count, mean): full racks, positive counts, no repeats, a bounded total."""
    batch = W.partitionBy("batch")
    rows = rows.withColumns({"same": F.count("*").over(W.partitionBy("batch", "rack")), "total": F.sum("count").over(batch)})
    rules = {
        "tiles": F.coalesce(tile_count(c("rack")), F.lit(0)) != RACK_TILES,
        "count": c("count") < 1,
        "mean": ~finite(c("mean")) | (F.abs("mean") > MAX_MEAN_EQUITY),
        "repeated": c("same") > 1,
        "total": c("total") > MAX_OCCURRENCES * games,
    }
    return violations(rows.withColumn("id", F.concat_ws(":", "batch", "rack")), "id", rules)


def validate_keys(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """Answered keys (id, keys) against the dispatched ones: as many, all of them, none twice."""
    rows = answers.join(requests.select("id", c("keys").alias("sent")), "id", "left")
    rules = {
        "unknown_request": c("sent").isNull(),
        "key_count": F.size("keys") != F.size("sent"),
        "key_unknown": F.size(F.array_except("keys", "sent")) > 0,
        "key_repeated": F.size(F.array_distinct("keys")) != F.size("keys"),
    }
    return violations(rows, "id", rules)


def validate_reissues(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answers (id, move) of a task that was issued again may name only moves that were sent with it (id, move)."""
    sent = candidates.select("id", "move", F.lit(True).alias("sent")).distinct()
    return violations(answers.join(sent, ["id", "move"], "left"), "id", {"not_a_candidate": c("sent").isNull()})


def validate_batches(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Batch sizes against the dispatched ones, twice as many games for pairs."""
    rows = results.join(requests.select("result_id", "dispatched", "paired"), "result_id", "left")
    return violations(rows, "result_id", {"batch_size": c("games") != c("dispatched") * F.when(c("paired"), 2).otherwise(1)})


def validate_claims(claims: DataFrame) -> DataFrame:
    """Moves generated within what the time allows, and counters that aren't negative."""
    return violations(claims, "claim_id", {"throughput": c("movegens") > MAX_MOVES_PER_MS * F.greatest(c("held_ms"), F.lit(1)), "negative": F.least("movegens", "held_ms") < 0})


def validate_staging(staged: DataFrame) -> DataFrame:
    """Parallel arrays of one length."""
    return violations(staged, "submission", {"array_lengths": (F.size("rack") != F.size("n")) | (F.size("n") != F.size("equity_cents"))})


def validate_distribution(rows: DataFrame) -> DataFrame:
    """Letter distributions (file, letter, count, score, is_vowel, columns): counts and flags in range, 50 letters, none twice, 5 or 7 columns."""
    rows = rows.withColumns({"same": F.count("*").over(W.partitionBy("file", "letter")), "letters": F.count("*").over(W.partitionBy("file"))})
    rules = {"count": ~c("count").between(0, 255), "vowel": ~c("is_vowel").isin(0, 1), "letters": c("letters") > 50, "repeated": c("same") > 1, "columns": ~c("columns").isin(5, 7)}
    return violations(rows.withColumn("id", F.concat_ws(":", "file", "letter")), "id", rules)


#: Languages by the start of a lexicon's name (leaves are named after their lexicon), and of a distribution's.
LEXICONS = {
    "english": ("CSW", "NWL", "OSPD", "OSW", "TWL", "America", "CEL"),
    "german": ("RD",),
    "norwegian": ("NSF",),
    "catalan": ("DISC",),
    "french": ("FRA",),
    "polish": ("OSPS",),
    "dutch": ("DSW",),
}
DISTRIBUTIONS = {x: (x,) for x in ("english", "german", "norwegian", "catalan", "polish", "dutch", "french")}


def language_of(name: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The language of a file's base name, in any case; null if no start is known."""
    base = F.lower(F.substring_index(name, "/", -1))
    out = F.when(F.lit(False), F.lit(""))
    for language, starts in table.items():
        for start in starts:
            out = out.when(base.startswith(start.lower()), language)
    return out


def unlike(a: Column, b: Column) -> Column:
    """Whether two languages differ or one is unknown."""
    return F.coalesce(a != b, F.lit(True))


def validate_configs(configs: DataFrame) -> DataFrame:
    """One player's files (config, lexicon, leaves, distribution): leaves and distribution of the lexicon's language; unknown names go with nothing."""
    lexicon, leaves = (language_of(c(x), LEXICONS) for x in ("lexicon", "leaves"))
    return violations(configs, "config", {"leaves": unlike(lexicon, leaves), "distribution": unlike(lexicon, language_of(c("distribution"), DISTRIBUTIONS))})


def validate_job_files(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Both players' files of a job (p1_lexicon, p1_leaves, p2_lexicon, p2_leaves, distribution): each by itself, and one language for both."""
    lexicon, leaves = ([language_of(c(f"{p}_{x}"), LEXICONS) for p in ("p1", "p2")] for x in ("lexicon", "leaves"))
    board = language_of(c("distribution"), DISTRIBUTIONS)
    rules = {}
    for i, p in enumerate(("p1", "p2")):
        rules |= {f"{p}_leaves": unlike(lexicon[i], leaves[i]), f"{p}_distribution": unlike(lexicon[i], board)}
    return violations(jobs, key, rules | {"lexicons_differ": unlike(*lexicon), "leaves_differ": unlike(*leaves)})


def name_conflicts(files: DataFrame) -> DataFrame:
    """Names that stand for more than one content."""
    return files.groupBy("path").agg(F.count_distinct("sha256").alias("contents")).filter("contents > 1")


def check_restore(claims: DataFrame, jobs: DataFrame, counters: DataFrame) -> DataFrame:
    """Counts that are zero in a sound copy: claims without a job, counters that differ from facts, completed claims without an end."""
    orphans = claims.join(jobs.select("job_id"), "job_id", "left_anti").agg(F.count("*").alias("n"))
    facts = claims.groupBy("job_id").agg(F.count_if(c("state") == "completed").alias("facts"))
    differ = counters.join(facts, "job_id", "full").filter(~F.coalesce("completed", F.lit(0)).eqNullSafe(F.coalesce("facts", F.lit(0)))).agg(F.count("*").alias("n"))
    endless = claims.filter("state = 'completed' and completed_at is null").agg(F.count("*").alias("n"))
    checks = (("orphan_claims", orphans), ("counter_differences", differ), ("endless_claims", endless))
    out = None
    for name, df in checks:
        row = df.select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out
