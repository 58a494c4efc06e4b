"""Result messages: JSON with a fixed schema, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TALLY = "games int, wins int, losses int, ties int, p1_score_mean double, p1_score_sd double, p2_score_mean double, p2_score_sd double"
_MOVE = "move string, score int, equity double, iterations bigint, win_percentage double, blended_utility double, mean_spread double, fidelity_plies smallint, plies array<struct<ply smallint, bingo_percentage double, average_score double>>"
_INFERENCE = "num_leaves bigint, total_draws bigint, average_equity double, leaves array<struct<leave string, draws bigint, equity double>>"
_POSITION = f"game_index smallint, turn_number smallint, player smallint, rack string, position string, previous_move string, previous_move_score int, played_move string, played_move_score int, num_moves int, analysis string, moves array<struct<{_MOVE}>>, inference struct<{_INFERENCE}>"
#: Fixed formats: what the messages of each kind hold.
SCHEMAS = {
    "games": f"claim_token string, movegens bigint, derived_skipped array<string>, result struct<all_games struct<{_TALLY}>, pentanomial array<bigint>, divergent_games struct<{_TALLY}>, positions array<struct<{_POSITION}>>>",
    "opening_rack": f"claim_token string, movegens bigint, derived_skipped array<string>, result struct<racks array<struct<rack string, num_moves int, moves array<struct<{_MOVE}>>>>>",
    "leave_gen": "claim_token string, movegens bigint, derived_skipped array<string>, result struct<racks array<struct<rack string, count bigint, mean double>>>",
}


def read_messages(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """Message files of one kind; what doesn't fit the schema is null, and kept in _corrupt for the quarantine."""
    reader = (spark.readStream if stream else spark.read).schema(f"{SCHEMAS[kind]}, _corrupt string")
    return reader.option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parsed(message: Column, kind: str) -> Column:
    return F.from_json(message, SCHEMAS[kind])


def tallies(messages: DataFrame) -> DataFrame:
    """Flat tallies of games messages, one row each."""
    games = "result.all_games"
    pent = [F.get("result.pentanomial", F.lit(i)).alias(f"pent_{i}") for i in range(5)]
    return messages.select("claim_token", *(F.col(f"{games}.{c}").cast("long").alias(c) for c in ("games", "wins", "losses", "ties")), *pent, F.col(f"{games}.p1_score_mean").alias("p1_score_mean"), F.col(f"{games}.p2_score_mean").alias("p2_score_mean"))


def analyses(messages: DataFrame) -> DataFrame:
    """Rack messages as rows of moves: claim_token, rack, num_moves, rank (from 1), move, score, equity, plies."""
    racks = messages.select("claim_token", F.explode("result.racks").alias("r"))
    moves = racks.select("claim_token", "r.rack", "r.num_moves", F.posexplode("r.moves").alias("i", "m"))
    return moves.select("claim_token", "rack", "num_moves", (F.col("i") + 1).cast("long").alias("rank"), "m.move", "m.score", "m.equity", F.size(F.coalesce("m.plies", F.array())).alias("plies"))


def captured(messages: DataFrame) -> DataFrame:
    """Positions of games messages, one row each, with the leaves of their inference."""
    rows = messages.select("claim_token", F.explode("result.positions").alias("p"))
    return rows.select("claim_token", *(F.col(f"p.{c}").cast("long").alias(c) for c in ("game_index", "turn_number", "player")), "p.rack", F.size("p.moves").alias("moves"), "p.inference.total_draws", F.size(F.coalesce("p.inference.leaves", F.array())).alias("leaves"))


def leave_deltas(messages: DataFrame, generation: Column) -> DataFrame:
    """Leave messages as staged parallel arrays; a mean is worth count times itself, in hundredths."""
    racks = "result.racks"
    return messages.select(
        generation.alias("generation"), F.col("claim_token").alias("submission"), F.transform(racks, lambda r: r["rack"]).alias("rack"), F.transform(racks, lambda r: r["count"]).alias("n"),
        F.transform(racks, lambda r: F.round(r["count"] * r["mean"] * 100).cast("long")).alias("equity_cents"),
    )
